from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import neardup


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """Plain Jaccard similarity of 0.8 or more, pair by pair."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, x in enumerate(sets):
        for g in x:
            where[g].append(i)
    for i, x in enumerate(sets):
        for j in {j for g in x for j in where[g] if j < i}:
            if len(x & sets[j]) / len(x | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_no_link_is_lost_and_none_is_made_up(small):
    rows = small.collect()
    got = {r.doc_id: r for r in neardup.classes(small).collect()}
    want = components([r.text for r in rows])
    groups, classes = defaultdict(set), defaultdict(set)
    for r, root in zip(rows, want, strict=True):
        groups[root].add(r.doc_id)
        classes[got[r.doc_id].class_id].add(r.doc_id)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, groups.values()))
    for c in classes.values():
        assert {got[i].class_size for i in c} == {len(c)} and [i for i in c if got[i].kept] == [min(c)]


def test_a_large_group_of_edited_copies(spark):
    """Copies of one text with more and more words of their own: all that are near it are found, others not."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        own = list(base)
        for j in range(i % 12):
            own[17 * j % 200] = f"x{rng.integers(1e9)}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"y{rng.integers(1e9)}" for _ in range(50))) for i in range(30)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components([t for _, t in rows])
    near = {rows[i][0] for i, c in enumerate(want) if c == 0}
    assert {k for k, v in got.items() if v == 0} == near and len(near) > 40


def edited(words, places, mark):
    own = list(words)
    for j in places:
        own[j] = f"{mark}x{j}"
    return own


def grouped(spark, rows):
    """Classes found, and those of all pairs, as sets of ids."""
    groups, classes = defaultdict(set), defaultdict(set)
    for (i, _), root in zip(rows, components([t for _, t in rows]), strict=True):
        groups[root].add(i)
    for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        classes[r.class_id].add(r.doc_id)
    return sorted(map(sorted, classes.values())), sorted(map(sorted, groups.values()))


def test_a_large_group_without_a_central_text(spark):
    """Copies of one text that are too far from each other, each with a near copy of its own."""
    rng = np.random.default_rng(2)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(200):
        one = edited(base, rng.choice(200, 5, replace=False), f"a{i}")
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(edited(one, rng.choice(200, 4, replace=False), f"b{i}")))]
    rows += [(1000 + i, " ".join(f"y{rng.integers(1e9)}" for _ in range(50))) for i in range(400)]
    got, want = grouped(spark, rows)
    assert len(want) > 500 and got == want


def test_recall_just_above_the_threshold_inside_a_large_group(spark):
    """Pairs at a plain similarity from 0.80 to 0.85, whose texts are all below 0.8 to the others, among a third of all rows."""
    rng = np.random.default_rng(8)
    base, rows, pairs = [f"w{i}" for i in range(300)], [], []
    for i in range(250):
        one = edited(base, rng.choice(300, 14, replace=False), f"a{i}")
        two = edited(one, 20 + 40 * np.arange(6) + rng.integers(0, 30), f"b{i}")
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
        a, b = shingle_set(rows[-2][1]), shingle_set(rows[-1][1])
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            pairs.append((2 * i, 2 * i + 1))
    rows += [(1000 + i, " ".join(f"y{rng.integers(1e9)}" for _ in range(50))) for i in range(1000)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 150 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.95
    assert len(set(got.values())) > 1100


def test_chains_inside_a_large_group(spark):
    """Versions that are near the one before only: linked members of a bucket are partners of the others too."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows, own = [], base
    for i in range(400):
        own = edited(own if i % 100 else base, rng.choice(200, 3, replace=False), f"c{i}")
        rows.append((i, " ".join(own)))
    got, want = grouped(spark, rows)
    assert len(want) < 10 and got == want


def test_a_shingle_that_occurs_very_often_in_one_text(spark):
    rows = [(1, "word " * 70000), (2, "word " * 80000), (3, "word " * 95000)]
    assert grouped(spark, rows[:1] + [(9, "other words than those of the long ones")])[0] == [[1], [9]]
    rows += [(1000 + i, f"z{i} of the other texts") for i in range(700)]  # that it isn't frequent among texts
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[1], got[2], got[3]} == {1}


@pytest.mark.parametrize("table", ["awkward", "nothing", "clashing"])
def test_defined_cases(request, table):
    docs = request.getfixturevalue(table)
    rows = neardup.classes(docs).collect()
    assert len(rows) == docs.count()
    if rows:
        size = {r.doc_id: r.class_size for r in rows}
        assert size[1] == size[2] == size[3] == 1 and size[4] == size[5] == 3
        assert sum(r.kept for r in rows if r.doc_id in (4, 5)) == 1
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns
    assert sum(r.kept for r in rows) == kept.count()


def test_repeated_rows_and_copies_without_ids(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (None, "one two three four five six"), (3, "seven")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_size) for r in neardup.classes(docs).collect() if r.doc_id) == [(3, 1)]
    assert sorted(r.text for r in neardup.keep(docs).collect()) == ["one two three four five six", "seven"]


def test_samples_agree_as_weighted_jaccard():
    """The share of equal samples estimates the similarity of weights."""
    s = neardup.Settings(bands=64, rows=8)
    rng = np.random.default_rng(4)
    sh = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    a, b = sh[:240], sh[60:]
    wa, wb = rng.uniform(0.5, 3, len(a)).astype(np.float32), None
    wb = np.concatenate([wa[60:] * rng.choice([1, 2], 180), rng.uniform(0.5, 3, len(b) - 180)]).astype(np.float32)
    sig = neardup.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a)]), s)
    low, high = np.minimum(wa[60:], wb[:180]).sum(), wa[:60].sum() + np.maximum(wa[60:], wb[:180]).sum() + wb[180:].sum()
    assert abs((sig[0] == sig[1]).mean() - low / high) < 0.07


def test_frequencies_over_all_texts(small):
    s = neardup.Settings()
    own = neardup.named(small, "doc_id", "text")
    sketch, n = neardup.document_frequencies(own, s)
    assert n == small.count()
    sh, _, offsets = neardup.shingles(pa.array([r.text for r in small.collect()]), s)
    values, df = np.unique(sh, return_counts=True)
    slots = neardup.slots(values, s)
    assert (np.minimum(sketch[slots[0]], sketch[slots[1]]) >= df).all() and sketch.sum() == neardup.DEPTH * len(sh)


def test_components(spark):
    edges = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"x", b"y")] + [(bytes([50 + i]), bytes([51 + i])) for i in range(20)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in neardup.components(df).collect()}
    assert all(got[x] == b"a" for x in (b"a", b"b", b"c", b"d")) and got[b"y"] == b"x"
    assert {got[bytes([50 + i])] for i in range(21)} == {bytes([50])}
    assert neardup.components(df.where(F.lit(False))).count() == 0
