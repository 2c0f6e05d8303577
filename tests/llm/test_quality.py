from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def words_of(t):
    out, w = [], ""
    for c in t or "":
        if c in SPACE:
            out, w = out + [w] * bool(w), ""
        else:
            w += c
    return out + [w] * bool(w)


def brute(t):
    w = words_of(t)
    win = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + d for i in range(len(w) - 2) if win[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))


def check(rows):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)


@pytest.mark.parametrize("table", ["awkward", "small", "clashing"])
def test_statistics_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = {}
    for r in quality.statistics(docs).collect():
        got.setdefault(str(r.doc_id), []).append(tuple(r)[1:])
    want = {}
    for r in docs.collect():
        want.setdefault(str(r.doc_id), []).append(brute(r.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\té|", max_size=60), min_size=1, max_size=30))
def test_statistics_of_odd_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_windows_with_equal_parts_of_hashes_are_told_apart(spark, small, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 58)  # six bits of each hash are left
    rows = quality.statistics(small).join(small.select("doc_id", "text"), "doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [brute(r.text)[4] for r in rows]


def test_the_way_for_very_long_texts(spark, small, monkeypatch):
    monkeypatch.setattr(quality, "POSITION_BITS", 3)
    rows = quality.statistics(small).join(small.select("doc_id", "text"), "doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [brute(r.text)[4] for r in rows]


def test_learned_rules_find_planted_ones():
    rows = []
    for i in range(900):
        x = {f: float((i * 37 + k * 11) % 100) for k, f in enumerate(quality.FEATURES)}
        rows.append((x, (x["symbols_per_word"] > 80) != (i % 50 == 0)))
    rules = quality.cover(rows)
    assert rules and rules[0].conditions[0].feature == "symbols_per_word" and rules[0].conditions[0].above
    hit = [bad for x, bad in rows if any(r.covers(x) for r in rules)]
    assert sum(hit) / len(hit) > 0.9 and sum(hit) > 0.8 * sum(bad for _, bad in rows)
    assert quality.cover([]) == []


def test_the_expression_judges_as_the_rules(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality.learn(docs, labels)
    assert rules
    for r in quality.judge(small, rules).selectExpr("*", *[f"cast({e} AS double) AS {n}" for n, e in quality.FEATURES.items()]).collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and not any(x.covers(r.asDict()) for x in rules))


def test_main_path_is_native(small, spark):
    plan = quality.judge(small, [])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
    assert quality.judge(spark.createDataFrame([], small.schema), []).count() == 0
    assert quality.learn(small, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")) == []
