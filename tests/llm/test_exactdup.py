import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import exactdup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r["text"])].append(r["doc_id"])
    out = []
    for r in rows:
        own = groups[t := lowered(r["text"])]
        keep = max((x for x in own if x is not None), default=None)
        out.append((r["doc_id"], keep, len(own), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    k, data = exactdup.golomb_encode(v)
    assert (exactdup.golomb_decode(len(v), k, data) == v).all()


def test_golomb_is_compact():
    v = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2))
    assert len(exactdup.golomb_encode(v)[1]) * 8 / len(v) < np.log2(2**64 / len(v)) + 1.7


@pytest.mark.parametrize("table", ["awkward", "small", "nothing", "clashing"])
def test_decisions_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = exactdup.decisions(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(docs.collect())
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_small_owners_and_shuffled_suspects(small, monkeypatch):
    """Several owners and tasks' blocks, and no broadcast."""
    monkeypatch.setattr(exactdup, "OWNER_ROWS", 40)
    monkeypatch.setattr(exactdup, "members", lambda df, keys, on, n: df.join(keys, on, "left_semi"))
    monkeypatch.setattr(exactdup, "strangers", lambda df, keys, on, n: df.join(keys, on, "left_anti"))
    got = exactdup.decisions(small.repartition(7)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(small.collect())


@pytest.mark.parametrize("table", ["awkward", "nothing", "clashing"])
def test_keep_returns_one_whole_row_per_text(request, table):
    docs = request.getfixturevalue(table)
    got = exactdup.keep(docs)
    assert got.columns == docs.columns
    best = {}
    for r in docs.collect():
        t = lowered(r["text"])
        best[t] = max(best.get(t, (False, 0)), (r["doc_id"] is not None, r["doc_id"] or 0))
    rows = got.collect()
    assert {lowered(r["text"]): r["doc_id"] for r in rows} == {t: v[1] if v[0] else None for t, v in best.items()}
    assert len(rows) == len(best)


def test_golomb_codes_of_several_slices():
    v = np.unique(np.random.default_rng(4).integers(0, 2**63, 2 * exactdup.SLICE + 12345).astype(np.uint64))
    k, data = exactdup.golomb_encode(v)
    assert (exactdup.golomb_decode(len(v), k, data) == v).all()
