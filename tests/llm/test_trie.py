"""Prefix trie of conversations against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """The rebuilt conversations, turn by turn."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, sha(sha(role or "") + sha(text or "")), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]  # as in SQL, c % 5 has the sign of c
    return out


def brute(rows):
    members = defaultdict(list)
    for c, turns in plain(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted(
        (least[p], len(p), least[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(c for c, n in m if n == len(p))))))
        for p, m in members.items()
    )


def key(r):
    return tuple((x is not None, x) for x in r)


def built(spark, rows, **more):
    made = trie.nodes(trie.rebuilt(spark.createDataFrame(rows, SCHEMA)), **more)
    assert made.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in made.collect()), key=key)


def talks(n, seed, words=3, most=12):
    """Conversations that share many of their first turns."""
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if t % 3 == 2 else "user", f"w{r.randrange(words)}" * r.randrange(1, 3)) for c in range(n) for t in range(r.randrange(most + 1))]


#: Runs of a few strings, pages of a few rows, nodes at edges that aren't broadcast.
SMALL = {"run_bytes": 900, "page_bytes": 60, "broadcast": 0}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("more", [{}, SMALL])
def test_equals_dictionaries(spark, seed, more):
    rows = talks(700, seed)
    assert built(spark, rows, **more) == sorted(brute(rows), key=key)


def test_nodes_deeper_than_the_key_are_added_up(spark):
    rows = talks(500, 7, words=2)
    assert built(spark, rows, key_turns=2, **SMALL) == sorted(brute(rows), key=key)


def test_one_conversation_in_very_many_copies(spark):
    rows = [(5 * c, t, "user", f"the same {t}") for c in range(900) for t in range(3)] + talks(60, 1)
    got = built(spark, rows, piece=16, **SMALL)
    assert got == sorted(brute(rows), key=key) and max(r[3] for r in got if r[1] == 3) >= 800


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, None, None, None), (1, None, "user", ""), (1, 3, "user", "x"), (1, 3, "user", "x"), (1, 2, "user", "é" * 100_000), (1, 2, "assistant", "b"), (1, -4, "user", "a")]
    rows += [(None, 1, "user", "nobody's"), (-3, 0, "user", "below zero"), (0, 0, "", "z"), (7, 0, "user", "q"), (5, None, "system", None)]
    rows += [(20, t, "user", str(t)) for t in range(1000)] + [(21, t, "user", str(t)) for t in range(1000)]
    for more in ({}, SMALL):
        assert built(spark, rows, **more) == sorted(brute(rows), key=key)


def test_empty_table_and_other_columns(spark):
    assert built(spark, []) == []
    rows = talks(50, 4)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("seq", "part", "kind", "first", "path", "depth", "bytes", "h", "base", "head", "turns")})
    assert sorted((tuple(r) for r in trie.nodes(trie.rebuilt(df)).collect()), key=key) == sorted(brute(rows), key=key)


def test_runs_merge_without_comparing_shared_turns():
    r = random.Random(2)
    turn = lambda: bytes(23) + bytes([r.randrange(2)])
    strings = [(b"".join(turn() for _ in range(r.randrange(12))), i) for i in range(400)]
    heads, pages = [], []
    for n in range(7):
        for row in trie.run_pages(0, n, strings[n::7], 100):
            (pages if row[1] else heads).append(dict(zip((c.split()[0] for c in trie.PAGES.split(", ")), row, strict=True)))
    pages.sort(key=lambda p: (p["first"], p["first_id"]))
    assert len(pages) > 20
    now, got = b"", []
    for lcp, base, tail, i in trie.Runs(heads, iter(pages)):
        assert base <= lcp <= base + len(tail) // trie.TURN
        text = now[: base * trie.TURN] + tail if len(got) else tail  # the base is shared with the string before, too
        assert trie.shared(now, text) == lcp
        now = text
        got.append((text, i))
    assert got == sorted(strings)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    want = duckdb.sql(queries.oracle_sql()["op12_prefix_trie"].replace("FROM conversations", f"FROM '{d}/conversations.parquet'")).fetchall()
    got = queries.op12_prefix_trie(spark, d)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
