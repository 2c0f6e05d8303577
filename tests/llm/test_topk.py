"""Exact top-k search against all products."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=10):
    """Sorted (query_id, rank, vec_id, score) by plain loops; a row's place in the list stands for itself."""
    whole = []
    for i, (vec_id, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, vec_id, [max(-(2**63), min(2**63 - 1, math.floor(1024 * float(np.float32(x))))) for x in v]))
    out = []
    for i, q_id, q in whole:
        if q_id is None or q_id % 100:
            continue
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), math.inf if vec_id is None else vec_id) for j, vec_id, v in whole if j != i]
        for rank, (s, vec_id) in enumerate(sorted(found)[:k], 1):
            out.append((q_id, rank, None if vec_id == math.inf else vec_id, -s))
    return sorted(out, key=str)


def searched(spark, rows, k=10, **more):
    v = topk.integral(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    return sorted((tuple(r) for r in topk.search(v, F.col("vec_id") % 100 == 0, k, **more).collect()), key=str)


def vectors(n, dims, seed, lengths=lambda r, n: np.ones(n)):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    v = centres[r.integers(0, 12, n)] + r.normal(size=(n, dims)) * 0.3
    v *= (lengths(r, n) / np.linalg.norm(v, axis=1))[:, None]
    return [(i, [float(x) for x in row]) for i, row in enumerate(v.astype(np.float32))]


@pytest.mark.parametrize("lengths", [lambda r, n: np.ones(n), lambda r, n: np.exp(r.normal(size=n)), lambda r, n: r.choice([0.0, 1.0, 3.0], n)])
def test_equals_all_products(spark, lengths):
    rows = vectors(1500, 16, 3, lengths)
    assert searched(spark, rows, bucket=64) == brute(rows)
    assert searched(spark, rows, 3, group_bytes=20_000, bucket=50) == brute(rows, 3)


def test_both_ways_of_pruning_are_taken(monkeypatch):
    r = np.random.default_rng(5)
    v = np.floor(r.normal(size=(4000, 8)) * np.exp(r.normal(size=4000))[:, None] * 100)
    v[:, 0] += np.where(r.random(4000) < 0.05, 4000, 0)
    norms = np.linalg.norm(v, axis=1)
    order = np.argsort(-norms)
    v, norms = v[order], norms[order]
    ids = np.arange(4000)
    taken = {"lists": 0, "length": 0}
    near, products = topk.Bucket.near, topk.Group.products

    def counted(self, q, cosine, most):
        rows = near(self, q, cosine, most)
        taken["lists"] += rows is not None
        return rows

    def multiplied(self, q, w):
        taken["length"] += len(q) > 1
        return products(self, q, w)

    monkeypatch.setattr(topk.Bucket, "near", counted)
    monkeypatch.setattr(topk.Group, "products", multiplied)
    g = topk.Group(v.astype(np.float32), norms, ids, ids, 10, np.float64, 256)
    assert len(g.buckets) > 16 and all(b.norms[-1] >= topk.RATIO * b.longest for b in g.buckets if b.longest > 0)
    q = v[::100]
    i, scores, found, _ = g.search(q, norms[::100], ids[::100], np.full(len(q), topk.LOWEST))
    for n in range(len(q)):
        s = (v @ q[n]).astype(np.int64)
        s[n * 100] = topk.LOWEST
        best = np.lexsort((ids, -np.maximum(s, topk.LOWEST + 1)))[:10]
        assert found[i == n].tolist() == best.tolist() and scores[i == n].tolist() == s[best].tolist()
    assert taken["lists"] > 0 and taken["length"] > 0


def test_nulls_ties_repeats_and_odd_components(spark):
    rows = [(i, [0.5, 0.25]) for i in range(40)]  # ties: the smaller ids come first
    rows += [(100, [0.5, 0.25]), (100, [0.5, 0.25]), (100, [-1.0, 2.0])]  # a repeated id: each row a query, the others its candidates
    rows += [(200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 1.0]), (600, [-0.0001, 0.0])]
    rows += [(None, [5.0, 5.0]), (None, [0.0, 0.0]), (700, []), (800, [1.0]), (900, [0.0, 0.0, 3.0])]
    assert searched(spark, rows) == brute(rows)
    assert searched(spark, rows[:3] + rows[40:41], 10) == brute(rows[:3] + rows[40:41])  # fewer than ten


@pytest.mark.parametrize("size", [2.0**13, 2.0**25, 1e15, 1e30])
def test_large_components_stay_exact(spark, size):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (r.normal(size=6) * size).astype(np.float32)]) for i in range(300)]
    assert searched(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.search(topk.integral(none, "vec_id", "embedding"), F.col("vec_id") % 100 == 0).collect() == []
    rows = vectors(300, 8, 1)
    more = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("v", "norm", "row", "group", "score", "rank", "query_id", "floor")})
    got = topk.search(topk.integral(more, "vec_id", "embedding"), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_one_very_common_vector(spark):
    rows = vectors(600, 8, 2)
    rows += [(10_000 + i, rows[100][1]) for i in range(1200)]
    assert searched(spark, rows, group_bytes=40_000) == brute(rows)


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.1"
    want = duckdb.sql(queries.oracle_sql()["op11_exact_topk"].replace("FROM embeddings", f"FROM '{d}/embeddings.parquet'")).fetchall()
    got = queries.op11_exact_topk(spark, d)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == sorted(want)
