"""Cosine search over vectors: exact in blocks, and over candidates from hyperplane hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dequantise, doubles
from .lexical import top


def shifted(cosine: Column) -> Column:
    return (cosine + 1) / 2


#: Bytes of vectors that a task holds.
GROUP_BYTES = 64 << 20


def search(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", key: str = "vec_id", vector: str = "vector", block: int = 256, planes: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """(query, key, cosine, rank): the k nearest rows of each query, over all rows, or with ``planes`` over those of a bucket that it probes (``near``).

    Vectors are dealt into groups that fit in a task. Each group meets all queries, which stream through it in blocks: a matrix
    product, and of each (query, group) k rows go on. Neither side passes through the driver, and no row is paired by itself."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = vectors.sparkSession
    own = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), doubles(F.col(vector)).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query).alias("q"), doubles(F.col(vector)).alias("v"))
    size = own.agg(F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)) * 8).first()[0]
    groups = max(spark.sparkContext.defaultParallelism, -(-size // GROUP_BYTES))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    qkind, kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, query), (vectors, key)))

    def matrix(col: pa.Array) -> np.ndarray:
        return np.asarray(col.flatten()).reshape(len(col), -1)

    def best(keys: pa.Array, m: np.ndarray, order_of: np.ndarray, own: np.ndarray | None, names: pa.Array, q: np.ndarray):
        scores = np.round(q @ m.T, 12)
        n = min(k, len(keys))
        if own is not None:
            scores[~shared(*buckets(q, planes, probes), own)] = -np.inf
        i, j = np.nonzero((scores >= np.partition(scores, len(keys) - n, axis=1)[:, len(keys) - n, None]) & (scores > -np.inf))
        s = scores[i, j]
        order = np.lexsort((order_of[j], -s, i))  # ties by the least key
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < n]
        return pa.record_batch({query: names.take(pa.array(i[order])), key: keys.take(pa.array(j[order])), "cosine": s[order]})

    def run(batches):
        group, parts, held = None, [], None
        for b in batches:
            g, is_query = np.asarray(b["g"]), np.asarray(b["is_query"])
            cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (is_query[1:] != is_query[:-1])) + 1), b.num_rows]
            for at, end in zip(cuts, cuts[1:], strict=False):
                if at == end:
                    continue
                if g[at] != group:
                    group, parts, held = g[at], [], None
                rows = b.slice(at, end - at)
                if not is_query[at]:
                    parts.append((rows["k"], matrix(rows["v"])))
                    continue
                if held is None and parts:
                    keys, parts = pa.concat_arrays([p[0] for p in parts]), [p[1] for p in parts]
                    m = np.concatenate(parts)
                    held, parts = (keys, m, np.argsort(np.asarray(pc.sort_indices(keys))), None if planes is None else buckets(m, planes)[0]), []
                for a in range(0, rows.num_rows if held else 0, block):
                    some = rows.slice(a, block)
                    yield best(*held, some["q"], matrix(some["v"]))

    rows = own.select(F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("is_query"), "k", F.lit(None).cast(qkind).alias("q"), "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("is_query"), F.lit(None).cast(kind).alias("k"), "q", "v")
    met = rows.unionByName(every).repartitionById(groups, "g").sortWithinPartitions("g", "is_query").mapInArrow(run, f"{query} {qkind}, {key} {kind}, cosine double")
    return top(met, [query], "cosine", key, k)


def stored(embeddings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, vector) from the stored table: vectors as they are, if they were kept so, else from their bytes."""
    return embeddings.select(key, F.coalesce("vector", dequantise(F.col("q"), F.col("scale"))).alias("vector"))


def hyperplane_bits(vector: Column, dims: int, tables: int = 4, bits: int = 8, seed: int = 3) -> list[Column]:
    """A bucket number for each table: the sides of ``bits`` random hyperplanes."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims)).round(6)
    out = []
    for t in range(tables):
        n = F.lit(0)
        for i in range(bits):
            plane = F.array(*[F.lit(float(x)) for x in planes[t, i]])
            side = F.aggregate(F.zip_with(doubles(vector), plane, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            n = n + F.when(side >= 0, 1 << i).otherwise(0)
        out.append(n)
    return out


def buckets(v: np.ndarray, planes: np.ndarray, probes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """For each of some vectors and tables the bucket, by the sides of the table's hyperplanes (planes: tables, bits, dims), and the bits of so many
    planes that the vector is closest to."""
    worth = 1 << np.arange(planes.shape[1])
    sides = np.einsum("nd,tbd->ntb", v[:, : planes.shape[2]], planes)
    close = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probes]
    return ((sides >= 0) * worth).sum(axis=2), worth[close].sum(axis=2)


def shared(asked: np.ndarray, free: np.ndarray, own: np.ndarray) -> np.ndarray:
    """(query, row): whether they share a bucket in a table, the query's bits ``free`` being either way."""
    out = np.zeros((len(asked), len(own)), bool)
    for t in range(asked.shape[1]):
        fixed_ = ~free[:, t]
        out |= (asked[:, t] & fixed_)[:, None] == (own[:, t][None, :] & fixed_[:, None])
    return out


def near(queries: DataFrame, vectors: DataFrame, k: int, planes: np.ndarray, probes: int = 3, query: str = "query_id", key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query, key, cosine, rank): the k nearest of the rows that share a bucket with the query in a table, with ``probes`` also those on the other sides of
    so many planes that it is closest to, in all their combinations. Buckets are compared in blocks, as vectors are in ``search``: where buckets are wide
    most rows are met, and pairs of them would grow with queries times rows."""
    return search(queries, vectors, k, query, key, vector, planes=planes, probes=probes)


def exemplars(queries: DataFrame, samples: DataFrame, query: str, label: str, vector: str = "vector") -> DataFrame:
    """(query, label, score): the label of the nearest of a few exemplars; ties by the least label."""
    from ..functions.vectors import dot

    few = F.broadcast(samples.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(vector).alias("v"))).alias("_few")))  # one row, a fixed, small set
    scored = queries.crossJoin(few).select(query, F.transform("_few", lambda s: F.struct((-dot(F.col(vector), s["v"])).alias("s"), s["label"].alias("label"))).alias("_all"))
    best = F.array_min("_all")
    return scored.where(F.size("_all") > 0).select(query, best["label"].alias(label), (-best["s"]).alias("score"))
