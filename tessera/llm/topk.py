"""Exact top-k search by inner product, over vectors in buckets of similar length.

Vectors are dealt into groups by length, longest first, equal lengths split; a task holds
one group and cuts it into buckets. For a query with a k-th score so far, a bucket has a local cosine threshold: what the score asks of
the angle even of the bucket's longest vector. Above 1 the bucket is passed over, and all shorter ones with it. Else each
(query, bucket) takes the cheaper way: pruning by length (those long enough for the score at cosine 1), or by coordinate
(in the query's strongest coordinates, only values that a vector within the threshold's angle can have, from sorted lists).
What is left is verified by exact integer products.

Each query first visits one group, dealt out over all of them; its k-th score there is a lower bound with
which it then visits only groups that can reach it. So no task meets all queries before there are thresholds, groups
stay below ``group_bytes``, and queries stream. A group gives at most k rows a query, which a window by query ranks.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as ending in zeros, empty ones as zero; ties go to the smaller vec_id, null ids last, then by row; each row of a repeated id is a
candidate and a query of its own; an empty table gives no rows; other columns don't matter.
Components and scores beyond 64 bits become the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stage

#: Memory of one group in a task, at ten bytes a component (the vector, and its place in a sorted list).
GROUP_BYTES, COMPONENT_BYTES = 96 << 20, 10
#: A bucket has so many rows at most, and no vector shorter than this share of its longest.
BUCKET, RATIO = 2048, 0.9
#: Coordinates that pruning looks at, and what a row found by lists costs against one of a whole product.
FOCUS, LIST_COST = 4, 12
#: Queries that a task handles at once.
QUERIES = 256
#: Allowance for rounding in lengths and in sorted lists.
EPS, LIST_EPS = 1e-9, 1e-5

LOWEST = np.iinfo(np.int64).min
VISITED = "query_row long, query_id long, score long, vec_id long, row long"


def integral(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """vec_id and v, the whole parts of ``scale`` times each component, of the vectors that take part."""
    x = F.col(vector_col)
    fit = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * float(scale))).alias("v"))


def dense(lists: pa.Array, width: int, kind) -> np.ndarray:
    """Lists as rows of one length, shorter ones filled up with zeros."""
    sizes = np.asarray(pc.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Bucket:
    """Vectors of similar length, longest first; sorted lists of a coordinate are made when first asked for."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.norms, self.ids, self.rows = vectors, norms, ids, rows
        self.longest, self.lists = float(norms[0]), {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of coordinate ``f`` of the vectors at length 1, ascending, and whose they are."""
        if f not in self.lists:
            at = np.divide(self.vectors[:, f].astype(np.float64), self.norms, out=np.zeros(len(self.norms)), where=self.norms > 0).astype(np.float32)
            order = np.argsort(at, kind="stable")
            self.lists[f] = at[order], order.astype(np.int16 if len(at) < 2**15 else np.int32)
        return self.lists[f]

    def near(self, q: np.ndarray, cosine: float, most: int) -> np.ndarray | None:
        """Rows within the first ``most`` that can have this cosine with ``q`` (of length 1) by its strongest
        coordinates, or None if lists don't pay. At an angle a to q and b between q and an axis, a vector's own
        angle to the axis is between b - a and b + a."""
        strongest = np.argsort(-np.abs(q))[:FOCUS]
        angle = np.arccos(min(1.0, cosine))
        own = np.arccos(np.clip(q[strongest], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - LIST_EPS, np.cos(np.maximum(0, own - angle)) + LIST_EPS
        spans = []
        for f, a, z in zip(strongest, low, high, strict=True):
            values = self.sorted_list(int(f))[0]
            spans.append((int(np.searchsorted(values, a, "left")), int(np.searchsorted(values, z, "right"))))
        best = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        if (spans[best][1] - spans[best][0]) * LIST_COST >= most:
            return None
        found = self.sorted_list(int(strongest[best]))[1][slice(*spans[best])].astype(np.int64)
        found = found[found < most]
        at = self.vectors[found][:, strongest].astype(np.float64) / np.maximum(self.norms[found], 1e-300)[:, None]
        return found[((at >= low) & (at <= high)).all(axis=1)]


class Group:
    """One group of a task in buckets, and the search in it. ``kind``: numbers that hold every product exactly."""

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, kind: type, bucket: int = BUCKET):
        self.k, self.kind, self.buckets, at = k, kind, [], 0
        while at < len(norms):
            end = min(at + bucket, int(np.searchsorted(-norms, -norms[at] * RATIO, "right"))) if norms[at] > 0 else at + bucket
            part = slice(at, max(at + 1, end))
            self.buckets.append(Bucket(vectors[part], norms[part], ids[part], rows[part]))
            at = part.stop

    def products(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact integer products of each row of ``q`` with each of ``v``."""
        if self.kind is not object:
            return (q.astype(self.kind) @ v.T.astype(self.kind)).astype(np.int64)
        wide = q.astype(object) @ v.T.astype(object)
        return np.clip(wide, LOWEST, np.iinfo(np.int64).max).astype(np.int64)

    def search(self, q: np.ndarray, q_norms: np.ndarray, q_rows: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each query (``floor``: a score that k vectors reach anyway) the best k here that reach it: number of the query, score, id, row."""
        n, self.found = len(q), (np.zeros(0, np.int64),) * 4
        least = floor.copy()
        unit = np.divide(q.astype(np.float64), q_norms[:, None], out=np.zeros(q.shape), where=q_norms[:, None] > 0)
        for b in self.buckets:
            reach = q_norms * b.longest * (1 + EPS)
            some = np.flatnonzero((least == LOWEST) | (reach >= least))
            if not len(some):
                break  # what comes is shorter still
            cosine = np.where((least[some] == LOWEST) | (reach[some] == 0), -1.0, least[some] / np.maximum(reach[some], 1e-300))
            length = np.divide(least[some], q_norms[some], out=np.full(len(some), -1.0), where=(q_norms[some] > 0) & (least[some] > 0)) * (1 - EPS)
            reached = np.searchsorted(-b.norms, -length, "right")
            by_length, hits = [], []
            for i, c, most in zip(some, cosine, reached, strict=True):
                rows = b.near(unit[i], float(c), int(most)) if c > 0 else None
                if rows is None:
                    by_length.append(i)
                elif len(rows):
                    hits.append((np.full(len(rows), i), self.products(q[i : i + 1], b.vectors[rows])[0], rows))
            if by_length:
                own = np.array(by_length)
                most = int(reached[np.isin(some, own)].max())
                if most:
                    scores = self.products(q[own], b.vectors[:most])
                    need = least[own]
                    if most > self.k:  # one more than k, as a query's own row may be among them
                        need = np.maximum(need, np.partition(scores, most - self.k - 1, axis=1)[:, most - self.k - 1])
                    i, j = np.nonzero(scores >= need[:, None])
                    hits.append((own[i], scores[i, j], j))
            if hits:
                self.keep(n, least, q_rows, *(np.concatenate([h[c] for h in hits]) for c in range(3)), b)
        return self.found

    def keep(self, n: int, least: np.ndarray, q_rows: np.ndarray, i: np.ndarray, scores: np.ndarray, j: np.ndarray, b: Bucket) -> None:
        """Ranks verified products with those found before; raises ``least`` to the k-th score of queries that have k."""
        ok = (scores >= least[i]) & (b.rows[j] != q_rows[i])
        i, scores, j = i[ok], scores[ok], j[ok]
        i, scores, ids, rows = (np.concatenate(x) for x in zip(self.found, (i, scores, b.ids[j], b.rows[j]), strict=True))
        order = np.lexsort((rows, ids, np.negative(np.maximum(scores, LOWEST + 1)), i))
        i = i[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, "left")
        order = order[rank < self.k]
        self.found = i[rank < self.k], scores[order], ids[order], rows[order]
        last = rank == self.k - 1
        least[i[last]] = np.maximum(least[i[last]], self.found[1][np.flatnonzero(rank[rank < self.k] == self.k - 1)])


def visit(group: DataFrame, queries: DataFrame, groups: int, width: int, most: int, k: int, bounds_only: bool, bucket: int) -> DataFrame:
    """Queries (query_row, query_id, v, norm, floor, group) in the groups that they name: the best k rows of each (query, group), or
    with ``bounds_only`` the queries again, with the k-th score as floor."""
    largest = float(most) ** 2 * max(width, 1)
    exact = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
    kind = np.float32 if most < 2**24 else exact
    null_id = np.iinfo(np.int64).max

    def answers(held: Group, b: pa.RecordBatch, lists: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, b.num_rows, QUERIES):
            part = b.slice(at, QUERIES)
            q = dense(lists.slice(at, QUERIES), width, exact)
            floor = np.array(pc.fill_null(part["floor"], LOWEST))
            i, scores, ids, rows = held.search(q, np.asarray(part["norm"]), np.asarray(part["row"]), floor.copy())
            if bounds_only:
                full = np.searchsorted(i, np.arange(part.num_rows), "right") - np.searchsorted(i, np.arange(part.num_rows), "left") == k
                last = np.searchsorted(i, np.arange(part.num_rows), "right") - 1
                floor[full] = scores[last[full]]
                yield pa.record_batch({"query_row": part["row"], "query_id": part["vec_id"], "v": part["v"], "norm": part["norm"], "floor": pa.array(floor, mask=floor == LOWEST)})
            elif len(i):
                yield pa.record_batch({"query_row": part["row"].take(pa.array(i)), "query_id": part["vec_id"].take(pa.array(i)), "score": pa.array(scores), "vec_id": pa.array(ids, mask=ids == null_id), "row": pa.array(rows)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            own, asked = np.asarray(batch["group"]), np.asarray(batch["is_query"])
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (asked[1:] != asked[:-1])) + 1), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                b = batch.slice(a, z - a)
                if own[a] != now:
                    now, parts, held = own[a], [], None
                if not asked[a]:
                    parts.append((dense(b["v"], width, kind), np.asarray(b["norm"]), np.asarray(pc.fill_null(b["vec_id"], null_id)), np.asarray(b["row"])))
                    continue
                if held is None:
                    parts = parts or [(np.zeros((0, width), kind), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
                    held, parts = Group(*(np.concatenate(x) for x in zip(*parts, strict=True)), k, exact, bucket), []
                yield from answers(held, b, b["v"])
        give_back()

    vectors = group.select("group", F.lit(0).alias("is_query"), "norm", "row", "vec_id", "v", F.lit(None).cast("long").alias("floor"))
    asked = queries.select("group", F.lit(1).alias("is_query"), "norm", F.col("query_row").alias("row"), F.col("query_id").alias("vec_id"), "v", "floor")
    dealt = vectors.unionByName(asked).repartitionById(groups, "group").sortWithinPartitions("group", "is_query", F.col("norm").desc())
    kind_v = dict(group.dtypes)["v"]
    return dealt.mapInArrow(run, f"query_row long, query_id long, v {kind_v}, norm double, floor long" if bounds_only else VISITED)


def search(vectors: DataFrame, asked: Column, k: int = 10, group_bytes: int = GROUP_BYTES, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row of vectors (vec_id, v array<long>) where ``asked``."""
    spark = vectors.sparkSession
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))).alias("most")).first()
    n, width, most = size["n"], size["width"] or 0, int(size["most"] or 0)
    kind = "smallint" if most < 2**15 else "int" if most < 2**31 else "bigint"
    groups = max(1, -(-n * max(width, 1) * COMPONENT_BYTES // group_bytes), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = vectors.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), norm.alias("norm"), F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    group = stage(rows.repartitionByRange(groups, F.col("norm").desc(), F.col("row")).withColumn("group", F.spark_partition_id()), "vectors")
    longest = {r["group"]: r["longest"] for r in group.groupBy("group").agg(F.max("norm").alias("longest")).collect()}  # a row a group
    if not longest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = max(longest) + 1
    reach = [longest.get(g, 0.0) for g in range(groups)]
    reach = [max(reach[g:]) for g in range(groups)] if any(a < z for a, z in zip(reach, reach[1:], strict=False)) else reach

    queries = group.where("asked").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "v", "norm", F.lit(None).cast("long").alias("floor"))
    first = queries.withColumn("group", F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int"))
    bounded = stage(visit(group, first, groups, width, most, k, True, bucket), "floors")
    # groups are numbered from the longest on: those that can reach the score are the first so many
    can = F.size(F.filter(F.lit(reach), lambda x: F.col("floor").isNull() | (x * F.col("norm") * (1 + EPS) >= F.col("floor"))))
    visits = bounded.withColumn("_n", can).where("_n > 0").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    found = visit(group, visits, groups, width, most, k, False, bucket)
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
