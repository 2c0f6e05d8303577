"""Scores of several searches made one, and what comes after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import count_matches
from .lexical import top


def quality_boost(kind: Column, text: Column) -> Column:
    """By the chunk's type, patterns of value in it, and its share of import lines; in [-0.2, 0.3]."""
    base = None
    for k, v in fixed.TYPE_BOOST.items():
        base = F.when(kind == k, v) if base is None else base.when(kind == k, v)
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  worked out once, whatever reads it how often
    spaces = F.lit(" \t\x0b\f")
    # a line that isn't blank, and whether it imports
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r]"), lambda x: F.ltrim(x, spaces)), lambda x: x != "")
    share = once(lines, lambda x: F.when(F.size(x) > 0, F.size(F.filter(x, lambda y: y.startswith("import ") | y.startswith("from "))) / F.size(x)).otherwise(0.0))
    penalty = once(share, lambda x: F.when(x > 0.6, 0.2).when(x > 0.3, 0.08).otherwise(0.0))
    value = base.otherwise(0.0) + F.least(F.lit(0.15), count_matches(text, fixed.HIGH_VALUE) * 0.025) - penalty
    return once(value, lambda x: F.greatest(F.lit(-0.2), F.least(F.lit(0.3), x)))


def fuse(parts: dict[str, DataFrame], query: str, key: str) -> DataFrame:
    """(query, key, one column for each part, 0 where it has no score), from tables (query, key, score) in long form: one aggregate in place of outer joins."""
    long = None
    for name, df in parts.items():
        one = df.select(query, key, F.lit(name).alias("kind"), F.col("score").cast("double").alias("score"))
        long = one if long is None else long.unionByName(one)
    return long.groupBy(query, key).agg(*[F.coalesce(F.max(F.when(F.col("kind") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in parts])


def ranked(fused: DataFrame, query: str, key: str, k: int | Column, boost: str | None = None) -> DataFrame:
    """Adds final (weights times scores, and the boost; 1 at most) and rank. Weights are columns lexical_weight, semantic_weight, graph_weight."""
    total = F.col("lexical_weight") * F.col("lexical") + F.col("semantic_weight") * F.col("semantic") + F.col("graph_weight") * F.col("graph")
    scored = fused.withColumn("final", F.least(F.lit(1.0), total + (F.col(boost) if boost else 0.0)))
    if isinstance(k, int):
        return top(scored, [query], "final", key, k)
    order = Window.partitionBy(query).orderBy(F.col("final").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, score, query: str, key: str, k: int) -> DataFrame:
    """Scores anew by ``score``, a function of the table that returns a column, and keeps the k best; without one, the k best as they are."""
    if score is None:
        return hits.where(F.col("rank") <= k)
    return top(hits.drop("rank").withColumn("final", score(hits)), [query], "final", key, k)


def affinity(hits: DataFrame, table: dict[str, float], kind: str = "chunk_type") -> DataFrame:
    """``final`` times a factor for the chunk's type."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])
    return hits.withColumn("final", F.col("final") * F.coalesce(F.try_element_at(m, F.col(kind)), F.lit(1.0)))


def without_overlap(hits: DataFrame, query: str) -> DataFrame:
    """In order of rank, rows whose lines meet no kept row's of the same file; a fold over the few rows of a query."""
    item = F.struct("rank", "file_path", "start_line", "end_line")
    lists = hits.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("items"))  # top k of a query

    def step(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["file_path"] == x["file_path"]) & (y["start_line"] <= x["end_line"]) & (x["start_line"] <= y["end_line"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("items", F.slice("items", 1, 0), step)
    return hits.join(lists.select(query, F.explode(kept).alias("x")).select(query, F.col("x.rank").alias("rank")), [query, "rank"], "left_semi")
