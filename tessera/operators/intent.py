"""Routing of queries: intent, expansion, strategy and confidence, as expressions on a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import count_matches, expand
from .semantic import exemplars


def strategies(spark) -> DataFrame:
    """One row for each intent: intent, weights, depth, top_k, use_graph, reverse, edge_types."""
    rows = [(name, *spec["strategy"]) for name, spec in fixed.INTENTS.items()]
    return spark.createDataFrame(rows, "intent string, lexical_weight double, semantic_weight double, graph_weight double, graph_depth int, top_k int, use_graph boolean, reverse boolean, edge_types array<string>")


def hits(query: Column) -> Column:
    """How many rules of each intent match, in order of declaration."""
    return F.array(*[count_matches(query, spec["rules"], ignore_case=True) for spec in fixed.INTENTS.values()])


def by_rules(query: Column) -> Column:
    """The intent with the most rules that match, the first of them on a tie; null without any."""
    names = F.array(*[F.lit(n) for n in fixed.INTENTS])
    # a variable of a lambda, so that the counts are worked out once
    chosen = lambda h: F.when(F.array_max(h) > 0, F.element_at(names, F.array_position(h, F.array_max(h)).cast("int")))
    return F.get(F.transform(F.array(hits(query)), chosen), 0)


def confidence(query: Column, intent: Column) -> Column:
    """From the share of rules that match, their number, and keywords; 1 at most."""
    names = F.array(*[F.lit(n) for n in fixed.INTENTS])
    rules = F.array(*[F.lit(len(s["rules"])) for s in fixed.INTENTS.values()])
    keywords = F.array(*[F.array(*[F.lit(k) for k in s["keywords"]]) for s in fixed.INTENTS.values()])
    at = (F.array_position(names, intent) - 1).cast("int")
    words = F.size(F.filter(F.get(keywords, at), lambda k: F.lower(query).contains(k)))
    rated = lambda h: F.least(F.lit(1.0), F.get(h, at) / F.get(rules, at) + F.least(F.lit(0.4), words * 0.15) + F.least(F.lit(0.4), F.get(h, at) * 0.2))
    return F.get(F.transform(F.array(hits(query)), rated), 0)


def route(queries: DataFrame, key: str = "query_id", text: str = "query", encode=None, override: str | None = None) -> DataFrame:
    """key, query, expanded, intent, confidence and the strategy's columns. Without a matching rule, the nearest
    exemplar by ``encode`` (a function of a table, its key and its text) decides, else the default."""
    q = F.col(text)
    if override:
        chosen = queries.withColumn("intent", F.lit(override))
    else:
        chosen = queries.withColumn("intent", by_rules(q))
        if encode:
            spark = queries.sparkSession
            every = [(n, t) for n, s in fixed.INTENTS.items() for t in s["exemplars"]]
            samples = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(every)], "i int, t string")
            near = exemplars(encode(chosen.where("intent IS NULL"), key, text), encode(samples, "i", "t"), key, "i")  # ties by the order of declaration
            chosen = chosen.join(near.select(key, F.get(F.array(*[F.lit(n) for n, _ in every]), "i").alias("_near")), key, "left").withColumn("intent", F.coalesce("intent", "_near")).drop("_near")
        chosen = chosen.withColumn("intent", F.coalesce("intent", F.lit(fixed.DEFAULT_INTENT)))
    rated = chosen.withColumn("expanded", expand(q)).withColumn("confidence", F.bround(confidence(q, F.col("intent")), 3))
    return rated.join(F.broadcast(strategies(queries.sparkSession)), "intent")  # seven rows
