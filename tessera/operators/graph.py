"""Edges and traversal. A traversal is a loop of joins, one for each level; frontiers stay distributed."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.store import cut, kept


def distinct_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Without self-loops; of each (from_id, to_id, edge_type) the first in ``order``."""
    first = F.row_number().over(Window.partitionBy("from_id", "to_id", "edge_type").orderBy(*order))
    return edges.where("from_id <> to_id").withColumn("_n", first).where("_n = 1").drop("_n")


def by_start(steps: DataFrame, *more: str) -> DataFrame:
    """The edges (node, ..) dealt out by their start (and ``more``), once for all levels of a walk; each level then moves its frontier only. Kept by the
    executors in memory or on disk; what a lost one had is worked out again."""
    return steps.repartition("node", *more).persist(StorageLevel.MEMORY_AND_DISK)


def walk(edges: DataFrame, seeds: DataFrame, depth: int, decay: float | None = None, edge_types: list[str] | None = None, reverse: bool = False, frontier: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by.., node, score): for each node the largest weight * decay**level over edges into it from a
    node that entered the frontier at that level. Seeds (by.., node) are level 0 and score only
    if an edge reaches them. ``by`` names columns of independent walks; ``frontier`` keeps the best so many nodes of a level in each."""
    by = by or []
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    if decay is None:
        decay = fixed.ROUTE_DECAY if edge_types and "DEFINES_ROUTE" in edge_types else fixed.DECAY
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    steps = by_start(edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "weight"))
    at, seen, levels = seeds.select(*by, "node").distinct(), None, []
    for level in range(depth):
        reached = cut(at.join(steps, "node").groupBy(*by, F.col("next")).agg(F.max(F.col("weight") * float(decay**level)).alias("score")).withColumnRenamed("next", "node"))
        levels.append(reached)
        fresh = reached if seen is None else reached.join(seen, [*by, "node"], "left_anti")
        if frontier:
            order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "node") if by else Window.orderBy(F.col("score").desc(), "node")
            fresh = fresh.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= frontier).drop("_n")
        at = fresh.select(*by, "node")
        seen = at if seen is None else seen.unionByName(at)
    steps.unpersist()
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.groupBy(*by, "node").agg(F.max("score").alias("score"))


def walks(edges: DataFrame, seeds: DataFrame, by: list[str], frontier: int | None = None) -> DataFrame:
    """``walk`` for many walks with strategies of their own, in as many levels as the deepest has: seeds (by.., node, depth, reverse,
    edge_types, decay), of each walk the same depth, direction, types (none: all) and decay."""
    how = F.struct("depth", "reverse", "edge_types", "decay").alias("how")
    at = seeds.select(*by, "node", how).distinct()
    depth, levels, seen = seeds.agg(F.max("depth")).first()[0] or 0, [], None
    ends = [edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "weight", "edge_type", F.lit(back).alias("back")) for a, b, back in (("from_id", "to_id", False), ("to_id", "from_id", True))]
    steps = by_start(ends[0].unionByName(ends[1]), "back") if depth else None
    for level in range(depth):
        live = at.where(F.col("how.depth") > level).withColumn("back", F.col("how.reverse"))
        met = live.join(steps, ["node", "back"]).where((F.size("how.edge_types") == 0) | F.array_contains("how.edge_types", F.col("edge_type")))
        reached = cut(met.groupBy(*by, "how", F.col("next").alias("node")).agg(F.max(F.col("weight") * F.pow("how.decay", F.lit(level))).alias("score")))
        levels.append(reached)
        fresh = reached if seen is None else reached.join(seen, [*by, "node"], "left_anti")
        if frontier:
            fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "node"))).where(F.col("_n") <= frontier).drop("_n")
        at = fresh.select(*by, "node", "how")
        seen = at.select(*by, "node") if seen is None else seen.unionByName(at.select(*by, "node"))
    if not levels:
        return seeds.select(*by, "node", F.lit(0.0).alias("score")).limit(0)
    steps.unpersist()
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    return every.groupBy(*by, "node").agg(F.max("score").alias("score"))


def distances(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(node, distance, path): a shortest path to each node, of ``depth`` edges at most; of equal ones the least."""
    at = cut(seeds.select("node", F.lit(0).alias("distance"), F.array("node").alias("path")).distinct())
    every, steps = at, by_start(edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("next")))
    for level in range(1, depth + 1):
        step = at.join(steps, "node").select(F.col("next").alias("node"), F.lit(level).alias("distance"), F.concat("path", F.array("next")).alias("path"))
        at = cut(step.groupBy("node").agg(F.min("distance").alias("distance"), F.min("path").alias("path")).join(every.select("node"), "node", "left_anti"))
        every = every.unionByName(at)
    steps.unpersist()
    return every


#: So many rows of a frontier are sent to the tasks that have the edges; and of so many at once the next level is worked out.
SENT, PART = 500_000, 50_000_000


def impact(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = True, edge_types: list[str] | None = None, levels: list[list[str]] | None = None) -> DataFrame:
    """(seed, node, distance, path, kinds): what each seed (node) reaches, or with ``reverse`` what depends on it, by a shortest path of ``depth`` edges
    at most; of equal ones the least. No node is entered twice by a seed, so cycles end. Where the nodes of each level are of a kind of their own (as in a schema of
    tables), ``levels`` names the types of each level's edges: a level then moves no others, and isn't compared with those before. A level is kept as columns, one
    for each node between seed and node and one for each edge's type: ways of a level are equally long, so the least by these is the
    least, and seed, node and lists move with none. What is known of a level is asked by its ends alone. Seeds of a large level are taken some
    at a time, so that what is shuffled at once doesn't grow with it."""
    if edge_types:
        edges = edges.where(F.col("edge_type").isin(edge_types))
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "edge_type")
    at = kept(seeds.select(F.col("node").alias("seed"), "node").distinct())
    held, every = None if levels else by_start(steps), [at]
    for level in range(1, depth + 1):
        own = steps.where(F.col("edge_type").isin(levels[level - 1])) if levels else held
        n = at.count()
        parts = max(1, -(-n // PART))
        between = [*[F.col(f"p{i}") for i in range(1, level - 1)], *([F.col("node").alias(f"p{level - 1}")] if level > 1 else [])]
        way = F.struct(*between, *[F.col(f"k{i}") for i in range(1, level)], F.col("edge_type").alias(f"k{level}"))
        new = []
        for i in range(parts):
            some = at.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == i) if parts > 1 else at
            new.append((F.broadcast(some) if n <= SENT else some).join(own, "node").groupBy("seed", F.col("next").alias("node")).agg(F.min(way).alias("w")).select("seed", "node", "w.*"))
            for known in [] if levels else every:
                new[i] = new[i].join(known.select("seed", "node"), ["seed", "node"], "left_anti")
        at = kept(*new)
        every.append(at)
    if held is not None:
        held.unpersist()
    found = [
        x.select("seed", "node", F.lit(n).alias("distance"), F.array("seed", *[f"p{i}" for i in range(1, n)], "node").alias("path"), F.array(*[f"k{i}" for i in range(1, n + 1)]).alias("kinds"))
        for n, x in enumerate(every) if n
    ]
    return functools.reduce(DataFrame.unionByName, found)


def between(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(a, b, distance): the least number of edges from a to b of each pair, ``depth`` at most. Searches from both ends take turns, and a pair whose ends
    have met is left out, so each side walks half of the way."""
    open_ = cut(pairs.select("a", "b").distinct())
    ends = {"a": open_.select("a", "b", F.col("a").alias("node"), F.lit(0).alias("n")), "b": open_.select("a", "b", F.col("b").alias("node"), F.lit(0).alias("n"))}
    new, far, found = dict(ends), {"a": 0, "b": 0}, open_.where("a = b").select("a", "b", F.lit(0).alias("distance"))
    steps = {s: by_start(edges.select(F.col(x).alias("node"), F.col(y).alias("next")).distinct()) for s, x, y in (("a", "from_id", "to_id"), ("b", "to_id", "from_id"))}
    open_ = open_.where("a <> b")
    for level in range(depth):
        s, other = ("a", "b") if level % 2 == 0 else ("b", "a")
        far[s] += 1
        step = new[s].join(open_, ["a", "b"], "left_semi").join(steps[s], "node").select("a", "b", F.col("next").alias("node")).distinct()
        new[s] = cut(step.join(ends[s].select("a", "b", "node"), ["a", "b", "node"], "left_anti").withColumn("n", F.lit(far[s])))
        ends[s] = ends[s].unionByName(new[s])
        met = cut(new[s].join(ends[other].withColumnRenamed("n", "m"), ["a", "b", "node"]).groupBy("a", "b").agg(F.min(F.col("n") + F.col("m")).cast("int").alias("distance")))
        found, open_ = found.unionByName(met), cut(open_.join(met, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            break
    for x in steps.values():
        x.unpersist()
    return found


def reached(edges: DataFrame, seeds: DataFrame, depth: int, by: list[str], reverse: bool = False) -> DataFrame:
    """(by.., node, n): what each walk, named by the columns ``by`` of its seeds (by.., node), reaches in ``depth`` edges at most, and the least number of them."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    at = every = seeds.select(*by, "node", F.lit(0).alias("n")).distinct()
    steps = by_start(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    for level in range(1, depth + 1):
        step = at.join(steps, "node").select(*by, F.col("next").alias("node")).distinct()
        at = cut(step.join(every.select(*by, "node"), [*by, "node"], "left_anti").withColumn("n", F.lit(level)))
        every = every.unionByName(at)
    steps.unpersist()
    return every


def meetings(edges: DataFrame, starts: DataFrame, ends: DataFrame, depth: int, by: list[str]) -> DataFrame:
    """(a, b, distance): as ``between``, of each start (a, by..) and end (b, by..) that agree in the columns ``by``. These pairs are never made: each start and
    each end walks its half of the way once, whatever pairs it is in, and only those that come to one node are rows. So the work grows with
    the ways, not with starts times ends."""
    there = reached(edges, starts.select("a", *by, F.col("a").alias("node")), (depth + 1) // 2, ["a", *by])
    back = reached(edges, ends.select("b", *by, F.col("b").alias("node")), depth // 2, ["b", *by], reverse=True)
    met = there.join(back.withColumnRenamed("n", "m"), ["node", *by])
    return met.groupBy("a", "b").agg(F.min(F.col("n") + F.col("m")).alias("distance"))


def export(edges: DataFrame, nodes: DataFrame, most: int = fixed.GRAPH_EDGES) -> tuple[DataFrame, DataFrame]:
    """The first edges, and labels of their ends: a chunk's name, else its type."""
    some = edges.orderBy("from_id", "to_id", "edge_type").limit(most)
    ends = some.select(F.col("from_id").alias("id")).union(some.select("to_id")).distinct()
    label = F.coalesce(F.nullif("name", F.lit("")), "chunk_type").alias("label")
    return some, nodes.join(ends, "id", "left_semi").select("id", label, "chunk_type")


def resolve(names: DataFrame, candidates: DataFrame, name: str = "name") -> DataFrame:
    """For each name its candidate (name, target, priority, ordinal) of the least priority, then ordinal."""
    best = candidates.groupBy(name).agg(F.min_by("target", F.struct("priority", "ordinal", "target")).alias("target"))
    return names.join(best, name)


def candidates(chunks: DataFrame, symbols: DataFrame, kinds: list[str], any_kind: bool) -> DataFrame:
    """Who may define a name: a chunk of that name, a symbol of a chunk of each kind in turn, any symbol."""
    main = chunks.where(F.col("name").isNotNull() & F.col("chunk_type").isin("COMPONENT", "HOOK", "FUNCTION")).select("name", F.col("id").alias("target"), F.lit(0).alias("priority"), F.col("id").alias("ordinal"))
    rank = F.lit(None).cast("int")
    for i, k in reversed(list(enumerate(kinds, 1))):
        rank = F.when(F.col("symbol_type") == k, i).otherwise(rank)
    if any_kind:
        rank = F.coalesce(rank, F.lit(len(kinds) + 1))
    more = symbols.select("name", F.col("chunk_id").alias("target"), rank.alias("priority"), F.col("chunk_id").alias("ordinal")).where("priority IS NOT NULL")
    return main.unionByName(more)
