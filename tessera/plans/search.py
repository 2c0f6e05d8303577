"""Hybrid search: lexical, symbol, semantic and graph scores of many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import stems
from ..functions.vectors import hashed_encoder
from ..operators import fusion, graph, lexical, semantic
from ..sources.store import Store, cut, kept

#: So many chunks found are sent to the tasks; with more, all chunks are joined.
FEW = 500_000


@dataclass(frozen=True)
class SearchConfig:
    pool: int = fixed.POOL
    symbols: int = fixed.SYMBOLS
    seeds: int = 5
    most_seeds: int = fixed.SEEDS
    frontier: int = fixed.FRONTIER
    most_depth: int = 4
    stem: bool = True
    compat: bool = False

    @classmethod
    def of(cls, settings: dict) -> SearchConfig:
        return cls(pool=settings["retrieval"]["fts_candidate_pool"], frontier=settings["memory"]["graph_bfs_frontier"], most_depth=settings["retrieval"]["max_graph_depth"])


def search(store: Store, routed: DataFrame, top_k: int | None = None, encode=hashed_encoder, config: SearchConfig | None = None) -> DataFrame:
    """query_id, rank, chunk_id, file_path, start_line, end_line, chunk_type, name, text, lexical, semantic, graph, boost, final; ``routed`` is the result of ``intent.route``."""
    c, q, k = config or SearchConfig(), "query_id", "chunk_id"
    asked = lexical.asked_terms(routed, q, "expanded")
    if c.stem:
        asked = asked.groupBy(q).agg(F.collect_set("term").alias("t")).select(q, F.explode(F.array_distinct(stems()("t"))).alias("term"))  # TERMS a query
    post = store.read("postings")
    size = post.select(k, "doc_len").distinct().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    best = lexical.best(asked, post, size, q, k, c.pool)
    lex = lexical.normalised(best, q, compat=c.compat).select(q, k, F.col("lexical").alias("score"))
    sym = lexical.symbol_hits(routed, store.read("symbols"), q, "expanded", c.symbols)
    lex = cut(lex.unionByName(sym.select(q, k, F.lit(fixed.SYMBOL_SCORE).alias("score"))).groupBy(q, k).agg(F.max("score").alias("score")))

    code = store.read("chunks").where("chunk_type <> 'IMPORT_BLOCK'").select(F.col("id").alias(k))
    vectors = semantic.stored(store.read("embeddings").join(code, k, "left_semi"))
    asked_v = cut(encode(routed, q, "expanded"))
    near = cut(semantic.search(asked_v, vectors, c.pool, q, k).select(q, k, semantic.shifted(F.col("cosine")).alias("score"), F.col("rank")))
    # the pool's own vectors, whatever their rank
    from ..functions.vectors import dot

    pooled = lex.select(q, k).join(vectors, k).join(F.broadcast(asked_v.select(q, F.col("vector").alias("_v"))), q)
    sem = near.select(q, k, "score").unionByName(pooled.select(q, k, semantic.shifted(dot(F.col("vector"), F.col("_v"))).alias("score")))

    graphs = _graph(store, routed, lex, sym, near, c, q, k)
    fused = kept(fusion.fuse({"lexical": lex, "semantic": sem, "graph": graphs}, q, k))
    ids, chunks = fused.select(k).distinct(), store.read("chunks").withColumnRenamed("id", k)
    if ids.count() <= FEW:  # texts of other chunks stay where they are
        chunks = chunks.join(F.broadcast(ids), k, "left_semi")
    rows = fused.join(chunks, k).join(routed.select(q, "lexical_weight", "semantic_weight", "graph_weight", F.col("top_k").alias("k")), q)
    rows = rows.withColumn("boost", fusion.quality_boost(F.col("chunk_type"), F.col("text")))
    hits = fusion.ranked(rows, q, k, F.lit(top_k) if top_k else F.col("k"), "boost")
    paths = store.read("files").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    score = lambda n: F.bround(n, 4).alias(n)
    return hits.join(paths, "file_id").select(q, "rank", k, "file_path", "start_line", "end_line", "chunk_type", "name", "text", *map(score, ("lexical", "semantic", "graph", "boost", "final")))


def _graph(store: Store, routed: DataFrame, lex: DataFrame, sym: DataFrame, near: DataFrame, c: SearchConfig, q: str, k: str) -> DataFrame:
    """Scores of chunks near the best ones, by each query's own depth, direction and edge types."""
    ranked = lexical.top(lex, [q], "score", k, c.seeds).select(q, k, F.col("rank").alias("n"))
    ranked = ranked.unionByName(sym.where(F.col("rank") <= c.seeds).select(q, k, (F.col("rank") + 100).alias("n"))).unionByName(near.where(F.col("rank") <= c.seeds).select(q, k, (F.col("rank") + 200).alias("n")))
    first = ranked.groupBy(q, k).agg(F.min("n").alias("n"))
    strategy = routed.where("use_graph").select(q, F.least(F.col("graph_depth"), F.lit(c.most_depth)).alias("depth"), "reverse", "edge_types", F.when(F.array_contains("edge_types", "DEFINES_ROUTE"), fixed.ROUTE_DECAY).otherwise(fixed.DECAY).alias("decay"))
    seeds = first.withColumn("i", F.row_number().over(Window.partitionBy(q).orderBy("n", k))).where(F.col("i") <= c.most_seeds).select(q, F.col(k).alias("node"))
    found = graph.walks(store.read("graph_edges"), cut(seeds.join(strategy, q)), [q], c.frontier)
    return found.select(q, F.col("node").alias(k), "score")
