"""The engine: projects, indexing, search, prompts, graph. Results are tables or small dictionaries."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import hashed_encoder
from .operators import context, fusion, graph, intent
from .plans import index as indexing
from .plans import search as searching
from .plugins import Plugins
from .sources import config as configuration
from .sources.store import Registry


class Engine:
    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None, encode=hashed_encoder, reranker=None):
        self.spark, self.config, self.reranker = spark, config or configuration.load(), reranker
        self.encode = functools.partial(encode, dims=self.config["embedding"]["dims"]) if encode is hashed_encoder else encode
        self.registry, self.plugins = Registry(spark, folder), Plugins(self.config["plugins"]["enabled"])

    def index(self, root: str, force: bool = False) -> dict:
        return indexing.index(self.registry.store(root), root, self.config, self.encode, force=force, plugins=self.plugins)

    def search(self, root: str, queries: DataFrame, top_k: int | None = None, override: str | None = None) -> DataFrame:
        """queries: query_id, query."""
        routed = intent.route(queries, encode=self.encode, override=override)
        hits = searching.search(self.registry.store(root), routed, top_k, self.encode, searching.SearchConfig.of(self.config))
        if self.config["retrieval"]["use_reranker"]:
            hits = fusion.rerank(hits, self.reranker, "query_id", "chunk_id", self.config["retrieval"]["reranker_top_k"])
        return self.plugins.run("on_results", hits, queries)

    def ask(self, root: str, query: str, top_k: int | None = None) -> list[dict]:
        """One query, answered from the cache if a live result is there."""
        if not 1 <= len(query) <= 1000:
            raise ValueError("a query has 1 to 1000 characters")
        top_k = top_k or self.config["retrieval"]["default_top_k"]
        if not 1 <= top_k <= 50:
            raise ValueError("top_k is from 1 to 50")
        store, key = self.registry.store(root), hashlib.sha256(f"{root}::{query}::{top_k}".encode()).hexdigest()
        if (found := store.cached(key)) is not None:
            return found
        rows = [r.asDict() for r in self.search(root, self._one(query), top_k).orderBy("rank").collect()]
        store.remember(key, rows, self.config["retrieval"]["cache_ttl_seconds"])
        return rows

    def prompt(self, root: str, query: str, top_k: int | None = None, max_tokens: int | None = None) -> str:
        asked = self._one(query)
        made = context.prompts(asked, self.search(root, asked, top_k), most=max_tokens or self.config["context"]["max_tokens"])
        return self.plugins.run("on_prompt", made.first()["prompt"])

    def route(self, query: str) -> dict:
        """Intent, confidence and strategy of a query."""
        return intent.route(self._one(query), encode=self.encode).first().asDict()

    def graph(self, root: str) -> tuple[DataFrame, DataFrame]:
        store = self.registry.store(root)
        return graph.export(store.read("graph_edges"), store.read("chunks"))

    def around(self, root: str, node: str, depth: int = 2, reverse: bool = False, edge_types: list[str] | None = None) -> DataFrame:
        seeds = self.spark.createDataFrame([(node,)], "node string")
        return graph.walk(self.registry.store(root).read("graph_edges"), seeds, depth, edge_types=edge_types, reverse=reverse)

    def meta(self, root: str) -> dict:
        store = self.registry.store(root)
        counts = {n: str(store.read(t).count()) for n, t in (("files", "files"), ("chunks", "chunks"), ("edges", "graph_edges"))}
        return {r["key"]: r["value"] for r in store.read("indexing_metadata").collect()} | counts

    def edge_counts(self, root: str) -> DataFrame:
        return self.registry.store(root).read("graph_edges").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))

    def projects(self) -> list[dict]:
        return self.registry.projects()

    def delete(self, root: str) -> bool:
        return self.registry.delete(root)

    def _one(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")
