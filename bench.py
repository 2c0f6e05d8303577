"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Seconds of each query are the median of three runs (after a warm-up of the session), with
results written to Spark's noop sink; ``calibration_sec`` is a plain aggregate beside them, by which machines can be compared."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.queries import QUERIES
from tessera.queries_code import FILES_SQL
from tessera.session import session

HEADLINE = [
    "bm25_topk", "hybrid_topk", "cosine_topk", "symbol_lookup", "quantize_roundtrip", "exemplar_classify", "lsh_buckets", "bfs_forward", "bfs_reverse", "shortest_distance", "edge_dedupe",
    "intent_route", "query_expand", "chunk_windows", "context_pack", "change_detect", "upsert_merge", "cascade_delete", "event_throttle", "quality_boost", "content_hash", "stemmed_terms", "import_edges",
]
RUNS = 3
#: Source files of the project that is indexed and asked.
FILES = 400


def engine_times(spark, d: str) -> dict[str, float]:
    """Seconds to index a project, to index it again after one file has changed, and to answer a question that isn't cached."""
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("bench_part")
    root = tempfile.mkdtemp(prefix="tessera-bench-")
    for r in spark.sql(f"WITH {FILES_SQL.replace('FROM part', 'FROM bench_part')} SELECT path, text FROM f ORDER BY k LIMIT {FILES}").collect():
        os.makedirs(os.path.dirname(at := os.path.join(root, r.path)), exist_ok=True)
        with open(at, "w") as f:
            f.write(r.text)
    e, took = Engine(spark, tempfile.mkdtemp(prefix="tessera-bench-")), {}

    def timed(name, f):
        began = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - began, 3)

    timed("engine_index", lambda: e.index(root))
    with open(at, "a") as f:
        f.write("export function changed() { return 1; }\n")
    timed("engine_index_one_file", lambda: e.index(root))
    timed("engine_ask", lambda: e.ask(root, "which files use useThing3", 5))
    return took


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/documents.parquet").selectExpr("sum(length(text))").collect()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    began = time.perf_counter()
    spark.range(200_000_000).select(F.sum(F.xxhash64("id") % 1000)).collect()
    calibration = round(time.perf_counter() - began, 3)
    docs = spark.read.parquet(f"{d}/documents.parquet").count()
    items = spark.read.parquet(f"{d}/benchmark.parquet").count()
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")), "bm25_queries_per_sec": round(items / took["bm25_topk"], 2), "documents": docs, "runs": RUNS, "calibration_sec": calibration, "engine": engine_times(spark, d)}))


if __name__ == "__main__":
    main()
