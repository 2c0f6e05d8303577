"""Indexing: one plan from a file tree to the tables, for changed files only. Edges are joined
again from the names that chunks mention, which are stored; texts are searched once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashed_encoder, quantise
from ..operators import chunks as C
from ..operators import extract, lexical
from ..plugins import Plugins
from ..sources import config as configuration
from ..sources import files as S
from ..sources.store import SEGMENTED, Store, cut, kept


#: How declarations are found, by the setting ``indexer.parser``: by patterns, 61 lines from each on, or by a scan for their real ends.
PARSERS = {"patterns": C.parsed, "scanner": C.declared}
#: Files that are read by their names, in place of a walk over the tree.
FEW = 1000


def index(store: Store, root: str, config: dict | None = None, encode=hashed_encoder, model: str = "hashed", force: bool = False, plugins: Plugins | None = None, compat: bool = False) -> dict:
    """Brings the tables up to date with the files below ``root`` and returns what was done. Files that are gone lose their rows (not with ``compat``)."""
    config, plugins, began = config or configuration.load(), plugins or Plugins(), time.time()
    if force:
        store.wipe()
    where = (root, config["indexer"]["file_extensions"], config["indexer"]["exclude_dirs"])
    known, listed = store.read("files"), cut(S.listing(store.spark, *where))
    # contents are read of files that are new or have another size or time: by their names if they are few
    touched = cut(S.touched(listed, known))
    n_scanned, n_touched = listed.count(), touched.count()
    few = [r["path"] for r in touched.select("path").collect()] if n_touched <= FEW else None
    read = S.scan(store.spark, *where, paths=few).join(touched.select("id"), "id", "left_semi") if n_touched else None
    read = cut(read) if n_touched else S.scan(store.spark, *where).limit(0)
    changed = S.changed(read, known)
    removed = S.removed(listed, known).select("id")
    gone = changed.select("id") if compat else changed.select("id").unionByName(removed)
    n_changed, n_gone = changed.count(), gone.count()
    made = 0
    if n_gone:
        new = new_tables(cut(changed), config, encode, model, plugins, compat)
        made = new["chunks"].count()
        apply(store, gone, new)
        store.merge()
        chunks, files = store.read("chunks"), store.read("files")
        edges, routes = extract.edges_and_routes(files, chunks, store.read("symbols"), compat, said=store.read("mentions"))
        store.write("graph_edges", edges, keep=True)
        store.write("routes", routes, keep=True)
        store.sweep()  # until here the old versions were read
    if n_touched > n_changed:  # other times, but the contents that are known
        same = read.join(store.read("files").select("id", "content_hash", "indexed_at", "segment"), ["id", "content_hash"])
        store.upsert("files", same.drop("text"))
    store.forget()
    store.set_metadata("last_indexed", str(int(time.time())))
    store.set_metadata("root", root)
    return {"files_scanned": n_scanned, "files_indexed": n_changed, "chunks_indexed": made, "elapsed_ms": int(1000 * (time.time() - began))}


def apply(store: Store, gone: DataFrame, new: dict[str, DataFrame]) -> None:
    """Takes the files ``gone`` (id) out of the tables and the rows of ``new`` ones in. Beside the list of files only the new rows are written."""
    segment = store.add({n: new[n] for n in SEGMENTED if n in new})
    known = store.read("files").join(gone, "id", "left_anti")
    store.write("files", known.unionByName(new["files"].withColumn("segment", F.lit(segment)), allowMissingColumns=True))


def new_tables(files: DataFrame, config: dict, encode, model: str, plugins: Plugins, compat: bool) -> dict[str, DataFrame]:
    """The tables' rows for some files (id, path, .., text)."""
    i = config["indexer"]
    parsed = PARSERS[i["parser"]](files)
    if not compat:
        parsed = kept(parsed)
        parsed = parsed.unionByName(C.whole_files(files, parsed))
    own = C.stored(C.shards(parsed, i["max_chunk_tokens"], i["overlap_tokens"], i["min_chunk_tokens"]), compat)
    chunks = kept(plugins.run("on_chunks", own.dropDuplicates(["id"])))
    now = F.current_timestamp()
    head = F.substring("text", 1, 100)
    symbols = chunks.select(F.col("id").alias("chunk_id"), F.explode("symbols").alias("name"), F.col("chunk_type").alias("symbol_type"), head.contains("export").alias("is_exported"), head.contains("export default").alias("is_default_export"))
    searched = chunks.select(F.col("id").alias("chunk_id"), "text", F.array_join("symbols", " ").alias("names"), "summary")
    quantised = config["embedding"]["quantize"]
    vectors = encode(searched, "chunk_id", "text").withColumn("v", quantise(F.col("vector")) if quantised else F.struct(F.lit(None).cast("array<tinyint>").alias("q"), F.lit(None).cast("double").alias("scale")))
    return {
        "files": files.drop("text").withColumn("indexed_at", now),
        "chunks": chunks.withColumn("created_at", now),
        "postings": lexical.postings(searched, "chunk_id", "text", "names", "summary", stem=True),
        "symbols": symbols,
        "embeddings": vectors.select("chunk_id", "v.q", "v.scale", F.lit(None).cast("array<double>").alias("vector") if quantised else F.col("vector").cast("array<double>").alias("vector"), F.lit(model).alias("model_id"), now.alias("created_at")),
        "mentions": extract.mentions(chunks),
        "api_calls": extract.api_calls(chunks.withColumnRenamed("id", "chunk_id")),
    }
