"""Tables as Parquet: cutting lineage, upserts, deletes, metadata, cache, and the catalog of projects.

A table is never overwritten where it is read: a new version goes beside it and its
name is written last, so readers see the old version or the new one.
"""

from __future__ import annotations

import contextlib
import json
import math
import re
import tempfile
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

TABLES = {
    "files": ("id string, path string, file_type string, size_bytes long, line_count int, content_hash string, indexed_at timestamp, modified_at timestamp, segment string", ["id"]),
    "chunks": ("id string, file_id string, chunk_type string, name string, text string, start_line int, end_line int, char_count int, summary string, created_at timestamp", ["id"]),
    "postings": ("term string, chunk_id string, tf long, doc_len long", ["term", "chunk_id"]),
    "symbols": ("chunk_id string, name string, symbol_type string, is_exported boolean, is_default_export boolean", ["chunk_id", "name"]),
    "embeddings": ("chunk_id string, q array<tinyint>, scale double, vector array<double>, model_id string, created_at timestamp", ["chunk_id"]),
    "mentions": ("chunk_id string, file_id string, kind string, name string, path string", ["chunk_id", "kind", "name", "path"]),
    "graph_edges": ("from_id string, to_id string, edge_type string, weight double, metadata string", ["from_id", "to_id", "edge_type"]),
    "routes": ("id string, path string, component string, chunk_id string, is_protected boolean, parent_route string, metadata string", ["id"]),
    "api_calls": ("chunk_id string, method string, endpoint string, client_type string, is_dynamic boolean", ["chunk_id", "method", "endpoint"]),
    "retrieval_cache": ("query_hash string, result_json string, created_at timestamp, hit_count int, ttl_seconds int", ["query_hash"]),
    "summaries": ("id string, subject_type string, summary string, generated_by string, token_count int, created_at timestamp", ["id"]),
    "indexing_metadata": ("key string, value string", ["key"]),
}

#: Tables whose rows belong to files. They are kept in segments: a change of some files is a new segment of their rows, and older ones stay as
#: they are. Which segment has a file's rows is a column of ``files``, so rows of older segments, of deleted files and of segments not yet committed are dead.
SEGMENTED = ("chunks", "postings", "symbols", "embeddings", "api_calls", "mentions")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only where that is unset and executors are the driver's threads a
    local folder takes its place."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = at or tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` saved to the cluster's checkpoint folder, without its lineage. A checkpoint works its rows out twice, to
    count and to write them; the second time they come from the executors' memory or disk."""
    shared_folder(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint()
    held.unpersist()
    return out


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what is written in here go when it has been written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def kept(df: DataFrame, *more: DataFrame) -> DataFrame:
    """``df`` saved as Parquet beside the checkpoints, without its lineage: for tables that several plans read. Each reads its own columns, where a
    checkpoint is whole rows, written one by one as objects. Rows of ``more`` tables like it are added one table after the other."""
    at = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    for x in (df, *more):
        with tidy(df.sparkSession):
            x.write.mode("append").option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def small(df: DataFrame, most: int) -> bool:
    """Whether it has so many bytes at most, by Spark's estimate."""
    return bool(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most)


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """A small table dealt out to all cores: a file of one row group is read by one task, which would do all that follows.
    Larger tables, by Spark's estimate of their bytes, have tasks enough and stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, df.columns[0]) if small(df, most) else df


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows, and the existing ones with other keys. Of new rows with one key the last stays, in ``order`` and
    then that of all other columns, so that the result has a row a key whatever order rows came in."""
    rest = [c for c in [*(order or []), *new.columns] if c not in key]
    rest = list(dict.fromkeys(rest))
    last = F.max(F.struct(*rest)).alias("_last") if rest else F.lit(0).alias("_last")
    one = new.groupBy(*key).agg(last).select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in new.columns])
    return existing.join(one.select(key), key, "left_anti").unionByName(one)


def insert_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Existing rows, and of each new key the first row in ``order``; self-loops of edges go before."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = new.withColumn("_n", first).where("_n = 1").drop("_n").join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files in ``gone`` (id) and whatever belongs to their chunks."""
    out = dict(tables)
    files = gone.select(F.col("id").alias("file_id")).distinct()
    chunks = tables["chunks"].join(files, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    out["files"] = delete(tables["files"], gone.select("id"), ["id"])
    out["chunks"] = delete(tables["chunks"], files, ["file_id"])
    for name in ("postings", "symbols", "embeddings", "api_calls", "routes"):
        if name in tables:
            out[name] = delete(tables[name], chunks, ["chunk_id"])
    if "graph_edges" in tables:
        ends = chunks.select(F.col("chunk_id").alias("id")).unionByName(files.select(F.col("file_id").alias("id")))
        edges = tables["graph_edges"]
        for side in ("from_id", "to_id"):
            edges = edges.join(ends.select(F.col("id").alias(side)), side, "left_anti")
        out["graph_edges"] = edges.select(tables["graph_edges"].columns)
    return out


def live(cache: DataFrame, now) -> DataFrame:
    """Cached results whose time to live isn't over."""
    return cache.where(F.col("created_at") + F.make_interval(secs=F.coalesce("ttl_seconds", F.lit(fixed.CACHE_TTL_SECONDS))) >= now)


#: So many files of segments are sent to all tasks, some 100 bytes each.
SENT = 1_000_000


def alive(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Those rows of segments whose file is in that segment still. Rows are many for each file, so they stay where they are: files go to them, the ones that are in
    their segments or, if these are too many, the ones that are in it no more. Only if both are, all rows are dealt out by file."""
    on = ["file_id", "segment"]
    live = files.select(F.col("id").alias("file_id"), "segment")
    if small(live, 1 << 20) or live.count() <= SENT:
        return rows.join(F.broadcast(live), on, "left_semi")
    named = rows.where("file_id IS NOT NULL AND segment IS NOT NULL")
    dead = kept(named.select(*on).distinct().join(live, on, "left_anti"))
    return named.join(F.broadcast(dead), on, "left_anti") if dead.count() <= SENT else rows.join(live, on, "left_semi")


class Store:
    """A project's tables in one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.folder}/{name}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.folder}/{name}/CURRENT").first()[0]

    def _segments(self, name: str) -> DataFrame:
        """All rows of a table in segments, dead ones too, with file_id and segment."""
        schema = TABLES[name][0] + ("" if "file_id" in TABLES[name][0] else ", file_id string") + ", segment string"
        fs, p = self._fs(f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def add(self, tables: dict[str, DataFrame]) -> str:
        """Writes rows of files (``chunks``, and tables with a chunk_id of theirs) as a new segment and gives its name. It counts once ``files`` names it."""
        segment = uuid.uuid4().hex
        owners = tables["chunks"].select(F.col("id").alias("chunk_id"), "file_id").distinct()
        for name, df in tables.items():
            own = df if "file_id" in df.columns else df.join(owners, "chunk_id")
            self._put(name, own, segment)
        return segment

    def _put(self, name: str, rows: DataFrame, segment: str) -> None:
        """Rows go to the segment's folder by name: a partitioned write would sort them all by it."""
        like = self.spark.createDataFrame([], self._segments(name).drop("segment").schema)
        full = like.unionByName(rows.select([c for c in rows.columns if c in like.columns]), allowMissingColumns=True)
        few = full.hint("rebalance") if small(full, 16 << 20) else full  # else each task's rows fill a file, and stay where they are
        with tidy(self.spark):
            few.write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/{name}/segment={segment}")

    def merge(self, fan: int = 4) -> int:
        """Puts segments of like size (of their live files, by powers of ``fan``) together, where there are ``fan`` of them; says how many went."""
        files, tiers = self.read("files"), {}
        for r in files.groupBy("segment").agg(F.sum("size_bytes").alias("n")).collect():  # a row a segment, and merging keeps them few
            if r["segment"] is not None:
                tiers.setdefault(int(math.log(max(1, r["n"] or 1), fan)), []).append(r["segment"])
        old = sorted(s for some in tiers.values() if len(some) >= fan for s in some)
        if old:
            segment = uuid.uuid4().hex
            live = files.where(F.col("segment").isin(old))
            for name in SEGMENTED:
                self._put(name, alive(self._segments(name).where(F.col("segment").isin(old)), live), segment)
            self.write("files", files.withColumn("segment", F.when(F.col("segment").isin(old), segment).otherwise(F.col("segment"))))
        return len(old)

    def read(self, name: str) -> DataFrame:
        if name in SEGMENTED:
            return alive(self._segments(name), self.read("files")).select([c.split()[0] for c in TABLES[name][0].split(", ")])
        schema, at = TABLES[name][0], self._current(name)
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{at}") if at else self.spark.createDataFrame([], schema)
        if name == "retrieval_cache" and (hits := self._hits()):
            n = self.spark.read.schema("query_hash string").parquet(*hits).groupBy("query_hash").agg(F.count(F.lit(1)).cast("int").alias("_n"))
            df = df.join(n, "query_hash", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).select(df.columns)
        return df

    def _hits(self) -> list[str]:
        """Files of hits since the cache table was written."""
        fs, p = self._fs(f"{self.folder}/cache_hits")
        return [str(x.getPath().toString()) for x in fs.listStatus(p) if not x.getPath().getName().startswith((".", "_"))] if fs.exists(p) else []

    def write(self, name: str, df: DataFrame, keep: bool = False) -> None:
        """A new version; the one before it goes once the name is set, or with ``sweep`` if kept. Fails if another writer
        has set a version meanwhile, rather than undo it."""
        old, new = self._current(name), f"v-{uuid.uuid4().hex}"
        hits = self._hits() if name == "retrieval_cache" else []
        columns = [c.split()[0] for c in TABLES[name][0].split(", ")]
        with tidy(self.spark):
            df.select(columns).write.option("compression", "zstd").parquet(f"{self.folder}/{name}/{new}")
        if self._current(name) != old:
            raise RuntimeError(f"another writer has changed {name}")
        for at in hits:  # their counts are in the new version
            fs, p = self._fs(at)
            fs.delete(p, True)
        fs, p = self._fs(f"{self.folder}/{name}/CURRENT")
        out = fs.create(p, True)
        out.write(bytearray(new.encode()))
        out.close()
        if old and not keep:
            fs.delete(self._fs(f"{self.folder}/{name}/{old}")[1], True)

    def sweep(self) -> None:
        """Removes all versions but the current ones, and segments that no file is in."""
        used = {f"segment={r['segment']}" for r in self.read("files").select("segment").distinct().collect()}
        for name in SEGMENTED:
            fs, p = self._fs(f"{self.folder}/{name}")
            for x in fs.listStatus(p) if fs.exists(p) else []:
                if x.isDirectory() and x.getPath().getName().startswith("segment=") and x.getPath().getName() not in used:
                    fs.delete(x.getPath(), True)
        for name in TABLES:
            fs, p = self._fs(f"{self.folder}/{name}")
            current = None if name in SEGMENTED else self._current(name)
            for x in fs.listStatus(p) if current else []:
                if x.getPath().getName() not in ("CURRENT", current):
                    fs.delete(x.getPath(), True)

    def upsert(self, name: str, new: DataFrame) -> None:
        self.write(name, upsert(self.read(name), new.select(self.read(name).columns), TABLES[name][1]))

    def wipe(self) -> None:
        fs, p = self._fs(self.folder)
        fs.delete(p, True)

    def set_metadata(self, key: str, value: str) -> None:
        self.upsert("indexing_metadata", self.spark.createDataFrame([(key, value)], TABLES["indexing_metadata"][0]))

    def metadata(self, key: str) -> str | None:
        row = self.read("indexing_metadata").where(F.col("key") == key).first()
        return row["value"] if row else None

    def cached(self, key: str) -> object | None:
        """The live result of a key; a hit is a small file beside the table, which later writes add up."""
        at = self._current("retrieval_cache")
        if at is None:
            return None
        cache = self.spark.read.schema(TABLES["retrieval_cache"][0]).parquet(f"{self.folder}/retrieval_cache/{at}")
        row = live(cache.where(F.col("query_hash") == key), F.current_timestamp()).first()
        if row is None:
            return None
        self.hit(self.spark.createDataFrame([(key,)], "query_hash string").coalesce(1))
        return json.loads(row["result_json"])

    def hit(self, keys: DataFrame) -> None:
        """Counts a hit for each row of ``keys`` (query_hash)."""
        keys.write.parquet(f"{self.folder}/cache_hits/{uuid.uuid4().hex}")

    def remember(self, key: str, value: object, ttl: int = fixed.CACHE_TTL_SECONDS) -> None:
        row = self.spark.createDataFrame([(key, json.dumps(value), 0, ttl)], "query_hash string, result_json string, hit_count int, ttl_seconds int")
        self.upsert("retrieval_cache", row.withColumn("created_at", F.current_timestamp()))

    def evict(self) -> int:
        """Removes what has outlived its time, and says how many."""
        cache = self.read("retrieval_cache")
        kept = cut(live(cache, F.current_timestamp()))
        gone = cache.count() - kept.count()
        if gone:
            self.write("retrieval_cache", kept)
        return gone

    def forget(self) -> None:
        self.write("retrieval_cache", self.spark.createDataFrame([], TABLES["retrieval_cache"][0]))


class Registry:
    """The catalog: which projects there are, a file each, so that writers of different projects don't meet."""

    SCHEMA = "project_id string, root string, created_at double"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self) -> list[dict]:
        fs, p = Store(self.spark, self.folder)._fs(f"{self.folder}/projects")
        if not fs.exists(p) or not fs.listStatus(p):
            return []
        return [r.asDict() for r in self.spark.read.schema(self.SCHEMA).json(f"{self.folder}/projects").collect()]

    def _file(self, key: str):
        return Store(self.spark, self.folder)._fs(f"{self.folder}/projects/{key}.json")

    @staticmethod
    def project_id(root: str) -> str:
        import hashlib

        return hashlib.sha1(root.encode()).hexdigest()

    def store(self, root: str) -> Store:
        key = self.project_id(root)
        fs, p = self._file(key)
        if not fs.exists(p):
            out = fs.create(p, True)
            out.write(bytearray(json.dumps({"project_id": key, "root": root, "created_at": time.time()}).encode()))
            out.close()
        return Store(self.spark, f"{self.folder}/{key}")

    def projects(self) -> list[dict]:
        """Each project with its size and whether its tables exist."""
        out = []
        for r in self._rows():
            fs, p = Store(self.spark, self.folder)._fs(f"{self.folder}/{r['project_id']}")
            there = fs.exists(p)
            out.append(r | {"exists": there, "size_bytes": fs.getContentSummary(p).getLength() if there else 0})
        return out

    def delete(self, root: str) -> bool:
        key = self.project_id(root)
        fs, p = self._file(key)
        if not fs.exists(p):
            return False
        Store(self.spark, f"{self.folder}/{key}").wipe()
        return bool(fs.delete(p, False))
