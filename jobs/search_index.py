"""Keeps a search index of a growing folder of documents current: positional postings and document lengths.

    python -m jobs.search_index DOCUMENTS INDEX CHECKPOINT [--config FILE]

DOCUMENTS is a folder of Parquet files to which files are added (or one file). A run takes the files that no run before has taken (a
file stream until it has no more, with its checkpoint) and writes, for each batch of files, a segment:

    INDEX/postings/segment=N/bucket=B    term, id, version, tf, doc_len, positions; a term's rows are in one bucket, sorted by term
    INDEX/documents/segment=N            id, version, n_terms, and the columns in ``keep``

What a run writes grows with the new files, not with the index. A batch that failed midway is taken again with the same files and number, and
replaces its segment. A run without new files changes nothing. An index has one checkpoint. A document that comes again replaces
its older rows (``current``): the newest segment counts, of several rows in one the greatest version, a hash of the text.

Null texts are empty; rows without an id are counted in the log and left out; repeated rows count once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators import positions
from tessera.queries import TERMS
from tessera.sources.files import stream_path
from tessera.sources.store import shared_folder

from . import log, main, settings

NAME = "search_index"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and no other."""
    df.write.partitionBy("segment", *by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def written(spark: SparkSession, path: str) -> int:
    """Rows of a partition, by its files' footers; it isn't there if it has none."""
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, conf: dict | None = None) -> dict:
    """Takes new files of ``documents`` into the index. What it did: batches, rows, rows without an id, postings."""
    c = conf or settings(NAME)
    index, kept = index.rstrip("/"), [k for k in c["keep"]]
    done = {"batches": 0, "rows": 0, "without_id": 0, "postings": 0}

    def segment(batch: DataFrame, number: int) -> None:
        text = F.coalesce(F.col(c["text"]).cast("string"), F.lit(""))
        rows = batch.select(F.col(c["id"]).alias("id"), text.alias("text"), F.xxhash64(text).alias("version"), *kept)
        n, without = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
        rows = rows.where(F.col("id").isNotNull()).dropDuplicates(["id", "version"])
        post = positions.placed(rows, ["id", "version"], "text")  # of a row by itself: texts are shuffled, not their words' places
        placed = post.withColumn("segment", F.lit(number)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(c["buckets"])).cast("int"))
        # whole buckets together, large ones split by size
        write(placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id"), f"{index}/postings", "bucket")
        sized = rows.select("id", "version", F.size(terms(F.col("text"))).cast("long").alias("n_terms"), *kept, F.lit(number).alias("segment"))
        write(sized, f"{index}/documents")
        made = written(spark, f"{index}/postings/segment={number}")
        log.info("segment %d: read %d rows (%d without an id), wrote %d postings to %s", number, n, without, made, index)
        for k, v in (("batches", 1), ("rows", n), ("without_id", without), ("postings", made)):
            done[k] += v

    schema = spark.read.parquet(documents).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(stream_path(documents))
    stream = new.writeStream.foreachBatch(segment).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("read %s: %s", documents, done)
    return done


def current(spark: SparkSession, index: str, few: int = 200_000) -> DataFrame:
    """The postings of each document's newest rows. Those of older rows are left out by a list of these, which is sent to the tasks if it has ``few`` at most;
    postings then stay where they are read."""
    docs = spark.read.parquet(f"{index.rstrip('/')}/documents").select("id", "segment", "version")
    newest = docs.groupBy("id").agg(F.max(F.struct("segment", "version")).alias("n")).select("id", "n.segment", "n.version")
    old = docs.join(newest, ["id", "segment", "version"], "left_anti")
    post, n = spark.read.parquet(f"{index.rstrip('/')}/postings"), old.count()
    return post.join(F.broadcast(old) if n <= few else old, ["id", "segment", "version"], "left_anti") if n else post


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, after two runs: the second finds nothing new."""
    at = f"{shared_folder(spark)}/{NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    rows = current(spark, f"{at}/index")
    return rows.select(F.col("id").alias("doc_id"), "term", "tf", "doc_len", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
    t AS (SELECT doc_id, {TERMS.format(c="text")} AS terms FROM d),
    p AS (SELECT doc_id, len(terms) AS doc_len, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM t)
    SELECT doc_id, term, count(*) AS tf, doc_len, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM p GROUP BY doc_id, term, doc_len"""

if __name__ == "__main__":
    main(NAME, run, "documents", "index", "checkpoint")
