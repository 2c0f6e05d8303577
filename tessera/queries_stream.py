"""Queries that run as streams or as table functions of SQL, and the same in DuckDB's SQL."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables
from .queries import SQL, query, read
from .sources.files import stream_path
from .sources.store import shared_folder
from .streaming import expiry, watch


def _streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream that ends."""
    return spark.readStream.schema(read(spark, d, name).schema).parquet(stream_path(f"{d}/{name}.parquet"))


def _out(stream: DataFrame) -> DataFrame:
    """What a stream gives until it has no more, written to a fresh folder and read back."""
    at = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/mark").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@query(SQL["event_throttle"])
def throttle_stream(spark, d):
    """``event_throttle`` by a stream with state."""
    found = _out(watch.throttle(_streamed(spark, d, "events"), "user_id", "ts", 3600.0))
    return found.select("user_id", F.round(F.col("ts_seconds") * 1_000_000).cast("long").alias("ts_us"))


@query("""WITH e AS (SELECT user_id, max(epoch_us(ts) // 1000) AS created_ms, count(*) AS writes FROM events GROUP BY user_id)
    SELECT user_id, created_ms, created_ms + 86400000 AS expired_ms, writes FROM e WHERE created_ms + 86400000 <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000""")
def expiry_stream(spark, d):
    """Events as entries of their users that live a day after the last one: those whose time is over ten minutes before the end."""
    with _set(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        return _out(expiry.expired(_streamed(spark, d, "events").withColumn("ttl", F.lit(86400)), "user_id", "ts", "ttl"))


@query(f"SELECT doc_id, shard_index, start_line, end_line, char_count FROM ({SQL['chunk_windows']}) WHERE shard_index IS NOT NULL")
def windows_in_sql(spark, d):
    """The windows of long documents by a table function beside the table."""
    tables.register(spark)
    view = f"documents_{uuid.uuid4().hex}"
    read(spark, d, "documents").createOrReplaceTempView(view)
    found = spark.sql(f"SELECT d.doc_id, w.shard_index, w.start_line, w.end_line, length(w.text) AS char_count FROM (SELECT doc_id, text FROM {view} WHERE length(text) >= 1204) d, LATERAL code_windows(d.text) w")
    spark.catalog.dropTempView(view)
    return found
