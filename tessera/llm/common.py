"""What the operators of this subpackage share: scratch tables in the folder that
driver and executors share, word splitting on Arrow arrays, and sums of large
count tables that never meet in one task.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker handles at once; larger Arrow batches are cut.
BLOCK_BYTES = 4 << 20

_libc = ctypes.CDLL(None) if sys.platform == "linux" else None

#: What this process has made and not yet released: paths of the shared folder, and broadcasts.
_made: list[tuple[SparkSession, str | Broadcast]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Only where that is unset and executors are
    the driver's threads (tests, a laptop) a local folder takes its place."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        spark.sparkContext.setCheckpointDir(at := tempfile.mkdtemp(prefix="tessera-"))
    return at.rstrip("/")


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches of about ``most`` for this session's Python functions: buffers of whole partitions
    would be several times as large, in the JVM and in each worker. Parquet is read by fewer rows at once, too: 4096 whole
    texts are arrays of tens of MB in the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. ``release`` removes it."""
    path = f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts lineage, and a lost
    executor costs a reread only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast, which ``release`` takes back."""
    out = spark.sparkContext.broadcast(value)
    _made.append((spark, out))
    return out


def made() -> list[str | Broadcast]:
    """What ``scratch`` and ``sent`` have made and ``release`` hasn't taken back."""
    return [x for _, x in _made]


def release(spark: SparkSession, *things: str | Broadcast) -> None:
    """Takes back what ``scratch`` and ``sent`` made in this process: some of it, or all of it. Only
    call it once no DataFrame that reads it is needed."""
    for s, x in [y for y in _made if not things or any(y[1] is t or y[1] == t for t in things)]:
        if isinstance(x, str):
            target = spark._jvm.org.apache.hadoop.fs.Path(x)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        else:
            x.destroy()
        _made.remove((s, x))


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _made}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the JVM may be gone
            pass


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def members(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int, most: int = 500_000) -> DataFrame:
    """Rows of ``df`` with a key in ``keys`` (``n_keys`` rows, counted by the caller). Up
    to ``most`` keys are broadcast; more are shuffled, where Spark adds its own
    bloom filter on the large side and splits hot keys."""
    return df.join(F.broadcast(keys) if n_keys <= most else keys, on, "left_semi")


def strangers(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int, most: int = 500_000) -> DataFrame:
    """Rows of ``df`` without a key in ``keys``."""
    return df.join(F.broadcast(keys) if n_keys <= most else keys, on, "left_anti")


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, until - at)
            at = until
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the system; the worker stays for other tasks, which count it too."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def tidy(f: Callable) -> Callable:
    """``f``, what a task does with its batches, after which memory is given back: once its own variables are gone."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def split_words(text: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (runs of anything but space and 0x09-0x0D) of each text: the distinct
    words, the code of each word in reading order, and the offsets of the texts.
    Letters A-Z become lower case if ``lower``."""
    text = pc.fill_null(text, "")
    return coded_lists(pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text))


def coded_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lists of strings: the distinct ones, the code of each but the empty ones, and the offsets of the lists."""
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        kept = codes != empty
        before = np.concatenate([[0], np.cumsum(kept)])
        codes, ends = codes[kept], before[ends]
    return coded.dictionary, codes, ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..starts[0]+lengths[0]-1, starts[1].. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = lengths > 0
    s, n = starts[some].astype(np.int64), lengths[some].astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[heads] = s
    out[heads[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


SUM_SCHEMA = "chunk int, part int, data binary"


def count_rows(counts: np.ndarray, part: int, width: int) -> Iterator[pa.RecordBatch]:
    """A task's flat table of counts as rows of ``width`` counts for ``summed``; rows of
    zeros are left out."""
    table = counts.reshape(-1, width).astype(np.int64)
    some = np.flatnonzero(table.any(axis=1))
    for at in range(0, len(some), 64):
        ids = some[at : at + 64]
        yield pa.record_batch({"chunk": pa.array(ids, pa.int32()), "part": pa.array([part] * len(ids), pa.int32()), "data": pa.array([table[i].tobytes() for i in ids], pa.binary())})


def summed(rows: DataFrame, fan: int = 16) -> DataFrame:
    """Adds up rows of SUM_SCHEMA by chunk, in two steps: ``fan`` partial sums of each
    chunk, then their sum. A task holds a few sums, never the rows of a chunk."""

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for chunk, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                one = np.frombuffer(data, np.int64)
                sums[chunk, part] = sums[chunk, part] + one if (chunk, part) in sums else one
        for (chunk, part), s in sums.items():
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([s.tobytes()], pa.binary())})

    some = rows.withColumn("part", F.col("part") % fan).repartition(F.col("chunk"), F.col("part")).mapInArrow(add, SUM_SCHEMA)
    return some.withColumn("part", F.lit(0)).repartition("chunk").mapInArrow(add, SUM_SCHEMA)


def collect_sums(rows: DataFrame, n_chunks: int, width: int) -> np.ndarray:
    """The sums as one array; its size is that of the table, whatever the input's size."""
    out = np.zeros((n_chunks, width), np.int64)
    for r in summed(rows).select("chunk", "data").toLocalIterator():
        out[r["chunk"]] = np.frombuffer(r["data"], np.int64)
    return out.ravel()
