"""Exact deduplication by a Golomb-coded exchange of fingerprints.

Each partition sorts the fingerprints of its rows, codes the gaps by Golomb's code
and sends one block to the owner of each hash range. An owner finds the fingerprints
that more than one block has and sends back a bitmap for each block. The partition's
blocks and bitmaps give the suspects; only rows with a suspect fingerprint move, and
their bytes decide.

Defined results: a null text counts as empty; texts are equal when identical after
lower-casing A-Z only. Of equal texts the row with the largest id stays (nulls are
smaller than any id). Repeated rows, with the same id and text, are told apart: one
of them stays. An empty table gives no rows. Other columns of the table don't matter,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import members, stage, strangers, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fingerprints that one owner handles, about; 8 bytes each.
OWNER_ROWS = 2_000_000
#: Fingerprints that a task codes into one set of blocks.
TASK_ROWS = 4_000_000
#: Remainders that are packed at once; a multiple of 8, so that slices end with bytes.
SLICE = 1 << 16


def normalised(name: str = "text") -> Column:
    return F.translate(whole_text(name), UPPER, LOWER)


def fingerprint(name: str = "text") -> Column:
    """64 bits, equal for equal normalised texts: lower() also folds other letters, so
    it can only add suspects, which the bytes then tell apart."""
    return F.xxhash64(F.lower(whole_text(name)))


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted distinct uint64 values as Golomb-coded gaps, of parameter 2**k: the unary
    quotients as one bit stream, then the k-bit remainders."""
    n = len(values)
    if not n:
        return 0, b""
    gaps = np.concatenate([values[:1], np.diff(values) - np.uint64(1)])
    mean = float(values[-1] - values[0]) / n + 1
    low = int(min(62, max(0, np.floor(np.log2(max(1.0, mean * 0.69))))))
    k = min((low, low + 1), key=lambda k: n * k + int((gaps[1:] >> np.uint64(k)).sum()))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    # the first value is coded whole in the header, so that its quotient isn't long
    q[0] = 0
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = b"".join(np.packbits(((gaps[a : a + SLICE, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes() for a in range(0, n if k else 0, SLICE))
    return k, int(values[0]).to_bytes(8, "little") + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + rest


def golomb_decode(n: int, k: int, data: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    first, bits = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    cut = 16 + -(-bits // 8)
    unary = np.unpackbits(np.frombuffer(data[16:cut], np.uint8), count=bits)
    q = np.diff(np.flatnonzero(unary == 0), prepend=-1) - 1
    low, tail = np.zeros(n, np.uint64), np.frombuffer(data[cut:], np.uint8)
    for a in range(0, n if k else 0, SLICE):
        own = low[a : a + SLICE]
        rest = np.unpackbits(tail[a * k // 8 :][: -(-len(own) * k // 8)], count=len(own) * k).reshape(-1, k)
        for j in range(k):
            own <<= np.uint64(1)
            own |= rest[:, j]
    gaps = (q.astype(np.uint64) << np.uint64(k)) | low
    gaps[1:] += np.uint64(1)
    gaps[0] = first
    return np.cumsum(gaps, dtype=np.uint64)


BLOCK_SCHEMA = "part long, owner int, n long, k int, data binary, twice binary"


def blocks_of(fps: DataFrame, owners: int) -> DataFrame:
    """Rows of BLOCK_SCHEMA from a column fp: for each task and owner the distinct
    fingerprints, coded, and a bitmap of those that the task had more than once."""

    def code(batches):
        def out(parts, seq):
            values, times = np.unique(np.concatenate(parts), return_counts=True)
            owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            heads, rows = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1)), []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(values)], strict=True):  # never more rows than fingerprints
                k, data = golomb_encode(values[a:b])
                rows.append((task | seq << 32, int(owner[a]), b - a, k, data, np.packbits(times[a:b] > 1).tobytes()))
            names = ["part", "owner", "n", "k", "data", "twice"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        task, held, size, seq = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(np.asarray(batch.column(0)).view(np.uint64))
                size += batch.num_rows
            if size >= TASK_ROWS:
                yield out(held, seq)
                held, size, seq = [], 0, seq + 1
        if size:
            yield out(held, seq)

    return fps.mapInArrow(code, BLOCK_SCHEMA)


def answer(table: pa.Table) -> pa.Table:
    """At an owner: for each block the bitmap of its fingerprints that are in more than
    one block or more than once in one."""
    ns, ks, datas, twices = (table.column(c).to_pylist() for c in ("n", "k", "data", "twice"))
    values = [golomb_decode(n, k, d) for n, k, d in zip(ns, ks, datas, strict=True)]
    many = [np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for n, t in zip(ns, twices, strict=True)]
    every, flags = np.concatenate(values), np.concatenate(many)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    dup = same.copy()
    dup[:-1] |= same[1:]
    back = flags.copy()
    back[order] |= dup
    cuts = np.cumsum([0, *ns])
    return pa.table({"part": table.column("part"), "owner": table.column("owner"), "bits": pa.array([np.packbits(back[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def suspects(fps: DataFrame, n_rows: int) -> DataFrame:
    """Distinct fingerprints (column fp) that two rows or more have."""
    owners = max(1, -(-n_rows // OWNER_ROWS))
    sent = stage(blocks_of(fps, owners), "golomb")
    bitmaps = sent.select("part", "owner", "n", "k", "data", "twice").groupBy("owner").applyInArrow(answer, "part long, owner int, bits binary")

    def marked(batches):
        for b in batches:
            for n, k, data, bits in zip(*(b.column(c).to_pylist() for c in ("n", "k", "data", "bits")), strict=True):
                found = golomb_decode(n, k, data)[np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)]
                if len(found):
                    yield pa.record_batch({"fp": pa.array(found.view(np.int64))})

    back = sent.select("part", "owner", "n", "k", "data").join(bitmaps, ["part", "owner"])
    return stage(back.mapInArrow(marked, "fp long").distinct(), "suspects")


def _parts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The table with columns of our own names, the suspects and their number."""
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), fingerprint(text_col).alias("fp"))
    found = suspects(own.select("fp"), docs.select(F.lit(1)).count())
    return own, found, found.count()


def _verified(own: DataFrame, found: DataFrame, n: int, *more) -> DataFrame:
    """Groups of suspects with equal bytes: text_sha256, keep_id, group_size. A group's
    rows are counted before they move."""
    rows = members(own, found, ["fp"], n).withColumn("norm", normalised())
    groups = rows.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *more)
    return groups.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows without a suspect fingerprint are alone in their group. Texts of suspects are
    grouped by their bytes; text_sha256 then names a group, which is checked."""
    own, found, n = _parts(docs, id_col, text_col)
    alone = strangers(own, found, ["fp"], n).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(normalised(), 256).alias("text_sha256"))
    if not n:
        return alone
    groups = stage(_verified(own, found, n), "groups")
    if groups.groupBy("text_sha256").count().where("count > 1").limit(1).count():
        raise ValueError("two different texts have one SHA-256")
    rows = members(own, found, ["fp"], n).select("doc_id", F.sha2(normalised(), 256).alias("text_sha256"))
    n_groups = groups.count()
    rows = rows.join(F.broadcast(groups) if n_groups <= 200_000 else groups, "text_sha256")
    last = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")) == 1
    shared = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & last)
    return alone.unionByName(shared.select(*alone.columns))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), fingerprint(text_col).alias("fp"))
    found = suspects(packed.select("fp"), docs.select(F.lit(1)).count())
    n = found.count()
    alone = strangers(packed, found, ["fp"], n).select("row")
    if n:
        rows = members(packed, found, ["fp"], n).withColumn("norm", normalised())
        alone = alone.unionByName(rows.groupBy("norm").agg(F.max_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("row")).select("row"))
    return alone.select(*[F.col("row").getField(c).alias(c) for c in cols])
