"""Packing of token sequences: Martello and Toth's reduction by dominance, then best fit.

Sizes are integers up to the capacity, so an instance of any number of documents is
a histogram with one count for each size. The driver reduces and packs that
histogram, in steps that each place all equal cases at once; the plan has a few
thousand runs at most, whatever the input's size. A run says where items number
a to b of one size go. The items' numbers within their size are prefix sums over tasks, so
no size, however frequent, has to meet in one task.

Defined results: a null text is an empty one, which is the end id alone; ids are cast to long; repeated
rows are packed each; a document over the capacity is cut into whole sequences and a
rest; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, sent, stage, whole_text
from .tokenfile import WordEncoder, encoder


@dataclass
class Run:
    """Items first..first+n-1 of a size: ``each`` a sequence, from sequence ``seq`` and offset ``offset`` on."""

    size: int
    first: int
    n: int
    each: int
    seq: int
    offset: int


class Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.c, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            if not 0 < size <= capacity:
                raise ValueError(f"size {size} doesn't fit into {capacity}")
            self.left[size] += n
        self.given, self.runs, self.n_seq, self.fixed = self.left.copy(), [], 0, 0

    def take(self, size: int, n: int, each: int, seq: int, offset: int) -> None:
        self.runs.append(Run(size, int(self.given[size] - self.left[size]), n, each, seq, offset))
        self.left[size] -= n

    def fix(self, sizes: list[int]) -> None:
        """As many sequences of just these sizes as there are items for."""
        need = {s: sizes.count(s) for s in sizes}
        n, at = min(int(self.left[s]) // k for s, k in need.items()), 0
        for s, k in need.items():
            self.take(s, n * k, k, self.n_seq, at)
            at += s * k
        self.n_seq += n
        self.fixed += n

    def dominating(self, w: int) -> list[int] | None:
        """A set with an item of size ``w`` that provably dominates all other feasible
        sets with it, of three items at most; None if none is found."""
        left, rest = self.left.copy(), self.c - w
        left[w] -= 1
        sizes = np.flatnonzero(left[: rest + 1])
        if not len(sizes):
            return [w]
        v = int(sizes[-1])
        if v == rest:
            return [w, v]
        small = np.repeat(sizes[:3], np.minimum(left[sizes[:3]], 3))[:3]
        k = int(np.searchsorted(np.cumsum(small), rest, "right"))
        if k <= 1:
            return [w, v]
        if k > 2:
            return None
        a, b = self.pair(left, sizes, rest)
        if v >= a + b:
            return [w, v]
        if a == v:
            left[a] -= 1
            between = np.flatnonzero(left[b + 1 : rest + 1]) + b + 1
            two = np.repeat(between[:2], np.minimum(left[between[:2]], 2))[:2]
            if len(two) < 2 or two.sum() > rest:
                return [w, a, b]
        return None

    @staticmethod
    def pair(left: np.ndarray, sizes: np.ndarray, rest: int) -> tuple[int, int]:
        """The two items of the largest sum that fits, the larger one first; of equal sums the one with the largest item."""
        best, found, i, j = -1, (0, 0), 0, len(sizes) - 1
        while i <= j:
            total = int(sizes[i] + sizes[j])
            if total > rest or (i == j and left[sizes[i]] < 2):
                j -= 1
                continue
            if total > best:
                best, found = total, (int(sizes[j]), int(sizes[i]))
            i += 1
        return found

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for w in range(self.c, 0, -1):
                while self.left[w] and (found := self.dominating(w)):
                    self.fix(found)
                    changed = True

    def best_fit(self) -> None:
        """Decreasing best fit of what is left. Sequences of one rest, side by side, are a group."""
        rests: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def open_(rest: int, seq: int, n: int) -> None:
            if rest and n:
                if rest not in groups:
                    groups[rest] = []
                    insort(rests, rest)
                groups[rest].append((seq, n))

        for s in range(self.c, 0, -1):
            while n := int(self.left[s]):
                at = bisect_left(rests, s)
                if at < len(rests):
                    rest = rests[at]
                    seq, m = groups[rest].pop()
                    if not groups[rest]:
                        del groups[rest], rests[at]
                else:
                    rest, seq, m = self.c, self.n_seq, -(-n // (self.c // s))
                    self.n_seq += m
                each = rest // s
                full = min(m, n // each)
                if full:
                    self.take(s, full * each, each, seq, self.c - rest)
                    open_(rest - each * s, seq, full)
                    seq, m, n = seq + full, m - full, n - full * each
                if m and 0 < n < each:
                    self.take(s, n, n, seq, self.c - rest)
                    open_(rest - n * s, seq, 1)
                    seq, m = seq + 1, m - 1
                open_(rest, seq, m)

    def solve(self) -> list[Run]:
        self.reduce()
        self.best_fit()
        return self.runs


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: no packing has fewer sequences."""
    n = np.zeros(capacity + 1, np.int64)
    for s, k in counts.items():
        n[s] += k
    total, number, best = np.cumsum(n * np.arange(capacity + 1)), np.cumsum(n), 0
    for a in range(capacity // 2 + 1):
        above, half = int(number[capacity] - number[capacity - a]), int(number[capacity - a] - number[capacity // 2])
        free = half * capacity - int(total[capacity - a] - total[capacity // 2])
        rest = int(total[capacity // 2] - (total[a - 1] if a else 0))
        best = max(best, above + half + max(0, -(-(rest - free) // capacity)))
    return best


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", spell: bool = True) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32;
    part and number say which item of its size it is within its task."""

    def run(batches):
        e, end, task, seen = encoder(WordEncoder, path, "<u4", spell), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in blocks(batches):
            out = []
            for key, ids in zip(b.column("doc_id").to_pylist(), e.encode(b.column("text")), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    out.append((key, i, at // 4, n, zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long")


def dense_bases(t: pa.Table, capacity: int) -> pa.Table:
    """One row: a task, and by size how many items of that size there are in the tasks before it."""
    base = np.zeros(capacity, np.int64)
    base[np.asarray(t.column("length")) - 1] = np.asarray(t.column("base"))
    return pa.table({"part": t.column("part").slice(0, 1), "base": pa.array([base], pa.list_(pa.int64()))})


def placed(items: DataFrame, runs: list[Run]) -> DataFrame:
    """sequence_id and offset of each item (length, rank within its length)."""
    by_size: dict[int, list[Run]] = {}
    for r in runs:
        by_size.setdefault(r.size, []).append(r)
    table = {s: np.array([(r.first, r.each, r.seq, r.offset) for r in sorted(own, key=lambda r: r.first)], np.int64) for s, own in by_size.items()}
    plan = sent(items.sparkSession, table)  # a few runs for each of the sizes

    def run(batches):
        for b in batches:
            size, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own, t = order[a:z], plan.value[int(size[order[a]])]
                first, each, start, at = t[np.searchsorted(t[:, 0], rank[own], "right") - 1].T
                j = rank[own] - first
                seq[own], off[own] = start + j // each, at + j % each * size[own]
            cols = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(cols | {"sequence_id": pa.array(seq), "offset": pa.array(off)})

    return items.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", spell: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece; ``spell`` as in ``tokenfile.Encoder``."""
    items = stage(pieces(docs, path, end_id, capacity, id_col, text_col, spell), "pieces")
    by_task = stage(items.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each size
    runs = Packer(counts, capacity).solve()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each task, with a number for each size: much less than a row for each size of each task
    bases = stage(by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")).groupBy("part").applyInArrow(lambda t: dense_bases(t, capacity), "part int, base array<long>"), "bases")
    ranked = items.join(bases, "part").withColumn("rank", F.col("base")[(F.col("length") - 1).cast("int")] + F.col("number"))
    return placed(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), runs)
