"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is a string of turns; a turn is 24 bytes, 16 of the SHA-256 of its role and text and 8 of its text's
length, so texts never move. Strings are dealt out by range of (first ``KEY_TURNS`` turns, conv_id): many copies of one
conversation are split by id. A task cuts what it gets into sorted runs, each in pages that hold, for each string, the LCP (in turns) with the one before
and the rest; Spark's sort keeps the pages, on disk if need be, in the order of their first strings. A loser tree merges the runs: of two strings that share more
with the last one written the one that shares more comes first, and only at a tie are turns compared, from the shared ones on. A run's next page is
read when its first string wins, so a task holds a page of each run. The merged stream feeds a stack of open nodes; a
string that shares fewer turns than are open finishes the deeper ones.

Only nodes on the first or last path of a task can go on in a neighbour. Such nodes are written as parts, with a digest of their path, and added up;
their number grows with tasks and depth, not with the conversations. Members that end in such a node go as sorted pieces of text into one stream a
node, as SHA-256 has to read them in order.

Defined results: rows without conv_id take no part; null role or text is empty; turns go by number, null first, equal
ones by the SHA-256 of role and text; repeated rows are turns each; an empty table has no nodes, not
even a root; other columns don't matter. A conversation's turns (24 bytes each, not its texts) have to fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stage

#: Bytes of a turn; turns of a string that decide its task.
TURN, KEY_TURNS = 24, 64
#: Bytes of strings in a task, a sorted run, and a page of a run; what a string takes besides its turns.
RANGE_BYTES, RUN_BYTES, PAGE_BYTES, EACH = 32 << 20, 4 << 20, 128 << 10, 64
#: Ids of members that a piece of text holds.
PIECE = 8192

PAGES = "part int, kind int, run int, first binary, first_id long, last binary, next binary, next_id long, next_lcp int, lcps binary, ids binary, ends binary, rest binary"
NODES = "kind int, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, path binary, up binary, above array<binary>, parent_conv_id long, ends string"
WHOLE, PART, MEMBERS = 0, 1, 2
ROOT = bytes(16)
NO_MEMBERS = hashlib.sha256().hexdigest()


def rebuilt(conversations: DataFrame, step: int = 5, most: int = 9) -> DataFrame:
    """conv_id and seq: the first h turns of conversation c - c % ``step``, then those of c after its first h; h is the CRC-32 of c in decimal, modulo ``most``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turn = F.concat(F.substring(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256), 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce(F.col("turn"), F.lit(0)).alias("b"), turn.alias("turn")).alias("x"))
    own = stage(rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["turn"]).alias("turns")), "conversations")
    heads = own.where(F.col("conv_id") % step == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % step).join(heads, "base", "left")
    turns = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return both.select("conv_id", F.unhex(F.array_join(turns, "")).alias("seq"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two strings share at their beginning."""
    n, i = min(len(a), len(b)) // TURN, 0
    for wide in (64, 8, 1):
        while n - i >= wide and a[i * TURN : (i + wide) * TURN] == b[i * TURN : (i + wide) * TURN]:
            i += wide
    return i


def run_pages(part: int, run: int, strings: list[tuple[bytes, int]], page_bytes: int, key_turns: int = KEY_TURNS) -> Iterator[tuple]:
    """A sorted run as rows of PAGES: its head, then its pages."""
    strings.sort()
    lcps = [0, *(shared(a[0], b[0]) for a, b in zip(strings, strings[1:], strict=False))]
    yield (part, 0, run, strings[0][0], strings[0][1], strings[-1][0][: key_turns * TURN], None, None, None, None, None, None, None)
    at = 0
    while at < len(strings):
        rest, end = [b""], at + 1  # the first string is in the column ``first``
        size = 0
        while end < len(strings) and size < page_bytes:
            rest.append(strings[end][0][lcps[end] * TURN :])
            size += len(rest[-1]) + 20
            end += 1
        more = strings[end] if end < len(strings) else (None, None)
        own = range(at, end)
        yield (part, 1, run, *strings[at], None, *more, lcps[end] if more[0] is not None else None, np.array([lcps[i] for i in own], np.int32).tobytes(), np.array([strings[i][1] for i in own], np.int64).tobytes(), np.cumsum([len(r) for r in rest]).astype(np.int64).tobytes(), b"".join(rest))
        at = end


def arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield arrow(held, schema)
            held = []
    if held:
        yield arrow(held, schema)


class Runs:
    """The runs of a task: of each its smallest string that isn't written yet, as what follows its first ``base`` turns, and
    its LCP with the last string written."""

    def __init__(self, heads: list[dict], pages: Iterator[dict]):
        self.pages, self.at = pages, {h["run"]: i for i, h in enumerate(heads)}
        self.tail, self.id = [h["first"] for h in heads], [h["first_id"] for h in heads]
        self.base, self.lcp = [0] * len(heads), [0] * len(heads)
        self.page, self.place = [None] * len(heads), [0] * len(heads)
        self.losers = [0] * len(heads)
        self.winner = self.play(1)

    def play(self, node: int) -> int:
        """The winner below a node of the tree; losers stay in it."""
        k = len(self.tail)
        if node >= k:
            return node - k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        if not self.before(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def before(self, a: int, b: int) -> bool:
        """Whether the string of run ``a`` comes first. Shared turns aren't compared again."""
        h = self.lcp[a]
        if h != self.lcp[b]:
            return h > self.lcp[b]
        if h < 0:  # both runs are over
            return True
        x, y = self.tail[a][(h - self.base[a]) * TURN :], self.tail[b][(h - self.base[b]) * TURN :]
        first = (x, self.id[a]) <= (y, self.id[b])
        self.lcp[b if first else a] = h + shared(x, y)
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(LCP with the one before, base, what follows the base, id) of all strings in order."""
        while self.tail and self.lcp[s := self.winner] >= 0:
            yield self.lcp[s], self.base[s], self.tail[s], self.id[s]
            self.advance(s)
            node = (s + len(self.tail)) // 2
            while node:
                if self.before(self.losers[node], s):
                    self.losers[node], s = s, self.losers[node]
                node //= 2
            self.winner = s

    def advance(self, s: int) -> None:
        """The next string of a run, whose last one was just written."""
        if self.page[s] is None:  # what won was the first string of a page still to be read: the next page in order
            p = next(self.pages)
            if self.at[p["run"]] != s:
                raise ValueError("pages are out of order")
            self.page[s] = [np.frombuffer(p[c], t) for c, t in (("lcps", np.int32), ("ids", np.int64), ("ends", np.int64))] + [p["rest"], p["next"], p["next_id"], p["next_lcp"]]
            self.place[s] = 0
        lcps, ids, ends, rest, following, next_id, next_lcp = self.page[s]
        self.place[s] += 1
        i = self.place[s]
        if i < len(lcps):
            self.lcp[s] = self.base[s] = int(lcps[i])
            self.tail[s], self.id[s] = rest[ends[i - 1] : ends[i]], int(ids[i])
        else:
            self.page[s], self.base[s] = None, 0
            self.lcp[s], self.tail[s], self.id[s] = (-1, b"", 0) if following is None else (next_lcp, following, next_id)


class Node:
    """An open node. ``path`` is None where all its members are in this task."""

    __slots__ = ("bytes", "children", "first", "ids", "last", "least", "leaves", "n", "path", "piece", "saved", "sha", "waiting")

    def __init__(self, size: int, path: bytes | None, first: bool, last: bool):
        self.bytes, self.path, self.first, self.last = size, path, first, last
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.sha, self.piece, self.ids, self.waiting = None, None, [], []


def finished(strings: Iterator[tuple[int, int, bytes, int]], first: bytes, last: bytes, key_turns: int = KEY_TURNS, piece: int = PIECE) -> Iterator[tuple]:
    """Rows of NODES from sorted strings, as nodes are finished. ``first``, ``last``: where the task's strings begin and end."""
    edges = [[e[i : i + TURN] for i in range(0, min(len(e), key_turns * TURN), TURN)] for e in (first, last)]
    stack: list[Node] = [Node(0, ROOT, True, True)]

    def below(up: Node, turn: bytes, depth: int) -> Node:
        on = [was and (depth > key_turns or (depth <= len(e) and e[depth - 1] == turn)) for was, e in zip((up.first, up.last), edges, strict=True)]
        path = hashlib.sha256(up.path + turn).digest()[:16] if up.path is not None and any(on) else None
        return Node(int.from_bytes(turn[16:]), path, *on)

    def pieces(x: Node) -> tuple:
        text, x.ids = ",".join(map(str, x.ids)), []
        return (MEMBERS, None, x.piece, None, None, None, None, None, x.path, None, None, None, text)

    def close() -> Iterator[tuple]:
        depth, x = len(stack) - 1, stack.pop()
        up = stack[-1] if stack else None
        if up is not None:
            up.n += x.n
            up.least = x.least if up.least is None else min(up.least, x.least)
        if x.path is not None:
            if x.ids:
                yield pieces(x)
            yield (PART, depth, x.least, x.n, x.children, x.leaves, x.saved, x.bytes, x.path, up.path if up else None, [n.path for n in stack], None, None)
            return
        leaves, saved = x.leaves or 1, x.saved + (x.n - 1) * x.bytes
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        for row in x.waiting:  # children know their parent's least member now
            yield (*row[:11], x.least, row[12])
        row = (WHOLE, depth, x.least, x.n, x.children, leaves, saved, x.bytes, None, up.path, None, None, x.sha.hexdigest() if x.sha else NO_MEMBERS)
        if up.path is not None:
            yield row
        else:
            up.waiting.append(row)

    for lcp, base, tail, conv in strings:
        while len(stack) - 1 > lcp:
            yield from close()
        for i in range((lcp - base) * TURN, len(tail), TURN):
            stack.append(below(stack[-1], tail[i : i + TURN], len(stack)))
        x = stack[-1]
        x.n += 1
        x.least = conv if x.least is None else min(x.least, conv)
        if x.path is None:
            if x.sha is None:
                x.sha = hashlib.sha256(str(conv).encode())
            else:
                x.sha.update(b",%d" % conv)
        else:
            if not x.ids:
                x.piece = conv
            x.ids.append(conv)
            if len(x.ids) == piece:
                yield pieces(x)
    while stack:
        yield from close()


def of_members(pieces: DataFrame) -> DataFrame:
    """path and ends_sha256: pieces of a path in order of their first ids, joined by commas, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sha = None, None
        for b in batches:
            for p, text in zip(b["path"].to_pylist(), b["ends"].to_pylist(), strict=True):
                if p == path:
                    sha.update(b"," + text.encode())
                    continue
                if sha:
                    yield pa.record_batch({"path": [path], "ends_sha256": [sha.hexdigest()]})
                path, sha = p, hashlib.sha256(text.encode())
        if sha:
            yield pa.record_batch({"path": [path], "ends_sha256": [sha.hexdigest()]})

    return pieces.select("path", "conv_id", "ends").repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(run, "path binary, ends_sha256 string")


def nodes(strings: DataFrame, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES, page_bytes: int = PAGE_BYTES, broadcast: int = 500_000, key_turns: int = KEY_TURNS, piece: int = PIECE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie over
    strings (conv_id long, seq binary, whole turns). Up to ``broadcast`` nodes at the tasks' edges are broadcast."""
    spark = strings.sparkSession
    strings = stage(strings.where("conv_id IS NOT NULL").select("conv_id", F.coalesce("seq", F.lit(b"")).alias("seq")), "strings")
    total = strings.agg(F.sum(F.octet_length("seq").cast("long") + EACH)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    dealt = strings.repartitionByRange(parts, F.substring("seq", 1, key_turns * TURN), "conv_id").withColumn("part", F.spark_partition_id())
    pages_schema, nodes_schema = (pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}[t]) for n, t in (c.split(" ") for c in s.split(", "))]) for s in (PAGES, NODES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size, n, part = [], 0, 0, 0
            for b in batches:
                for s, conv, part in zip(b["seq"].to_pylist(), b["conv_id"].to_pylist(), b["part"].to_pylist(), strict=True):
                    held.append((s, conv))
                    size += len(s) + EACH
                    if size >= run_bytes:
                        yield from run_pages(part, n, held, page_bytes, key_turns)
                        held, size, n = [], 0, n + 1
            if held:
                yield from run_pages(part, n, held, page_bytes, key_turns)

        yield from batched(rows(), pages_schema, 8)
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        heads, page = [], None
        for page in rows:
            if page["kind"]:
                break
            heads.append(page)
        if heads:
            rest = (p for some in ([page], rows) for p in some)
            merged = Runs(heads, rest)
            yield from batched(finished(iter(merged), min(h["first"] for h in heads), max(h["last"] for h in heads), key_turns, piece), nodes_schema, 4096)
        give_back()

    pages = dealt.mapInArrow(runs, PAGES).sortWithinPartitions("part", "kind", "first", "first_id")
    made = stage(pages.mapInArrow(merge, NODES), "nodes")

    part = made.where(F.col("kind") == PART).groupBy("depth", "path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("bytes").alias("bytes"), F.first("up").alias("up"), F.first("above").alias("above"))
    part = stage(part, "edges")
    hint = F.broadcast if part.count() <= broadcast else lambda df: df
    children = part.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("more"))
    own = part.join(children, "path", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = own.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes"))
    sums = own.select(F.explode(F.array_append("above", F.col("path"))).alias("path"), "n_leaves", "saved").groupBy("path").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    ends = of_members(made.where(F.col("kind") == MEMBERS))
    own = own.drop("n_leaves", "saved").join(sums, "path").join(ends, "path", "left").withColumn("ends", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))

    least = part.select(F.col("path").alias("up"), F.col("conv_id").alias("of_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    whole = made.where(F.col("kind") == WHOLE)
    inside = whole.where("up IS NULL").select(columns)
    under = whole.where("up IS NOT NULL").unionByName(own.select(whole.drop("kind", "above", "parent_conv_id", "bytes").columns), allowMissingColumns=True)
    under = under.join(hint(least), "up", "left").withColumn("parent_conv_id", F.col("of_parent")).select(columns)
    return inside.unionByName(under).withColumn("depth", F.col("depth").cast("long"))
