"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) p(column | class, history) p(word | class, column). A word's class is a
hash of its ending, so unseen words have one too; the end of a text has a class of its own. Within a class the
words' softmax has a weight for each column, a hash of the word's beginning and of the whole word: words of one column share
the weights of their histories and divide its probability by discounted counts; what is discounted goes to one unseen
word a column, so that the probabilities of all words add up to 1.

Both softmaxes have the same features of the history, hashed: the word before, it with the one before it (n-grams), the
word two back (skip) and the ending of the word before, each by whole words; in the second softmax with the class. A
feature is a row of weights, one for each class or column. Rows divide one table, whose size grows with the cube root of the corpus
(2^24 weights at 1 GB of text, 2^30 at 100 TB), so that every worker can hold it; counts of words grow with the
vocabulary and are never in one place.

Training covers every training text. A first pass cuts the texts into blocks (codes of words, and a dictionary each) and
counts, for each row of the table, the classes or columns that followed. Dictionaries go to owners of hash ranges of words, which
add up the counts and send each block the counts of its words: a row for each block and owner with words, so
never more rows than words. In each update, tasks work out what the current weights expect to follow in training
blocks (all of them in each update, unless a ``share`` is asked for in later ones; tokens of a few blocks with the same history and class once),
the expectations are summed by range of rows, and
there each weight takes a step along its gradient, what was counted less what is expected, scaled by itself as in iterative
scaling. In the first update all weights are zero and all histories of a class expect the same, so that tasks only count classes for each row. Neither tables nor gradients pass through the driver; weights are read from the shared folder. Scoring
takes blocks as numpy batches.

Defined results: a null text counts as empty, which has one token, the end; ids are cast to long, a null id
is the empty string for the choice of training texts; repeated rows count each; an
empty table gives no rows; without training texts each word is unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, ragged, scratch, split_words, stage, whole_text
from .tokenfile import _uri as uri

#: Not a word: words have no space.
END = " end"
#: Classes, and columns of a class: the softmaxes' widths. The last class is the end's.
WIDTH = 64
#: Rows in a range that is summed and updated at once.
RANGE = 1024
#: Buckets of endings, and rows of them with classes.
ENDINGS, ENDING_ROWS = 1024, 8192
#: Tokens whose rows are added up at once: enough for few calls of numpy, few enough for the cache.
SLICE = 8192
#: Rows of a slice whose running sums are worked out one after the other, and for all such pieces of the slice at once.
PIECE = 32
#: A context that was seen more often is repeated, as running sums of large numbers lose small ones.
MOST_SEEN = 8
#: Tokens of blocks whose contexts are found at once, and contexts taken at once.
TOKENS, CONTEXTS = 4 << 20, 512 << 10


@dataclass(frozen=True)
class Shape:
    bits: float = 24.0  # log2 of the weights at 1 GB of text
    least_bits: int = 18
    updates: int = 2
    rates: tuple[float, ...] = (0.8, 0.3)
    block_bytes: int = 4 << 20
    share: float = 1.0  # of the blocks, in updates after the first,
    least: int = 1_000_000  # but so many tokens at least
    blocks_a_task: int = 24  # in an update: a task sends a table of expectations, whatever it reads
    smooth: float = 8.0  # added to counts and expectations
    most: float = 4.0  # weights stay within
    discount: float = 0.75
    skip_modulus: int = 7
    skip_remainder: int = 2

    def row_bits(self, text_bytes: int) -> int:
        """log2 of the rows without those of endings."""
        return max(self.least_bits, round(self.bits + np.log2(max(text_bytes, 1) / 1e9) / 3)) - 6

    def rows(self, bits: int) -> int:
        return (1 << bits) + ENDINGS + ENDING_ROWS


def held_out(key, shape: Shape) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % shape.skip_modulus == shape.skip_remainder


def packed(a: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: high bytes are mostly alike."""
    return pa.compress(np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T), "zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


def kinds(words: list[str]) -> np.ndarray:
    """For each word its hash, and its ending's bucket, class and column in one number."""
    h = np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32)
    ending = np.array([zlib.crc32(w[-3:].encode()) for w in words], np.uint32)
    start = np.array([zlib.crc32(w[:2].encode()) for w in words], np.uint32)
    cls, column = (ending >> 8) % (WIDTH - 1), start % 8 << 3 | h % 8
    last = np.array([w == END for w in words], bool)
    cls[last], column[last] = WIDTH - 1, 0
    return np.stack([h, ending % ENDINGS << 12 | cls << 6 | column])


def cell(own: np.ndarray) -> np.ndarray:
    """class * WIDTH + column."""
    return (own[1] & np.uint32(0xFFF)).astype(np.int64)


def mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def before(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words one and two before each token. Before a text's first word stands the end."""
    one, two = np.full((2, len(codes)), codes[-1], codes.dtype)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    two[ends[:-1]] = codes[-1]  # only a text's first token reaches over the end before it
    return one, two


def rows_of(own: np.ndarray, one: np.ndarray, two: np.ndarray, cls: np.ndarray, bits: int) -> np.ndarray:
    """The rows of a history's features, four for the class and four for the column, given the class."""
    one, ending, two = own[0][one], own[1][one] >> np.uint32(12), own[0][two]
    salt = cls.astype(np.uint32) * np.uint32(0x85EBCA6B)
    pair = mix32(one * np.uint32(0x9E3779B1) + two)
    top = lambda x, b: (x >> np.uint32(32 - b)).astype(np.int32)
    at = [np.int32((1 << bits) // 8 * i) for i in range(9)]
    return np.stack([
        top(one, bits - 2), at[2] + top(mix32(two + np.uint32(1)), bits - 3), at[3] + top(pair, bits - 3), at[8] + ending.astype(np.int32),
        at[4] + top(mix32(one + salt), bits - 2), at[6] + top(mix32(two + salt + np.uint32(1)), bits - 3), at[7] + top(mix32(pair + salt), bits - 3),
        at[8] + np.int32(ENDINGS) + (mix32(ending + salt) % np.uint32(ENDING_ROWS)).astype(np.int32),
    ])


def features(own: np.ndarray, codes: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token the rows of its history's features, its class and its column."""
    at = cell(own)[codes]
    cls, column = at // WIDTH, at % WIDTH
    return rows_of(own, *before(codes, ends), cls, bits), cls, column


def contexts(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, class and number of the tokens that are on in blocks (words' kinds, codes, ends, on), once for all those with one history and class, some at
    a time. They come by the ending of the word before, class and word before, so that equal rows of these are neighbours."""
    words = np.concatenate([own[0].astype(np.uint64) << np.uint64(32) | own[1] for own, *_ in blocks])
    words, code = np.unique(words, return_inverse=True)
    every, n, first, keys = np.stack([words >> np.uint64(32), words & np.uint64(0xFFFFFFFF)]).astype(np.uint32), len(words), 0, []
    ending = (every[1] >> np.uint32(12)).astype(np.int64)
    for own, codes, ends, on in blocks:
        one, two = (code[first + x[on]] for x in before(codes, ends))
        cls, first = (cell(own) // WIDTH)[codes[on]], first + own.shape[1]
        if n > 1 << 23:  # too many words for one number of all
            yield rows_of(every, one, two, cls, bits), cls, np.ones(len(cls), np.float32)
        else:
            keys.append(((ending[one] * WIDTH + cls) * n + one) * n + two)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    del keys, code, words
    key.sort()
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    seen, key = np.diff(heads, append=len(key)), key[heads]
    times = -(-seen // MOST_SEEN)
    seen, key = np.repeat((seen / times).astype(np.float32), times), np.repeat(key, times)
    for a in range(0, len(key), CONTEXTS):
        one, two = np.divmod(key[a : a + CONTEXTS], n)
        cls, one = np.divmod(one, n)
        cls %= WIDTH
        yield rows_of(every, one, two, cls, bits), cls, seen[a : a + CONTEXTS]


def count(table: np.ndarray, rows: np.ndarray, cls: np.ndarray, column: np.ndarray) -> None:
    """Adds to the flat table what followed each row."""
    for j, r in enumerate(rows):
        seen = r.astype(np.int32 if len(table) < 2**31 else np.int64) * WIDTH
        seen += (cls if j < 4 else column).astype(seen.dtype)
        seen.sort()
        heads = np.flatnonzero(np.diff(seen, prepend=-1))
        table[seen[heads]] += np.diff(heads, append=len(seen)).astype(table.dtype)


SUMS = "part int, kind int, data binary"
#: Kinds of rows of SUMS: counts, weights, expectations.
COUNTS, WEIGHTS, EXPECTED = range(3)


def sums(table: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Ranges of the table that aren't zero, as rows of SUMS; expectations with 8 bits of precision."""
    for i in range(0, len(table), RANGE):
        own = table[i : i + RANGE]
        if own.any():
            data = packed((own.view(np.uint32) + np.uint32(0x8000) >> np.uint32(16)).astype("<u2") if kind == EXPECTED else own)
            yield pa.record_batch({"part": pa.array([i // RANGE], pa.int32()), "kind": pa.array([kind], pa.int32()), "data": pa.array([data], pa.binary())})


def summed(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], np.ndarray]:
    """What a task's ranges add up to, by range and kind."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for part, kind, data in zip(*[b.column(c).to_pylist() for c in ("part", "kind", "data")], strict=True):
            if kind == EXPECTED:
                own = (unpacked(data, "<u2", RANGE * WIDTH).astype(np.uint32) << np.uint32(16)).view(np.float32)
            else:
                own = unpacked(data, "<i4" if kind == COUNTS else "<f4", RANGE * WIDTH)
            own = own.reshape(RANGE, WIDTH)
            out[part, kind] = out[part, kind] + own if (part, kind) in out else own
    return out


BLOCK_SCHEMA = f"block long, n int, doc_ids array<long>, held array<boolean>, ends binary, codes binary, n_words int, words binary, kinds binary, {SUMS}"


def tokenised(docs: DataFrame, shape: Shape, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of BLOCK_SCHEMA: a block each, and at a task's end (block is null) its counts of what followed, in rows of SUMS."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        table = np.zeros(shape.rows(bits) * WIDTH, np.int32)
        for b in blocks(batches, most=shape.block_bytes):
            words, codes, ends = split_words(b.column("text"))
            words = [*words.to_pylist(), END]
            n = np.diff(ends)
            full = np.full(len(codes) + len(n), len(words) - 1, np.int32)
            ends = ends + np.arange(len(ends))
            full[ragged(ends[:-1], n)] = codes
            keys = b.column("doc_id").to_pylist()
            held = np.array([held_out(k, shape) for k in keys], bool)
            own = kinds(words)
            rows, cls, column = features(own, full, ends, bits)
            on = np.repeat(~held, np.diff(ends))
            count(table, rows[:, on], cls[on], column[on])
            yield row(block=task << 32 | seq, n=len(full), doc_ids=keys, held=held.tolist(), ends=ends.astype("<i8").tobytes(), codes=packed(full.astype("<i4")), n_words=len(words), words=joined(words), kinds=packed(own.astype("<u4")))
            seq += 1
        for s in sums(table.reshape(-1, WIDTH), COUNTS):
            yield row(**{k: v[0] for k, v in s.to_pydict().items()})
        del table
        give_back()

    def row(**x):
        return pa.record_batch([pa.array([x.get(f.name)], f.type) for f in schema], schema=schema)

    kind = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    schema = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in BLOCK_SCHEMA.split(", ")])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, BLOCK_SCHEMA)


def joined(words: list[str]) -> bytes:
    data = "\n".join(words).encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def parted(data: bytes) -> list[str]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).decode().split("\n")


class Block:
    """A row of BLOCK_SCHEMA."""

    def __init__(self, b: pa.RecordBatch, i: int):
        get = lambda c: b.column(c)[i].as_py()
        self.n, self.ends = get("n"), np.frombuffer(get("ends"), "<i8")
        self.codes, self.own = unpacked(get("codes"), "<i4", self.n), unpacked(get("kinds"), "<u4", 2 * get("n_words")).reshape(2, -1)
        self.training = np.repeat(~np.array(get("held"), bool), np.diff(self.ends))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Blocks as ``contexts`` takes them, so many tokens at once."""
    some, n = [], 0
    for b in batches:
        for i in range(b.num_rows):
            block = Block(b, i)
            if some and n + block.n > TOKENS:
                yield some
                some, n = [], 0
            some.append((block.own, block.codes, block.ends, block.training))
            n += block.n
    if some:
        yield some


def exchange(parts: DataFrame, owners: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """For each block the training counts of its words (block, owner, counts), and the
    totals by class and column: tokens and distinct words."""

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                block, words = Block(b, i), parted(b.column("words")[i].as_py())
                counts = np.bincount(block.codes[block.training], minlength=len(words))
                owner = owner_of(block.own[0], owners)
                order = np.argsort(owner, kind="stable")
                heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
                for a, z in zip(heads.tolist(), [*heads[1:].tolist(), len(order)], strict=True):
                    own = order[a:z]
                    yield pa.record_batch({"block": b.column("block").slice(i, 1), "owner": pa.array([int(owner[own[0]])], pa.int32()), "words": pa.array([joined([words[j] for j in own.tolist()])], pa.binary()), "counts": pa.array([packed(counts[own].astype("<i8"))], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        lists = [parted(w) for w in t.column("words").to_pylist()]
        coded = pa.array([w for ws in lists for w in ws], pa.string()).dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary.to_pylist()
        counts = np.concatenate([unpacked(c, "<i8", len(ws)) for c, ws in zip(t.column("counts").to_pylist(), lists, strict=True)])
        total = np.bincount(codes, counts, minlength=len(words)).astype("<i8")
        at = cell(kinds(words))
        stats = np.concatenate([np.bincount(at, total, minlength=WIDTH**2), np.bincount(at, total > 0, minlength=WIDTH**2)]).astype("<i8")
        back = np.split(total[codes], np.cumsum([len(w) for w in lists])[:-1])
        owner = t.column("owner")[0].as_py()
        return pa.table({"block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "owner": pa.array([owner] * (len(lists) + 1), pa.int32()), "counts": pa.array([*(packed(x) for x in back), stats.tobytes()], pa.binary())})

    sent = parts.select("block", "n", "held", "ends", "codes", "n_words", "words", "kinds").mapInArrow(send, "block long, owner int, words binary, counts binary")
    got = stage(sent.groupBy("owner").applyInArrow(add, "block long, owner int, counts binary"), "counts")
    stats = np.zeros(2 * WIDTH**2, np.int64)
    for r in got.where("block is null").select("counts").toLocalIterator():  # one row for each owner
        stats += np.frombuffer(r["counts"], "<i8")
    tokens, distinct = stats.reshape(2, WIDTH, WIDTH)
    return got.where("block is not null"), tokens, distinct


def owner_of(hashed: np.ndarray, owners: int) -> np.ndarray:
    return hashed.astype(np.int64) * owners >> 32


@dataclass
class Priors:
    """Logarithms of the shares of classes, and of columns in their class."""

    classes: np.ndarray
    columns: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray) -> Priors:
        share = (tokens.sum(axis=1) + 1) / (tokens.sum() + WIDTH)
        within = (tokens + 0.5) / (tokens.sum(axis=1, keepdims=True) + WIDTH / 2)
        within[-1] = np.eye(WIDTH)[0]  # the end is the one word of its class
        return cls(np.log(share).astype(np.float32), np.log(np.maximum(within, 1e-30)).astype(np.float32))

    def usual(self, part: int, bits: int) -> np.ndarray:
        """What any history expects, for the rows of a range."""
        row = np.arange(part * RANGE, (part + 1) * RANGE)
        of_class = (row < 1 << bits - 1) | (row >= 1 << bits) & (row < (1 << bits) + ENDINGS)
        share = np.exp(self.classes) / np.exp(self.classes).sum()
        return np.where(of_class[:, None], share, share @ np.exp(self.columns)).astype(np.float32)


def softmaxes(table: np.ndarray, prior: Priors, rows: np.ndarray, cls: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(layer, where a slice begins, unnormalised probabilities of its classes or columns); arrays are used again, so that a taker may change them."""
    z, y = np.empty((2, SLICE, WIDTH), np.float32)
    for a in range(0, rows.shape[1], SLICE):
        n = min(SLICE, rows.shape[1] - a)
        for layer in (0, 1):
            np.take(prior.columns, cls[a : a + n], axis=0, out=z[:n], mode="clip") if layer else np.copyto(z[:n], prior.classes)
            for r in rows[4 * layer : 4 * layer + 4, a : a + n]:
                np.take(table, r, axis=0, out=y[:n], mode="clip")
                z[:n] += y[:n]
            np.exp(z[:n], out=z[:n])
            yield layer, a, z[:n]


def log_likelihood(table: np.ndarray, prior: Priors, rows: np.ndarray, cls: np.ndarray, column: np.ndarray) -> np.ndarray:
    """ln p(class | history) + ln p(column | class, history) of each token."""
    out, ones = np.zeros(rows.shape[1]), np.ones(WIDTH, np.float32)
    for layer, a, p in softmaxes(table, prior, rows, cls):
        k = (column if layer else cls)[a : a + len(p)]
        out[a : a + len(p)] += np.log(p.ravel()[np.arange(len(p)) * WIDTH + k] / (p @ ones))
    return out


def runs(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each slice of rows: an order that brings equal ones together, and whether another one comes next."""
    place = max(1, SLICE - 1).bit_length()
    r = r.astype(np.int64) << place
    for a in range(0, len(r), SLICE):
        r[a : a + SLICE] |= np.arange(len(r[a : a + SLICE]))
        r[a : a + SLICE].sort()
    own = r >> place
    ends = np.append(own[1:] != own[:-1], True)
    ends[SLICE - 1 :: SLICE] = True
    return r & (1 << place) - 1, ends


class Adder:
    """Adds probabilities of a slice's tokens to rows of ``out``; arrays for a slice are used again."""

    def __init__(self, out: np.ndarray):
        self.out, size = out, -(-SLICE // PIECE) * PIECE
        self.own, self.at, self.sums, self.less = np.empty((4, size, WIDTH), np.float32)

    def put(self, r: np.ndarray, p: np.ndarray) -> None:
        """out[r] += p, where no row comes again."""
        own = np.take(self.out, r, axis=0, out=self.own[: len(r)], mode="clip")
        own += p
        self.out[r] = own

    def run_sums(self, p: np.ndarray, order: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the runs of rows, taken in ``order``, that end at the places ``last``: differences of running sums, which go on in pieces side by side."""
        pieces = -(-len(order) // PIECE)
        at = np.zeros(pieces * PIECE, np.int64)
        at[: len(order)] = order
        x = np.take(p, at.reshape(pieces, PIECE).T.ravel(), axis=0, out=self.at[: len(at)], mode="clip").reshape(PIECE, pieces, WIDTH)
        for i in range(1, PIECE):
            np.add(x[i], x[i - 1], out=x[i])
        x[:, 1:] += np.add.accumulate(x[-1, :-1], axis=0)
        upto = np.take(self.at, last % PIECE * pieces + last // PIECE, axis=0, out=self.sums[: len(last)], mode="clip")
        less = self.less[: len(last) - 1]
        np.copyto(less, upto[:-1])
        upto[1:] -= less
        return upto

    def add(self, r: np.ndarray, p: np.ndarray, order: np.ndarray, ends: np.ndarray) -> None:
        """out[r] += p for a slice with its ``runs``: a run's last row as it is, the others by their sum."""
        last = order[ends]
        self.put(r[last], np.take(p, last, axis=0, out=self.at[: len(last)], mode="clip"))
        if len(last) < len(order):
            order = order[~ends]
            own = r[order]
            last = np.flatnonzero(np.append(own[1:] != own[:-1], True))
            self.put(own[last], self.run_sums(p, order, last))


def expectations(table: np.ndarray, prior: Priors, rows: np.ndarray, cls: np.ndarray, out: np.ndarray, seen: np.ndarray | None = None) -> None:
    """Adds to each row the probabilities of the tokens that have it; ``seen`` says how many tokens each stands for. Neighbours with one word before
    (as ``contexts`` gives them) are added up before they are added to its rows and its ending's."""
    ones, adder = np.ones(WIDTH, np.float32), Adder(out)
    found = {i: runs(rows[i]) for i in (1, 2, 5, 6)}
    for layer, a, p in softmaxes(table, prior, rows, cls):
        z = a + len(p)
        p *= ((1 if seen is None else seen[a:z]) / (p @ ones))[:, None]
        for i in (4 * layer + 1, 4 * layer + 2):
            order, ends = found[i]
            adder.add(rows[i, a:z], p, order[a:z], ends[a:z])
        one, ending = rows[4 * layer, a:z], rows[4 * layer + 3, a:z]
        last = np.flatnonzero(np.append((one[1:] != one[:-1]) | (ending[1:] != ending[:-1]), True))
        p[: len(last)] = adder.run_sums(p, np.arange(len(p)), last)
        for r in (one[last], ending[last]):
            adder.add(r, p[: len(last)], *runs(r))


def first_expectations(rows: np.ndarray, cls: np.ndarray, seen: np.ndarray) -> None:
    """Counts the classes of the tokens that have each of the columns' rows (``seen``: flat, rows by classes)."""
    for r in rows[4:]:
        at = r.astype(np.int64) * WIDTH + cls
        at.sort()
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        seen[at[heads]] += np.diff(heads, append=len(at)).astype(seen.dtype)


def step(weights: np.ndarray, counts: np.ndarray, expected: np.ndarray, usual: np.ndarray, rate: float, s: Shape) -> np.ndarray:
    """The weights of some rows after an update. A row's expectations are brought to its counts, as they may be of a share of the
    tokens; where none were sent (the classes' rows in the first update, tokens that the share doesn't hold) they are those of any history (``usual``). The gradient is counts less expectations; log1p of its share of the expectation keeps a step from going too far."""
    total, n = expected.sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True).astype(np.float32)
    expected = np.where(total > 0, expected * (n / np.maximum(total, 1e-9)), n * usual)
    gradient = counts - expected
    moved = weights + np.float32(rate) * np.log1p(gradient / (expected + np.float32(s.smooth)))
    return np.clip(moved, -s.most, s.most).astype(np.float32)


_read: dict[str, np.ndarray] = {}


def weights_in(folder: str, rows: int) -> np.ndarray:
    """The table from the shared folder, once for each Python worker; an older one is forgotten."""
    if folder not in _read:
        _read.clear()
        fs, root = pafs.FileSystem.from_uri(uri(folder))
        table = np.zeros((rows, WIDTH), np.float32)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.path.endswith(".parquet"):
                t = pq.read_table(f.path, columns=["part", "kind", "data"], filesystem=fs)
                for part, kind, data in zip(*[t.column(c).to_pylist() for c in ("part", "kind", "data")], strict=True):
                    if kind == WEIGHTS:
                        table[part * RANGE : (part + 1) * RANGE] = unpacked(data, "<f4", RANGE * WIDTH).reshape(RANGE, WIDTH)
        _read[folder] = table
    return _read[folder]


def train(parts: DataFrame, counts: DataFrame, prior: Priors, tokens: int, n_blocks: int, bits: int, s: Shape) -> str | None:
    """The folder of the weights (and counts) by range; None without updates."""
    spark, rows, folder = parts.sparkSession, s.rows(bits), None

    def add(batches):
        for (part, kind), own in summed(batches).items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "data": pa.array([packed(own)], pa.binary())})

    counted = stage(counts.repartition("part").mapInArrow(add, SUMS), "followed")
    state = counted
    for rate in s.rates[: s.updates]:

        def first(batches):
            seen = np.zeros(rows * WIDTH, np.int32)
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(b, i)
                    f, cls, _ = features(block.own, block.codes, block.ends, bits)
                    first_expectations(f[:, block.training], cls[block.training], seen)
            within = np.exp(prior.columns)
            within /= within.sum(axis=1, keepdims=True)
            for at in range(0, rows, RANGE):  # the classes' rows expect what any history does
                own = seen[at * WIDTH : (at + RANGE) * WIDTH].reshape(-1, WIDTH)
                if own.any():
                    for part in sums(own.astype(np.float32) @ within, EXPECTED):
                        yield part.set_column(0, "part", pa.array([at // RANGE], pa.int32()))
            del seen
            give_back()

        def expect(batches, folder=folder):
            table, out = weights_in(folder, rows), np.zeros((rows, WIDTH), np.float32)
            for some in together(batches):
                for f, cls, seen in contexts(some, bits):
                    expectations(table, prior, f, cls, out, seen)
                    del f, cls, seen
            yield from sums(out, EXPECTED)
            del out
            give_back()

        def update(batches, rate=rate):
            own = summed(batches)
            for part in {p for p, k in own if k == COUNTS}:
                counted, zero = own[part, COUNTS], np.zeros((RANGE, WIDTH), np.float32)
                new = step(own.get((part, WEIGHTS), zero), counted, own.get((part, EXPECTED), zero), prior.usual(part, bits), rate, s)
                for kind, x in ((COUNTS, counted), (WEIGHTS, new)):
                    yield pa.record_batch({"part": pa.array([part], pa.int32()), "kind": pa.array([kind], pa.int32()), "data": pa.array([packed(x)], pa.binary())})
            del own
            give_back()

        share = min(1.0, max(s.share, s.least / max(tokens, 1))) if folder else 1.0
        some = parts.where(F.pmod(F.xxhash64(F.lit(rate), "block"), F.lit(1 << 20)) < int(share * (1 << 20))).select("n", "held", "ends", "codes", "n_words", "kinds")
        some = some.coalesce(max(1, -(-int(share * n_blocks) // s.blocks_a_task)))  # files as they are: blocks don't move
        expected = some.mapInArrow(expect if folder else first, SUMS)
        new = state.unionByName(expected).repartition("part").mapInArrow(update, SUMS)
        folder = scratch(spark, "weights")
        new.write.parquet(folder)
        state = spark.read.schema(new.schema).parquet(folder)
    return folder


def score(docs: DataFrame, shape: Shape | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    s = shape or Shape()
    spark = docs.sparkSession
    bits = s.row_bits(docs.select(F.sum(F.octet_length(whole_text(text_col)).cast("long"))).first()[0] or 0)
    made = stage(tokenised(docs, s, bits, id_col, text_col), "blocks")
    parts = made.where("block is not null").drop("part", "kind", "data")
    entries, n_blocks = parts.select(F.sum("n_words"), F.count(F.lit(1))).first()
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(entries or 0) // 1_000_000))
    counts, tokens, distinct = exchange(parts, owners)
    prior, n_all, v_all = Priors.of(tokens), int(tokens.sum()), int(distinct.sum())
    folder = train(parts, made.where("block is null").select("part", "kind", "data"), prior, n_all, n_blocks, bits, s)
    answers = counts.groupBy("block").agg(F.collect_list(F.struct("owner", "counts")).alias("answers"))  # an answer for each owner

    def run(batches):
        table = weights_in(folder, s.rows(bits)) if folder else np.zeros((s.rows(bits), WIDTH), np.float32)
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b, i)
                owner, c = owner_of(block.own[0], owners), np.zeros(block.own.shape[1], np.int64)
                order = np.argsort(owner, kind="stable")
                at = np.searchsorted(owner[order], np.arange(owners + 1))
                for a in b.column("answers")[i].as_py():
                    own = order[at[a["owner"]] : at[a["owner"] + 1]]
                    c[own] = unpacked(a["counts"], "<i8", len(own))
                f, cls, column = features(block.own, block.codes, block.ends, bits)
                by_class = log_likelihood(table, prior, f, cls, column)
                k = cell(block.own)
                t, v = tokens.ravel()[k].astype(float), distinct.ravel()[k]
                unseen = np.where(t > 0, s.discount * v / np.maximum(t, 1), 1.0)
                in_column = np.log(np.where(c > 0, (c - s.discount) / np.maximum(t, 1), unseen))
                base = np.log10((c + 1) / (n_all + v_all + 1))
                heads, n = block.ends[:-1], np.diff(block.ends)
                yield pa.record_batch({
                    "doc_id": b.column("doc_ids")[i].values, "held_out": b.column("held")[i].values,
                    "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(np.add.reduceat((c > 0)[block.codes].astype(np.int64), heads)),
                    "train_tokens": pa.array([n_all] * len(n), pa.int64()), "base_score": pa.array(np.add.reduceat(base[block.codes], heads)),
                    "score": pa.array(np.add.reduceat(by_class + in_column[block.codes], heads) / np.log(10)),
                })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # blocks are large rows: hashing the answers spares sorting them
    return parts.select("block", "n", "doc_ids", "held", "ends", "codes", "n_words", "kinds").join(answers.hint("shuffle_hash"), "block").mapInArrow(run, schema)
