"""Token ids as flat binary files.

Format, per part k: ``part-k.ids``, unsigned integers (16 bits if the vocabulary
fits, else 32), little-endian, one document after the other; ``part-k.off``, 64-bit
offsets into it, one more than there are documents; ``part-k.doc``, 64-bit document
ids. Parts are in ascending order of document ids. ``manifest.json`` has each part's
counts and its base, the number of ids in all parts before it: a prefix sum over
parts, so no task has to see more than its own part.

Writers put a file under a name of their attempt and rename it, so a retried or
speculative task can't leave half a file. Readers memory-map a local file and read
others through Arrow's file systems.

Defined results: a null text is an empty one, which is the end id alone; ids are cast to long; a null id is
written as -2**63 and read as null, before all others; repeated rows stay, each with
ids of its own; rows with one id are in order of a hash of their ids; an empty table
gives a manifest without parts.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, coded_lists, ragged, scratch, split_words, whole_text

NO_ID = -(2**63)
#: White space that tokenizers and Arrow might not see alike, and the mark between chunks; such texts are encoded whole.
ODD_SPACE = r"[\x{0}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Marks that join with a letter in normal form, or not if the letter is in lower case.
JOINING = r"[\x{300}-\x{36F}]"
#: White space and what follows it: a byte-level tokenizer never joins across its start.
CHUNK = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"
#: A letter and a mark after it (no apostrophe, which may begin an ending like 's): a run of letters is over there, for all
#: these tokenizers. Cut apart, a word is encoded once with whatever mark follows it.
MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?)\]}*$%&|#<>\"-])"
#: Chunks whose ids a Python worker remembers in each of two generations, of some 200 bytes each.
REMEMBERED = 300_000


#: Text whose ids go to one file, about; and what a small table's files have at least.
PART_BYTES, LEAST_PART_BYTES = 256 << 20, 1 << 20


class Encoder:
    """Ids by the tokenizers library, for byte-level pre-tokenizers. A text is cut before
    white space and between letters and marks, where the pre-tokenizer cuts too, so that each distinct chunk is
    encoded once and its ids are remembered; those not seen for a while are forgotten. New chunks go to the library many at a time,
    with separators between them whose id no chunk has. Texts with odd white
    space are encoded whole.

    With ``spell``, a literal special token in a text is spelt by ordinary pieces, so that no text can forge one;
    without it, it gets its id, the library's default, and texts with one are encoded whole."""

    #: Between chunks: its text, and what a chunk must be to be set apart by it.
    separator, plain, remembered, odd = "\n", re.compile(r" [^\x20\t-\r]+"), REMEMBERED, ODD_SPACE

    def __init__(self, path: str, dtype: str, spell: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.spell = Tokenizer.from_file(path), spell
        self.dtype, self.known, self.older = np.dtype(dtype), {}, {}
        self.mark = self._ids([self.separator])[0]
        assert len(self.mark) == 1
        special = [] if spell else sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join([self.odd, *map(re.escape, special)])  # texts with a match are encoded whole

    def _ids(self, texts: list[str], spell: bool = True) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = spell
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain, other = [], []
        for c in new:
            (plain if self.plain.fullmatch(c) else other).append(c)
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for at in range(0, len(groups), 32):
            some = groups[at : at + 32]
            for group, ids in zip(some, self._ids([self.separator.join(g) for g in some]), strict=True):
                cuts = np.flatnonzero(ids == self.mark[0])
                if len(cuts) == len(group) - 1:
                    data, w, a = ids.tobytes(), self.dtype.itemsize, 0
                    for c, z in zip(group, [*(cuts * w).tolist(), len(data)], strict=True):
                        self.known[c] = data[a:z]
                        a = z + w
                else:
                    other += group
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            self.known.update(zip(some, (x.tobytes() for x in self._ids(some)), strict=True))

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of some distinct chunks."""
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for c in chunks:
            if c not in known:
                if c in older:
                    known[c] = older[c]
                else:
                    new.append(c)
        self._learn(new)
        return [known[c] for c in chunks]

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the codes of each text's, and the offsets of the texts."""
        cut = pc.replace_substring_regex(pc.replace_substring_regex(texts, CHUNK, "\\1\0"), MARKED, "\\1\0\\2")
        return coded_lists(pc.split_pattern(cut, "\0"))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text (none is null), as bytes."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = pc.match_substring_regex(texts, self.whole)
        odd = np.flatnonzero(np.asarray(whole)).tolist()
        distinct, codes, ends = self.chunks(pc.if_else(whole, "", texts) if odd else texts)
        ids = self.ids_of(distinct.to_pylist())
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        at = np.cumsum(n) - n
        cuts = np.concatenate([[0], np.cumsum(n[codes])])[ends] * self.dtype.itemsize
        data = flat[ragged(at[codes], n[codes])].tobytes()
        out = [data[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for i, x in zip(odd, self._ids(texts.take(pa.array(odd, pa.int64())).to_pylist(), self.spell), strict=True):
            out[i] = x.tobytes()
        return out


class WordEncoder(Encoder):
    """For tokenizers that drop white space and lower-case letters: a chunk is a word, or a mark and what follows it."""

    separator, plain, remembered, odd = " \0 ", re.compile(r"[^\0]+"), REMEMBERED * 2 // 3, f"{ODD_SPACE}|{JOINING}"

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return split_words(pc.replace_substring_regex(texts, MARKED, "\\1 \\2"))


_encoders: dict[tuple, Encoder] = {}


def encoder(kind: type[Encoder], path: str, dtype: str, spell: bool = True) -> Encoder:
    """One for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (kind.__name__, path, dtype, spell)
    if key not in _encoders:
        _encoders[key] = kind(path, dtype, spell)
    return _encoders[key]


def bounds(docs: DataFrame, parts: int, id_col: str = "doc_id") -> list[int]:
    """Ids that divide the documents into ``parts`` ranges of about the same size, of
    which the driver gets these numbers only. A very frequent id occurs more than once."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts)).alias("b")).first()["b"] or []


def encoded(docs: DataFrame, path: str, end_id: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text", cuts: list[int] | None = None, spell: bool = True) -> DataFrame:
    """doc_id, the ids of each whole text as bytes, with ``end_id`` at the end, and the
    range of its id. An id that is several bounds has their ranges, dealt by the ids' hash."""

    def run(batches):
        e, end = encoder(Encoder, path, dtype, spell), np.array([end_id], dtype).tobytes()
        edges = np.array(cuts or [], np.int64)
        for b in blocks(batches, most=2 * BLOCK_BYTES):
            keys = np.asarray(pc.fill_null(b.column("doc_id"), NO_ID))
            ids = [x + end for x in e.encode(b.column("text"))]
            low, high = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
            crc = np.array([zlib.crc32(x) for x in ids], np.int64)
            part = np.where(high > low, low + (crc * (high - low + 1) >> 32), low)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary()), "part": pa.array(part, pa.int32()), "crc": pa.array(crc)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, part int, crc long")


def _put(folder: str, name: str, write: Callable[[pa.NativeFile], None]) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(mine := f"{root}/.{name}.{uuid.uuid4().hex}") as f:
        write(f)
    fs.move(mine, f"{root}/{name}")


def _uri(path: str) -> str:
    return path if re.match(r"[a-z0-9]+://|file:/", path) else f"file://{path}"


def write(rows: DataFrame, folder: str, parts: int, dtype: str = "<u2") -> dict:
    """Writes the rows of ``encoded``, one file for each range, and returns the
    manifest, which has one small entry for each."""
    folder, width = _uri(folder), np.dtype(dtype).itemsize

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices():
            for b in batches:
                part = np.asarray(b.column("part"))
                heads = np.flatnonzero(np.diff(part, prepend=-1))
                for a, z in zip(heads, [*heads[1:], len(part)], strict=True):
                    yield int(part[a]), b.slice(a, z - a)

        for k, own in itertools.groupby(slices(), lambda x: x[0]):
            doc, off, at = [], [np.zeros(1, "<i8")], 0

            def stream(f, own=own, doc=doc, off=off):
                nonlocal at
                for _, b in own:
                    ids = b.column("ids")
                    ends = at + np.cumsum(np.asarray(pc.binary_length(ids), dtype="<i8")) // width
                    for x in ids.to_pylist():
                        f.write(x)
                    doc.append(np.asarray(pc.fill_null(b.column("doc_id"), NO_ID)).astype("<i8"))
                    off.append(ends)
                    at = int(ends[-1])

            _put(folder, f"part-{k:06d}.ids", stream)
            docs = np.concatenate(doc)
            _put(folder, f"part-{k:06d}.off", lambda f, off=off: f.write(np.concatenate(off).astype("<i8").tobytes()))
            _put(folder, f"part-{k:06d}.doc", lambda f, docs=docs: f.write(docs.tobytes()))
            yield pa.record_batch({"part": pa.array([k], pa.int32()), "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([at], pa.int64())})

    order = [F.col("part"), F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("ids")]
    placed = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    made = sorted((r.asDict() for r in placed.mapInArrow(save, "part int, docs long, tokens long").collect()), key=lambda r: r["part"])
    base = first = 0
    for r in made:
        r["base"], r["first_doc"] = base, first
        base, first = base + r["tokens"], first + r["docs"]
    manifest = {"dtype": dtype, "tokens": base, "docs": first, "parts": made}
    _put(folder, "manifest.json", lambda f: f.write(json.dumps(manifest).encode()))
    return manifest


class Ranged:
    """Numbers of a file that isn't on a local disk; a slice reads its bytes only."""

    def __init__(self, file: pa.NativeFile, dtype: str):
        self.file, self.dtype = file, np.dtype(dtype)
        self.n = file.size() // self.dtype.itemsize

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, key: slice) -> np.ndarray:
        a, z, _ = key.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, z - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)


def opened(folder: str, name: str, dtype: str) -> np.ndarray | Ranged:
    """The file's numbers; a local file is memory-mapped and its pages are read on use, of others the slices asked for."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        if not fs.get_file_info(f"{root}/{name}").size:
            return np.zeros(0, dtype)
        return np.memmap(f"{root}/{name}", dtype, "r")
    return Ranged(fs.open_input_file(f"{root}/{name}"), dtype)


def read(spark: SparkSession, folder: str, manifest: dict | None = None, with_ids: bool = False) -> DataFrame:
    """From the files, for each document: doc_id, start (over all parts), n_tokens,
    ids_crc32 (of the ids as unsigned 32-bit integers) and, if asked, ids."""
    folder = _uri(folder)
    if manifest is None:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/manifest.json") as f:
            manifest = json.loads(f.readall())
    dtype = manifest["dtype"]

    def load(batches):
        for b in batches:
            for k, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                name = f"part-{k:06d}"
                ids, off, doc = (opened(folder, f"{name}.{x}", t) for x, t in (("ids", dtype), ("off", "<i8"), ("doc", "<i8")))
                for at in range(0, len(doc), 4096):
                    cuts = np.asarray(off[at : at + 4097])
                    some = ids[cuts[0] : cuts[-1]].astype("<u4")
                    own = [some[a - cuts[0] : z - cuts[0]] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                    keys = np.asarray(doc[at : at + 4096])
                    cols = {"doc_id": pa.array(keys, pa.int64(), mask=keys == NO_ID), "start": pa.array(base + cuts[:-1], pa.int64()), "n_tokens": pa.array(np.diff(cuts), pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                    yield pa.record_batch(cols | ({"ids": pa.array([x.tolist() for x in own], pa.list_(pa.int64()))} if with_ids else {}))

    rows = [(r["part"], r["base"]) for r in manifest["parts"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    frame = spark.createDataFrame(rows, "part int, base long")
    return frame.repartition(max(1, len(rows))).mapInArrow(load, schema)


def smallest(path: str, end_id: int) -> str:
    """The type of ids: 16 bits if every id of the vocabulary and the end's fit, else 32."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def parts_for(docs: DataFrame, text_col: str) -> int:
    """Files of about PART_BYTES of text; a small table has one for each of Spark's shuffle partitions, as long as they aren't tiny."""
    size = docs.select(F.sum(F.octet_length(whole_text(text_col)).cast("long"))).first()[0] or 0
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // PART_BYTES), min(usual, -(-size // LEAST_PART_BYTES)))


def token_files(docs: DataFrame, path: str, end_id: int, dtype: str | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, spell: bool = True) -> tuple[str, dict]:
    """Encodes, writes and returns the folder and its manifest. Ranges come from the ids
    alone, so that each text is encoded once and its ids move once."""
    folder, dtype = folder or scratch(docs.sparkSession, "ids"), dtype or smallest(path, end_id)
    parts = parts or parts_for(docs, text_col)
    cuts = bounds(docs, parts, id_col)
    return folder, write(encoded(docs, path, end_id, dtype, id_col, text_col, cuts, spell), folder, parts, dtype)
