"""SentencePiece segmentations sampled by forward filtering and backward sampling.

A text is "▁" and the text with "▁" for each space, as the library's dummy prefix
and white-space escape give it. It is cut into words, each with all spaces before it: no piece goes on
from another character to a space (a model with such pieces is refused), so the words' lattices are the text's. Over each word all pieces of the vocabulary span a
lattice; characters without a piece are spanned by their byte pieces. The forward pass
sums the weights of all ways to each position, the backward pass draws one way from
its exact distribution. Weights of a piece: its score if the model is a unigram
model, else (scores are ranks) 1 / (1 + rank); both to the power ``alpha``.

Distinct words of a block share lattices, half a million characters at once, and their draws are made
together in numpy, from random numbers that are hashes of (seed, row key, word
number, step). A very long word (``LONG`` characters) goes by stretches: the forward pass is linear in what comes into a stretch, so all
stretches are worked out at once for each place that can be entered, then chained, then worked out again from what really comes in; the backward pass
makes one window's edges at a time. Only the sum of each position is kept. So a row's segmentation depends on nothing but these. Decoding joins the pieces and drops the prefix: it gives the text
back. A literal "▁" is spelt in bytes, so that it isn't read as a space.

Defined results: a null text counts as empty, an empty one has no pieces; a null key
is a key of its own (``round_trip`` casts keys to long); repeated rows, with the same key and text, get the same
segmentation; other columns don't matter.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, mix64, ragged, whole_text

SPACE = 0x2581
#: Stands for a literal "▁" in a text; no character has this number.
LITERAL = 0x110000
STEP, BASE, SLOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
SLOT_BITS = 20
#: Text whose words share lattices; states and edges take some 200 times its memory.
LATTICE_BYTES = BLOCK_BYTES // 2
#: Characters of distinct words in lattices at once (an edge takes some 300 bytes), and draws at once.
LATTICE_CHARS, DRAWS = 1 << 19, 1 << 19
#: Words from so many characters on go by stretches of STRETCH, back by windows of WINDOW positions.
LONG, STRETCH, WINDOW = 1 << 15, 1 << 10, 1 << 14
#: In place of a piece's id: the character is spelt in bytes.
SPELT = 0xFFFFF


class Model:
    """The vocabulary's prefixes by hash, and weights."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = np.array([sp.get_score(i) for i in range(n)])
        usual = score > -1e8
        if score[usual].min() < -1000:  # ranks
            score = -np.log1p(np.where(usual, -score, n))
        self.weight, self.byte_weight = alpha * score, alpha * float(min(score[normal].min(), -np.log1p(n)))
        self.byte_id = np.array([next((i for i in range(n) if sp.is_byte(i) and sp.id_to_piece(i) == f"<0x{b:02X}>"), -1) for b in range(256)])
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.surface = [b""] * n
        for b, i in enumerate(self.byte_id):
            self.surface[i] = bytes([b])
        prefixes: dict[int, int] = {}
        self.longest = 1
        for i in normal:
            piece = sp.id_to_piece(i)
            self.surface[i] = piece.replace("▁", " ").encode()
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{piece!r} spans words")
            self.longest, h = max(self.longest, len(piece)), 0
            for c in piece:
                h = (h * int(BASE) + ord(c) + 1) % 2**64
                prefixes.setdefault(h, -1)
            prefixes[h] = i
        self.hashes = np.array(list(prefixes), np.uint64)
        self.piece = np.array(list(prefixes.values()), np.int64)
        slots = (self.hashes * SLOT) >> np.uint64(64 - SLOT_BITS)
        self.tables, left = [], np.arange(len(slots))
        while len(left):  # a table for the first prefix of each slot, one for the second, and so on
            s, first = np.unique(slots[left], return_index=True)
            t = np.full(1 << SLOT_BITS, -1, np.int32)
            t[s] = left[first]
            self.tables.append(t)
            left = np.delete(left, first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Which prefix has the hash, or -1."""
        slot, out = (h * SLOT) >> np.uint64(64 - SLOT_BITS), None
        for t in self.tables:
            i = t[slot]
            i = np.where((i >= 0) & (self.hashes[i] == h), i, -1)
            out = i if out is None else np.maximum(out, i)
        return out


class Lattices:
    """The lattices of many words. A state is a position in a word; states are numbered
    by position first and longest words first, so that edges in order of their
    targets serve both passes. While they are sorted, an edge is one integer: its
    target, its length and its piece."""

    def __init__(self, model: Model, words: pa.Array):
        text = "".join(words.to_pylist())
        size = np.asarray(pc.utf8_length(words)).astype(np.int32) + np.int32(1)  # with the space before
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        raw[raw == SPACE] = LITERAL
        raw[raw == ord(" ")] = SPACE
        base = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        chars = np.full(base[-1], SPACE, np.uint64)
        keep = np.ones(base[-1], bool)
        keep[base[:-1]] = False
        chars[keep] = raw
        chars += np.uint64(1)
        long_first = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[long_first] = np.arange(len(size))
        longest = int(size.max())
        having = np.searchsorted(-size[long_first], -np.arange(longest + 1), "right")  # words of so many characters or more
        at_state = np.concatenate([[0], np.cumsum(having)])  # where the states of each position begin
        self.first, self.last = rank, at_state[size] + rank
        word = np.repeat(np.arange(len(size), dtype=np.int32), size)
        place = np.arange(base[-1]) - np.repeat(base[:-1], size)
        rank_at, left = rank[word], (size[word] - place).astype(np.int32)

        at, h = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        edges, spelt = [], at[:0]
        for k in range(1, model.longest + 1):
            fits = left[at] >= k
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h *= BASE
            h += chars[at + (k - 1)]
            i = model.find(h)
            on = i >= 0
            at_k, h, i = at[on], h[on], i[on]
            piece = model.piece[i]
            full = piece >= 0
            if k == 1:
                spelt = np.concatenate([at[~on], at_k[~full]])
            own = at_k[full]
            edges.append((at_state[place[own] + k] + rank_at[own]) << 28 | k << 20 | piece[full])
            at = at_k
        own = np.sort(spelt)
        edges.append((at_state[place[own] + 1] + rank_at[own]) << 28 | 1 << 20 | SPELT)
        edges = np.sort(np.concatenate(edges))
        self.target, k, token = edges >> 28, edges >> 20 & 0xFF, edges & 0xFFFFF
        heads = np.flatnonzero(np.diff(self.target, prepend=-1))
        reps = np.diff([*heads, len(edges)])
        cuts = np.searchsorted(self.target, at_state)
        where = np.repeat(np.arange(longest + 1), np.diff(cuts))  # the position of each target
        self.source = at_state[where - k] + self.target - at_state[where]
        # each edge's ids are a stretch of self.ids: one piece, or the bytes of a character
        is_spelt = token == SPELT
        self.ids_n = np.ones(len(edges), np.int64)
        weight = model.weight[np.where(is_spelt, 0, token)]
        self.ids = np.where(is_spelt, 0, token)
        self.ids_at = np.arange(len(edges))
        if is_spelt.any():
            row = self.source[is_spelt] - at_state[where[is_spelt] - 1]
            codes = chars[base[long_first[row]] + where[is_spelt] - 1] - np.uint64(1)
            codes = np.where(codes == LITERAL, SPACE, codes).astype("<u4")
            data = np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)
            width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
            weight[is_spelt] = model.byte_weight * width
            self.ids_n[is_spelt] = width
            self.ids_at[is_spelt] = len(self.ids) + np.cumsum(width) - width
            self.ids = np.concatenate([self.ids, model.byte_id[data]])

        # forward: the log of the summed weights of all ways to each state; backward: each edge's
        # share of its target's ways, cumulated on top of the target's number
        forward, share = np.zeros(int(at_state[-1])), np.empty(len(edges))
        own_heads = np.searchsorted(heads, cuts)
        for p in range(1, longest + 1):
            a, z = cuts[p], cuts[p + 1]
            own, times = heads[own_heads[p] : own_heads[p + 1]] - a, reps[own_heads[p] : own_heads[p + 1]]
            v = forward[self.source[a:z]] + weight[a:z]
            top = np.maximum.reduceat(v, own)
            v = np.exp(v - np.repeat(top, times))
            total = np.add.reduceat(v, own)
            forward[self.target[a:z][own]] = top + np.log(total)
            share[a:z] = v / np.repeat(total, times)
        run = np.cumsum(share)
        cum = np.minimum(run - np.repeat(run[heads] - share[heads], reps), 1)
        cum[heads + reps - 1] = 1
        self.key = self.target + cum


def sample(model: Model, words: pa.Array, codes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word of ``codes`` in order, and how many each has. key: a random
    uint64 for each."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lat = Lattices(model, words)
    order = np.argsort(lat.last[codes])  # equal words' edges are near in memory
    state, goal, key = lat.last[codes[order]], lat.first[codes[order]], key[order]
    who, drawn, step = np.arange(len(codes)), [], np.uint64(0)
    steps = np.zeros(len(codes), np.int64)
    while len(who):
        step += np.uint64(1)
        u = (mix64(key + np.array([step]) * STEP) >> np.uint64(34)).astype(np.float64) * 2.0**-30
        edge = np.searchsorted(lat.key, state + u, "right")
        drawn.append((who, edge))
        steps[who] += 1
        state = lat.source[edge]
        on = state != goal
        who, state, goal, key = who[on], state[on], goal[on], key[on]
    heads = np.cumsum(steps) - steps
    edges = np.zeros(int(steps.sum()), np.int64)
    for i, (who, edge) in enumerate(drawn):
        edges[heads[who] + steps[who] - 1 - i] = edge
    counts = np.add.reduceat(lat.ids_n[edges], heads)
    # back into reading order
    back = np.empty(len(codes), np.int64)
    back[order] = np.arange(len(codes))
    edges = edges[ragged(heads[back], steps[back])]
    ids = lat.ids[ragged(lat.ids_at[edges], lat.ids_n[edges])]
    return ids, counts[back]


def outgoing(m: Model, chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges from each start by length (1 to the longest piece): weight (-inf: none) and piece."""
    weight, token = np.full((len(start), m.longest), -np.inf), np.full((len(start), m.longest), -1, np.int64)
    at, h = np.flatnonzero(start < len(chars)), np.zeros(len(start), np.uint64)
    inside = at
    for k in range(1, m.longest + 1):
        at = at[start[at] + k <= len(chars)]
        if not len(at):
            break
        h[at] = h[at] * BASE + chars[start[at] + k - 1]
        i = m.find(h[at])
        at, piece = at[i >= 0], m.piece[i[i >= 0]]
        full = piece >= 0
        weight[at[full], k - 1], token[at[full], k - 1] = m.weight[piece[full]], piece[full]
    bare = inside[token[inside, 0] < 0]
    codes = chars[start[bare]] - np.uint64(1)
    codes = np.where(codes == LITERAL, SPACE, codes)
    weight[bare, 0] = m.byte_weight * (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))
    token[bare, 0] = SPELT
    return weight, token


def long_word(m: Model, word: str, key: np.uint64) -> np.ndarray:
    """Ids of one draw for a long word, as ``sample`` draws it."""
    raw = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    raw[raw == SPACE] = LITERAL
    raw[raw == ord(" ")] = SPACE
    chars = np.concatenate([[np.uint64(SPACE)], raw]) + np.uint64(1)
    n, wide = len(chars), m.longest
    first = np.arange(n // STRETCH + 1) * STRETCH

    def pass_on(ring: np.ndarray, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What comes into the next stretches (stretch, way of entry, place), and its scale, from what comes into these."""
        scale = np.zeros(ring.shape[:2])
        ring = np.concatenate([ring, np.zeros((*ring.shape[:2], 1))], axis=2)
        for t in range(STRETCH):
            weight, _ = outgoing(m, chars, first + t)
            now = t % (wide + 1)
            value = ring[:, :, now].copy()
            if logs is not None:
                inside = first + t <= n
                logs[first[inside] + t] = np.log(value[inside, 0]) + scale[inside, 0]
            ring[:, :, now] = 0
            for k in range(1, wide + 1):
                w = np.exp(weight[:, k - 1])
                if w.any():
                    ring[:, :, (t + k) % (wide + 1)] += value * w[:, None]
            if t % 16 == 15:
                top = ring.max(axis=2)
                top[top == 0] = 1
                ring /= top[:, :, None]
                scale += np.log(top)
        return np.roll(ring, -(STRETCH % (wide + 1)), axis=2)[:, :, :wide], scale

    enter = np.zeros((len(first), 1, wide))
    enter[0, 0, 0] = 1
    base = np.zeros(len(first))
    if len(first) > 1:
        every = np.broadcast_to(np.eye(wide), (len(first), wide, wide)).copy()
        out, scale = pass_on(every)
        for j in range(len(first) - 1):
            with np.errstate(divide="ignore"):
                way = np.log(enter[j, 0]) + scale[j]
            top = way.max()
            enter[j + 1, 0] = np.exp(way - top) @ out[j]
            most = enter[j + 1, 0].max()
            enter[j + 1, 0] /= most
            base[j + 1] = base[j] + top + np.log(most)
    forward = np.empty(n + 1)
    pass_on(enter, forward)
    forward += base[np.arange(n + 1) // STRETCH]

    drawn, at, step = array("q"), n, 0
    while at:
        low = max(0, (at - 1) // WINDOW * WINDOW)
        begin = max(0, low - wide)
        weight, token = outgoing(m, chars, np.arange(begin, at))
        target = np.arange(low + 1, at + 1)
        share, own = np.zeros((len(target), wide)), np.full((len(target), wide), -1, np.int64)
        for k in range(1, wide + 1):
            ok = target - k >= 0
            source = target[ok] - k
            with np.errstate(invalid="ignore"):
                share[ok, k - 1] = np.exp(forward[source] + weight[source - begin, k - 1] - forward[target[ok]])
            own[ok, k - 1] = token[source - begin, k - 1]
        share = np.cumsum(share, axis=1) / share.sum(axis=1, keepdims=True)
        share[np.arange(wide) >= wide - np.argmax(own[:, ::-1] >= 0, axis=1)[:, None] - 1] = 1  # the last of a target's edges
        own = np.where(own == SPELT, -target[:, None], own)
        cuts, own, u, used = share.tolist(), own.tolist(), [], 0
        while at > low:
            if used == len(u):
                steps = np.arange(step + 1, step + 4097, dtype=np.uint64)
                u, used = ((mix64(key + steps * STEP) >> np.uint64(34)).astype(np.float64) * 2.0**-30).tolist(), 0
            k = bisect_right(cuts[at - low - 1], u[used]) + 1
            drawn.append(own[at - low - 1][k - 1])
            at, step, used = at - k, step + 1, used + 1
    ids = np.frombuffer(drawn, np.int64)[::-1]
    spelt = np.flatnonzero(ids < 0)  # in place of a piece the position after a character
    codes = chars[-ids[spelt] - 1] - np.uint64(1)
    codes = np.where(codes == LITERAL, SPACE, codes).astype("<u4")
    width = np.ones(len(ids), np.int64)
    width[spelt] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)
    out = np.repeat(ids, width)
    out[ragged((np.cumsum(width) - width)[spelt], width[spelt])] = m.byte_id[np.frombuffer(codes.tobytes().decode("utf-32-le").encode(), np.uint8)]
    return out


def sampled(m: Model, words: pa.Array, codes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``sample``, of any number of distinct words of any length: some words and some draws at once."""
    size = np.asarray(pc.utf8_length(words)).astype(np.int64)
    group = np.cumsum(np.where(size >= LONG, 0, size + 1)) // LATTICE_CHARS
    group[size >= LONG] = -1
    if len(words) and group.max() == 0 and group.min() == 0 and len(codes) <= DRAWS:
        return sample(m, words, codes, key)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(group[codes], kind="stable")
    cuts = np.concatenate([np.flatnonzero(np.diff(group[codes[order]], prepend=-2)), [len(codes)]]).astype(np.int64)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for at in range(a, z, DRAWS):
            own = order[at : min(z, at + DRAWS)]
            if group[codes[own[0]]] < 0:
                for i in own:
                    ids = long_word(m, words[int(codes[i])].as_py(), key[i])
                    parts.append((np.array([i]), ids.astype(np.int32), np.array([len(ids)])))
                continue
            distinct, new = np.unique(codes[own], return_inverse=True)
            ids, n = sample(m, words.take(pa.array(distinct)), new, key[own])
            parts.append((own, ids.astype(np.int32), n))
    counts = np.zeros(len(codes), np.int64)
    for own, _, n in parts:
        counts[own] = n
    heads, out = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
    for own, ids, n in parts:
        out[ragged(heads[own], n)] = ids
    return out, counts


def spaced_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls, each with the spaces before it but one (the last of a text may be
    spaces alone), and how many each text has; an empty text has none."""
    lists = pc.split_pattern(text, " ")
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    last = np.zeros(len(flat), bool)
    last[np.cumsum(n) - 1] = True
    whole = last | np.asarray(pc.greater(pc.binary_length(flat), 0))  # what stands between two spaces goes with what follows
    ends = np.flatnonzero(whole)
    lead = np.diff(ends, prepend=-1) - 1
    words = flat.take(pa.array(ends))
    if lead.any():
        words = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(" "), pa.array(lead)), words, "")
    some = np.asarray(pc.greater(pc.binary_length(text), 0))
    counts = np.add.reduceat(whole, np.cumsum(n) - n) if len(n) else n
    if not some.all():
        words = words.filter(pa.array(np.repeat(some, counts)))
    return words, np.where(some, counts, 0)


def encode_block(model: Model, keys: pa.Array, text: pa.Array, seed: int) -> list[np.ndarray]:
    words, n = spaced_words(pc.fill_null(text, ""))
    coded = words.dictionary_encode()
    row = np.array([xxhash.xxh3_64_intdigest(repr(k)) for k in keys.to_pylist()], np.uint64) + np.array([seed], np.uint64) * STEP
    heads = np.cumsum(n) - n
    number = np.arange(int(n.sum())) - np.repeat(heads, n)
    key = mix64(np.repeat(mix64(row), n) ^ (number.astype(np.uint64) * BASE))
    ids, counts = sampled(model, coded.dictionary, np.asarray(coded.indices).astype(np.int64), key)
    ends = np.concatenate([[0], np.cumsum(counts)])
    cuts = ends[np.concatenate([[0], np.cumsum(n)])]
    return [ids[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def decode_ids(model: Model, ids) -> str:
    surface = model.surface
    return b"".join([surface[i] for i in ids])[1:].decode()


_models: dict[tuple, Model] = {}


def model(path: str, alpha: float = 1.0) -> Model:
    if (path, alpha) not in _models:
        _models[path, alpha] = Model(path, alpha)
    return _models[path, alpha]


def encode(docs: DataFrame, path: str, seed: int = 0, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, as an array of a sampled segmentation of the whole text."""

    def run(batches):
        m = model(path, alpha)
        for b in blocks(batches, most=LATTICE_BYTES):
            ids = encode_block(m, b.column("doc_id"), b.column("text"), seed)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))})

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids."""

    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([decode_ids(m, x or []) for x in b.column("ids").to_pylist()], pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, seed: int = 0, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: doc_id, n_pieces, ids_crc32 (ids as unsigned 32-bit
    integers), text_crc32 (the decoded text in UTF-8) and lossless (whether that is
    the text). Encoding and decoding happen where the text is, in one pass."""

    def run(batches):
        m = model(path, alpha)
        for b in blocks(batches, most=LATTICE_BYTES):
            text = b.column("text").to_pylist()
            ids = encode_block(m, b.column("doc_id"), b.column("text"), seed)
            back = [decode_ids(m, x.tolist()) for x in ids]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_pieces": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()), "text_crc32": pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), "lossless": pa.array([a == z for a, z in zip(text, back, strict=True)], pa.bool_())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
