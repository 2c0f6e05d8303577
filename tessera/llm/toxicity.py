"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over the words
of a text and the beginnings of its words (present or not), and the probabilities of the categories before it. A later
model is trained with out-of-fold predictions of the earlier ones, so it sees them as
uncertain as they are on new texts. Words enter a model if they are frequent enough
and their frequencies differ significantly between the classes. A category's threshold is the one with
the best F measure on out-of-fold predictions, with recall counting more than precision.

Training takes at most ``most_rows`` labelled ids, those with the least hashes, at most twice as many rows with them, and of
near copies with the same labels one: else their words look significant, and folds share texts. Scoring
reads every whole text, in blocks, with a model of bounded size.

Defined results: a null or empty text has no words and gets the models' intercepts;
repeated rows get equal results; ids don't matter for scoring; label rows with a null
aren't used, of several labels of an id the greatest is; a category without labels of both kinds is never predicted; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, mix64, ragged, release, sent, split_words, stage, tidy, whole_text
from .neardup import Settings as Shingles
from .neardup import shingles

PUNCTUATION = ".,;:!?\"'()[]{}<>«»„“”‘’*#$%&|-_/\\"


@dataclass(frozen=True)
class Settings:
    most_rows: int = 10_000
    folds: int = 5
    least_texts: int = 5
    least_z: float = 4.0
    most_words: int = 20_000
    most_codes: int = 1 << 20  # features that are gathered to choose words from, the classes' counts of which are furthest apart
    penalty: float = 0.5
    updates: int = 120


@dataclass
class Link:
    """One category's model."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = float("inf")


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)


#: Lengths of the beginnings of words that are features, written with a star.
PREFIXES = (3, 5)


def text_words(text: pa.Array, known: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct features, and for each text the codes of its own, each once. With ``known``, only those, coded by their place in it."""
    words, codes, ends = split_words(text)
    bare = pc.utf8_trim(words, characters=PUNCTUATION)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    kinds = [bare, *[pc.if_else(pc.greater(pc.utf8_length(bare), k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, k), "*", ""), None) for k in PREFIXES]]
    if known is None:
        every = pa.concat_arrays([x.cast(pa.string()) for x in kinds]).dictionary_encode()
        known, of = every.dictionary, np.asarray(pc.fill_null(every.indices, -1)).reshape(len(kinds), -1)
    else:
        of = np.stack([np.asarray(pc.fill_null(pc.index_in(x, value_set=known), -1)) for x in kinds])
    size, found = max(1, len(known)), []
    for own in of:
        c = own[codes].astype(np.int64)
        found.append(row[c >= 0] * size + c[c >= 0])
    pairs = np.unique(np.concatenate(found))
    return known, pairs % size, np.searchsorted(pairs // size, np.arange(len(ends)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Training rows: which words (of ``size``) each has."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, size: int):
        self.codes, self.offsets, self.size = codes, offsets, size

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.offsets)[rows]
        return Rows(self.codes[ragged(self.offsets[rows], n)], np.concatenate([[0], np.cumsum(n)]), self.size)

    def dot(self, w: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(w[self.codes])])
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def add(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.codes, np.repeat(g, np.diff(self.offsets)), self.size)


def apart(n_with, pos_with, n: int, pos: int, sqrt=np.sqrt, most=np.maximum, number=float):
    """How many standard deviations a feature's count in the ``pos`` positive of ``n`` rows is off, if it says nothing; for arrays or columns."""
    rate = n_with / n
    return (pos_with - rate * pos) / sqrt(most(rate * (1 - rate) * (pos * (1 - pos / n)), number(1e-9)))


def fit_link(name: str, x: Rows, earlier: np.ndarray, y: np.ndarray, s: Settings) -> Link:
    """A logistic model by gradient steps scaled for each weight (Adagrad), with an L2 penalty."""
    n, pos = len(y), int(y.sum())
    link = Link(name, np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log((pos + 0.5) / (n - pos + 0.5))))
    if not 0 < pos < n:
        return link
    of_pos, of_all = x.add(y.astype(float)), x.add(np.ones(n))
    z = apart(of_all, of_pos, n, pos)
    chosen = np.flatnonzero((of_all >= s.least_texts) & (np.abs(z) >= s.least_z))
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")][: s.most_words]
    place = np.full(x.size, -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[x.codes]
    ends = np.concatenate([[0], np.cumsum(kept >= 0)])[x.offsets]
    own = Rows(kept[kept >= 0], ends, len(chosen))
    w, e, b = np.zeros(len(chosen)), np.zeros(earlier.shape[1]), link.bias
    seen = [np.full(len(chosen), 1e-8), np.full(len(e), 1e-8), 1e-8]
    for _ in range(s.updates):
        g = y - sigmoid(own.dot(w) + earlier @ e + b)
        for i, grad in enumerate((own.add(g) - s.penalty * w, earlier.T @ g - 20 * s.penalty * e, g.sum())):
            seen[i] = seen[i] + grad**2
            step = 0.5 * grad / np.sqrt(seen[i])
            w, e, b = (w + step, e, b) if i == 0 else (w, e + step, b) if i == 1 else (w, e, b + step)
    link.words, link.weights, link.earlier, link.bias = chosen, w, e, float(b)
    return link


def probability(link: Link, x: Rows, earlier: np.ndarray) -> np.ndarray:
    w = np.zeros(x.size)
    w[link.words] = link.weights
    return sigmoid(x.dot(w) + earlier @ link.earlier + link.bias)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the scores around the cut with the best F of beta squared 2 (recall counts more than precision); above all scores if none is right."""
    if not y.any():
        return float("inf")
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = 3 * hit / (np.arange(1, len(y) + 1) + 2 * y.sum())
    ends = np.append(np.diff(p[order]) < 0, True)
    f[~ends] = -1
    i = int(np.argmax(f))
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


def fit_rows(vocabulary: list, x: Rows, labels: dict[str, np.ndarray], s: Settings) -> Chain:
    """Chain whose links have words themselves; folds go by the rows' order."""
    n = len(x.offsets) - 1
    fold, chain, earlier = np.arange(n) % s.folds, Chain(), np.zeros((n, 0))
    for name, y in labels.items():
        out = np.zeros(n)
        for k in range(s.folds):
            a, z = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(a) and len(z):
                out[z] = probability(fit_link(name, x.take(a), earlier[a], y[a], s), x.take(z), earlier[z])
        link = fit_link(name, x, earlier, y, s)
        if 0 < y.sum() < n:
            link.threshold = best_threshold(out, y)
        link.words = np.array([vocabulary[i] for i in link.words], dtype=object)
        chain.links.append(link)
        earlier = np.column_stack([earlier, out])
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """``labels``: ``id_col`` and a column of 0 or 1 for each category, in the chain's order. Of repeated ids the greatest label counts."""
    s = settings or Settings()
    ys = [f"y{i}" for i in range(len(categories))]
    rows = labels.select(F.col(id_col).alias("doc_id"), *[F.col(c).cast("int").alias(y) for c, y in zip(categories, ys, strict=True)]).na.drop()
    rows = rows.groupBy("doc_id").agg(*[F.max(y).alias(y) for y in ys]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.most_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    found = own.join(F.broadcast(rows), "doc_id").drop("doc_id")  # of most_rows rows

    def words(batches):
        for b in blocks(batches):
            dictionary, codes, offsets = text_words(b.column("text"))
            hashed = np.array([xxhash.xxh32_intdigest(w) for w in dictionary.to_pylist()], np.uint32).view(np.int32)
            cut = pa.array(offsets, pa.int32())
            yield pa.record_batch({
                "words": pa.ListArray.from_arrays(cut, dictionary.take(pa.array(codes))), "codes": pa.ListArray.from_arrays(cut, pa.array(hashed[codes], pa.int32())),
                "least": pa.array(least_shingles(b.column("text")), pa.list_(pa.int64())), "hash": pa.array([xxhash.xxh3_64_intdigest(t) >> 1 for t in b.column("text").to_pylist()], pa.int64()),
            } | {y: b.column(y) for y in ys})

    # features stay where they are, and so does their count by class: the driver gets codes of those that may differ between the classes, and each row's among them
    made = stage(found.mapInArrow(tidy(words), "words array<string>, codes array<int>, least array<long>, hash long, " + ", ".join(f"{y} int" for y in ys)), "features")
    n, *pos = made.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    by_class = made.select(F.explode("codes").alias("code"), *ys).groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).where(F.col("n") >= s.least_texts)
    # how far the classes are apart, in the category where they are furthest
    far = [F.abs(apart(F.col("n"), F.col(y), n, k, F.sqrt, F.greatest, F.lit)) for y, k in zip(ys, pos, strict=True) if 0 < k < n]
    furthest = F.greatest(F.lit(0.0), F.lit(0.0), *far)
    may_differ = by_class.select("code", furthest.alias("z")).where(F.col("z") >= s.least_z / 2).orderBy(F.col("z").desc(), "code").limit(s.most_codes).select("code").toArrow()
    may_differ = np.sort(np.asarray(may_differ.column("code").combine_chunks() if may_differ.num_rows else [], np.int32))
    known = sent(docs.sparkSession, may_differ)

    def chosen(batches):
        for b in batches:
            flat, n = np.asarray(b.column("codes").flatten()), np.asarray(pc.list_value_length(b.column("codes")), dtype=np.int64)
            codes = known.value
            on = codes[np.minimum(np.searchsorted(codes, flat), len(codes) - 1)] == flat if len(codes) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], np.cumsum(n)])]
            yield pa.record_batch({"codes": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[on]))} | {c: b.column(c) for c in ("least", "hash", *ys)})

    # rows of one text have one hash, so the order is the same whatever order they come in
    t = made.drop("words").mapInArrow(tidy(chosen), "codes array<int>, least array<long>, hash long, " + ", ".join(f"{y} int" for y in ys)).orderBy("hash", *ys).limit(2 * s.most_rows).toArrow()
    release(docs.sparkSession, known)
    y = np.stack([np.asarray(t.column(c)) for c in ys], axis=1) if ys else np.zeros((t.num_rows, 0))
    order = one_of_each(t.column("least").to_pylist(), y.tolist())
    t, y = t.drop_columns(["least", "hash"]).take(pa.array(order, pa.int64())).combine_chunks(), y[order].astype(float)
    lists = t.column("codes").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int32()))
    names, codes = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    x = Rows(codes.astype(np.int32), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))]), max(1, len(names)))
    chain = fit_rows(names.tolist(), x, {c: y[:, i] for i, c in enumerate(categories)}, s)
    used = sorted({int(w) for link in chain.links for w in link.words})  # most_words a category
    spelt: dict[int, list[str]] = {}
    asked = docs.sparkSession.createDataFrame([(c,) for c in used], "code int")
    pairs = made.select(F.explode(F.arrays_zip("words", "codes")).alias("x")).select("x.words", F.col("x.codes").alias("code"))
    for r in pairs.join(F.broadcast(asked), "code").distinct().collect() if used else []:
        spelt.setdefault(r["code"], []).append(r["words"])
    for link in chain.links:
        own = [(w, v) for c, v in zip(link.words, link.weights, strict=True) for w in sorted(spelt[int(c)])]
        link.words, link.weights = np.array([w for w, _ in own], dtype=object), np.array([v for _, v in own])
    del t, x, lists, codes, y
    give_back()
    return chain


#: Samples of a text's shingles, and how many near copies must share.
SAMPLES, ALIKE = 8, 5


def least_shingles(text: pa.Array, n: int = SAMPLES) -> list[list[int]]:
    """For each text its least shingle by ``n`` hashes; near copies share most of them."""
    sh, _, offsets = shingles(text, Shingles())
    out = []
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        out.append([int(mix64(sh[a:z] + np.uint64(i)).min() >> np.uint64(1)) for i in range(n)] if z > a else [])
    return out


def one_of_each(least: list[list[int]], labels: list) -> list[int]:
    """The rows but those with most samples (``ALIKE``) and all labels equal to an earlier row that stays: a common passage alone
    makes no copy. Rows that share so many samples share a pair of neighbours, so only such rows are compared."""
    stay, at = [], {}
    for i, own in enumerate(least):
        keys = [(k, own[k], own[k + 1]) for k in range(0, len(own), 2)]
        near = {j for k in keys for j in at.get(k, ())}
        if any(labels[i] == labels[j] and sum(a == b for a, b in zip(own, least[j], strict=True)) >= ALIKE for j in near):
            continue
        stay.append(i)
        for k in keys:
            at.setdefault(k, []).append(i)
    return stay


def probabilities(chain: Chain, text: pa.Array) -> np.ndarray:
    """A column for each category, in the chain's order."""
    names = sorted({w for link in chain.links for w in link.words})
    place = {w: i for i, w in enumerate(names)}
    known, codes, offsets = text_words(text, pa.array(names, pa.string()))
    x, p = Rows(codes, offsets, max(1, len(names))), np.zeros((len(text), 0))
    for link in chain.links:
        w = np.zeros(x.size)
        w[[place[n] for n in link.words]] = link.weights
        p = np.column_stack([p, sigmoid(x.dot(w) + p @ link.earlier + link.bias)])
    return p


def scores(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, p_<category> for each category, and whether it reaches its
    threshold, as a column of the category's name."""
    fitted = sent(docs.sparkSession, chain)  # most_words a category

    def run(batches):
        for b in blocks(batches):
            p = probabilities(fitted.value, b.column("text"))
            cols = {"doc_id": b.column("doc_id")}
            for i, link in enumerate(fitted.value.links):
                cols |= {f"p_{link.name}": pa.array(p[:, i]), link.name: pa.array(p[:, i] >= link.threshold)}
            yield pa.record_batch(cols)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}" + "".join(f", p_{x.name} double, {x.name} boolean" for x in chain.links)
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(tidy(run), schema)


def clean(docs: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that don't reach the category's threshold."""
    fitted = sent(docs.sparkSession, chain)
    i = [x.name for x in chain.links].index(category)

    @F.arrow_udf("boolean")
    def reached(text: pa.Array) -> pa.Array:
        parts = [probabilities(fitted.value, b.column("text"))[:, i] >= fitted.value.links[i].threshold for b in blocks([pa.record_batch({"text": text})])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(~reached(whole_text(text_col)))
