"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded,
verified by weighted Jaccard similarity.

A text's shingles are its runs of five words (A-Z lower-cased); a shorter text is one
shingle. A shingle's weight is its count in the text times an inverse document
frequency between 1/2 and 1: shingles in fewer than 1 in 200 texts weigh 1, more
frequent ones less, down to 1/2. Frequencies relative to the corpus come from a count-min sketch
over all texts, whose relative error doesn't depend on the corpus' size, so neither
do weights.

Equal texts are one node. Nodes with an equal band share a bucket. One member leads a bucket, the others
are compared with it; after that all pairs of a bucket are compared that aren't in one class
yet, those of large buckets in blocks, as products of matrices (see ``links``). A link needs a similarity of at
least ``threshold``, by weights or by plain counts. Classes are connected components of links, found
by passing minima along edges; nothing about all documents is collected.

Defined results: null and empty texts, and texts without words, are each alone;
repeated rows and equal texts share a class, with or without ids; a class is named by its least id
(null if none has one); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SUM_SCHEMA, blocks, collect_sums, count_rows, members, mix64, ragged, sent, split_words, stage, tidy, whole_text


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 12
    rows: int = 3
    sketch_bits: int = 20
    rare: float = 0.005
    least_idf: float = 0.5
    seed: int = 1


#: Rows of the sketch, and counts in one of its chunks.
DEPTH, WIDTH = 2, 1 << 15
#: Entries of the tables from which a sample's random variables are drawn.
POOL = 1 << 16
P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted 64-bit hashes, their counts, and the offsets of the texts."""
    words, codes, ends = split_words(text)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)[codes] if len(words) else np.zeros(0, np.uint64)
    n = np.diff(ends)
    run = h[: len(h) - s.words + 1].copy() if len(h) >= s.words else np.zeros(0, np.uint64)
    for i in range(1, s.words):
        run *= P
        run ^= run >> np.uint64(29)
        run += h[i : len(h) - s.words + 1 + i]
    run = mix64(run)
    values, counts, offsets = [], [], [0]
    for a, k in zip(ends[:-1].tolist(), n.tolist(), strict=True):
        if k >= s.words:
            v, c = np.unique(run[a : a + k - s.words + 1], return_counts=True)
        elif k:
            one = np.uint64(k)
            with np.errstate(over="ignore"):
                for x in h[a : a + k]:
                    one = one * P ^ x
            v, c = mix64(np.array([one])), np.ones(1, np.int64)
        else:
            offsets.append(offsets[-1])
            continue
        values.append(v)
        counts.append(c)
        offsets.append(offsets[-1] + len(v))
    join = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return join(values, np.uint64), join(counts, np.int64), np.array(offsets)


def slots(sh: np.ndarray, s: Settings) -> list[np.ndarray]:
    mask = np.uint64((1 << s.sketch_bits) - 1)
    return [(((sh >> np.uint64(20 * d)) & mask) + np.uint64(d << s.sketch_bits)).astype(np.int64) for d in range(DEPTH)]


def document_frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """The sketch of all texts' shingles, of a fixed size, and the number of texts."""

    def run(batches):
        table, n = np.zeros(DEPTH << s.sketch_bits, np.int64), 0
        for b in blocks(batches):
            sh, _, _ = shingles(b.column("text"), s)
            for x in slots(sh, s):
                table += np.bincount(x, minlength=len(table))
            n += b.num_rows
        if n:
            yield from count_rows(table, TaskContext.get().partitionId(), WIDTH)

    rows = docs.select("text").mapInArrow(tidy(run), SUM_SCHEMA)
    return collect_sums(rows, (DEPTH << s.sketch_bits) // WIDTH, WIDTH), docs.select(F.lit(1)).count()


def idf_table(sketch: np.ndarray, n: int, s: Settings) -> np.ndarray:
    share = np.maximum(sketch / max(n, 1), s.rare)
    return np.clip(np.log(share) / np.log(s.rare), s.least_idf, 1).astype(np.float32)


def weights(sh: np.ndarray, counts: np.ndarray, idf: np.ndarray, s: Settings) -> np.ndarray:
    own = idf[slots(sh, s)[0]]
    for x in slots(sh, s)[1:]:
        own = np.maximum(own, idf[x])  # the least count is the nearest
    return own * counts.astype(np.float32)


def pool(s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) r and ln c, uniform beta."""
    rng = np.random.default_rng(s.seed)
    return rng.gamma(2, 1, POOL).astype(np.float32), np.log(rng.gamma(2, 1, POOL)).astype(np.float32), rng.random(POOL).astype(np.float32)


def samples(sh: np.ndarray, w: np.ndarray, heads: np.ndarray, s: Settings, tables=None) -> np.ndarray:
    """bands * rows consistent weighted samples (32 bits each) of each non-empty text; heads: where each begins."""
    r_of, c_of, beta_of = tables or pool(s)
    k = s.bands * s.rows
    out = np.empty((len(heads), k), np.uint32)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64) * P + np.uint64(s.seed)) | np.uint64(1)
    log_w, low = np.log(w), (sh & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    # pieces of whole texts that stay in cache
    cuts, at = [0], 0
    while at < len(heads):
        at = max(at + 1, int(np.searchsorted(heads, heads[at] + 32768)))
        cuts.append(at)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = heads[a], heads[z] if z < len(heads) else len(sh)
        own, lw, bits, at = sh[lo:hi], log_w[lo:hi], low[lo:hi], heads[a:z] - lo
        for j in range(k):
            i = ((own * odd[j]) >> np.uint64(48)).astype(np.int32)
            r = r_of[i]
            t = np.floor(lw / r + beta_of[i])
            # ln a = ln c - r (t - beta) - r
            a_log = c_of[i] - r * (t - beta_of[i] + np.float32(1))
            # the sample is (shingle, t); its key orders by a, as floats of either sign
            raw = a_log.view(np.uint32)
            key = np.where(raw >> np.uint32(31), ~raw, raw | np.uint32(0x80000000)).astype(np.uint64) << np.uint64(32)
            key |= bits ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[a:z, j] = (np.minimum.reduceat(key, at) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def bands_of(sig: np.ndarray, s: Settings) -> np.ndarray:
    x = sig.astype(np.uint64).reshape(len(sig), s.bands, s.rows)
    h = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64), x.shape[:2])
    for i in range(s.rows):
        h = mix64(h * P + x[:, :, i])
    return h.view(np.int64)


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, node: 128 bits of a hash of the text."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("node"))


def signatures(own: DataFrame, idf, s: Settings) -> DataFrame:
    """doc_id, node and bands (null without words) of each row."""

    def run(batches):
        tables = pool(s)
        for b in blocks(batches):
            sh, counts, offsets = shingles(b.column("text"), s)
            some = np.diff(offsets) > 0
            bands = [None] * b.num_rows
            if some.any():
                sig = samples(sh, weights(sh, counts, idf.value, s), offsets[:-1][some], s, tables)
                for i, x in zip(np.flatnonzero(some), bands_of(sig, s).tolist(), strict=True):
                    bands[i] = x
            yield pa.record_batch({"doc_id": b.column("doc_id"), "node": b.column("node"), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return own.mapInArrow(tidy(run), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, node binary, bands array<long>")


#: How counts and weights are stored.
COUNT, WEIGHT = "<u4", "<f4"


def vectors(own: DataFrame, idf, s: Settings) -> DataFrame:
    """node, sh (32 bits of each distinct shingle, sorted), n (counts), w (weights), and size (the sum of counts)."""

    def run(batches):
        for b in blocks(batches):
            sh, counts, offsets = shingles(b.column("text"), s)
            w = weights(sh, counts, idf.value, s).astype(WEIGHT)
            sh = (sh >> np.uint64(32)).astype("<u4")
            counts = counts.astype(COUNT)
            size = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[offsets])
            cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())  # noqa: B023, E731
            yield pa.record_batch({"node": b.column("node"), "sh": cut(sh), "n": cut(counts), "w": cut(w), "size": pa.array(size, pa.int64())})

    return own.select("node", "text").mapInArrow(tidy(run), "node binary, sh binary, n binary, w binary, size long")


def similarity(a: tuple, b: tuple) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two vectors (sh, n, w)."""
    sa, sb = np.frombuffer(a[0], "<u4"), np.frombuffer(b[0], "<u4")
    _, i, j = np.intersect1d(sa, sb, return_indices=True)
    out = []
    for k, kind in ((2, WEIGHT), (1, COUNT)):
        x, y = np.frombuffer(a[k], kind).astype(float), np.frombuffer(b[k], kind).astype(float)
        both = np.minimum(x[i], y[j]).sum()
        out.append(float(both / (x.sum() + y.sum() - both)) if len(x) + len(y) else 0.0)
    return out[0], out[1]


def verified(pairs: DataFrame, vecs: DataFrame, s: Settings, most: int = 1000) -> DataFrame:
    """(lead, node, ok) of each pair. Leaders with many pairs are dealt out: their vectors are
    copied once for every ``most`` pairs."""

    def run(batches):
        for b in batches:
            x = [b.column(c).to_pylist() for c in ("sh", "n", "w", "lead_sh", "lead_n", "lead_w")]
            ok = [max(similarity((p, q, r), (t, u, v))) >= s.threshold for p, q, r, t, u, v in zip(*x, strict=True)]
            yield pa.record_batch({"lead": b.column("lead"), "node": b.column("node"), "ok": pa.array(ok, pa.bool_())})

    copies = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("copies"))
    leaders = vecs.select(F.col("node").alias("lead"), *[F.col(c).alias(f"lead_{c}") for c in ("sh", "n", "w")])
    dealt = leaders.join(copies, "lead").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    own = pairs.join(copies, "lead").withColumn("copy", F.pmod(F.xxhash64("node"), "copies").cast("int")).drop("copies")
    return own.join(vecs.drop("size"), "node").join(dealt.drop("copies"), ["lead", "copy"]).select("lead", "node", "sh", "n", "w", "lead_sh", "lead_n", "lead_w").mapInArrow(tidy(run), "lead binary, node binary, ok boolean")


#: Members of a bucket whose pairs are rows; larger buckets are compared in blocks.
FEW = 8
#: Members and shingles (with repeats) of one side of a block, about, and shingles that are multiplied at once.
BLOCK_ROWS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 19, 2048


def links(sig: DataFrame, own: DataFrame, idf, s: Settings) -> DataFrame:
    """Verified links (a, b) between nodes, enough of them to join all that pairs with a common bucket do.

    The member that shares most buckets with others leads its bucket and is compared with all others: what copies of
    one text have in common is nearest to them. Then every pair of a bucket whose members aren't in one class yet is
    compared, linked members included: pairs of small buckets as rows, those of larger ones in blocks."""
    spark = sig.sparkSession
    nodes_bands = sig.where("bands is not null").select("node", "bands").dropDuplicates(["node"])
    buckets = stage(_shared(nodes_bands.select("node", F.explode("bands").alias("band"))), "buckets")
    nodes = stage(buckets.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], "a binary, b binary")
    texts = members(own, nodes.select("node"), ["node"], n).groupBy("node").agg(F.first("text").alias("text"))
    vecs = stage(vectors(texts, idf, s), "vectors")
    order = F.struct(-F.col("degree"), F.xxhash64("band", "node"), F.col("node"))
    buckets = buckets.drop("n").join(nodes, "node")
    first = stage(buckets.groupBy("band").agg(F.min(order).alias("lead")), "leaders")
    # leaders meet all others of their bucket, so they are done with it
    rest = stage(buckets.join(first, "band").where(order > F.col("lead")).select("band", "node", F.col("lead.node").alias("lead")), "rest")
    linked = lambda pairs: verified(pairs, vecs, s).where("ok").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    found = stage(linked(rest.select("lead", "node").distinct()), "links")
    roots = components(found)
    sized = rest.select("band", "node").join(vecs.select("node", "size"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sized = stage(sized, "rest")
    parts = sized.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("band").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("roots"))
    parts = stage(parts.where("roots > 1").select("band", "n", "size", "main"), "unsettled")
    few = sized.join(parts.where(F.col("n") <= FEW).select("band"), "band")
    pairs = few.select("band", F.col("node").alias("lead"), F.col("root").alias("lead_root")).join(few, "band").where("lead < node AND lead_root <> root")
    found = found.unionByName(stage(linked(pairs.select("lead", "node").distinct()), "links"))
    cut = lambda rows, size: F.ceil(F.greatest(rows / BLOCK_ROWS, size / BLOCK_SHINGLES)).cast("int")
    many = parts.where(F.col("n") > FEW).select("band", F.col("main.root").alias("main"), cut(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("is"), cut(F.col("n"), F.col("size")).alias("js"))
    many = sized.join(many, "band")
    dealt = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = many.where("root <> main").select("band", "node", "root", F.lit(True).alias("asks"), dealt(0, F.col("is")).alias("i"), every("js").alias("j"))
    right = many.select("band", "node", "root", F.lit(False).alias("asks"), every("is").alias("i"), dealt(1, F.col("js")).alias("j"))
    own_vecs = left.unionByName(right).join(vecs.drop("size"), "node")
    met = own_vecs.groupBy("band", "i", "j").applyInArrow(lambda t: block_links(t, s), "a binary, b binary")
    return found.unionByName(stage(met.distinct(), "links"))


def block_links(t: pa.Table, s: Settings) -> pa.Table:
    """Links (a, b) of members that ask with the others, where roots differ; of those that join the same members, some are left out."""
    asks = np.asarray(t.column("asks").combine_chunks().to_numpy(zero_copy_only=False), bool)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not (len(x) and len(y)):
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    nodes, vecs = t.column("node").to_pylist(), list(zip(*[t.column(c).to_pylist() for c in ("sh", "n", "w")], strict=True))
    root = np.asarray(t.column("root").combine_chunks().dictionary_encode().indices)
    sh, counts, w = (np.concatenate([np.frombuffer(v[k], kind) for v in vecs]) for k, kind in enumerate(("<u4", COUNT, WEIGHT)))
    row = np.repeat(np.arange(len(vecs)), [len(v[0]) // 4 for v in vecs])
    totals = [np.bincount(row, z, len(vecs)) for z in (counts, w)]
    # a shingle that occurs c times is c columns, so that products of ones are least counts
    c = counts.astype(np.int64)
    level = ragged(np.zeros(len(c), np.int64), c).astype(np.uint64)
    key, row, idf = np.repeat(sh.astype(np.uint64), c) << np.uint64(32) | level, np.repeat(row, c), np.repeat(w.astype(np.float32) / counts, c)
    _, column = np.unique(key, return_inverse=True)
    size = int(column.max()) + 1
    both = (np.bincount(column[asks[row]], minlength=size) > 0) & (np.bincount(column[~asks[row]], minlength=size) > 0)
    on = np.flatnonzero(both[column])
    column = (np.cumsum(both) - 1)[column[on]]
    on = on[np.argsort(column, kind="stable")]
    column.sort()
    place = np.zeros(len(vecs), np.int64)
    place[x], place[y] = np.arange(len(x)), np.arange(len(y))
    common = np.zeros((2, len(x), len(y)), np.float32)
    for at in range(0, int(both.sum()), COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        own, k = on[a:z], column[a:z] - at
        left = asks[row[own]]
        one, two, weigh = np.zeros((len(x), COLUMNS), np.float32), np.zeros((len(y), COLUMNS), np.float32), np.zeros(COLUMNS, np.float32)
        one[place[row[own[left]]], k[left]] = 1
        two[place[row[own[~left]]], k[~left]] = 1
        weigh[k] = idf[own]
        common[0] += one @ two.T
        common[1] += (one * weigh) @ two.T
    best = np.zeros((len(x), len(y)), np.float32)
    for own, total in zip(common, totals, strict=True):
        np.maximum(best, own / np.maximum(total[x][:, None] + total[y][None] - own, 1e-9), out=best)
    best[root[x][:, None] == root[y][None]] = 0
    ok = best >= s.threshold
    for i, j in np.argwhere(np.abs(best - s.threshold) < 1e-4):  # too near for sums of 32 bits
        ok[i, j] = max(similarity(vecs[x[i]], vecs[y[j]])) >= s.threshold
    out, new = [], ok.any(axis=1)
    todo, fresh = np.flatnonzero(new), ok.any(axis=0)
    while len(todo):
        # from one member on to all that it is linked with, and back, until none is new
        now, new[todo[0]] = todo[:1], False
        while len(now):
            reached = np.flatnonzero(ok[now].any(axis=0) & fresh)
            fresh[reached] = False
            out += zip(x[now[ok[np.ix_(now, reached)].argmax(axis=0)]].tolist(), y[reached].tolist(), strict=True)
            now = np.flatnonzero(ok[:, reached].any(axis=1) & new)
            new[now] = False
            out += zip(x[now].tolist(), y[reached[ok[np.ix_(now, reached)].argmax(axis=1)]].tolist(), strict=True) if len(now) else []
        todo = np.flatnonzero(new)
    return pa.table({"a": pa.array([nodes[i] for i, _ in out], pa.binary()), "b": pa.array([nodes[j] for _, j in out], pa.binary())})


def _shared(bands: DataFrame) -> DataFrame:
    """Buckets of two nodes or more, with their sizes n."""
    many = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bands.join(many, "band")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node of its component, for nodes with an edge. Large-star
    and small-star steps in turn, by minima and joins, until nothing changes."""
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = stage(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = now
    raise RuntimeError("components didn't settle")


def _grouped(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    own = named(docs, id_col, text_col)
    sketch, n = document_frequencies(own, s)
    idf = sent(docs.sparkSession, idf_table(sketch, n, s))
    sig = stage(signatures(own, idf, s), "signatures")
    roots = stage(components(links(sig, own, idf, s)), "roots")
    return own, sig, roots, roots.count()


def classes(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least id of the class),
    class_size, kept (true for one row of a class: that of class_id)."""
    s = settings or Settings()
    _, sig, roots, n = _grouped(docs, s, id_col, text_col)
    nodes = sig.select("doc_id", "node", F.col("bands").isNull().alias("blank"))
    joined = nodes.join(F.broadcast(roots) if n <= 500_000 else roots, "node", "left").select("doc_id", "node", "blank", F.coalesce("root", "node").alias("root"))
    groups = stage(joined.where("not blank").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1"), "classes")
    k = groups.count()
    out = joined.join(F.broadcast(groups) if k <= 200_000 else groups, (joined["root"] == groups["root"]) & ~joined["blank"], "left").select("doc_id", joined["root"], F.col("class_size").isNull().alias("alone"), "class_id", "class_size")
    single = out.where("alone").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    # of repeated rows with the class's id, one stays
    chosen = F.row_number().over(Window.partitionBy("root", "doc_id").orderBy("doc_id")) == 1
    shared = out.where("not alone").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")) & chosen)
    return single.unionByName(shared.select(*single.columns))


def keep(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of each class, that with the least id, and all rows that are alone."""
    s = settings or Settings()
    cols = docs.columns
    _, sig, roots, n = _grouped(docs, s, id_col, text_col)
    nodes = sig.where("bands is not null").select("doc_id", "node")
    named_roots = nodes.join(F.broadcast(roots) if n <= 500_000 else roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    # of each class with more than one row the node to keep
    best = named_roots.groupBy("root").agg(F.min_by(F.struct("node", "doc_id"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = stage(best.select("root", "best.node", "best.doc_id"), "best")
    many = stage(named_roots.join(best.select("root"), "root", "left_semi").select("node").distinct(), "many")
    m = many.count()
    text = whole_text(text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col(id_col).alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("node"))
    small = F.broadcast if m <= 500_000 else (lambda x: x)
    alone = packed.join(small(many), "node", "left_anti").select("row")
    kept = packed.join(small(best.select(F.col("node").alias("best_node"), F.col("doc_id").alias("best_id"))), (F.col("node") == F.col("best_node")) & F.col("doc_id").eqNullSafe(F.col("best_id")), "left_semi")
    one = kept.groupBy("node").agg(F.first("row").alias("row")).select("row")
    return alone.unionByName(one).select(*[F.col("row").getField(c).alias(c) for c in cols])
