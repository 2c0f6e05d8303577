"""Toxicity chain, maximum-entropy scores, sampled pieces, Merkle audit and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import maxent, merkle, pieces, queries, toxicity

# --- Toxicity --------------------------------------------------------------------


def labelled(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random() < 0.3, rng.random() < 0.5
        words = [f"w{rng.randrange(3000)}" for _ in range(40)]
        if a:
            words[rng.randrange(40)] = rng.choice(["badone,", "(badtwo)", "BADTHREE"])
        if a and b:
            words[rng.randrange(40)] = rng.choice(["threat", "violent"])
        rows.append((i, " ".join(words), int(a), int(a and b)))
    return rows


@pytest.fixture(scope="module")
def chain(spark):
    df = spark.createDataFrame(labelled(3000), "doc_id long, text string, insult int, threat int")
    return toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "insult", "threat"), ["insult", "threat"])


def test_held_out_accuracy(spark, chain):
    test = labelled(1000, 1)
    df = spark.createDataFrame([r[:2] for r in test], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scores(df, chain).collect()}
    for i, name in ((2, "insult"), (3, "threat")):
        wrong = sum(got[r[0]][name] != bool(r[i]) for r in test)
        assert wrong <= 50, (name, wrong)
    assert [len(x.earlier) for x in chain.links] == [0, 1]
    kept = {r.doc_id for r in toxicity.clean(df, chain, "insult").collect()}
    assert kept == {k for k, r in got.items() if not r.insult}


def test_later_links_use_earlier_ones(chain):
    assert chain.links[1].earlier[0] > 0


@pytest.mark.parametrize("table", ["awkward", "nothing", "clashing"])
def test_toxicity_of_odd_rows(request, chain, table):
    docs = request.getfixturevalue(table)
    assert toxicity.scores(docs, chain).count() == docs.count()
    out = toxicity.clean(docs, chain, "insult")
    assert out.columns == docs.columns and out.count() == docs.count()


def test_without_labels_nothing_is_toxic(spark, awkward):
    none = toxicity.fit(awkward, spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"), ["toxic"])
    assert not any(r.toxic for r in toxicity.scores(awkward, none).collect())


def plain_features(text):
    out = set()
    for w in (text or "").split():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).strip(toxicity.PUNCTUATION)
        out |= {w} | {w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k}
    return out


def plain_chain(rows, s):
    """From (features, labels) of each row, by dense matrices: for each category a function of features and earlier probabilities, and its threshold."""
    names = sorted(set().union(*(f for f, _ in rows)))
    x = np.array([[n in f for n in names] for f, _ in rows], float)
    y = np.array([ls for _, ls in rows], float)
    links, earlier, fold = [], np.zeros((len(rows), 0)), np.arange(len(rows)) % s.folds

    def learn(x, e, y):
        n, pos = len(y), y.sum()
        with_, rate = x.T @ y, x.mean(axis=0)
        z = (with_ - pos * rate) / np.sqrt(np.maximum(pos * rate * (1 - rate) * (1 - pos / n), 1e-9))
        on = (x.sum(axis=0) >= s.least_texts) & (np.abs(z) >= s.least_z)
        own, w, v, b = x[:, on], np.zeros(on.sum()), np.zeros(e.shape[1]), np.log((pos + 0.5) / (n - pos + 0.5))
        gw, gv, gb = np.full(len(w), 1e-8), np.full(len(v), 1e-8), 1e-8
        for _ in range(s.updates):
            g = y - 1 / (1 + np.exp(-(own @ w + e @ v + b)))
            dw, dv, db = own.T @ g - s.penalty * w, e.T @ g - 20 * s.penalty * v, g.sum()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            w, v, b = w + 0.5 * dw / np.sqrt(gw), v + 0.5 * dv / np.sqrt(gv), b + 0.5 * db / np.sqrt(gb)
        full = np.zeros(x.shape[1])
        full[on] = w
        return lambda x, e: 1 / (1 + np.exp(-(x @ full + e @ v + b)))

    for i in range(y.shape[1]):
        out = np.zeros(len(rows))
        for k in range(s.folds):
            a, z = fold != k, fold == k
            out[z] = learn(x[a], earlier[a], y[a, i])(x[z], earlier[z])
        links.append(learn(x, earlier, y[:, i]))
        earlier = np.column_stack([earlier, out])
    return names, links


def test_scores_equal_a_plain_chain(spark, chain):
    """Trained and scored on whole rows; the rows of a text's near copy aren't among them."""
    rows = [r for r in labelled(700, 5)]
    rows += [(9000, rows[0][1], *rows[0][2:]), (9001, None, 0, 0), (9002, "", 0, 0)]  # a copy, and rows without words
    df = spark.createDataFrame(rows, "doc_id long, text string, insult int, threat int")
    made = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "insult", "threat").union(df.select("doc_id", F.lit(0), F.lit(0))), ["insult", "threat"])
    got = {r.doc_id: r for r in toxicity.scores(df, made).collect()}
    ordered = sorted(rows[:700] + rows[701:], key=lambda r: (toxicity.xxhash.xxh3_64_intdigest(r[1] or "") >> 1, *r[2:]))
    names, links = plain_chain([(plain_features(r[1]), r[2:]) for r in ordered], toxicity.Settings())
    x = np.array([[n in f for n in names] for f in (plain_features(r[1]) for r in rows)], float)
    p = np.zeros((len(rows), 0))
    for link in links:
        p = np.column_stack([p, link(x, p)])
    for r, (a, b) in zip(rows, p, strict=True):
        assert (got[r[0]].p_insult, got[r[0]].p_threat) == (pytest.approx(a, abs=1e-6), pytest.approx(b, abs=1e-6))


def test_common_passages_make_no_copies():
    a, b = list(range(8)), [0, 1, 2, 13, 14, 15, 16, 17]  # three samples of one passage
    near = [0, 1, 2, 3, 4, 25, 26, 27]
    assert toxicity.one_of_each([a, b, near, near, [], []], [[1], [1], [1], [0], [0], [0]]) == [0, 1, 3, 4, 5]


# --- Maximum entropy ---------------------------------------------------------------


@pytest.mark.parametrize("table", ["awkward", "small", "clashing", "nothing"])
def test_base_scores_equal_brute_force(request, table):
    docs = request.getfixturevalue(table)
    got = sorted(maxent.score(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    rows = []
    for r in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)] + [" end"]
        rows.append((r.doc_id, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2, w))
    c = Counter(x for _, held, w in rows if not held for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted(((str(i), len(w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), sum(c[x] > 0 for x in w), held) for i, held, w in rows))
    assert len(got) == len(want)
    for r, x in zip(got, want, strict=True):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.held_out) == (x[0], x[1], x[3], x[4]) and r.train_tokens == n
        assert r.base_score == pytest.approx(x[2]) and r.score <= 0


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = maxent.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def random_model(seed, bits=12):
    rng = np.random.default_rng(seed)
    s = maxent.Shape()
    table = rng.normal(0, 0.5, (s.rows(bits), maxent.WIDTH)).astype(np.float32)
    tokens = rng.integers(0, 50, (maxent.WIDTH, maxent.WIDTH))
    tokens[-1, 1:] = 0
    return s, table, maxent.Priors.of(tokens)


def test_probabilities_of_a_history_add_up():
    s, table, prior = random_model(0)
    cls, column = (x.ravel() for x in np.meshgrid(np.arange(maxent.WIDTH), np.arange(maxent.WIDTH), indexing="ij"))
    rows = np.random.default_rng(1).integers(0, len(table), (8, maxent.WIDTH)).astype(np.int32)
    every = np.concatenate([np.repeat(rows[:4, :1], len(cls), axis=1), rows[4:][:, cls]])  # the column's features go with the class
    p = np.exp(maxent.log_likelihood(table, prior, every, cls, column))
    assert p.sum() == pytest.approx(1, abs=1e-4)


def test_gradient_is_that_of_the_likelihood():
    s, table, prior = random_model(2)
    rng = np.random.default_rng(3)
    n = 3000
    rows, cls, column = rng.integers(0, 40, (8, n)).astype(np.int32), rng.integers(0, maxent.WIDTH - 1, n), rng.integers(0, maxent.WIDTH, n)
    counts = np.zeros(table.size, np.int32)
    maxent.count(counts, rows, cls, column)
    expected = np.zeros_like(table)
    maxent.expectations(table, prior, rows, cls, expected)
    assert counts.sum() == 8 * n and expected.sum() == pytest.approx(8 * n, rel=1e-4)
    for i, j in ((0, 3), (7, 60), (39, 0)):
        values = []
        for e in (0.02, -0.02):
            moved = table.copy()
            moved[i, j] += e
            values.append(maxent.log_likelihood(moved, prior, rows, cls, column).sum())
        assert (values[0] - values[1]) / 0.04 == pytest.approx(counts[i * maxent.WIDTH + j] - expected[i, j], abs=0.5)


def test_scores_equal_a_plain_version(spark):
    """The whole model by loops over tokens: counts, expectations of all training texts, two updates, discounted counts."""
    docs = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The cat sat on the hat", "a dog sat on a log", "", None, "the dog ate the cat", "on the mat the cat sat", "zebra!", "the cat sat", "one two three two one", "the end the end"] * 2)]
    got = {r.doc_id: r.score for r in maxent.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    s = maxent.Shape()
    bits, texts = s.row_bits(sum(len(t or "") for _, t in docs)), []
    for i, t in docs:
        words = [*(t or "").lower().split(), maxent.END]
        rows, cls, column = maxent.features(maxent.kinds(words), np.arange(len(words)), np.array([0, len(words)]), bits)
        texts.append((i, maxent.held_out(i, s), words, rows.T.tolist(), cls.tolist(), column.tolist()))
    words = Counter(w for _, held, ws, *_ in texts if not held for w in ws)
    cell_of = {w: (k, c) for _, _, ws, _, cls, col in texts for w, k, c in zip(ws, cls, col, strict=True)}
    tokens = np.zeros((64, 64), int)
    distinct = np.zeros((64, 64), int)
    for w, n in words.items():
        tokens[cell_of[w]] += n
        distinct[cell_of[w]] += 1
    prior, weights, counts = maxent.Priors.of(tokens), {}, Counter()

    def softmax(log_prior, rows):
        z = np.exp(np.array(log_prior, float) + sum(weights.get(r, np.zeros(64)) for r in rows))
        return z / z.sum()

    for _, held, _, rows, cls, col in texts:
        for r, k, c in zip(rows, cls, col, strict=True):
            for j, x in enumerate(r if not held else []):
                counts[x, k if j < 4 else c] += 1
    for rate in s.rates[: s.updates]:
        expected = {}
        for _, held, _, rows, cls, _ in texts:
            for r, k in zip(rows if not held else [], cls, strict=False):
                for own, p in ((r[:4], softmax(prior.classes, r[:4])), (r[4:], softmax(prior.columns[k], r[4:]))):
                    for x in own:
                        expected[x] = expected.get(x, 0) + p
        for x, e in expected.items():
            n = np.array([counts[x, j] for j in range(64)])
            weights[x] = np.clip(weights.get(x, np.zeros(64)) + rate * np.log1p((n - e) / (e + s.smooth)), -s.most, s.most)
    for i, _, ws, rows, cls, col in texts:
        total = 0.0
        for w, r, k, c in zip(ws, rows, cls, col, strict=True):
            t, v, n = tokens[k, c], distinct[k, c], words[w]
            inside = (n - s.discount) / t if n else s.discount * v / t if t else 1.0
            total += math.log10(softmax(prior.classes, r[:4])[k]) + math.log10(softmax(prior.columns[k], r[4:])[c]) + math.log10(inside)
        assert got[i] == pytest.approx(total, rel=2e-3, abs=2e-3), (i, ws)


# --- Pieces ------------------------------------------------------------------------

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("table", ["awkward", "small", "nothing", "clashing"])
def test_pieces_are_lossless_and_reproducible(request, table):
    from sentencepiece import SentencePieceProcessor

    docs = request.getfixturevalue(table)
    first = pieces.encode(docs, PATH)
    back = pieces.decode(first, PATH)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted(map(str, first.collect())) == sorted(map(str, pieces.encode(docs.repartition(3), PATH).collect()))
    sp = SentencePieceProcessor(model_file=PATH)
    text = {str(r.doc_id): r.text or "" for r in docs.collect() if r.doc_id}
    for r in first.collect():
        if r.doc_id and "▁" not in text[str(r.doc_id)]:
            assert sp.decode(r.ids) == text[str(r.doc_id)]
    assert all(r.lossless for r in pieces.round_trip(docs, PATH).collect())


def test_draws_follow_the_lattice():
    """Frequencies of all segmentations of a word against their exact probabilities."""
    m = pieces.model(PATH)
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    text, ways = "▁thener", {}

    def go(i, ids, weight):
        if i == len(text):
            ways[tuple(ids)] = math.exp(weight)
        for j in range(i + 1, len(text) + 1):
            k = sp.piece_to_id(text[i:j])
            if sp.id_to_piece(k) == text[i:j]:
                go(j, [*ids, k], weight + m.weight[k])

    go(0, [], 0.0)
    n, total = 50_000, sum(ways.values())
    ids, counts = pieces.sample(m, pa.array([text[1:]]), np.zeros(n, np.int64), pieces.mix64(np.arange(n, dtype=np.uint64) * pieces.STEP))
    got = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    assert set(got) <= set(ways)
    for k, w in ways.items():
        p = w / total
        assert abs(got[k] - n * p) <= 5 * math.sqrt(n * p) + 3


def test_draws_follow_the_lattice_of_spaces():
    """Runs of spaces: every segmentation of the whole text, with pieces of several spaces, against its exact probability."""
    m = pieces.model(PATH)
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    whole, text = "▁a▁▁▁b▁▁", "a   b  "
    ways = {0: {(): 0.0}}
    for i in range(len(whole)):
        for ids, weight in ways.get(i, {}).items():
            for j in range(i + 1, len(whole) + 1):
                k = sp.piece_to_id(whole[i:j])
                if sp.id_to_piece(k) == whole[i:j]:
                    ways.setdefault(j, {})[*ids, k] = weight + m.weight[k]
    ways = {ids: math.exp(w) for ids, w in ways[len(whole)].items()}
    n, total = 20_000, sum(ways.values())
    got = Counter(tuple(x.tolist()) for x in pieces.encode_block(m, pa.array(range(n)), pa.array([text] * n), 0))
    assert set(got) <= set(ways) and len(ways) > 8
    for k, w in ways.items():
        p = w / total
        assert abs(got[k] - n * p) <= 5 * math.sqrt(n * p) + 3
    odd = ["", " ", "  ", " a", "a ", "  a  b  ", None, "é😀" * 3000, " " * 5000, "\0 \0  \0"]
    back = pieces.encode_block(m, pa.array(range(len(odd))), pa.array(odd, pa.string()), 0)
    assert [pieces.decode_ids(m, x.tolist()) for x in back] == [x or "" for x in odd]


def test_sampled_ids_equal_a_plain_sampler(spark, small):
    """op10 as registered, over some whole texts: forward filtering and backward sampling word by word, by loops."""
    m, mask = pieces.model(PATH), 2**64 - 1
    mix = lambda x: int(pieces.mix64(np.array([x & mask], np.uint64))[0])
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PATH)
    known = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    docs = small.orderBy("doc_id").limit(25).unionByName(spark.createDataFrame([(-1, "  two  spaces ▁ ends  ", "", "", 0), (-2, "", "", "", 0), (-3, None, "", "", 0), (None, "née 語", "", "", 0)], small.schema))

    def ids_of(key, text):
        row, out = pieces.xxhash.xxh3_64_intdigest(repr(key)), []
        words = __import__("re").findall(r" *[^ ]+| +$", " " + text) if text else []
        words = [w.replace("▁", chr(0x110000 - 1)).replace(" ", "▁") for w in words]
        for number, w in enumerate(words):
            own, edges, total = mix(mix(row) ^ (number * int(pieces.BASE) & mask)), [[] for _ in range(len(w) + 1)], [0.0] + [-math.inf] * len(w)
            for z in range(1, len(w) + 1):
                for k in range(1, min(z, m.longest) + 1):
                    if (i := known.get(w[z - k : z])) is not None:
                        edges[z].append((k, [i], m.weight[i]))
                if not any(k == 1 for k, _, _ in edges[z]):
                    data = w[z - 1].replace(chr(0x110000 - 1), "▁").encode()
                    edges[z].insert(0, (1, [int(m.byte_id[b]) for b in data], m.byte_weight * len(data)))
                total[z] = math.log(sum(math.exp(total[z - k] + x) for k, _, x in edges[z]))
            at, step, drawn = len(w), 0, []
            while at:
                step += 1
                u, run = (mix(own + step * int(pieces.STEP)) >> 34) * 2.0**-30, 0.0
                for k, ids, x in edges[at]:
                    run += math.exp(total[at - k] + x - total[at])
                    if u < run:
                        break
                drawn.append(ids)
                at -= k
            out += [i for ids in reversed(drawn) for i in ids]
        return out

    path = str(spark.sparkContext.getConf().get("spark.checkpoint.dir")) + "/few"
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_pieces, r.ids_crc32, r.lossless) for r in queries.op10_sampled_pieces(spark, path).collect())
    want = [(r.doc_id, ids_of(r.doc_id, r.text or "")) for r in docs.collect()]
    assert got == sorted((str(k), len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for k, x in want)


def test_seeds_and_keys_differ():
    m, t = pieces.model(PATH), pa.array(["the same words in each of these rows"] * 2)
    a, b = pieces.encode_block(m, pa.array([1, 2]), t, 0)
    (c,) = pieces.encode_block(m, pa.array([1]), t.slice(0, 1), 1)
    assert a.tolist() != b.tolist() and a.tolist() != c.tolist()


# --- Merkle ------------------------------------------------------------------------


def archive(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return merkle.placed(merkle.records(df), 3)


def test_offsets_are_prefix_sums(spark):
    pages = [(i * 7 % 50, f"http://x/{i}", "é" * (i % 9)) for i in range(50)] + [(None, None, None), (3, "dup", None), (3, "dup", None)]
    got = archive(spark, pages).orderBy("offset").collect()
    at = 0
    for r in got:
        assert r.offset == at
        at += r.length
    assert len(got) == 53 and [r.key for r in got] == sorted([p[0] for p in pages], key=lambda k: (k is not None, k))


def test_audit_locates_every_fault_and_nothing_else(spark):
    pages = [(i, f"http://x/{i}", "body " * (i % 40)) for i in range(300)]
    index = archive(spark, pages).cache()
    rows = {r.key: r for r in index.collect()}
    bad, gone = {5, 77, 78, 299}, {0, 150}
    found = [(r.offset, r.length, "0" * 64 if k in bad else r.sha) for k, r in rows.items() if k not in gone] + [(10**9, 5, "f" * 64)]
    replica = spark.createDataFrame(found, "offset long, found_length long, found_sha string")
    got = {(r.key, r.status) for r in merkle.audit(index, replica, range_bytes=1024, fan=4).collect()}
    assert {x for x in got if x[1] != "extra"} == {(k, "altered") for k in bad} | {(k, "missing") for k in gone}
    same = index.select("offset", F.col("length").alias("found_length"), F.col("sha").alias("found_sha"))
    assert merkle.audit(index, same, range_bytes=1024, fan=4).count() == 0
    assert merkle.audit(index.where("false"), same.where("false")).count() == 0
    one, two = merkle.tree(index, 1024, 4), merkle.tree(index.repartition(7), 1024, 4)
    root = lambda t: t[0].where(F.col("level") == t[1]).first().hash
    assert root(one) == root(two) and one[0].where(F.col("level") == one[1]).count() == 1


# --- Pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen, stages = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, seen, d)
        assert name == "best-fit packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen = stages[name] = spark.read.parquet(str(tmp_path / name))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for r in stages["toxicity"].collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in stages["exact dedup"].collect())
    near = stages["near dedup"].collect()
    assert len({r.doc_id for r in near}) == len(near) < len(best)
    safe = {r.doc_id: r for r in stages["secret scan"].collect()}
    assert set(safe) == {r.doc_id for r in near} and not any("token = " in r.text for r in safe.values())
    assert all(r.n_chars == len(r.text) for r in safe.values())
    assert {r.doc_id for r in seen.collect()} == set(safe)
    assert P.ORACLE_SQL is None and [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "near dedup", "secret scan", "best-fit packing"]


def test_a_run_takes_back_what_its_stages_made(spark):
    import corpus_pipeline as P

    from tessera.llm import common

    common.release(spark)
    packed = P.run(spark, "/root/testdata/sf0.001")
    n = packed.count()
    assert n > 100
    left = [x for x in common.made() if isinstance(x, str)]
    assert len(left) <= 5 and sum("tessera-stage" in x for x in left) == 1 and packed.count() == n
    common.release(spark)
    assert not common.made()


@pytest.mark.parametrize("table", ["awkward", "nothing", "clashing"])
def test_every_stage_takes_odd_rows(request, table):
    import corpus_pipeline as P

    docs = request.getfixturevalue(table)
    for name, stage in P.STAGES:
        out = stage(docs.sparkSession, docs, "/root/testdata/sf0.001")
        assert name == "best-fit packing" or out.columns == docs.columns
        out.collect()
