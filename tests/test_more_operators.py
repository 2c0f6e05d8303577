"""Places of words, similar words, vectors of tokens, bindings, impact: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bindings, chunks, extract, graph, lexical, neural, positions, semantic

DOCS = [(1, "the old oven and the new oven timer"), (2, "oven timer"), (3, None), (4, ""), (5, "timer oven timer the oven"), (6, "a " * 5000 + "the oven timer")]


@pytest.fixture(scope="module")
def post(spark):
    return positions.positional(spark.createDataFrame(DOCS, "doc_id long, text string"), "doc_id", "text")


def asked(spark, *texts):
    return positions.asked(spark.createDataFrame(list(enumerate(texts)), "query_id long, q string"), "query_id", "q")


def test_positions(post):
    rows = {(r.doc_id, r.term): (r.tf, r.doc_len, r.positions) for r in post.collect()}
    assert rows[1, "oven"] == (2, 8, [2, 6]) and rows[6, "a"][0] == 5000 and not any(d in (3, 4) for d, _ in rows)


def test_only_asked_places_are_dealt_out(spark, post):
    """Places are no rows before the shuffle, and of other terms none is in it; a repeated row changes nothing."""
    docs = spark.createDataFrame(DOCS + DOCS[:2], "doc_id long, text string")
    only = spark.createDataFrame([("oven",), ("old",), ("oven",), ("none",)], "term string")
    got = positions.positional(docs, "doc_id", "text", only=only)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, post.where("term IN ('oven', 'old')").collect()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(positions.placed(docs, "doc_id", "text")) and "Aggregate" not in plan(positions.placed(docs, "doc_id", "text"))
    assert plan(got).index("RepartitionByExpression") < plan(got).index("LeftSemi")  # plans are read from below


def test_phrases_with_repeated_words(spark, post):
    ask = asked(spark, "oven timer", "timer oven timer", "oven", "", "never seen")
    got = sorted((r.query_id, r.doc_id, r.n_found, r.first) for r in positions.phrases(ask, post).collect())
    assert got == [(0, 1, 1, 6), (0, 2, 1, 0), (0, 5, 1, 1), (0, 6, 1, 5001), (1, 5, 1, 0), (2, 1, 2, 2), (2, 2, 1, 0), (2, 5, 2, 1), (2, 6, 1, 5001)]


def test_nearness(spark, post):
    got = sorted((r.query_id, r.doc_id, r.span) for r in positions.proximity(asked(spark, "old timer", "oven the"), post, 7).collect())
    assert got == [(0, 1, 7), (1, 1, 3), (1, 5, 2), (1, 6, 2)]


def test_snippets(spark, post):
    got = {(r.query_id, r.doc_id): (r.start, r.n_words, r.n_hits) for r in positions.snippets(asked(spark, "the oven timer"), post, 3).collect()}
    assert got == {(0, 1): (0, 2, 2), (0, 2): (0, 2, 2), (0, 5): (1, 3, 3), (0, 6): (5000, 3, 3)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_similar_words_equal_all_pairs(spark, distance):
    r = random.Random(distance)
    some = lambda n: sorted({"".join(r.choice("abc") for _ in range(r.randrange(13))) for _ in range(n)})
    words, terms = some(60), some(200)
    got = {(x.word, x.term, x.distance) for x in lexical.similar(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in terms], "term string"), distance).collect()}
    assert got == {(w, t, edits(w, t)) for w in words for t in terms if edits(w, t) <= distance}


def test_words_that_sound_alike(spark):
    got = lexical.sounding_alike(spark.createDataFrame([("robert",), ("oven",)], "word string"), spark.createDataFrame([("rupert",), ("robert",), ("rubin",), ("ovum",)], "term string"))
    assert {(r.word, r.term) for r in got.collect()} == {("robert", "rupert"), ("oven", "ovum")}


def test_pooling_of_short_and_long_texts(spark, monkeypatch):
    table = np.random.default_rng(0).normal(size=(50, 6))
    rows = [(i, [int(x) for x in np.random.default_rng(i).integers(0, 50, n)]) for i, n in enumerate([0, 1, 3, 700, 40_000, 2])] + [(9, None)]
    df = spark.createDataFrame(rows, "id long, t array<int>")
    got = {r.id: r.vector for r in neural.pooled(df, "id", F.col("t"), neural.sent(spark, table)).collect()}
    for i, t in rows:
        want = table[t].mean(axis=0) if t else np.zeros(6)
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))
    with pytest.raises(ValueError):
        monkeypatch.setattr(neural, "TABLE_BYTES", 10)
        neural.sent(spark, table)


def test_late_interaction(spark):
    table = np.random.default_rng(1).normal(size=(30, 4))
    rows = [(1, 1, [1, 2], [3, 4, 5]), (1, 2, [1, 2], []), (2, 1, None, [1]), (3, 3, [7], list(range(30)) * 300)]
    got = {(r.q, r.k): r.score for r in neural.late_interaction(spark.createDataFrame(rows, "q long, k long, asked array<int>, tokens array<int>"), "q", "k", neural.sent(spark, table)).collect()}
    for q, k, a, t in rows:
        assert got[q, k] == pytest.approx((table[a] @ table[t].T).max(axis=1).sum() if a and t else 0)


def test_exact_search_of_many_groups(spark):
    r = np.random.default_rng(2)
    v = [(i, [float(x) for x in r.normal(size=5).round(1)]) for i in range(400)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(5000, None)]
    df = spark.createDataFrame(v, "vec_id long, vector array<double>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    m = np.array([x for _, x in v[:-1]])
    for block in (1, 256):
        got = sorted((x.query_id, x["rank"], x.vec_id) for x in semantic.search(q, df, 4, block=block).collect())
        want = sorted((i, n + 1, v[j][0]) for i, x in v[:-1] if i % 50 == 0 for n, j in enumerate(np.lexsort((np.arange(len(m)), -np.round(m @ np.array(x), 12)))[:4]))
        assert got == want
    assert semantic.search(q, df.limit(0), 4).collect() == [] and semantic.search(q.limit(0), df, 4).collect() == []


def test_bindings_through_cycles_and_missing_files(spark):
    files = [
        ("a", "src/a.ts", "export * from './b';\nexport { x as y } from './b';\n"), ("b", "src/b.ts", "export * from './a';\nimport q from './none';\nexport function x() {}\n"),
        ("c", "src/c.ts", "import { x, y as z } from './a';\nimport * as all from './b';\nimport { gone } from './a';\nimport d from 'react';\nfunction x1() {}\n"),
    ]
    chunks = [("kx", "b", "x", "FUNCTION", "function x() {}"), ("kc", "c", "x1", "FUNCTION", "x() + z() + gone() + d() + x1()")]
    f, c = spark.createDataFrame(files, "id string, path string, text string"), spark.createDataFrame(chunks, "id string, file_id string, name string, chunk_type string, text string")
    assert sorted((r.file_id, r.local, r.target) for r in bindings.bindings(f, c).collect()) == [("c", "x", "kx"), ("c", "z", "kx")]
    assert sorted(map(tuple, bindings.edges(f, c).collect())) == [("kc", "kx", "CALLS")]


def test_impact_and_meeting_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("c", "a", "X"), ("c", "d", "X"), ("a", "d", "Z"), ("d", "e", "X")], "from_id string, to_id string, edge_type string")
    seeds = spark.createDataFrame([("a",), ("e",)], "node string")
    got = {(r.seed, r.node): (r.distance, "".join(r.path), "".join(r.kinds)) for r in graph.impact(edges, seeds, 9, reverse=False).collect()}
    assert got == {("a", "b"): (1, "ab", "X"), ("a", "d"): (1, "ad", "Z"), ("a", "c"): (2, "abc", "XY"), ("a", "e"): (2, "ade", "ZX")}
    assert {r.node for r in graph.impact(edges, seeds.where("node = 'e'"), 2).collect()} == {"d", "a", "c"}
    pairs = spark.createDataFrame([("a", "e"), ("b", "e"), ("e", "a"), ("c", "c"), ("b", "d")], "a string, b string")
    assert {(r.a, r.b): r.distance for r in graph.between(edges, pairs, 9).collect()} == {("a", "e"): 2, ("b", "e"): 3, ("c", "c"): 0, ("b", "d"): 2}


def test_bucket_search_makes_no_pairs(spark):
    """Against a plain loop over queries; a query that meets nothing has no rows, and no row is paired by a join."""
    r = np.random.default_rng(2)
    v, planes = r.normal(size=(90, 6)), r.normal(size=(2, 5, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, vector array<double>")
    q = df.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id")
    found = semantic.near(q, df.where("vec_id % 4 <> 0"), 4, planes, 1)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    sides = np.einsum("nd,tbd->ntb", v, planes)
    want = set()
    for i in range(0, 90, 9):
        ok = [j for j in range(90) if j % 4 and any(all(b == np.abs(sides[i, t]).argmin() or (sides[i, t, b] >= 0) == (sides[j, t, b] >= 0) for b in range(5)) for t in range(2))]
        want |= {(i, n, j) for n, j in enumerate(sorted(ok, key=lambda j: (-round(v[i] @ v[j], 12), j))[:4], 1)}
    assert {(x.query_id, x["rank"], x.vec_id) for x in found.collect()} == want


def test_meetings_equal_searches_of_all_pairs(spark):
    """Starts and ends of a group as pairs, on random edges; a start in two groups, and ends without one."""
    r = random.Random(5)
    edges = spark.createDataFrame([(str(r.randrange(40)), str(r.randrange(40))) for _ in range(70)], "from_id string, to_id string").withColumn("edge_type", F.lit("X"))
    starts = spark.createDataFrame([(str(i), i % 3) for i in range(20)] + [("1", 0)], "a string, g int")
    ends = spark.createDataFrame([(str(i), i % 3) for i in range(15, 40)] + [("2", None)], "b string, g int")
    for depth in (0, 1, 3, 4):
        got = sorted(map(tuple, graph.meetings(edges, starts, ends, depth, ["g"]).collect()))
        assert got == sorted(map(tuple, graph.between(edges, starts.join(ends, "g"), depth).collect())) and (got or not depth)


def test_meetings_make_no_pairs(spark):
    """Starts times ends of one group would be 900 million rows; one way meets."""
    starts, ends = spark.range(30_000).select(F.concat(F.lit("C"), "id").alias("a"), F.lit(0).alias("g")), spark.range(30_000).select(F.concat(F.lit("S"), "id").alias("b"), F.lit(0).alias("g"))
    edges = spark.createDataFrame([("C7", "O", "X"), ("O", "P", "X"), ("P", "S9", "X")], "from_id string, to_id string, edge_type string")
    assert [tuple(r) for r in graph.meetings(edges, starts, ends, 3, ["g"]).collect()] == [("C7", "S9", 3)]


def test_min_max_and_beginnings(spark):
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 3.0), (2, 1, 5.0)], "query_id long, doc_id long, bm25 double")
    assert {(r.query_id, r.doc_id): r.share for r in lexical.min_max(hits, "query_id").collect()} == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 0.5, (2, 1): 1.0}
    vocabulary = spark.createDataFrame([("oven",), ("ovens",), ("ove",), ("timer",)], "term string")
    asked = spark.createDataFrame([(1, "oven"), (1, "tim"), (2, "ov"), (2, "none"), (3, "time")], "query_id long, term string")
    assert sorted(map(tuple, lexical.or_beginnings(asked, vocabulary).collect())) == [(1, "oven"), (1, "timer"), (3, "timer")]
    assert lexical.or_beginnings(asked.limit(0), vocabulary).collect() == [] and lexical.or_beginnings(asked, vocabulary.limit(0)).collect() == []


def test_caps_of_a_file(spark):
    rows = [(f"c{i:02}", "a", "MISC" if i % 2 else "HOOK", 100 - i, ["x"] * 30) for i in range(40)] + [("d", "b", "NEW", 1, None)]
    got = chunks.capped(spark.createDataFrame(rows, "id string, file_id string, chunk_type string, start_line int, symbols array<string>"), 25).collect()
    kept = {r.id for r in got if r.file_id == "a"}
    assert len(kept) == 25 and {f"c{i:02}" for i in range(0, 40, 2)} <= kept and {f"c{i}" for i in (39, 37, 35, 33, 31)} <= kept
    assert {len(r.symbols) for r in got if r.symbols} == {20} and "d" in {r.id for r in got}


def test_parts_of_code(spark):
    code = "const [a, setA] = useState(0); const [ s ,dispatch] = React.useReducer(r, {}); const X = createContext(null); useContext( Y ); <b onClick={f} onMouseOver = {() => g()} once={1} />"
    got = sorted((r.part, r.name) for r in extract.parts(spark.createDataFrame([("c", code), ("d", None)], "id string, text string")).collect())
    assert got == [("context", "Y"), ("handler", "onClick"), ("handler", "onMouseOver"), ("provider", "X"), ("state", "a"), ("state", "s")]


def test_best_documents_equal_the_joined_way(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(12)))) for i in range(300)] + [(1000 + i, "a bb c") for i in range(40)]
    asked = spark.createDataFrame([(q, t) for q in range(60) for t in r.sample(["a", "bb", "c", "dd", "e", "ff", "g", "zz"], 3)], "query_id long, term string")
    post, size = lexical.asked_postings(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", asked)
    one = sorted(map(tuple, lexical.best(asked, post, size, "query_id", "doc_id", 5).select("query_id", "doc_id", "bm25", "rank").collect()))
    other = sorted(map(tuple, lexical.best(asked, post, size, "query_id", "doc_id", 5, most=0).select("query_id", "doc_id", "bm25", "rank").collect()))
    assert one == other and len(one) > 200
    assert lexical.best(asked.limit(0), post, size, "query_id", "doc_id", 5).collect() == []
    names = spark.createDataFrame([("q", "a")], "query_id string, term string")
    words = post.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert [r.doc_id for r in lexical.best(names, words, size, "query_id", "doc_id", 2).collect()] == [r.doc_id for r in lexical.best(names, words, size, "query_id", "doc_id", 2, most=0).collect()]
