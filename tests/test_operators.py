import collections
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.functions.text import porter
from tessera.operators import chunks, context, extract, fusion, graph, lexical, semantic
from tessera.sources import config, files, store
from tessera.streaming import watch


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=60), max_size=60), st.integers(5, 60), st.integers(0, 20))
def test_windows_cover_lines_and_move_on(lines, most, overlap):
    got = chunks.windows(lines, most, overlap, least=0)
    assert [a for a, _ in got] == sorted({a for a, _ in got})
    assert {i for a, z in got for i in range(a, z)} == set(range(len(lines)))
    cost = [max(1, len(x) // 4) + 1 for x in lines]
    assert all(sum(cost[a:z]) <= most or z - a == 1 for a, z in got)


def test_shards(spark):
    long = "\n".join(f"const line{i} = value{i};" for i in range(200))
    rows = [("f", 0, "FUNCTION", "big", long, 10, 209, ["big"]), ("f", 1, "MISC", None, "x", 1, 1, []), ("f", 2, "COMPONENT", "Small", "x", 1, 1, [])]
    df = spark.createDataFrame(rows, "file_id string, ordinal int, chunk_type string, name string, text string, start_line int, end_line int, symbols array<string>")
    got = sorted(chunks.stored(chunks.shards(df)).collect(), key=lambda r: (r.ordinal, r.shard_index or 0))
    big = [r for r in got if r.ordinal == 0]
    assert [r.name for r in big][:2] == ["big", "big[1]"] and big[0].start_line == 10 and big[-1].end_line == 209
    assert {r.shard_total for r in big} == {len(big)} and len({r.id for r in got}) == len(got)
    assert [r.name for r in got if r.ordinal] == ["Small"]
    for r in big:
        assert r.text == "\n".join(long.split("\n")[r.start_line - 10 : r.end_line - 9])


def test_parse_finds_lines(spark):
    src = "import a from 'a';\n\nexport default async function useThing(x) {\n  return 1;\n}\nconst Big = (p) => <Tag/>;\n"
    got = {r.name: r for r in chunks.parsed(spark.createDataFrame([("f", src), ("e", ""), ("g", "!! not code")], "id string, text string")).collect()}
    assert (got["useThing"].chunk_type, got["useThing"].start_line) == ("HOOK", 3)
    assert (got["Big"].chunk_type, got["Big"].start_line) == ("COMPONENT", 6)
    assert got[None].chunk_type == "IMPORT_BLOCK" and len(got) == 3


@pytest.mark.parametrize("seed", range(4))
def test_walk_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice("AB"), rng.random()) for _ in range(30)]
    df = spark.createDataFrame(edges, "from_id string, to_id string, edge_type string, weight double")
    got = {r.node: r.score for r in graph.walk(df, spark.createDataFrame([("n0",), ("n1",)], "node string"), 3).collect()}
    best, seen, at = {}, set(), {"n0", "n1"}
    for level in range(3):
        hit = {}
        for a, b, _, w in edges:
            if a in at:
                hit[b] = max(hit.get(b, 0), w * 0.65**level)
        for k, v in hit.items():
            best[k] = max(best.get(k, 0), v)
        at = set(hit) - seen
        seen |= at
    assert got == pytest.approx(best)


def test_context_stops_at_the_first_overflow(spark):
    rng = random.Random(1)
    for _ in range(8):
        sizes = [rng.randrange(4, 700) for _ in range(8)]
        df = spark.createDataFrame([(0, i, "x" * n) for i, n in enumerate(sizes)], "q int, rank int, text string")
        got = [(r.rank, len(r.packed)) for r in context.packed(df, ["q"], ["rank"], "text", 250).orderBy("rank").collect()]
        want, used = [], 0
        for i, n in enumerate(sizes):
            t = max(1, n // 4)
            if used + t > 250:
                if 250 - used > 50:
                    want.append((i, min(n, 4 * (250 - used))))
                break
            want.append((i, n))
            used += t
        assert got == want


def test_quantised_vectors_are_close(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>").withColumn("z", vectors.quantise(F.col("v")))
    for r in df.withColumn("b", vectors.dequantise(F.col("z.q"), F.col("z.scale"))).collect():
        assert all(abs(a - b) <= r.z.scale / 254 + 1e-12 for a, b in zip(r.v, r.b, strict=True))


def test_semantic_search_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(5)
    q = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in semantic.search(q, df, 3, block=4).collect()}
    for i, v in rows[::20]:
        want = sorted(rows, key=lambda x: (-round(sum(a * b for a, b in zip(v, x[1], strict=True)), 12), x[0]))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [w[0] for w in want]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("controlling", "control"), ("rate", "rate"), ("cease", "ceas"), ("sky", "sky")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_text_functions(spark):
    df = spark.createDataFrame([("where is useAuth for login",)], "q string")
    r = df.select(text.query_terms(F.col("q")).alias("t"), text.expand(F.col("q")).alias("e"), text.language(F.lit("a/b.tsx")).alias("l"), text.language(F.lit("x")).alias("n")).first()
    assert r.t[:4] == ["useAuth", "use", "auth", "useauth"] and "signin" in r.t and "sign in" not in r.t
    assert r.e.startswith("where is useAuth for login signin") and r.e.endswith("use auth")
    assert (r.l, r.n) == ("typescript", "javascript")


def test_overlapping_results_go(spark):
    rows = [(0, 1, "a", 1, 10), (0, 2, "a", 5, 12), (0, 3, "a", 11, 20), (0, 4, "b", 5, 6)]
    got = fusion.without_overlap(spark.createDataFrame(rows, "query_id int, rank int, file_path string, start_line int, end_line int"), "query_id")
    assert sorted(r["rank"] for r in got.collect()) == [1, 3, 4]


def test_store_upsert_cache_and_eviction(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.set_metadata("a", "1")
    s.set_metadata("a", "2")
    assert s.metadata("a") == "2" and s.metadata("b") is None
    s.remember("k", [1, 2], ttl=3600)
    s.remember("old", [3], ttl=-1)
    assert s.cached("k") == [1, 2] and s.cached("old") is None
    assert s.evict() == 1 and s.evict() == 0
    s.forget()
    assert s.cached("k") is None


def test_insert_ignore_keeps_the_first(spark):
    old = spark.createDataFrame([("a", "b", 1)], "x string, y string, n int")
    new = spark.createDataFrame([("a", "b", 2), ("c", "d", 4), ("c", "d", 3)], "x string, y string, n int")
    assert sorted(map(tuple, store.insert_ignore(old, new, ["x", "y"], ["n"]).collect())) == [("a", "b", 1), ("c", "d", 3)]


def test_scan(spark, tmp_path):
    for name, data in {"src/a.ts": b"x\ny", "src/b.py": b"", "dist/c.js": b"", "src/hooks/d.tsx": b"\xff\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.ts", "src/hooks/d.tsx"}
    assert got["src/a.ts"].line_count == 2 and got["src/hooks/d.tsx"].text == "�\n" and got["src/hooks/d.tsx"].file_type == "HOOK"
    known = spark.createDataFrame([(got["src/a.ts"].id, got["src/a.ts"].content_hash), ("gone", "x")], "id string, content_hash string")
    scanned = files.scan(spark, str(tmp_path))
    assert [r.path for r in files.changed(scanned, known).collect()] == ["src/hooks/d.tsx"]
    assert [r.id for r in files.removed(scanned, known).collect()] == ["gone"]


def test_config_from_the_environment(tmp_path):
    (tmp_path / "c.json").write_text('{"indexer": {"max_chunk_tokens": 5}}')
    c = config.load(str(tmp_path / "c.json"), {"TESSERA_RETRIEVAL_DEFAULT_TOP_K": "3"})
    assert c["indexer"]["max_chunk_tokens"] == 5 and c["retrieval"]["default_top_k"] == 3


def test_fetch_calls(spark):
    df = spark.createDataFrame([("c", "fetch('/a'); fetch('/a'); axios.POST('/b'); fetch(`/c/${id}`)")], "chunk_id string, text string")
    got = {(r.method, r.endpoint, r.client_type, r.is_dynamic) for r in extract.api_calls(df).collect()}
    assert got == {("GET", "/a", "fetch", False), ("POST", "/b", "axios", False), ("GET", "/c/${id}", "fetch", False), ("GET", "/c/*", "fetch", True)}


def test_lexical_helpers(spark):
    docs = spark.createDataFrame([(1, "use the hook"), (2, "the used hooks"), (3, None)], "id long, t string")
    assert [r.id for r in lexical.phrase(docs, "id", "t", ["the", "hook"]).collect()] == [1]
    post = lexical.postings(docs, "id", "t")
    assert {r.term for r in lexical.by_prefix(post, "hook").collect()} == {"hook", "hooks"}
    assert {r.term for r in lexical.fuzzy(post, "uses").collect()} == {"use", "used"}


def throttled(events, seconds):
    last, out = {}, []
    for k, t in sorted(events, key=lambda x: (x[1])):
        if k not in last or t - last[k] >= seconds:
            last[k] = t
            out.append((k, t))
    return sorted(out)


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.choice("ab"), float(t)) for t in range(0, 40)]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(events)], "k string, i int, t double").select("k", "i", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r.k, r.ts.timestamp()) for r in watch.throttle_batch(df, "k", "ts", "i").collect())
    assert got == throttled(events, 3.0)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = watch.throttle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts")
    q = stream.writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.ts_seconds) for r in spark.table("throttled").collect()) == throttled(events, 3.0)


def test_stemmed_postings_equal_plain_counts(spark):
    rows = [(1, "Runs running, ran. THE cats", "cat cats"), (2, None, "relational"), (3, "", ""), (4, None, None), (5, "x " * 3000, "x")]
    docs = spark.createDataFrame(rows, "id long, name string, text string")
    for stem in (False, True):
        want = []
        for i, name, text in rows:
            n = collections.Counter()
            for value, weight in ((name, 3), (text, 1)):
                for w in re.findall("[a-z0-9]+", (value or "").lower()):
                    n[porter(w) if stem else w] += weight
            want += [(w, i, tf, n.total()) for w, tf in n.items()]
        got = lexical.postings(docs, "id", "name", "text", stem=stem, weights={"name": 3})
        assert sorted(map(tuple, got.select("term", "id", "tf", "doc_len").collect())) == sorted(want)
