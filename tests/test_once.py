"""Texts of source files are gone through in a line and once: declarations of long files, calls, names and parts of chunks."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.operators import chunks, extract

CODE = "// x\r\nimport { a } from './a';\n\n  import b from './b';\nexport default async function one(x) {\n  return x;\n}\nconst two = (y) =>\n  y;\nexport\nfunction\nthree (z) {}\nlet four=async(w) => w; const five = (v) => v;\n"


def plain(text):
    lines = re.split(r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text)
    for i, pattern in enumerate((fixed.FUNCTION, fixed.ARROW)):
        for n, m in enumerate(re.finditer(pattern, text, re.ASCII)):
            start = text.count("\n", 0, m.start()) + 1
            end = min(start + fixed.CHUNK_LINES - 1, len(lines))
            yield i * 100_000 + n, m[1], start, end, "\n".join(lines[start - 1 : end])
    at = [i for i, x in enumerate(lines, 1) if re.match(r"\s*import ", x, re.ASCII)]
    if at:
        yield 1_000_000, None, at[0], at[-1], "\n".join(lines[at[0] - 1 : at[-1]])


def test_long_files_are_gone_through_in_a_line(spark):
    """Before, each character after the last declaration was followed by a search to the end: 400,000 characters took hours."""
    texts = [CODE, "", "  \n ", "no code", None, "\n" * 70 + CODE * 3, CODE + "x = y + 1;\n" * 36_000]
    began = time.time()
    got = sorted((r.file_id, r.ordinal, r.name, r.start_line, r.end_line, r.text) for r in chunks.parsed(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect())
    assert time.time() - began < 60
    assert got == sorted((i, *x) for i, t in enumerate(texts) if t for x in plain(t) if re.search(r"\S", x[-1]))


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame([("c", "f", "COMPONENT", "const [a, setA] = useState(0);\nuseQuery('/q');\n<Route path='/r' element={<Page />} />")], "id string, file_id string, chunk_type string, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_searched_once(code):
    p = plan(extract.mentions(code))
    assert [p.count(x) for x in (fixed.EDGE_HOOK, fixed.USE_CONTEXT, fixed.EDGE_TAG, fixed.IMPORT_FROM)] == [1] * 4


def test_routes_are_searched_once(code):
    assert plan(extract.mentions(code).where("kind = 'DEFINES_ROUTE'")).count(fixed.ROUTE) == 2  # a group each
    assert [(r.name, r.path) for r in extract.mentions(code).where("kind = 'DEFINES_ROUTE'").collect()] == [("Page", "/r")]


def test_routes_alone_need_no_other_names(code):
    full = code.select("*", F.lit("Page").alias("name"), F.lit(1).alias("start_line"))
    files, symbols = code.select(F.lit("f").alias("id"), F.lit("a.tsx").alias("path")), code.select(F.col("id").alias("chunk_id"), F.lit("Page").alias("name"), F.lit("COMPONENT").alias("symbol_type"))
    routes = extract.edges_and_routes(files, full, symbols)[1]
    assert not any(x in plan(routes) for x in (fixed.EDGE_HOOK, fixed.USE_CONTEXT, fixed.EDGE_TAG, fixed.USE_STATE)) and fixed.ROUTE in plan(routes)
    assert [(r.path, r.component, r.chunk_id) for r in routes.collect()] == [("/r", "Page", "c")]


def test_calls_are_searched_once(code):
    calls = extract.api_calls(code, "id")
    assert plan(calls).count(fixed.USE_QUERY) == 1 and plan(calls).count(fixed.FETCH) == 2
    assert [tuple(r) for r in calls.collect()] == [("c", "GET", "/q", "useQuery", False)]


def test_parts_are_searched_once(code):
    parts = extract.parts(code)
    assert plan(parts).count("useContext") == 1
    assert [(r.part, r.name) for r in parts.collect()] == [("state", "a")]


def test_tables_read_only_their_columns_of_chunks(spark):
    from tessera.functions.vectors import hashed_encoder
    from tessera.plans import index
    from tessera.plugins import Plugins
    from tessera.sources import config

    files = spark.createDataFrame([("f", "src/a.ts", CODE)], "id string, path string, text string")
    symbols = index.new_tables(files, config.load(env={}), hashed_encoder, "hashed", Plugins(), False)["symbols"]
    read = symbols._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in read and "summary" not in read and "char_count" not in read
    assert symbols.count() > 0


def test_postings_of_a_small_table_are_worked_out_on_all_cores(spark):
    """Before, the one task that reads a file of one row group dealt its texts out into terms alone, and postings were joined with chunks."""
    from tessera import queries_code

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id AS string) AS id", "text")
    post = queries_code._postings(docs)
    assert "RepartitionByExpression" in plan(post)
    assert post.where("file_id <> chunk_id OR file_id IS NULL").isEmpty() and not post.isEmpty()


def test_levels_of_impact_are_kept_as_columns(spark):
    """Before, each level was whole rows, ways and all, read again for every later level's ends."""
    from tessera.operators import graph

    edges = spark.createDataFrame([("b", "a", "X"), ("c", "b", "Y"), ("a", "c", "X"), ("c", "a", "Z")], "from_id string, to_id string, edge_type string")
    found = graph.impact(edges, spark.createDataFrame([("a",)], "node string"), 3)
    assert "LogicalRDD" not in plan(found)
    assert sorted((r.node, r.distance, r.path, r.kinds) for r in found.collect()) == [("b", 1, ["a", "b"], ["X"]), ("c", 1, ["a", "c"], ["Z"])]


def test_long_names_are_found_by_one_pattern(spark):
    """The words that splitting and a pattern for each word gave, without a call for each word."""
    from tessera.queries_code import LONG_NAME

    texts = ["Capitals9 xCapitalisedNot Short ABCDEFGHI", "ABCDEFGHIJ_KLMNOPQRSTU-Épouvantable Überraschung Éléphantasm9", "9Capitalised\nCapitalised\r\nCapitalised", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.regexp_extract_all("t", F.lit(LONG_NAME), F.lit(0)).alias("x")).collect()
    assert [r.x for r in sorted(got)] == [None if t is None else [w for w in re.split("[^A-Za-z0-9]+", t) if re.fullmatch("[A-Z][a-zA-Z0-9]{8,}", w)] for t in texts]


def test_texts_that_are_not_found_are_not_looked_at(spark):
    """Before, the boost of every document was worked out, and then joined with those found."""
    from tessera import queries

    assert "LeftSemi" in plan(queries.hybrid_topk(spark, "/root/testdata/sf0.001"))


def test_stems_come_back_counted(spark):
    """Before, lists of all terms went to Python and back, and each term was a row of its own. The same postings, of repeated and odd texts, too."""
    from collections import Counter

    from tessera.functions.text import counted_stems, porter
    from tessera.operators import lexical

    texts = ["Running runs, run; the RUNNER", "", None, "--", "Kelvin İx cafés 9 9", "running " * 300]
    docs = spark.createDataFrame([(i, t, "runs day") for i, t in enumerate([*texts, *texts[:1]])], "id int, text string, title string")
    got = {(r.term, r.id): (r.tf, r.doc_len) for r in lexical.postings(docs, "id", "text", "title", stem=True, weights={"title": 3}).collect()}
    want = {}
    for r in docs.select("id", F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+").alias("t")).collect():
        n = Counter(porter(w) for w in r.t if w) + Counter({"run": 3, "dai": 3})
        want |= {(w, r.id): (k, sum(n.values())) for w, k in n.items()}
    assert got == want
    rows = docs.where("id = 5").select(counted_stems(F.col("text")).alias("x")).collect()
    assert [(r.x.n, [tuple(s) for s in r.x.terms]) for r in rows] == [(300, [("run", 300)])]
