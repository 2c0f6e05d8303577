"""What is written beside the results: rows of segments, postings and levels of a walk stay where they are, and shuffle files go in time."""

import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera import queries, queries_code
from tessera.operators import graph, lexical
from tessera.plans import index
from tessera.sources import store

D = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    n = 0
    while files.hasNext():
        n += files.next().getName().startswith("shuffle_")
    return n


TEXTS = ["One two, TWO; one-two 9", "", None, "--", "Kelvin İx cafés 9 9", "word " * 3000, "one\ntwo\x00three"]


def test_postings_of_documents_are_counted_where_they_are(spark, monkeypatch):
    """F1, F2. Before, a row for each word of a text was dealt out by term, four times the text, and its files joined to it."""
    monkeypatch.setattr(store, "spread", lambda df: df)  # as for large tables
    docs = spark.createDataFrame([(str(i), "f", t) for i, t in enumerate(TEXTS)], "id string, source string, text string")
    for file in ("id", "source"):
        got = queries_code._postings(docs, file) if file != "id" else queries_code._postings(docs)
        assert "Exchange" not in physical(got)
        want = lexical.postings(docs.withColumnRenamed("id", "chunk_id"), "chunk_id", "text")
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert {(r.chunk_id, r.file_id) for r in got.collect()} == {(str(i), str(i) if file == "id" else "f") for i in (0, 4, 5, 6)}


def test_postings_of_documents_with_one_id_are_added_up(spark):
    docs = spark.createDataFrame([("a", "one two one"), ("a", "one four five"), ("b", "one")], "id string, text string")
    got = {(r.term, r.chunk_id): r.tf for r in queries_code._postings(docs).where("doc_len = 3").collect()}
    assert got == {("one", "a"): 3, ("two", "a"): 1, ("four", "a"): 1, ("five", "a"): 1}


def test_texts_that_are_not_found_stay_where_they_are(spark):
    """F1. Before, all chunks were dealt out, texts and all, to be joined with the few that searches had found."""
    p = queries_code.hybrid_search(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi, \(\w+#\d+ = chunk_id#\d+\), rightHint=\(strategy=broadcast\)", p)


def test_shuffle_files_go_once_a_table_is_written(spark):
    """F1 to F3. Before, they were there until the driver happened to collect its garbage."""
    before = shuffle_files(spark)
    out = store.kept(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count())
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_files(spark) <= before and out.count() == 5


@pytest.fixture
def changed(spark, tmp_path):
    """Segments with live rows, rows of files that went to another segment, and of files that are gone."""
    s = store.Store(spark, str(tmp_path))
    docs = spark.createDataFrame([(str(i), f"word{i} one") for i in range(40)], "id string, text string")

    def change(some, gone):
        index.apply(s, gone.select("id"), {"files": some.select("id", F.lit(1).alias("size_bytes")), "chunks": some.select("id", F.col("id").alias("file_id"), "text"), "postings": queries_code._postings(some)})

    change(docs, docs.limit(0))
    some = docs.where("id % 4 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    change(some, some)
    change(docs.limit(0), docs.where("id % 5 = 0"))
    want = sorted((t, str(i)) for i in range(40) if i % 5 for t in ("one", f"word{i}", *(["changed"] if i % 4 == 0 else [])))
    return s, want


@pytest.mark.parametrize("sent", [1000, 20, 0])
def test_rows_of_segments_are_not_dealt_out(spark, changed, monkeypatch, sent):
    """F2. Before, many files were joined by dealing out all rows. Files in segments are sent, those no longer in them (18 of 32), or, if both are too many, joined."""
    s, want = changed
    monkeypatch.setattr(store, "SENT", sent)
    monkeypatch.setattr(store, "small", lambda df, most: most != 1 << 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = s.read("postings")
        assert ("Exchange hashpartitioning" in physical(rows)) == (sent == 0)
        assert sorted((r.term, r.chunk_id) for r in rows.collect()) == want
        assert s.merge(2) in (0, 2)
        s.sweep()
        assert sorted((r.term, r.chunk_id) for r in s.read("postings").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_segment_is_written_without_sorting(spark, changed, monkeypatch):
    """F1, F2. Before, a segment's rows were dealt out once more, and sorted by the segment, which is one."""
    s, _ = changed
    seen, write = [], type(spark.range(0)).write.fget
    monkeypatch.setattr(store, "small", lambda df, most: False)
    monkeypatch.setattr(type(spark.range(0)), "write", property(lambda df: (seen.append(physical(df)), write(df))[1]))
    name = uuid.uuid4().hex
    s._put("postings", spark.range(9).select(F.lit("t").alias("term"), F.col("id").cast("string").alias("chunk_id"), F.col("id").cast("string").alias("file_id")), name)
    assert len(seen) == 1 and "Exchange" not in seen[0]
    rows = s._segments("postings").where(F.col("segment") == name)
    assert rows.count() == 9 and [x.getName() for x in [f.getPath() for f in s._fs("x")[0].listStatus(s._fs(f"{s.folder}/postings")[1])] if name in x.getName()] == [f"segment={name}"]


def test_levels_of_kinds_move_their_own_edges_only(spark):
    """F3. Before, all edges were made distinct, dealt out and held for all levels, and ways were shuffled with seeds, ends and lists."""
    found = graph.impact(queries.edges(spark, D, once=False), queries._seeds(spark, D, "supplier", "s_suppkey", "S"), 3)
    by_kind = queries.impact_report(spark, D)
    rows = lambda df: sorted((r.seed, r.node, r.distance, r.path, r.kinds) for r in df.collect())
    assert rows(by_kind) == rows(found.select("seed", "node", "distance", F.array_join("path", ">").alias("path"), F.array_join("kinds", ">").alias("kinds")))
    assert "Exchange" not in physical(queries.edges(spark, D, once=False))
    assert not any("array" in x for x in re.findall("ReadSchema: (.*)", physical(by_kind)))


@pytest.mark.parametrize("sent", [0, 500_000])
def test_seeds_of_a_large_level_are_taken_some_at_a_time(spark, monkeypatch, sent):
    """F3. Before, a level's shuffle grew with all seeds."""
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", t) for i in range(12) for j in range(12) if (i * j) % 5 == 1 for t in "XY"] + [("n1", "n2", None)], "from_id string, to_id string, edge_type string")
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(12)], "node string")
    rows = lambda: sorted((r.seed, r.node, r.distance, tuple(r.path), tuple(k or "" for k in r.kinds)) for r in graph.impact(edges, seeds, 4).collect())
    want, calls = rows(), []
    monkeypatch.setattr(graph, "PART", 5)
    monkeypatch.setattr(graph, "SENT", sent)
    kept = graph.kept
    monkeypatch.setattr(graph, "kept", lambda *x: (calls.append(len(x)), kept(*x))[1])
    assert rows() == want and want
    assert max(calls) > 1
    for seed, node, distance, path, _ in want:
        assert path[0] == seed and path[-1] == node and len(path) == distance + 1 and len(set(path)) == len(path)
