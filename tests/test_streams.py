"""File events, entries with a time to live, table functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import tables
from tessera.queries_stream import _set
from tessera.streaming import expiry, tree


def test_file_events_survive_a_restart(spark, tmp_path):
    root, mark = tmp_path / "p", str(tmp_path / "mark")
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    tree.register(spark)
    got = []

    def step():
        batches = []
        s = spark.readStream.format("source_tree").load(str(root))
        s.writeStream.foreachBatch(lambda df, n: batches.append(sorted((r.path, r.event, r.size_bytes) for r in df.collect()))).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        got.append([x for x in batches if x])

    (root / "src/a.ts").write_text("one")
    (root / "b.js").write_text("")
    (root / "node_modules/c.js").write_text("no")
    (root / "d.py").write_text("no")
    step()
    step()
    (root / "src/a.ts").write_text("another")
    (root / "b.js").unlink()
    (root / "src/e.tsx").write_text("x")
    step()
    assert got == [[[("b.js", "created", 0), ("src/a.ts", "created", 3)]], [], [[("b.js", "deleted", None), ("src/a.ts", "changed", 7), ("src/e.tsx", "created", 1)]]]


def test_a_tree_that_is_not_there_has_no_files(tmp_path):
    assert tree.listing(str(tmp_path / "none"), ["ts"], []) == {}
    assert tree.events({}, {}) == [] and tree.events({"a": [1, 2]}, {"a": [1, 2]}) == []


def test_entries_live_on_when_written_again(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    schema = "k string, ts timestamp, ttl int"
    batches = [
        [("a", at(0), 3600), ("b", at(0), 3600), ("c", at(5), None), ("n", None, 1)],
        [("a", at(50), 3600), ("z", at(62), 60)],  # a lives on; c and b are over by now
        [("z", at(200), 60), ("b", at(190), 60)],  # b begins anew
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with _set(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
            s = expiry.expired(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", "ttl", late_minutes=1)
            s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
        if i == 1:
            assert {(r.k, r.writes) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("b", 1), ("c", 1)}
    rows = spark.read.parquet(str(tmp_path / "out")).select("k", F.expr("(expired_ms - created_ms) / 1000").cast("int").alias("ttl"), "writes").collect()
    assert sorted(map(tuple, rows)) == [("a", 3600, 2), ("b", 60, 1), ("b", 3600, 1), ("c", 0, 1)]  # z is written again in time, and lives
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_table_functions(spark):
    tables.register(spark)
    text = "import a from 'a';\nexport function one() {\n  return 1;\n}\nconst two = 2;"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string").createOrReplaceTempView("sources_for_functions")
    got = spark.sql("SELECT id, d.* FROM sources_for_functions s, LATERAL code_declarations(s.text) d ORDER BY start_line").collect()
    assert [tuple(r) for r in got] == [(1, True, 1, 1, "import a from 'a';"), (1, False, 2, 4, "function one() {\n  return 1;\n}"), (1, False, 5, 5, "const two = 2;")]
    assert spark.sql("SELECT porter_stem('relational') AS a, porter_stem(NULL) AS b").first() == ("relat", None)
    assert spark.sql("SELECT w.shard_index FROM sources_for_functions s, LATERAL code_windows(s.text, 8, 0, 1) w").count() >= 3
