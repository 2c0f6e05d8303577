"""The jobs, over growing input and again."""

import json
import shutil
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import jobs
from jobs import evidence_packs, search_index

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split_terms(text):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()


def indexed(spark, at):
    return {(r.id, r.term): (r.tf, r.doc_len, r.positions) for r in search_index.current(spark, at).collect()}


def expected(rows):
    out = {}
    for r in rows:
        places = defaultdict(list)
        words = split_terms(r["text"])
        for i, w in enumerate(words):
            places[w].append(i)
        out |= {(r["doc_id"], w): (len(p), len(words), p) for w, p in places.items()}
    return out


def test_index_of_a_growing_folder(spark, tmp_path):
    folder, index, mark = tmp_path / "docs", str(tmp_path / "index"), str(tmp_path / "mark")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    add = lambda df: df.coalesce(1).write.mode("append").parquet(str(folder))
    add(docs.where("doc_id % 3 > 0"))
    first = search_index.run(spark, str(folder), index, mark)
    rows = docs.where("doc_id % 3 > 0").collect()
    assert first["rows"] == len(rows) and first["batches"] == 1 and indexed(spark, index) == expected(rows)
    before = {str(p): p.stat().st_mtime_ns for p in Path(index).rglob("*.parquet")}
    # nothing new: nothing is read or written
    assert search_index.run(spark, str(folder), index, mark) == {"batches": 0, "rows": 0, "without_id": 0, "postings": 0}
    assert {str(p): p.stat().st_mtime_ns for p in Path(index).rglob("*.parquet")} == before
    # new documents, one that comes again with another text, one without an id
    again = rows[0].doc_id
    more = docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(again, "another text now", "en", "x", 16), (None, "no id", None, None, 5)], SCHEMA))
    add(more)
    second = search_index.run(spark, str(folder), index, mark)
    assert second["rows"] == more.count() and second["without_id"] == 1 and second["batches"] == 1
    want = expected([r for r in rows if r.doc_id != again] + [r for r in more.collect() if r.doc_id is not None])
    assert indexed(spark, index) == want and second["postings"] < first["postings"]
    assert all(Path(p).stat().st_mtime_ns == t for p, t in before.items())  # older segments are as they were


def test_one_run_and_many_batches_give_the_same(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.repartition(5).write.parquet(str(tmp_path / "docs"))
    conf = jobs.settings("search_index") | {"files_per_batch": 2, "buckets": 3}
    done = search_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "a"), str(tmp_path / "mark"), conf)
    assert done["batches"] == 3 and indexed(spark, str(tmp_path / "a")) == expected(docs.collect())


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    write, calls = search_index.write, []

    def failing(df, path, *by):
        write(df, path, *by)
        calls.append(path)
        if len(calls) == 1:
            raise OSError("lost after the postings were written")

    monkeypatch.setattr(search_index, "write", failing)
    at = [str(tmp_path / n) for n in ("docs", "index", "mark")]
    with pytest.raises(Exception, match="lost after"):
        search_index.run(spark, *at)
    search_index.run(spark, *at)
    assert indexed(spark, at[1]) == expected(docs.collect())
    segments = [r.segment for r in spark.read.parquet(f"{at[1]}/postings").select("segment").distinct().collect()]
    assert segments == [0]


def test_odd_rows_of_the_index(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b a", "en", "a", 5), (3, "a b a", "en", "a", 5), (None, "x", None, None, None), (4, "long " * 200_000, "en", "b", 1)]
    spark.createDataFrame(rows, SCHEMA).withColumn("tf", F.lit(1)).withColumn("segment", F.lit("s")).write.parquet(str(tmp_path / "docs"))
    at = [str(tmp_path / n) for n in ("docs", "index", "mark")]
    done = search_index.run(spark, *at)
    assert (done["rows"], done["without_id"]) == (6, 1)
    got = indexed(spark, at[1])
    assert {k: v[0] for k, v in got.items()} == {(3, "a"): 2, (3, "b"): 1, (4, "long"): 200_000} and got[3, "a"][2] == [0, 2]
    assert spark.read.parquet(f"{at[1]}/documents").count() == 4
    for i, none in enumerate(([], [(1, None, None, None, None), (2, "  .. ", "en", "a", 5)], [(None, "no id", None, None, None)])):
        spark.createDataFrame(none, SCHEMA).write.parquet(str(tmp_path / f"none{i}"))
        done = search_index.run(spark, *(str(tmp_path / f"{n}{i}") for n in ("none", "i", "m")))
        assert (done["rows"], done["postings"]) == (len(none), 0)


def test_current_postings_are_not_joined_without_older_rows(spark, tmp_path):
    folder, index, mark = (str(tmp_path / n) for n in ("docs", "index", "mark"))
    rows = lambda x: spark.createDataFrame(x, "doc_id long, lang string, source string, text string").coalesce(1)
    rows([(1, "en", "s", "old oven"), (2, "en", "s", "timer")]).write.parquet(folder)
    search_index.run(spark, folder, index, mark)
    assert "Join" not in search_index.current(spark, index)._jdf.queryExecution().optimizedPlan().toString()
    rows([(1, "en", "s", "new")]).write.mode("append").parquet(folder)
    search_index.run(spark, folder, index, mark)
    for few in (0, 10):
        assert sorted((r.id, r.term) for r in search_index.current(spark, index, few).collect()) == [(1, "new"), (2, "timer")]


def test_evidence_is_packed_and_reruns_are_the_same(spark, tmp_path):
    at = str(tmp_path / "out")
    done = evidence_packs.run(spark, f"{D}/documents.parquet", f"{D}/benchmark.parquet", at)
    rows = lambda: sorted(map(tuple, spark.read.parquet(f"{at}/evidence").select("question_id", "rank", "id", "packed", "used").collect()))
    first, prompts = rows(), spark.read.parquet(f"{at}/prompts").collect()
    assert done["prompts"] == done["questions"] == len(prompts) == 40 and done["evidence"] == len(first) > 0
    assert evidence_packs.run(spark, f"{D}/documents.parquet", f"{D}/benchmark.parquet", at) == done and rows() == first
    held = defaultdict(int)
    for q, _, _, packed, used in first:
        assert used == held[q]
        held[q] += max(1, len(packed) // 4)
    assert max(held.values()) <= 2000
    by = {p.question_id: p.prompt for p in prompts}
    assert all(packed in by[q] for q, _, _, packed, _ in first)


def test_questions_without_evidence_and_odd_rows(spark, tmp_path):
    docs = [(1, None, None, None, None), (2, "the oven", "en", "a", 8), (2, "the oven", "en", "a", 8), (None, "oven", "en", "a", 4), (3, "oven " * 50_000, None, "a", 1)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(1, "the oven"), (2, "nothing"), (3, None), (None, "oven")], "item_id long, text string").write.parquet(str(tmp_path / "asked"))
    done = evidence_packs.run(spark, str(tmp_path / "docs"), str(tmp_path / "asked"), str(tmp_path / "out"))
    assert (done["documents"], done["questions"], done["prompts"]) == (4, 3, 3)
    got = spark.read.parquet(f"{tmp_path}/out/evidence").collect()
    assert {r.question_id for r in got} == {1} and {r.language for r in got} == {"en", None}
    spark.createDataFrame([(1, "unheard of")], "item_id long, text string").write.parquet(str(tmp_path / "other"))
    for asked in ("other", "other"):  # nothing is found
        assert evidence_packs.run(spark, str(tmp_path / "docs"), str(tmp_path / asked), str(tmp_path / "out")) == {"documents": 4, "questions": 1, "evidence": 0, "prompts": 1}


def test_command_lines(tmp_path):
    shutil.copytree(f"{D}/documents.parquet", tmp_path / "docs") if Path(f"{D}/documents.parquet").is_dir() else shutil.copy(f"{D}/documents.parquet", tmp_path / "docs.parquet")
    docs = str(next(p for p in (tmp_path / "docs", tmp_path / "docs.parquet") if p.exists()))
    conf = tmp_path / "c.json"
    conf.write_text(json.dumps({"buckets": 2}))
    run = subprocess.run([sys.executable, "-m", "jobs.search_index", docs, str(tmp_path / "i"), str(tmp_path / "m"), "--config", str(conf)], capture_output=True, text=True, cwd=Path(jobs.__file__).parent.parent, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert json.loads(run.stdout.strip().splitlines()[-1])["rows"] == 200
    packs = subprocess.run([sys.executable, "-m", "jobs.evidence_packs", docs, f"{D}/benchmark.parquet", str(tmp_path / "o")], capture_output=True, text=True, cwd=Path(jobs.__file__).parent.parent, timeout=300)
    assert packs.returncode == 0 and json.loads(packs.stdout.strip().splitlines()[-1])["prompts"] == 40 and "read 200 documents" in packs.stderr
    assert any(p.name.startswith("language=") for p in (tmp_path / "o/evidence").iterdir())
    assert "segment 0: read 200 rows" in run.stderr and {p.name for p in (tmp_path / "i/postings/segment=0").iterdir()} == {"bucket=0", "bucket=1"}
