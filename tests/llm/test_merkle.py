"""The audit of all pages where ids are null or repeated."""

import hashlib

from tessera.llm import queries


def test_pages_with_null_and_repeated_ids(spark, tmp_path):
    ids = [None, None, 7, 7, 7, *range(8, 400)]
    rows = [(k, f"http://host/{i}", f"<p>body {i}</p>") for i, k in enumerate(ids)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    fault = lambda u: hashlib.sha256(u.encode()).hexdigest()[:2]
    want = [(k, {"0": "missing", "1": "missing"}.get(f[0]) if f[1] == "7" else "altered") for k, u, _ in rows if (f := fault(u)) in ("05", "15", "25", "35", "07", "17")]
    got = [(r.key, r.status) for r in queries.op1_merkle_audit(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
