"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdup, maxent, merkle, neardup, packing, pieces, quality, secrets, tokenfile, topk, toxicity, trie
from .common import small_batches

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica of it with faults: where the SHA-256 of a page's
    URL begins with 05, 15, 25 or 35 a byte of the body is another, where it begins with 07 or 17 the record is gone."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fault = F.substring(F.sha2(F.coalesce("url", F.lit("")), 256), 1, 2)
    altered = F.when(fault.isin("05", "15", "25", "35"), F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    # each record goes with what the replica has of it, so that null and repeated ids keep theirs
    found, gone = merkle.warc(F.col("url"), altered), fault.isin("07", "17")
    both = merkle.records(pages, F.when(~gone, F.octet_length(found).cast("long")).alias("found_length"), F.when(~gone, F.sha2(found, 256)).alias("found_sha"))
    placed = merkle.stage(merkle.placed(both), "index")
    return merkle.audit(placed.select("key", "offset", "length", "sha"), placed.select("offset", "found_length", "found_sha"))


def toxicity_chain(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Chain:
    """The labels have two categories: of low quality, and toxic."""
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "1 - quality AS low_quality", "toxic")
    return toxicity.fit(docs, labels, ["low_quality", "toxic"])


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity_chain(spark, sf_dir, docs)).withColumn("kept", ~F.col("toxic"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = tokenfile.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 2, spell=False)
    return tokenfile.read(spark, folder, manifest)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.decisions(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), spell=False)


def op9_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integral(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.search(vectors, F.col("vec_id") % 100 == 0, 10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_merkle_audit, op2_toxicity_chain, op3_token_files, op4_secret_scan, op5_near_dedup, op6_exact_dedup, op7_quality_rules, op8_best_fit_packing, op9_maxent_scores, op10_sampled_pieces, op11_exact_topk, op12_prefix_trie)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    norm = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crlf = "chr(13) || chr(10)"
    record = f"'WARC/1.1' || {crlf} || 'WARC-Type: resource' || {crlf} || 'WARC-Target-URI: ' || url || {crlf} || 'Content-Type: text/html' || {crlf} || 'Content-Length: ' || strlen({{0}}) || {crlf} || {crlf} || {{0}} || {crlf} || {crlf}"
    return {
        "op1_merkle_audit": f"""
            WITH r AS (SELECT page_id, substr(sha256(url), 1, 2) AS fault, {record.format("html")} AS rec, {record.format("('~' || substr(html, 2))")} AS bad FROM pages),
            o AS (SELECT page_id AS key, (sum(strlen(rec)) OVER (ORDER BY page_id) - strlen(rec))::BIGINT AS "offset", strlen(rec)::BIGINT AS length,
                         sha256(rec) AS expected_sha256, CASE WHEN fault IN ('05', '15', '25', '35') THEN sha256(bad) END AS found_sha256, fault FROM r)
            SELECT key, "offset", length, expected_sha256, found_sha256, CASE WHEN found_sha256 IS NULL THEN 'missing' ELSE 'altered' END AS status
            FROM o WHERE fault IN ('05', '15', '25', '35', '07', '17') AND found_sha256 IS DISTINCT FROM expected_sha256""",
        "op6_exact_dedup": f"""
            WITH n AS (SELECT doc_id, sha256({norm}) AS text_sha256 FROM documents),
            g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
                         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
        "op11_exact_topk": """
            WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, c.r, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r)
            SELECT query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, r))::INTEGER AS rank, vec_id, score FROM s
            QUALIFY rank <= 10""",
        "op12_prefix_trie": """
            WITH t AS (SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS tok, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
            own AS (SELECT conv_id, list({'tok': tok, 'bytes': bytes} ORDER BY turn NULLS FIRST, tok) AS seq,
                           xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                               lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h
                    FROM t GROUP BY conv_id),
            c AS (SELECT o.conv_id, list_concat(coalesce(b.seq, [])[1:o.h], o.seq[o.h + 1:]) AS seq FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
            p AS (SELECT conv_id, d AS depth, len(seq) AS n, array_to_string(list_transform(seq[1:d], lambda x: x.tok), ',') AS path,
                         array_to_string(list_transform(seq[1:d - 1], lambda x: x.tok), ',') AS up, CASE WHEN d > 0 THEN seq[d].bytes ELSE 0 END AS bytes, seq
                  FROM c, unnest(range(0, len(seq) + 1)) AS r(d)),
            n AS (SELECT depth, path, min(conv_id) AS conv_id, any_value(up) AS up, any_value(bytes) AS bytes, count(*) AS n_convs, any_value(seq[1:depth]) AS seq, max(n) = depth AS leaf,
                         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, path),
            k AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
            s AS (SELECT a.d AS depth, array_to_string(list_transform(seq[1:a.d], lambda x: x.tok), ',') AS path, sum((n_convs - 1) * bytes) AS saved_tokens, sum(leaf::INT) AS n_leaves
                  FROM n, unnest(range(0, depth + 1)) AS a(d) GROUP BY ALL)
            SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
            FROM n JOIN s ON s.depth = n.depth AND s.path = n.path LEFT JOIN k ON k.depth = n.depth AND k.path = n.path LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.up AND n.depth > 0""",
    }
