"""Evidence and prompts for a whole table of questions, to be answered offline.

    python -m jobs.evidence_packs DOCUMENTS QUESTIONS OUTPUT [--config FILE]

For each question the best documents by BM25, packed in order of rank into a budget of tokens: the first that doesn't fit is
cut, nothing comes after it. Writes

    OUTPUT/evidence/language=L    question_id, rank, id, bm25, lexical, tokens, used, packed
    OUTPUT/prompts                question_id, prompt (a question without evidence has one too)

A run replaces what is there, so it can be run again at any time, with the same result from the same input.

Null texts are empty and never found; rows without an id, and questions without one, are counted in the log and left out;
a repeated id counts as one document for each different text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed
from tessera.functions.text import terms
from tessera.operators import context, lexical
from tessera.queries import BM25, BY_ITEM
from tessera.sources.store import shared_folder, spread

from . import log, main, settings

NAME = "evidence_packs"


def run(spark: SparkSession, documents: str, questions: str, output: str, conf: dict | None = None) -> dict:
    """Writes evidence and prompts. What it did: documents, questions, evidence rows and prompts."""
    c, output = conf or settings(NAME), output.rstrip("/")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    docs = spark.read.parquet(documents).select(F.col(c["id"]).alias("id"), text(c["text"]).alias("text"), F.col(c["language"]).alias("language"))
    asked = spark.read.parquet(questions).select(F.col(c["question_id"]).alias("question_id"), text(c["question"]).alias("question"))
    n_docs, n_asked = docs.agg(F.count("id"), F.count_if(F.col("id").isNull())).first(), asked.agg(F.count("question_id"), F.count_if(F.col("question_id").isNull())).first()
    log.info("read %d documents (and %d without an id) from %s, %d questions (and %d without an id) from %s", *n_docs, documents, *n_asked, questions)
    docs, asked = docs.where("id IS NOT NULL"), asked.where("question_id IS NOT NULL").dropDuplicates(["question_id"])

    wanted = asked.select("question_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term"))
    post, size = lexical.asked_postings(spread(docs.select("id", "text")), "id", "text", wanted)
    hits = lexical.best(wanted, post, size, "question_id", "id", c["hits"])
    hits = lexical.normalised(hits, "question_id").withColumn("lexical", F.round("lexical", 6))
    # texts join after the limit: only those of hits move
    packed = context.packed(hits.join(docs, "id"), ["question_id"], ["rank", "text"], "text", c["budget_tokens"])
    rows = packed.select("question_id", "rank", "id", "bm25", "lexical", "tokens", "used", "packed", "language")
    rows.hint("rebalance", "language").write.partitionBy("language").mode("overwrite").parquet(f"{output}/evidence")

    made = spark.read.schema(rows.schema).parquet(f"{output}/evidence")
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "used", "packed"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["packed"], F.lit("\n"))), "")
    bodies = made.groupBy("question_id").agg(blocks.alias("body"))  # within the budget
    prompt = F.concat(F.lit("User question:\n"), "question", F.lit("\n\nEvidence:\n"), F.coalesce("body", F.lit("")), F.lit(fixed.INSTRUCTION))
    asked.join(bodies, "question_id", "left").select("question_id", prompt.alias("prompt")).write.mode("overwrite").parquet(f"{output}/prompts")
    done = {"documents": n_docs[0], "questions": n_asked[0], "evidence": made.count(), "prompts": spark.read.parquet(f"{output}/prompts").count()}
    log.info("wrote to %s: %s", output, done)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for all benchmark texts, after two runs into one folder."""
    at = f"{shared_folder(spark)}/{NAME}-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at)
    rows = spark.read.parquet(f"{at}/evidence")
    return rows.select("question_id", "rank", F.col("id").alias("doc_id"), "bm25", "lexical", "tokens", "used", "packed", "language")


SQL = f"""WITH {BY_ITEM}, {BM25},
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM hits) WHERE rank <= 20),
    s AS (SELECT query_id AS question_id, rank, doc_id, bm25, round(greatest(0.05, least(1.0, bm25 / max(bm25) OVER (PARTITION BY query_id))), 6) AS lexical, text, lang AS language,
                 greatest(1, length(text) // 4) AS tokens FROM top JOIN documents USING (doc_id)),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - tokens AS used FROM s)
    SELECT question_id, rank, doc_id, bm25, lexical, tokens::INT AS tokens, used::BIGINT AS used, CASE WHEN tokens <= 2000 - used THEN text ELSE substr(text, 1, (4 * (2000 - used))::BIGINT) END AS packed, language
    FROM u WHERE 2000 - used >= 0 AND (tokens <= 2000 - used OR 2000 - used > 50)"""

if __name__ == "__main__":
    main(NAME, run, "documents", "questions", "output")
