"""Evidence for a prompt, packed into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import first_tokens, language, n_tokens


def packed(rows: DataFrame, by: list[str], order: list[str], text: str, budget: Column | int) -> DataFrame:
    """Rows in order until the budget is used, the first that doesn't fit cut to what is
    left if that is over 50 tokens, and nothing after it. Adds tokens, used (before the row) and packed (the text)."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    w = Window.partitionBy(*by).orderBy(*order)
    sized = rows.withColumn("tokens", n_tokens(F.col(text)))
    until = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    used = sized.withColumn("used", until - F.col("tokens"))
    left = budget - F.col("used")
    fits = F.col("tokens") <= left
    kept = used.where((budget > 0) & (left >= 0) & (fits | (left > fixed.LEAST_TAIL_TOKENS)))
    return kept.withColumn("packed", F.when(fits, F.col(text)).otherwise(first_tokens(F.col(text), left.cast("int"))))


def block(rank: Column, path: Column, start: Column, end: Column, kind: Column, name: Column, score: Column, text: Column) -> Column:
    """A result as evidence."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.concat(
        F.lit("\n["), rank.cast("string"), F.lit("] "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"),
        F.lit("\nType: "), kind, F.lit("  Name: "), F.coalesce(F.nullif(name, F.lit("")), F.lit("n/a")), F.lit("  Score: "), F.format_string("%.3f", score),
        F.lit("\n```"), language(path), F.lit("\n"), bare, F.lit("\n```\n"),
    )


def prompts(queries: DataFrame, hits: DataFrame, query: str = "query_id", text: str = "query", most: int = fixed.MAX_CONTEXT_TOKENS) -> DataFrame:
    """(query, prompt): question, evidence within the budget, and the instruction. hits: query, rank, file_path, start_line, end_line, chunk_type, name, final, text."""
    header = F.concat(F.lit("User question:\n"), F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), F.lit("\n\nEvidence:\n"))
    asked = queries.select(query, header.alias("header")).withColumn("budget", F.lit(most) - n_tokens(F.col("header")) - n_tokens(F.lit(fixed.INSTRUCTION)))
    made = hits.select(query, "rank", block(F.col("rank"), F.coalesce("file_path", F.lit("unknown")), F.col("start_line"), F.col("end_line"), F.col("chunk_type"), F.col("name"), F.col("final"), F.col("text")).alias("block"))
    fit = packed(made.join(asked.select(query, "budget"), query), [query], ["rank"], "block", F.col("budget"))
    bodies = fit.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "packed"))), lambda x: x["packed"]), "").alias("body"))
    full = F.concat("header", F.coalesce("body", F.lit("")), F.lit(fixed.INSTRUCTION))
    return asked.join(bodies, query, "left").select(query, F.concat(F.regexp_replace(full, r"^\s+|\s+$", ""), F.lit("\n")).alias("prompt"))
