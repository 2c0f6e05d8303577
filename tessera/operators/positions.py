"""Postings with positions: phrases, words near each other, and the best snippet of a document. Queries are rows, so many run in one plan;
of the postings only those of asked terms are read, and what meets in a row is one document's places of one query's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import each, terms


def placed(docs: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """(term, *key, tf, doc_len, positions): where a term stands in a document, from 0, ascending. Each row for itself: its places sorted by
    term and cut where the next term begins, so that no place is a row and nothing is shuffled."""
    keys = [key] if isinstance(key, str) else key
    found = docs.select(*keys, terms(F.col(text)).alias("_all"))
    marks = F.sort_array(F.transform("_all", lambda t, i: F.struct(t.alias("term"), i.alias("pos"))))
    sorted_ = found.select(*keys, F.size("_all").cast("long").alias("doc_len"), marks.alias("_marks"))
    begins = F.transform("_marks", lambda m, i: F.when((i == 0) | (m["term"] != F.get("_marks", i - 1)["term"]), i))
    cut_ = sorted_.select(*keys, "doc_len", "_marks", F.filter(begins, lambda i: i.isNotNull()).alias("_begins"))

    def run(b: Column, n: Column) -> Column:
        end = F.coalesce(F.get("_begins", n + 1), F.size("_marks"))
        return F.struct(F.get("_marks", b)["term"].alias("term"), F.transform(F.slice("_marks", b + 1, end - b), lambda m: m["pos"]).alias("positions"))

    long = each(cut_, [*keys, "doc_len"], F.transform("_begins", run), "_x")
    return long.select("_x.term", *keys, F.size("_x.positions").cast("long").alias("tf"), "doc_len", "_x.positions")


def positional(docs: DataFrame, key: str | list[str], text: str, only: DataFrame | None = None) -> DataFrame:
    """As ``placed``, but a repeated row of a document changes nothing. With ``only`` (term, ..) other terms are left out before anything is shuffled. Rows are
    dealt out by ``key``, so that what follows for each document stays where it is."""
    keys = [key] if isinstance(key, str) else key
    found = placed(docs, keys, text)
    if only is not None:
        found = found.join(only.select("term").distinct(), "term", "left_semi")
    grouped = found.repartition(*keys).groupBy("term", *keys, "doc_len").agg(F.collect_set("positions").alias("_sets"))
    positions = F.when(F.size("_sets") == 1, F.get("_sets", 0)).otherwise(F.array_sort(F.array_distinct(F.flatten("_sets"))))
    return grouped.select("term", *keys, positions.alias("positions"), "doc_len").select("term", *keys, F.size("positions").cast("long").alias("tf"), "doc_len", "positions")


def asked(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, place, term, n): the terms of each query in order, repeated ones too, and how many there are."""
    all_terms = queries.select(query, terms(F.col(text)).alias("_all"))
    return all_terms.select(query, F.posexplode("_all").alias("place", "term"), F.size("_all").alias("n"))


def _together(words: DataFrame, post: DataFrame, query: str, key: str) -> DataFrame:
    """(query, key, found): for each document with all of a query's words their places, as a list of (place, positions)."""
    hits = words.join(post.select("term", key, "positions"), "term")
    grouped = hits.groupBy(query, key).agg(F.collect_list(F.struct("place", "positions")).alias("found"), F.max("n").alias("n"))  # a query's words, at most
    return grouped.where(F.size("found") == F.col("n"))


def phrases(ask: DataFrame, post: DataFrame, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, n_found, first): documents with all words of a query one after the other, how often, and where first.
    Each word's positions are moved back by its place in the phrase; a phrase begins where all of them meet."""
    both = _together(ask, post, query, key)
    moved = F.transform("found", lambda f: F.transform(f["positions"], lambda p: p - f["place"]))
    # the rarest word's list first: what is left can only get shorter
    ordered = F.array_sort(moved, lambda a, b: F.size(a) - F.size(b))
    starts = F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.get(ordered, 0), F.array_intersect)
    found = both.select(query, key, starts.alias("_s")).where(F.size("_s") > 0)
    return found.select(query, key, F.size("_s").alias("n_found"), F.array_min("_s").alias("first"))


def _marks(found: Column) -> Column:
    """(p, place) of all words in order of position."""
    return F.array_sort(F.flatten(F.transform(found, lambda f: F.transform(f["positions"], lambda p: F.struct(p.alias("p"), f["place"].alias("place"))))))


def proximity(ask: DataFrame, post: DataFrame, most: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, span): documents in which all different words of a query stand within ``most`` positions, and the
    least such stretch. One pass over the words' positions in order: the stretch that ends here begins at the
    oldest of the words' last places."""
    once = ask.groupBy(query, "term").agg(F.min("place").alias("place"))
    counted = once.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(query)).cast("int"))
    counted = counted.withColumn("place", (F.row_number().over(Window.partitionBy(query).orderBy("place")) - 1).cast("int"))
    both = _together(counted, post, query, key).select(query, key, "n", _marks(F.col("found")).alias("marks"))
    none = F.lit(2**31 - 1)
    begin = F.struct(F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.lit(-1)).alias("last"), none.alias("best"))

    def step(s: Column, m: Column) -> Column:
        last = F.transform(s["last"], lambda x, i: F.when(i == m["place"], m["p"]).otherwise(x))
        oldest = F.array_min(last)
        return F.struct(last.alias("last"), F.when(oldest < 0, s["best"]).otherwise(F.least(s["best"], m["p"] - oldest + 1)).alias("best"))

    spans = both.select(query, key, F.aggregate("marks", begin, step, lambda s: s["best"]).alias("span"))
    return spans.where(F.col("span") <= most)


def snippets(ask: DataFrame, post: DataFrame, width: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, start, n_words, n_hits): of each document with a word of a query the stretch of ``width`` terms with the most
    different words, then the most places of them, then the first; ``start`` is its first such place."""
    words = ask.select(query, "term").distinct()
    marks = words.join(post.select("term", key, F.explode("positions").alias("start")), "term")
    ahead = Window.partitionBy(query, key).orderBy("start").rangeBetween(0, width - 1)
    rated = marks.withColumn("n_words", F.size(F.collect_set("term").over(ahead))).withColumn("n_hits", F.count(F.lit(1)).over(ahead).cast("int"))
    best = F.max(F.struct("n_words", "n_hits", (-F.col("start")).alias("s"))).alias("b")
    return rated.groupBy(query, key).agg(best).select(query, key, (-F.col("b.s")).alias("start"), "b.n_words", "b.n_hits")
