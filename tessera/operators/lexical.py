"""BM25 over postings, and symbol lookup. Queries are rows, so many run in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import counted_stems, each, identifiers, query_terms, terms
from ..sources.store import cut


def postings(docs: DataFrame, key: str, *texts: str, stem: bool = False, weights: dict[str, int] | None = None) -> DataFrame:
    """(term, key, tf, doc_len) over the columns ``texts``; a weight counts a column's terms so many times."""

    found = [(counted_stems(F.col(t)) if stem else terms(F.col(t))).alias(f"_terms{i}") for i, t in enumerate(texts)]

    def weighed(c: Column, w: int) -> Column:
        if stem:
            return c["terms"] if w == 1 else F.transform(c["terms"], lambda x: F.struct(x["term"].alias("term"), (x["w"] * w).alias("w")))
        return F.transform(c, lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))

    own = [(F.col(f"_terms{i}"), (weights or {}).get(t, 1)) for i, t in enumerate(texts)]
    length = sum(((c["n"] if stem else F.size(c).cast("long")) * w for c, w in own), F.lit(0))
    sized = docs.select(key, *found).select(key, F.concat(*[weighed(c, w) for c, w in own]).alias("all"), length.alias("doc_len"))  # before the explode, else it is worked out for each term
    long = each(sized, [key, "doc_len"], F.col("all"), "x").select(key, "doc_len", "x.term", "x.w")
    return long.groupBy("term", key, "doc_len").agg(F.sum("w").cast("long").alias("tf")).select("term", key, "tf", "doc_len")


def own_postings(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(term, keep.., tf, doc_len) of rows that are a document each (``repeated`` says whether they are): a row's terms are counted where the row is. So no
    postings are shuffled, and those of a document come one after the other, where columns that are the same for all of them take no room in Parquet."""
    counted = docs.select(*keep, counted_stems(F.col(text), stemmer=None).alias("_t")).select(*keep, F.col("_t.n").alias("doc_len"), F.col("_t.terms").alias("_terms"))
    return each(counted, [*keep, "doc_len"], F.col("_terms"), "_x").select("_x.term", *keep, F.col("_x.w").cast("long").alias("tf"), "doc_len")


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether rows have a key in common."""
    return not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def corpus_size(docs: DataFrame, *texts: str) -> DataFrame:
    """One row: n_docs and avg_len."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(sum((F.size(terms(F.col(t))) for t in texts), F.lit(0))).alias("avg_len"))


def asked_postings(docs: DataFrame, key: str, text: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, key, tf, doc_len) of the asked terms only, and the corpus' size, from one pass over documents whose postings aren't
    stored. Next to its terms each document has a mark, which is no term, so that its length counts without them; marks differ, so no task gets them all."""
    sized = docs.select(key, terms(F.col(text)).alias("all")).select(key, "all", F.size("all").cast("long").alias("doc_len"))
    mark = F.concat(F.lit("#"), F.pmod(F.xxhash64(key), F.lit(4096)).cast("string"))
    long = each(sized, [key, "doc_len"], F.concat("all", F.array(mark)), "term")
    wanted = long.join(asked.select("term", F.lit(True).alias("_asked")).distinct(), "term", "left").where(F.col("_asked") | F.col("term").startswith("#"))
    post = cut(wanted.groupBy("term", key, "doc_len").agg(F.count(F.lit(1)).alias("tf")).select("term", key, "tf", "doc_len"))
    size = post.where(F.col("term").startswith("#")).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), (F.sum(F.col("tf") * F.col("doc_len")) / F.sum("tf")).alias("avg_len"))
    return post.where(~F.col("term").startswith("#")), size


def bm25_part(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    idf = F.when(idf > 0, idf).otherwise(fixed.LEAST_IDF)
    return idf * tf * (fixed.K1 + 1) / (tf + fixed.K1 * (1 - fixed.B + fixed.B * length / mean))


def top(df: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group, ties by the least ``tie``; adds rank, from 1."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def asked_terms(queries: DataFrame, key: str = "query_id", text: str = "query", most: int = fixed.TERMS) -> DataFrame:
    """(key, term): each query's search terms, lower-cased, each once."""
    return queries.select(key, F.explode(F.array_distinct(F.transform(query_terms(F.col(text), most), F.lower))).alias("term"))


def bm25(asked: DataFrame, post: DataFrame, size: DataFrame, query: str, key: str, most: int = 200_000) -> DataFrame:
    """(query, key, bm25) of all documents with a term. Postings of other terms are left out before the
    frequencies are counted. Up to ``most`` asked terms are broadcast; more are joined by term, where Spark splits hot ones."""
    wanted = post.join(asked.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = wanted.join(df, "term").crossJoin(F.broadcast(size))  # one row
    part = bm25_part(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))
    weights = rated.select("term", key, part.alias("part"))
    if asked.count() <= most:
        # documents are dealt out once; all of a document's parts then meet where they are made, whatever the query
        asked, weights = F.broadcast(asked), weights.repartition(key)
    return asked.join(weights, "term").groupBy(query, key).agg(F.sum("part").alias("bm25"))


def best(asked: DataFrame, post: DataFrame, size: DataFrame, query: str, key: str, k: int, most: int = 200_000) -> DataFrame:
    """(query, key, bm25, rank): the k best documents of each query, scores rounded to six places, ties by the least key.

    Up to ``most`` asked terms (and queries) are sent to the tasks; documents are dealt out once, each with its parts of asked terms, and a task adds the parts
    of some documents up for all queries at once, in a matrix, and keeps k of each query. So pairs of queries and documents are never rows. More
    asked terms are joined by term."""
    n = asked.count()
    if n > most:
        return top(bm25(asked, post, size, query, key).withColumn("bm25", F.round("bm25", 6)), [query], "bm25", key, k)
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = post.sparkSession
    rows = asked.select(query, "term").distinct().collect()  # ``most`` at most
    names, terms_ = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at = {q: i for i, q in enumerate(names)}
    by_term: list[list[int]] = [[] for _ in terms_]
    place = {t: i for i, t in enumerate(terms_)}
    for q, t in rows:
        by_term[place[t]].append(at[q])
    width = np.array([len(x) for x in by_term], np.int64)
    sent = spark.sparkContext.broadcast((names, pa.array(terms_, pa.string()), width, np.array([q for x in by_term for q in x], np.int64)))
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    qkind, kind = asked.schema[query].dataType.simpleString(), post.schema[key].dataType.simpleString()

    def run(batches):
        names, vocabulary, width, queries = sent.value
        first, held = np.cumsum(width) - width, None  # the best so far: query, score, key

        def keep(q, score, keys):
            nonlocal held
            if held:
                q, score, keys = np.concatenate([held[0], q]), np.concatenate([held[1], score]), pa.concat_arrays([held[2], keys])
            tie = np.empty(len(keys), np.int64)
            tie[np.asarray(pc.sort_indices(keys))] = np.arange(len(keys))
            order = np.lexsort((tie, -score, q))
            order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
            held = q[order], score[order], keys.take(pa.array(order))

        def add(t: pa.Table):
            """Whole documents: their parts for all queries, some documents at once."""
            coded = pc.run_end_encode(t[key].combine_chunks())
            ends, keys = np.asarray(coded.run_ends).astype(np.int64), coded.values
            term = np.asarray(pc.index_in(t["term"], vocabulary).combine_chunks())
            part, some = np.asarray(t["part"]), max(1, (1 << 21) // max(1, len(names)))
            for a in range(0, len(ends), some):
                z = min(len(ends), a + some)
                low, high = (int(ends[a - 1]) if a else 0), int(ends[z - 1])
                own, doc = term[low:high], np.searchsorted(ends, np.arange(low, high), "right") - a
                n = width[own]
                inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
                cell = np.repeat(doc, n) * len(names) + queries[inner]
                score = np.round(np.bincount(cell, np.repeat(part[low:high], n), (z - a) * len(names)), 6).reshape(z - a, -1)
                met = np.bincount(cell, minlength=(z - a) * len(names)).reshape(z - a, -1) > 0
                score[~met] = -np.inf
                least = np.partition(score, -k, axis=0)[-k] if z - a > k else np.full(len(names), -np.inf)
                i, q = np.nonzero(met & (score >= least))
                if len(i):
                    keep(q, score[i, q], keys.take(pa.array(a + i)))

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = t[key][t.num_rows - 1]
            whole = pc.index(t[key], last).as_py()  # the last document may go on in the next batch
            if whole:
                add(t.slice(0, whole))
            rest = t.slice(whole)
        if rest is not None and rest.num_rows:
            add(rest)
        if held:
            yield pa.record_batch([pa.array([names[i] for i in held[0]], kinds[qkind]), held[2], pa.array(held[1])], [query, key, "bm25"])

    wanted = post.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # dealt out as they are, by key: a document's length is the same in all its rows, where parts would differ in each
    met = wanted.where(F.col(key).isNotNull()).select("term", key, "tf", "doc_len").repartition(key)
    rated = met.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # a row for each asked term; one row
    part = bm25_part(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))
    dealt = rated.select("term", key, part.alias("part")).sortWithinPartitions(key)
    return top(dealt.mapInArrow(run, f"{query} {qkind}, {key} {kind}, bm25 double"), [query], "bm25", key, k)


def normalised(hits: DataFrame, query: str, score: str = "bm25", compat: bool = False) -> DataFrame:
    """Adds lexical, in [0.05, 1]: the share of the query's best score; with ``compat`` the other way round, from 0.2 for the best."""
    best = F.max(score).over(Window.partitionBy(query))
    value = 1 - F.col(score) / (best + 1e-9) * 0.8 if compat else F.col(score) / best
    return hits.withColumn("lexical", F.greatest(F.lit(0.05), F.least(F.lit(1.0), value)))


def min_max(hits: DataFrame, query: str, score: str = "bm25") -> DataFrame:
    """Adds share, in [0, 1]: where a score lies between the least and the best of its query; 1 if all are one."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn("share", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0)))


def or_beginnings(asked: DataFrame, vocabulary: DataFrame, query: str = "query_id", least: int = 3) -> DataFrame:
    """(query, term): the asked terms that the vocabulary (term, each once) has; in place of each other one, of ``least`` letters or more, all terms that begin with it.
    Beginnings of as many letters as asked terms have are joined by key."""
    known = asked.join(vocabulary, "term", "left_semi")
    rest = asked.join(vocabulary, "term", "left_anti").where(F.length("term") >= least)
    lengths = rest.select(F.length("term").alias("n")).distinct().agg(F.array_sort(F.collect_set("n")).alias("ns"))  # one row of a few numbers
    begun = vocabulary.crossJoin(F.broadcast(lengths)).select("term", F.explode(F.filter("ns", lambda n: n < F.length("term"))).alias("n"))
    begun = begun.select(F.expr("substring(term, 1, n)").alias("begin"), "term")
    return known.select(query, "term").unionByName(rest.withColumnRenamed("term", "begin").join(begun, "begin").select(query, "term")).distinct()


def symbol_hits(queries: DataFrame, symbols: DataFrame, query: str = "query_id", text: str = "query", k: int = fixed.SYMBOLS) -> DataFrame:
    """(query, chunk_id, rank): chunks with a symbol that is an identifier of the query, k at most."""
    names = queries.select(query, F.explode(F.array_distinct(identifiers(F.col(text)))).alias("name"))
    found = names.join(symbols.select("name", "chunk_id"), "name").select(query, "chunk_id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("chunk_id"))).where(F.col("rank") <= k)


def phrase(docs: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Documents with the words one after the other."""
    return docs.where(F.concat(F.lit(" "), F.array_join(terms(F.col(text)), " "), F.lit(" ")).contains(f" {' '.join(words)} ")).select(key)


def by_prefix(post: DataFrame, prefix: str) -> DataFrame:
    return post.where(F.col("term").startswith(prefix))


def fuzzy(post: DataFrame, word: str, distance: int = 1) -> DataFrame:
    """Terms at most ``distance`` edits away."""
    return post.where(F.abs(F.length("term") - len(word)) <= distance).where(F.levenshtein("term", F.lit(word)) <= distance)


def deletions(word: Column, distance: int, prefix: int = 7) -> Column:
    """The beginning of a word, and what is left of it when up to ``distance`` of its characters go, each once."""
    begin = F.substring(word, 1, prefix)
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    level = every = F.array(begin)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.when(F.length(x) > 0, without(x)).otherwise(F.array().cast("array<string>")))))
        every = F.concat(every, level)
    return F.array_distinct(every)


def similar(words: DataFrame, vocabulary: DataFrame, distance: int = 2, word: str = "word", term: str = "term") -> DataFrame:
    """(word, term, distance): for each of many words the terms of a vocabulary (each once) that are at most so many edits away. Two such words have
    a beginning with some characters gone in common, so these are joined by key, and edits are counted of what meets only."""
    mine = words.select(word).distinct().select(word, F.explode(deletions(F.col(word), distance)).alias("_d"))
    theirs = vocabulary.select(term).select(term, F.explode(deletions(F.col(term), distance)).alias("_d"))
    met = mine.join(theirs, "_d").where(F.abs(F.length(word) - F.length(term)) <= distance).select(word, term).distinct()
    return met.withColumn("distance", F.levenshtein(word, term)).where(F.col("distance") <= distance)


def sounding_alike(words: DataFrame, vocabulary: DataFrame, word: str = "word", term: str = "term") -> DataFrame:
    """(word, term): other terms with a word's phonetic key, of the same first letter."""
    return words.select(word).distinct().withColumn("_s", F.soundex(word)).join(vocabulary.select(term, F.soundex(term).alias("_s")), "_s").where(F.col(word) != F.col(term)).select(word, term)
