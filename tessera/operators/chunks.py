"""Source files into typed chunks. Declarations are found line by line with built-in functions, or by a scan that knows where their
bodies end; the overlapping windows of a long chunk are a fold, since where one starts depends on the one before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.code import spans
from ..functions.text import each as text_each
from ..functions.text import n_tokens, summary, symbols
from ..functions.vectors import once

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def windows(lines: list[str], most: int = fixed.MAX_CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, least: int = fixed.MIN_CHUNK_TOKENS) -> list[tuple[int, int]]:
    """(first, end) of windows over lines: as many whole lines as fit; the next window goes
    back by the last lines that the overlap holds, or half a window if that is all of it."""
    cost = [max(1, len(x) // 4) + 1 for x in lines]
    out, first = [], 0
    while first < len(lines):
        end, total = first, 0
        while end < len(lines) and (end == first or total + cost[end] <= most):
            total += cost[end]
            end += 1
        if total >= least:
            out.append((first, end))
        if end == len(lines):
            break
        back, room = end, overlap
        while back > first and cost[back - 1] <= room:
            back -= 1
            room -= cost[back]
        first = back if back > first else first + max(1, (end - first) // 2)
    return out


def kind_of(name: Column, text: Column | None = None) -> Column:
    """HOOK for use*, COMPONENT for a capital (with a tag in the text, if given), else FUNCTION."""
    big = name.rlike("^[A-Z]")
    if text is not None:
        big = big & text.contains("<")
    return F.when(name.startswith("use"), "HOOK").when(big, "COMPONENT").otherwise("FUNCTION")


def starts(text: Column, pattern: str) -> Column:
    """(name, start_line) of each match of a declaration's pattern, in order. What stands between matches is what splitting the text by the pattern gives, so
    the text is gone through in a line; a pattern with a lazy beginning would, after the last match, try the rest of the text from each of its characters."""
    ends = lambda x: F.regexp_count(x, F.lit("\n"))
    # each match with the line ends before it, since the last match, and in it; what follows the last match has none
    steps = F.arrays_zip(F.transform(F.split(text, pattern), ends).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("name"), ends(x).alias("own"))).alias("head"))
    none = F.array().cast("array<struct<name:string,start_line:int>>")
    found = lambda s, x: F.concat(s["rows"], F.array(F.struct(x["head"]["name"].alias("name"), (s["at"] + x["gap"]).alias("start_line"))))
    return F.aggregate(steps, F.struct(F.lit(1).alias("at"), none.alias("rows")), lambda s, x: F.when(x["head"].isNull(), s).otherwise(F.struct((s["at"] + x["gap"] + x["head"]["own"]).alias("at"), found(s, x).alias("rows"))), lambda s: s["rows"])


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, chunk_type, name, text, start_line, end_line, symbols) from files (id, text): a chunk of 61 lines
    from each function or arrow declaration on, and one from the first import line to the last."""
    last = F.size("lines")

    def places(rule: int, pattern: str, needs: str) -> Column:
        none = F.array().cast("array<struct<name:string,start_line:int>>")
        # texts without what each match has are gone through by a short pattern only
        found = F.when(F.col("text").rlike(needs), starts(F.col("text"), pattern)).otherwise(none)
        return F.transform(found, lambda x, n: F.struct((n + rule * 100_000).alias("ordinal"), x["name"].alias("name"), x["start_line"].alias("start_line"), F.least(x["start_line"] + (fixed.CHUNK_LINES - 1), last).alias("end_line")))

    at = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(r"^\s*import "), i + 1)), lambda x: x.isNotNull())
    block = once(at, lambda at: F.when(F.size(at) > 0, F.array(F.struct(F.lit(1_000_000).alias("ordinal"), F.lit(None).cast("string").alias("name"), F.get(at, 0).alias("start_line"), F.element_at(at, -1).alias("end_line")))).otherwise(F.array().cast("array<struct<ordinal:int,name:string,start_line:int,end_line:int>>")))
    cut = files.select(F.col("id").alias("file_id"), "text", F.split("text", LINE_END).alias("lines"))
    # what a text has is worked out once, before it becomes rows
    each = text_each(cut, ["file_id", "lines"], F.concat(places(0, fixed.FUNCTION, fixed.FUNCTION_HAS), places(1, fixed.ARROW, fixed.ARROW_HAS), block), "x").select("file_id", "lines", "x.*")
    rows = each.withColumn("text", F.array_join(F.slice("lines", F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n")).where(F.col("text").rlike(r"\S"))
    is_import = F.col("ordinal") == 1_000_000
    kind = F.when(is_import, "IMPORT_BLOCK").otherwise(kind_of(F.col("name")))
    found = F.when(is_import, F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.IMPORTED), F.lit(1)))).otherwise(symbols(F.col("name"), F.col("text")))
    return rows.select("file_id", "ordinal", kind.alias("chunk_type"), "name", "text", "start_line", "end_line", found.alias("symbols"))


def declared(files: DataFrame, *keep: str) -> DataFrame:
    """As ``parsed``, with declarations that end where their bodies end: each outermost function, arrow function, ``const`` or ``let``
    statement is a chunk, and so is each import. A capital makes a component only if there is a tag. Columns of files
    in ``keep`` go along, so that chunks needn't be joined with files again."""
    each = files.select(F.col("id").alias("file_id"), *keep, "text", F.posexplode(spans(F.col("text"))).alias("ordinal", "s"))
    body = F.substring("text", F.col("s.start"), F.col("s.length"))
    rows = each.select("file_id", *keep, "ordinal", "s.is_import", "s.start_line", "s.end_line", body.alias("text")).where(F.col("text").rlike(r"\S"))
    named = rows.withColumn("name", F.when(~F.col("is_import"), F.nullif(F.regexp_extract("text", fixed.DECLARED, 1), F.lit(""))))
    kind = F.when(F.col("is_import"), "IMPORT_BLOCK").otherwise(F.coalesce(kind_of(F.col("name"), F.col("text")), F.lit("FUNCTION")))
    imported = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(fixed.IMPORTED), F.lit(1)), lambda t: (F.length(t) >= fixed.MIN_SYMBOL) & ~t.isin(fixed.NOISE)))
    found = F.when(F.col("is_import"), imported).otherwise(symbols(F.col("name"), F.col("text")))
    return named.select("file_id", "ordinal", kind.alias("chunk_type"), "name", "text", "start_line", "end_line", found.alias("symbols"), *keep)


def whole_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """A MISC chunk, the whole file, for each file (id, text) that has none and isn't blank; so nothing is lost to search."""
    rest = files.where(F.col("text").rlike(r"\S")).join(chunks.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti")
    return rest.select(F.col("id").alias("file_id"), F.lit(2_000_000).alias("ordinal"), F.lit("MISC").alias("chunk_type"), F.lit(None).cast("string").alias("name"), "text", F.lit(1).alias("start_line"), F.size(F.split("text", LINE_END)).alias("end_line"), F.array().cast("array<string>").alias("symbols"))


def shards(chunks: DataFrame, most: int = fixed.MAX_CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, least: int = fixed.MIN_CHUNK_TOKENS) -> DataFrame:
    """Chunks within the budget as they are (small ones of no account go), others in windows named name[i]; adds shard_index and shard_total (null if whole)."""
    size = n_tokens(F.col("text"))
    whole = chunks.where((size <= most) & ((size >= least) | F.col("chunk_type").isin(fixed.ALWAYS_KEPT))).withColumn("shard_index", F.lit(None).cast("int")).withColumn("shard_total", F.lit(None).cast("int"))

    @F.arrow_udf("array<struct<first:int,end:int>>")
    def cut(lists: pa.Array) -> pa.Array:
        return pa.array([[{"first": a, "end": z} for a, z in windows(x or [], most, overlap, least)] for x in lists.to_pylist()], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))

    long = chunks.where(size > most).withColumn("lines", F.split("text", LINE_END)).withColumn("cuts", cut("lines"))
    each = long.withColumn("shard_total", F.size("cuts")).select("*", F.posexplode_outer("cuts").alias("shard_index", "w")).where("w IS NOT NULL")  # as text.each
    name = F.when(F.col("shard_index") == 0, F.col("name")).otherwise(F.concat("name", F.lit("["), F.col("shard_index").cast("string"), F.lit("]")))
    split = each.select(
        "file_id", "ordinal", "chunk_type", name.alias("name"), F.array_join(F.slice("lines", F.col("w.first") + 1, F.col("w.end") - F.col("w.first")), "\n").alias("text"),
        (F.col("start_line") + F.col("w.first")).alias("start_line"), (F.col("start_line") + F.col("w.end") - 1).alias("end_line"), "symbols", "shard_index", "shard_total",
    )
    return whole.unionByName(split)


def capped(chunks: DataFrame, most: int = 30, symbols_each: int = 20, file: str = "file_id", order: str = "start_line", key: str = "id") -> DataFrame:
    """At most so many chunks a file, by their types (hooks, components, functions, imports, others), then their lines; and so many symbols a chunk. The ranks are
    worked out from narrow rows, texts join after."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in ("HOOK", "COMPONENT", "FUNCTION", "CLASS", "IMPORT_BLOCK")]), F.col("chunk_type")), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(file).orderBy(F.when(kind == 0, 99).otherwise(kind), order, key))
    kept = chunks.select(key, file, "chunk_type", order).withColumn("_n", rank).where(F.col("_n") <= most).select(key)
    out = chunks.join(kept, key, "left_semi")
    return out.withColumn("symbols", F.slice("symbols", 1, symbols_each)) if "symbols" in chunks.columns else out


def fixed_windows(docs: DataFrame, key: str, text: str, lines: int = 40, step: int = 30) -> DataFrame:
    """(key, start_line, text): windows of so many lines for files that can't be parsed."""
    cut = docs.select(key, F.split(text, LINE_END).alias("lines"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines")), F.lit(step))
    return cut.select(key, "lines", F.explode(starts).alias("start_line")).select(key, "start_line", F.array_join(F.slice("lines", F.col("start_line"), lines), "\n").alias("text"))


def stored(chunks: DataFrame, compat: bool = False) -> DataFrame:
    """With id, char_count and summary. Ids add the chunk's place in its file, so that two chunks of one line differ; ``compat`` leaves it out."""
    parts = [F.col("file_id"), F.col("start_line").cast("string"), F.coalesce("name", F.lit(""))]
    if not compat:
        parts += [F.col("ordinal").cast("string"), F.coalesce(F.col("shard_index").cast("string"), F.lit(""))]
    return chunks.withColumn("id", F.sha1(F.concat_ws(":", *parts))).withColumn("char_count", F.length("text")).withColumn("summary", summary(F.col("chunk_type"), F.col("name"), F.col("text")))
