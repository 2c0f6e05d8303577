"""Names resolved through imports: each use goes to the declaration that its file imports, not to any of that name.

An import binds a local name to a name of another file; files pass names on by re-exports. Resolution is an iterated join of (file, name): with what the file
declares and exports, else with what it passes on, so a chain of so many files takes so many joins, for all names at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.store import cut
from .extract import resolved_specifiers

_IMPORT = r"import\s+(?:type\s+)?([\w$*{][^'\";]*?)\s+from\s+['\"]([^'\"]+)['\"]"
_PASSED_ON = r"export\s*(\*|\{[^}]*\})\s*from\s+['\"]([^'\"]+)['\"]"
_LISTED = r"export\s*\{([^}]*)\}(?!\s*from)"
_DECLARED = r"export\s+(?:async\s+)?(?:function\s*\*?|const|let|var|class)\s+([\w$]+)"
_DEFAULT = r"export\s+default\s+(?:async\s+)?(?:function\s*\*?\s+|class\s+)?([\w$]+)"
_CALL, _TAG = r"(?<![\w$.])([\w$]+)\s*\(", fixed.EDGE_TAG


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))


def _names(listed: Column) -> Column:
    """(name, as) of ``a, b as c``."""
    items = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.get(F.split(x, " as "), 0).alias("name"), F.element_at(F.split(x, " as "), -1).alias("local")))


def imports(files: DataFrame) -> DataFrame:
    """(file_id, local, name, specifier) from files (id, text); name is ``default`` or ``*`` for imports of these."""
    each = files.select(F.col("id").alias("file_id"), F.explode(_pairs(F.col("text"), _IMPORT)).alias("i")).select("file_id", F.col("i.a").alias("clause"), F.col("i.b").alias("specifier"))
    one = lambda pattern, name: F.when(F.regexp_extract("clause", pattern, 1) != "", F.array(F.struct(F.lit(name).alias("name"), F.regexp_extract("clause", pattern, 1).alias("local")))).otherwise(F.array().cast("array<struct<name:string,local:string>>"))
    bound = F.concat(one(r"^([\w$]+)", "default"), one(r"\*\s+as\s+([\w$]+)", "*"), _names(F.regexp_extract("clause", r"\{([^}]*)\}", 1)))
    return each.select("file_id", "specifier", F.explode(bound).alias("x")).select("file_id", "x.local", "x.name", "specifier")


def passed_on(files: DataFrame) -> DataFrame:
    """(file_id, local, name, specifier): names that a file exports from another one; ``*`` for all."""
    each = files.select(F.col("id").alias("file_id"), F.explode(_pairs(F.col("text"), _PASSED_ON)).alias("i")).select("file_id", F.col("i.a").alias("clause"), F.col("i.b").alias("specifier"))
    every = F.array(F.struct(F.lit("*").alias("name"), F.lit("*").alias("local")))
    return each.select("file_id", "specifier", F.explode(F.when(F.col("clause") == "*", every).otherwise(_names(F.regexp_extract("clause", r"\{([^}]*)\}", 1)))).alias("x")).select("file_id", "x.local", "x.name", "specifier")


def declared(chunks: DataFrame) -> DataFrame:
    """(file_id, name, target): the chunk that declares a name in a file; of several the least."""
    named = chunks.where("name IS NOT NULL AND chunk_type <> 'IMPORT_BLOCK'")
    return named.groupBy("file_id", "name").agg(F.min("id").alias("target"))


def exported(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, name, target): chunks by the names under which their files export them."""
    t = F.col("text")
    own = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    same = F.transform(own(_DECLARED), lambda x: F.struct(x.alias("name"), x.alias("local")))
    default = F.transform(own(_DEFAULT), lambda x: F.struct(x.alias("name"), F.lit("default").alias("local")))
    listed = F.flatten(F.transform(own(_LISTED), _names))
    rows = files.select(F.col("id").alias("file_id"), F.explode(F.concat(same, default, listed)).alias("x")).select("file_id", F.col("x.name").alias("own"), F.col("x.local").alias("name")).distinct()
    return rows.join(declared(chunks).withColumnRenamed("name", "own"), ["file_id", "own"]).groupBy("file_id", "name").agg(F.min("target").alias("target"))


def bindings(files: DataFrame, chunks: DataFrame, depth: int = 8) -> DataFrame:
    """(file_id, local, target) of all imports of files (id, path, text) that lead to a chunk, through ``depth`` files at most; by the fewest files, then the
    least chunk."""
    bound, more = imports(files), passed_on(files)
    aimed = cut(resolved_specifiers(files, bound.select("file_id", "specifier").unionByName(more.select("file_id", "specifier")).distinct()))
    own, links = cut(exported(files, chunks)), cut(more.join(aimed, ["file_id", "specifier"]).select(F.col("file_id").alias("at"), F.col("local").alias("as"), F.col("name").alias("inner"), "to_id"))
    asks = cut(bound.join(aimed, ["file_id", "specifier"]).select("file_id", "local", F.col("to_id").alias("at"), "name"))
    found = None
    for level in range(depth):
        met = asks.join(own.select(F.col("file_id").alias("at"), "name", "target"), ["at", "name"]).select("file_id", "local", "target", F.lit(level).alias("level"))
        found = met if found is None else found.unionByName(met)
        rest = asks.join(met.select("file_id", "local").distinct(), ["file_id", "local"], "left_anti")
        by_name = rest.join(links, (rest["at"] == links["at"]) & (rest["name"] == links["as"])).select("file_id", "local", F.col("to_id").alias("at"), F.col("inner").alias("name"))
        by_star = rest.where("name NOT IN ('default', '*')").join(links.where("as = '*'"), "at").select("file_id", "local", F.col("to_id").alias("at"), "name")
        asks = cut(by_name.unionByName(by_star).distinct())
        if asks.isEmpty():
            break
    return found.groupBy("file_id", "local").agg(F.min_by("target", F.struct("level", "target")).alias("target"))


def uses(chunks: DataFrame) -> DataFrame:
    """(id, file_id, name, edge_type): RENDERS for tags, USES_HOOK and CALLS for calls."""
    t = F.col("text")
    calls = F.transform(F.regexp_extract_all(t, F.lit(_CALL), F.lit(1)), lambda x: F.struct(x.alias("name"), F.when(x.rlike("^use[A-Z]"), "USES_HOOK").otherwise("CALLS").alias("edge_type")))
    tags = F.transform(F.regexp_extract_all(t, F.lit(_TAG), F.lit(1)), lambda x: F.struct(x.alias("name"), F.lit("RENDERS").alias("edge_type")))
    rows = chunks.where("chunk_type <> 'IMPORT_BLOCK'").select("id", "file_id", F.explode(F.array_distinct(F.concat(calls, tags))).alias("x"))
    return rows.select("id", "file_id", "x.name", "x.edge_type")


def edges(files: DataFrame, chunks: DataFrame, depth: int = 8) -> DataFrame:
    """(from_id, to_id, edge_type): what each chunk calls, renders and hooks into: the import of that name, or else the file's own
    declaration. A use that leads to neither has no edge, nor has one of itself."""
    inside = declared(chunks).select("file_id", F.col("name").alias("local"), F.col("target").alias("own"))
    through = bindings(files, chunks, depth)
    used = uses(chunks).withColumnRenamed("name", "local")
    both = used.join(through, ["file_id", "local"], "left").join(inside, ["file_id", "local"], "left").withColumn("to_id", F.coalesce("target", "own"))
    return both.where("to_id IS NOT NULL AND to_id <> id").select(F.col("id").alias("from_id"), "to_id", "edge_type").distinct()
