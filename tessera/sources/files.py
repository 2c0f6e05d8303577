"""Files of a source tree as a table, and what changed in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import file_type, valid_text


def _found(spark: SparkSession, root: str, extensions: list[str], excluded: list[str], max_bytes: int | None, paths: list[str] | None = None) -> DataFrame:
    """Spark's table of files with rel, the path from the root. Names and sizes are checked before contents are read."""
    root = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(extensions)}}}")
    raw = read.load([f"{root}/{p}" for p in paths] if paths else root)
    base = F.lit(root.split("://", 1)[-1].removeprefix("file:"))
    path = F.regexp_replace(F.col("path"), "^[a-z0-9]+:/*", "/")
    kept = raw.withColumn("rel", F.substring(path, F.length(base) + 2, F.length(path))).where(~F.arrays_overlap(F.split("rel", "/"), F.lit(excluded)))
    return kept.where(F.col("length") <= max_bytes) if max_bytes else kept


def stream_path(path: str) -> str:
    """``path`` as a pattern that only it matches: a file stream takes a single file, too, by a pattern only."""
    path = path.rstrip("/")
    return path if set(path) & set("{}[]*?\\") else f"{path[:-1]}[{path[-1]}]"


def listing(spark: SparkSession, root: str, extensions: list[str] = fixed.EXTENSIONS, excluded: list[str] = fixed.EXCLUDED_DIRS, max_bytes: int | None = None) -> DataFrame:
    """id, path, size_bytes and modified_at of each source file; contents aren't read."""
    return _found(spark, root, extensions, excluded, max_bytes).select(F.sha1("rel").alias("id"), F.col("rel").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def touched(listed: DataFrame, known: DataFrame) -> DataFrame:
    """Listed files that are new, or have another size or time than the known one."""
    return listed.join(known.select("id", "size_bytes", "modified_at"), ["id", "size_bytes", "modified_at"], "left_anti")


def scan(spark: SparkSession, root: str, extensions: list[str] = fixed.EXTENSIONS, excluded: list[str] = fixed.EXCLUDED_DIRS, max_bytes: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """id, path (from the root), file_type, size_bytes, line_count, content_hash, modified_at, text of each
    source file that isn't below an excluded folder, or of some ``paths`` only."""
    kept = _found(spark, root, extensions, excluded, max_bytes, paths)
    text = valid_text(F.col("content"))
    return kept.select(
        F.sha1("rel").alias("id"), F.col("rel").alias("path"), file_type(F.col("rel")).alias("file_type"), F.col("length").alias("size_bytes"),
        (F.regexp_count(text, F.lit("\n")) + 1).cast("int").alias("line_count"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified_at"), text.alias("text"),
    )


def changed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Scanned rows whose (id, content_hash) isn't known: new and altered files."""
    return scanned.join(known.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def removed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """Known rows whose id isn't there any more."""
    return known.join(scanned.select("id"), "id", "left_anti")
