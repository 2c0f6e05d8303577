"""Merkle fixity audit of WARC records.

A record's leaf is the SHA-256 of its bytes. Leaves are gathered by ranges of offsets, in
order; a range's hash is that of its leaves with their offsets and lengths, an inner
node's that of its children, up to one root. A tree is a table of nodes. To compare two
replicas, only roots are compared first; below each pair of nodes that differ the children are, level by
level, down to ranges and at last records. So matching branches are never read.

The index of offsets belongs to the archive, not to a replica: a replica's bytes are
what is found at an offset, or nothing.

Defined results: records go by (key, then bytes); a null key goes first; null
columns of a page are empty in its record; repeated rows are records each; a
null payload is a missing record; equal or empty archives give no rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Bytes of an archive that one leaf range spans, and children of an inner node.
RANGE_BYTES, FAN = 1 << 20, 16
CRLF = "\r\n"


def warc(url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(head, body, F.lit(CRLF + CRLF))


def placed(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds the offset of each record (key, length, sha): a sum within ranges of keys, on
    top of the sums of the ranges before. Only one row for each range meets in a task."""
    spark = records.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("sha"), F.col("length")]
    dealt = stage(records.repartitionByRange(parts, *order[:2]).withColumn("part", F.spark_partition_id()), "records")
    sizes = dealt.groupBy("part").agg(F.sum("length").alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("base"))  # one row for each of ``parts``
    own = F.sum("length").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("until", own).join(F.broadcast(bases), "part").withColumn("offset", F.col("base") + F.col("until") - F.col("length")).drop("part", "base", "until")


def tree(leaves: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> tuple[DataFrame, int]:
    """Nodes (level, node, hash) over leaves (offset, length, sha), and the root's
    level. A node has at most ``fan`` children, a range the records that begin in its bytes."""
    item = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("sha", F.lit("-")))
    nodes = leaves.groupBy(F.floor(F.col("offset") / range_bytes).alias("node")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", item.alias("item")))), lambda x: x["item"]), ","), 256).alias("hash"))
    level, made = 0, stage(nodes.select(F.lit(0).alias("level"), "node", "hash"), "nodes")
    every, most = made, made.agg(F.max("node")).first()[0] or 0
    while most > 0:
        level, most = level + 1, most // fan
        parents = made.groupBy(F.floor(F.col("node") / fan).alias("parent")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ","), 256).alias("hash"))
        made = stage(parents.select(F.lit(level).alias("level"), F.col("parent").alias("node"), "hash"), "nodes")
        every = every.unionByName(made)
    return every, level


def mismatches(a: DataFrame, b: DataFrame, level: int, fan: int = FAN) -> DataFrame:
    """Leaf ranges (column node) where two trees differ, by descent from the root."""
    asked = None
    for k in range(level, -1, -1):
        x, y = (t.where(F.col("level") == k).select("node", "hash") for t in (a, b))
        if asked is not None:
            up = lambda t, q=asked: t.withColumn("up", F.floor(F.col("node") / fan)).join(q.select(F.col("node").alias("up")), "up", "left_semi").drop("up")
            x, y = up(x), up(y)
        differ = x.withColumnRenamed("hash", "one").join(y.withColumnRenamed("hash", "two"), "node", "full").where("NOT (one <=> two)").select("node")
        asked = stage(differ, f"level{k}")
        if not asked.limit(1).count():
            break
    return asked


def audit(index: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """index: key, offset, length, sha of each record of the archive; replica: offset,
    found_length, found_sha (null: nothing there). Rows of records that differ: key, offset, length, expected_sha256,
    found_sha256, status (altered, missing, or extra for a record the index doesn't have)."""
    mine, level = tree(index.select("offset", "length", "sha"), range_bytes, fan)
    theirs, other = tree(replica.select("offset", F.col("found_length").alias("length"), F.col("found_sha").alias("sha")), range_bytes, fan)
    if level != other:  # a longer or shorter replica: compare what both have, and the rest as a whole
        level = min(level, other)
    bad = mismatches(mine, theirs, level, fan)
    inside = lambda t: t.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, "node", "left_semi").drop("node")
    both = inside(index.select("key", "offset", "length", "sha")).join(inside(replica.select("offset", "found_length", "found_sha")), "offset", "full").where("NOT (sha <=> found_sha AND length <=> found_length)")
    status = F.when(F.col("found_sha").isNull(), "missing").when(F.col("sha").isNull(), "extra").otherwise("altered")
    return both.select("key", "offset", "length", F.col("sha").alias("expected_sha256"), F.col("found_sha").alias("found_sha256"), status.alias("status"))


def records(pages: DataFrame, *more: Column, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """key, length and sha of each page's record, and ``more`` columns of the page. Bytes are hashed where they are read and never move."""
    own = warc(F.col(url_col), F.col(body_col))
    return pages.select(F.col(id_col).alias("key"), F.octet_length(own).cast("long").alias("length"), F.sha2(own, 256).alias("sha"), *more)
