"""File events of a source tree as a stream: which files were created, changed or deleted since the last batch.

    tree.register(spark)
    spark.readStream.format("source_tree").option("extensions", "ts,tsx").load("/src/project")

An offset is the listing (path, time, size) that a batch has seen, so a batch's events are the difference of two listings: the same after a
restart from the checkpoint, and none get lost between. A tree as it was gives no batch. Offsets grow with the number of source files of a project, of which
a listing is held by the driver as it is by any watcher; rows of events are dealt out."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import fixed

SCHEMA = "path string, event string, size_bytes long, modified_at timestamp"
#: Events of one task.
EVENTS = 10_000

Listing = dict[str, list[int]]


def listing(root: str, extensions: list[str], excluded: list[str]) -> Listing:
    """Time (microseconds) and size of each source file below a folder of any file system that Arrow knows."""
    import pyarrow.fs as pafs

    fs, top = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
    top, out = top.rstrip("/"), {}
    todo = [top]
    while todo:
        for x in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
            if x.type == pafs.FileType.Directory:
                if x.base_name not in excluded:
                    todo.append(x.path)
            elif x.extension in extensions:
                out[x.path[len(top) + 1 :]] = [int((x.mtime_ns or 0) // 1000), x.size]
    return out


def events(old: Listing, new: Listing) -> list[tuple[str, str, int | None, int | None]]:
    """(path, created, changed or deleted, size, time) by path."""
    out = []
    for path in sorted(old.keys() | new.keys()):
        if path not in new:
            out.append((path, "deleted", None, None))
        elif old.get(path) != new[path]:
            out.append((path, "changed" if path in old else "created", new[path][1], new[path][0]))
    return out


class Events(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        named = lambda k, usual: [x for x in options.get(k, "").split(",") if x] or usual
        self.root, self.extensions, self.excluded = options["path"], named("extensions", fixed.EXTENSIONS), named("exclude", fixed.EXCLUDED_DIRS)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(listing(self.root, self.extensions, self.excluded), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = events(json.loads(start["files"]), json.loads(end["files"]))
        return [Events(found[at : at + EVENTS]) for at in range(0, len(found), EVENTS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        for path, event, size, at in partition.rows:
            yield path, event, size, None if at is None else datetime.datetime.fromtimestamp(at / 1e6)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
