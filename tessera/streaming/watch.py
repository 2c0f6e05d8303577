"""File events as a stream: throttled by file, and the index kept current."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import fixed
from ..sources import files
from . import tree


def accepted(stamps: list[float], last: float | None, seconds: float) -> tuple[list[bool], float | None]:
    """Which of some events in order are accepted: those ``seconds`` or more after the last accepted one."""
    out = []
    for t in stamps:
        out.append(last is None or t - last >= seconds)
        last = t if out[-1] else last
    return out, last


def throttle_batch(events: DataFrame, key: str, ts: str, tie: str, seconds: float = fixed.THROTTLE_SECONDS) -> DataFrame:
    """The accepted events of a table: for each key a fold over its events in order of time, then ``tie``.

    The fold keeps one number a key. It runs over rows sorted by key within partitions, so no key's
    events are held at once; a key's events meet in one task, since each depends on the one before."""

    def run(batches):
        current, last = object(), None
        for pdf in batches:
            keep = []
            for k, t in zip(pdf[key], pdf["_t"], strict=True):
                if k != current:
                    current, last = k, None
                (ok,), last = accepted([t], last, seconds)
                keep.append(ok)
            yield pdf[keep].drop(columns="_t")

    timed = events.withColumn("_t", (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6))
    return timed.repartition(F.col(key)).sortWithinPartitions(key, "_t", tie).mapInPandas(run, events.schema)


def throttle(events: DataFrame, key: str, ts: str, seconds: float = fixed.THROTTLE_SECONDS, late_minutes: int = 60) -> DataFrame:
    """(key, ts_seconds) of accepted events of a stream. Events more than ``late_minutes`` behind the latest are
    dropped by the watermark. A key's state, the time of its last accepted event, is forgotten once the watermark has
    passed it by ``seconds``: any event still to come would be accepted then, so nothing is lost, and a stream without new events is at rest."""

    def run(k: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        stamps = np.sort(np.concatenate([f["_t"].to_numpy() for f in frames]))
        kept, at = [], 0 if last is None else np.searchsorted(stamps, last + seconds)
        while at < len(stamps):  # from one accepted event to the next, not event by event
            last = float(stamps[at])
            kept.append(last)
            at = max(at + 1, np.searchsorted(stamps, last + seconds))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int((last + seconds + 60 * late_minutes) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({key: [k[0]] * len(kept), "ts_seconds": kept})

    kind = events.schema[key].dataType.simpleString()
    # a watermark begins at 1970 and drops what is at it: moved on by the time that events may be late, it drops none since then
    moved = F.col(ts).cast("timestamp") + F.make_interval(mins=F.lit(late_minutes))
    timed = events.select(key, moved.alias("_w"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t")).withWatermark("_w", f"{late_minutes} minutes")
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, ts_seconds double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def follow(engine, root: str, checkpoint: str | None = None, seconds: float = fixed.THROTTLE_SECONDS, once: bool = False) -> StreamingQuery:
    """Keeps the index of a project current: a stream of new, changed and deleted files. Events of ``seconds`` (the throttle) are taken together, and the
    project is indexed once for them; batches run one at a time. ``once``: what there is now, then the stream ends."""

    def look(found: DataFrame, _: int) -> None:
        if not found.isEmpty():
            engine.index(root)

    tree.register(engine.spark)
    c = engine.config["indexer"]
    seen = engine.spark.readStream.format("source_tree").option("extensions", ",".join(c["file_extensions"])).option("exclude", ",".join(c["exclude_dirs"])).load(root)
    w = seen.writeStream.foreachBatch(look)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    return w.start()


def stale(engine, root: str) -> bool:
    """Whether a file is new, has another size or time, or is gone."""
    known = engine.registry.store(root).read("files")
    listed = files.listing(engine.spark, root, engine.config["indexer"]["file_extensions"], engine.config["indexer"]["exclude_dirs"])
    return not files.touched(listed, known).isEmpty() or not files.removed(listed, known).isEmpty()
