"""Entries that live a time, as a stream with state: a timer for each entry, moved when it is written again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STATE = StructType([StructField("created_ms", LongType()), StructField("until_ms", LongType()), StructField("writes", LongType())])


class Expiry(StatefulProcessor):
    """Of each key the last entry (the latest, then the one that lives longest) is kept until the watermark is past its time."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        best, writes = (held[0], held[1]) if held else None, held[2] if held else 0
        for pdf in rows:
            if pdf.empty:
                continue
            writes += len(pdf)
            own = max(zip(pdf["entry_created"].tolist(), pdf["entry_until"].tolist(), strict=True))
            best = own if best is None else max(best, own)
        if best is None:
            return
        if held and held[1] != best[1]:
            self.handle.deleteTimer(held[1])
        self.entry.update((best[0], best[1], writes))
        self.handle.registerTimer(best[1])
        yield from ()  # entries come out when their time is over

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, until, writes = self.entry.get()
        self.entry.clear()
        yield pd.DataFrame({self.key: [key[0]], "created_ms": [created], "expired_ms": [until], "writes": [writes]})

    def close(self) -> None:
        pass


def expired(entries: DataFrame, key: str, created: str, ttl_seconds: str, late_minutes: int = 10) -> DataFrame:
    """(key, created_ms, expired_ms, writes): entries of a stream that have outlived their time, once the watermark (``late_minutes`` behind the
    latest) is past it. A key that is written again before then lives on by its latest entry; one written later begins anew. State goes with the entry.
    Needs the RocksDB state store, which the session has to be set to."""
    kind = entries.schema[key].dataType.simpleString()
    ms = F.unix_millis(F.col(created).cast("timestamp"))
    timed = entries.where(F.col(created).isNotNull()).select(key, F.col(created).cast("timestamp").alias("entry_at"), ms.alias("entry_created"), (ms + F.coalesce(F.col(ttl_seconds), F.lit(0)) * 1000).cast("long").alias("entry_until"))
    out = f"{key} {kind}, created_ms long, expired_ms long, writes long"
    return timed.withWatermark("entry_at", f"{late_minutes} minutes").groupBy(key).transformWithStateInPandas(Expiry(key), out, "Append", "EventTime")
