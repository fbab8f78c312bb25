"""Keyed state that outlives a batch: a cache whose entries expire, and the last progress of jobs. Both are stateful processors with timers
in event time, so a restart goes on from the checkpoint and entries nobody asks for again are removed when the watermark passes them.

The state lives in RocksDB on the executors with its changes in the checkpoint folder; ready() chooses that provider for the session. A
batch's rows of one key are held together by its task, so a hot key asks for smaller batches (maxFilesPerTrigger, maxOffsetsPerTrigger)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship
from .records import progress_events

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ship(spark)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch in order of time and id."""
    return pd.concat(list(rows)).sort_values(["ms", "id"], kind="stable")


class Memo(StatefulProcessor):
    """An entry of a key lives `ttl` milliseconds from the request that made it; one that is asked for at its last moment still counts."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "expires long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = expires = self.entry.get()[0] if self.entry.exists() else None
        ids, hits = [], []
        batch = _in_order(rows)
        for i, ms in zip(batch["id"], batch["ms"], strict=True):
            hits.append(expires is not None and ms <= expires)
            ids.append(i)
            if not hits[-1]:
                expires = int(ms) + self.ttl
        if expires != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.entry.update((expires,))
            self.handle.registerTimer(expires)
        yield pd.DataFrame({"key": pd.Series([str(key[0])] * len(ids), dtype=object), "id": ids, "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The entry is gone and nothing comes out."""
        if self.entry.exists() and self.entry.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield from ()

    def close(self) -> None:
        pass


def cache_requests(requests: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, id, hit) of a stream of requests (key, id, at): whether the value of a key was still there or had to be worked out [ST4].

    Requests of a batch are taken in order of time and id; a request that is later than the watermark allows is dropped by Spark."""
    ready(requests.sparkSession)
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.unix_millis("at").alias("ms"), "at").withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Memo(ttl_ms), "key string, id long, hit boolean", "Append", "EventTime")


class Progress(StatefulProcessor):
    """The last percent and phase that a job's output told, and its chunks so far; a job that is silent for `idle` milliseconds is given up."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "percent int, phase string, chunks long, alarm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        percent, phase, chunks, alarm = self.state.get() if self.state.exists() else (None, None, 0, None)
        batch = _in_order(rows)
        for p, f in zip(batch["percent"], batch["phase"], strict=True):
            percent = percent if pd.isna(p) else int(p)
            phase = phase if f is None or pd.isna(f) else f
            chunks += 1
        last = int(batch["ms"].iloc[-1]) + self.idle
        if alarm is not None:
            last = max(last, alarm)
            self.handle.deleteTimer(alarm)
        self.handle.registerTimer(last)
        self.state.update((percent, phase, chunks, last))
        yield self._row(key, percent, phase, chunks, "running" if percent is None or percent < 100 else "completed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            percent, phase, chunks, _ = self.state.get()
            self.state.clear()
            if percent is None or percent < 100:
                yield self._row(key, percent, phase, chunks, "failed")

    def _row(self, key, percent, phase, chunks, status) -> pd.DataFrame:
        text = lambda x: pd.Series([x], dtype=object)
        return pd.DataFrame({"job": text(str(key[0])), "percent": pd.array([percent], "Int32"), "phase": text(phase), "chunks": [chunks], "status": text(status)})

    def close(self) -> None:
        pass


def job_progress(chunks: DataFrame, idle_ms: int, late: str = "1 hour") -> DataFrame:
    """(job, percent, phase, chunks, status) after each batch of a stream of output (job, id, at, value), and of jobs that fell silent below 100 per cent [ST3]."""
    ready(chunks.sparkSession)
    told = progress_events(chunks.select(F.col("job").cast("string").alias("job"), F.col("id").cast("long").alias("id"), "at", "value"))
    rows = told.select("job", "id", F.unix_millis("at").alias("ms"), "percent", "phase", "at").withWatermark("at", late)
    return rows.groupBy("job").transformWithStateInPandas(Progress(idle_ms), "job string, percent int, phase string, chunks long, status string", "Update", "EventTime")
