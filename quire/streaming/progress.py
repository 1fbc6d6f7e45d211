"""Progress events and incremental arrival as structured streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.text import redact
from quire.operators.memory import fold
from quire.sources.stores import write_checkpoints

EVENTS = "job_id string, seq long, ts timestamp, log_line string, completed long, total long, status string"
SAVES = "job_id string, seq long, completed long, total long, status string, saved_at long, reason string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMORY = "book string, chapter_no long, recent array<string>, glossary array<struct<source: string, target: string>>"
MEMORY_STATE = "chapter_no long, recent array<string>, glossary array<struct<source: string, target: string>>"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Progress events of JSON files as they arrive; secrets are taken out of log lines."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return stream.withColumn("log_line", redact("log_line"))


def job_progress(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Latest completed, total and share of each job and ten-second window."""
    latest = events.withWatermark("ts", lateness).groupBy(F.window("ts", "10 seconds"), "job_id").agg(F.max("completed").alias("completed"), F.max("total").alias("total"), F.count("*").alias("events"))
    return latest.withColumn("progress", F.coalesce(F.try_divide("completed", "total"), F.lit(0.0)))


def save_checkpoints(events: DataFrame, path: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Appends each job's last state of a batch; the trigger is the throttle between saves."""

    def save(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("job_id").agg(F.max_by(F.struct("ts", "completed", "total"), "seq").alias("s")).select("job_id", "s.*")
        last.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class Throttle(StatefulProcessor):
    """A job's saves: its first state, its state after `blocks` more blocks, what is unsaved `seconds` after the last save, and its last state.

    A timer stands for the unsaved state, so a job that falls silent is saved too. Events that are older than the state are left
    out. State lives for `kept` milliseconds after its last change, so jobs that never end don't pile up.
    """

    ENDED = ("completed", "failed", "cancelled")

    def __init__(self, blocks: int = 20, seconds: float = 10.0, kept: int = 24 * 3600 * 1000):
        self.blocks, self.wait, self.kept = blocks, int(seconds * 1000), kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "seq long, completed long, total long, status string, saved_blocks long, saved_at long", self.kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, old = timerValues.getCurrentProcessingTimeInMs(), self._held()
        last = max(((int(seq), int(done), int(total), status) for part in rows for seq, done, total, status in self._events(part)), key=lambda e: e[0], default=None)
        if last is None or (old and last[0] <= old[0]):
            return
        seq, done, total, status = last
        if status in self.ENDED or done >= total > 0:
            reason = "last"
        elif old is None:
            reason = "first"
        elif done - old[4] >= self.blocks:
            reason = "blocks"
        else:
            reason = "time" if now - old[5] >= self.wait else None
        if reason:
            yield self._save(key, last, now, reason)
        else:
            self.state.update((seq, done, total, status, old[4], old[5]))
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(old[5] + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._held()
        if old:
            yield self._save(key, old[:4], timerValues.getCurrentProcessingTimeInMs(), "time")

    def close(self) -> None:
        pass

    @staticmethod
    def _events(part: pd.DataFrame) -> Iterator[tuple]:
        """Events without a number are left out; missing counts are 0."""
        known = part[part["seq"].notna()]
        return zip(known["seq"], known["completed"].fillna(0), known["total"].fillna(0), known["status"], strict=True)

    def _held(self) -> tuple | None:
        return tuple(self.state.get()) if self.state.exists() else None

    def _save(self, key, last: tuple, now: int, reason: str) -> pd.DataFrame:
        self.state.update((*last, last[1], now))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        return pd.DataFrame([(key[0], *last, now, reason)], columns=[field.split()[0] for field in SAVES.split(", ")])


def throttled_saves(events: DataFrame, blocks: int = 20, seconds: float = 10.0) -> DataFrame:
    """The states of jobs that are to be saved (SAVES), as Throttle says. Timers need the RocksDB state store."""
    rows = events.select("job_id", "seq", "completed", "total", "status")
    return rows.groupBy("job_id").transformWithStateInPandas(Throttle(blocks, seconds), SAVES, "append", "processingTime")


def save_throttled(events: DataFrame, path: str, checkpoint: str, blocks: int = 20, seconds: float = 10.0, every: str = "1 second") -> StreamingQuery:
    """Keeps each job's checkpoint in its folder of `path`, as write_checkpoints() does; a batch that comes again writes the same.

    Timers are looked at by each trigger, with or without new events.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("job_id").agg(F.max_by(F.struct("completed", "total", "status", "saved_at"), "seq").alias("s")).select("job_id", "s.*")
        write_checkpoints(last.select(F.col("job_id").alias("jobKey"), "status", F.col("completed").alias("completedBlocks"), F.col("total").alias("totalBlocks"), F.timestamp_millis("saved_at").cast("string").alias("updatedAtIso8601")), path)

    spark, provider = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # a query keeps what it has been started with
    try:
        return throttled_saves(events, blocks, seconds).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        spark.conf.set(provider, before)


def rolling_memory_stream(chapters: DataFrame) -> DataFrame:
    """The memory after each arriving chapter of a book; chapters of one book must arrive in order.

    State is the last two summaries and at most 32 glossary entries for each book.
    """

    def roll(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, recent, glossary = state.get if state.exists else (-1, [], [])
        memory = {"recent": list(recent), "glossary": {e["source"].lower(): dict(e) for e in map(_entry, glossary)}}
        rows = sorted((r for part in parts for r in part.to_dict("records")), key=lambda r: r["chapter_no"])
        out = []
        for r in rows:
            memory = fold(memory, {"summary": r["summary"], "glossary": [_entry(e) for e in r["glossary"]]})
            last = r["chapter_no"]
            out.append((key[0], last, memory["recent"], list(memory["glossary"].values())))
        state.update((last, memory["recent"], [(e["source"], e["target"]) for e in memory["glossary"].values()]))
        yield pd.DataFrame(out, columns=["book", "chapter_no", "recent", "glossary"])

    return chapters.groupBy("book").applyInPandasWithState(roll, MEMORY, MEMORY_STATE, "append", GroupStateTimeout.NoTimeout)


def _entry(e) -> dict:
    return {"source": e["source"], "target": e["target"]} if isinstance(e, dict) else {"source": e[0], "target": e[1]}
