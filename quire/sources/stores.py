"""Stored job records: history, checkpoints, settings, last paths."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.numbers import checkpoint_int, job_int, progress
from quire.operators.history import HISTORY

STATUSES = ("idle", "queued", "running", "inspected", "cancelled", "failed", "completed")
COUNTS = ("completedFiles", "totalFiles", "completedBlocks", "totalBlocks", "cachedBlocks", "resumedBlocks")
TEXTS = ("id", "inputPath", "outputPath", "status", "phase", "progress", "currentChapter", "currentBlock", "errorMessage", "jobKey", "inputFingerprint", "updatedAtIso8601")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _text(v: Column, name: str) -> Column:
    """A string field; other kinds count as empty."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(kind == "STRING", _field(v, name)).otherwise("")


def decode_jobs(rows: DataFrame, json: str = "json") -> DataFrame:
    """Job records of JSON objects, field by field; rows without an id or that are no object are left out."""
    v = F.try_parse_json(F.col(json))
    read = rows.withColumn("v", v).where(F.schema_of_variant(F.col("v")).startswith("OBJECT"))
    v = F.col("v")
    status = F.when(_text(v, "status").isin(*STATUSES), _text(v, "status")).otherwise("idle")
    named = F.when(_text(v, "phase").isin("inspection", "translation"), _text(v, "phase"))
    phase = F.coalesce(named, F.when(status == "completed", "translation").otherwise("inspection"))
    counts = {c: job_int(_field(v, c)) for c in COUNTS}
    out = read.select(
        *[c for c in rows.columns if c != json], _text(v, "id").alias("id"), _text(v, "inputPath").alias("inputPath"), _text(v, "outputPath").alias("outputPath"), status.alias("status"), phase.alias("phase"),
        progress(_field(v, "progress").try_cast("double")).alias("progress"), *(x.alias(c) for c, x in counts.items()),
        *(F.nullif(_text(v, c), F.lit("")).alias(c) for c in ("currentChapter", "currentBlock", "errorMessage")),
    )
    return out.where("id <> ''")


def decode_checkpoints(rows: DataFrame, json: str = "json") -> DataFrame:
    """Checkpoints of JSON objects; counts in any number format, status `running` unless it is given."""
    v = F.col("v")
    read = rows.withColumn("v", F.try_parse_json(F.col(json))).where(F.schema_of_variant(v).startswith("OBJECT"))
    return read.select(
        *[c for c in rows.columns if c != json], *(_text(v, c).alias(c) for c in ("jobKey", "inputFingerprint", "inputPath", "outputPath", "currentChapter", "updatedAtIso8601")),
        F.coalesce(F.nullif(_text(v, "status"), F.lit("")), F.lit("running")).alias("status"), *(checkpoint_int(_field(v, c)).alias(c) for c in COUNTS),
    )


def write_history(jobs: DataFrame, path: str, order: str = "ord") -> None:
    """The first records by order as one JSON-lines file (at most HISTORY rows)."""
    jobs.orderBy(order).limit(HISTORY).coalesce(1).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records of write_history(); lines that are no records are left out."""
    lines = spark.read.text(path).withColumnRenamed("value", "json")
    return decode_jobs(lines.withColumn("ord", F.try_variant_get(F.try_parse_json("json"), "$.ord", "long"))).orderBy("ord").limit(HISTORY)


def write_checkpoints(states: DataFrame, path: str) -> None:
    """One folder for each job key, so that saving a job leaves the others alone."""
    states.withColumn("job_key", F.col("jobKey")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_key").json(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoints of all jobs, or of those in this folder, in one read, with job_key (of their folders); no row where nothing is saved."""
    try:
        # the folders' names are read as text: a key of digits is no number
        lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("json"), F.regexp_extract("_metadata.file_path", "/job_key=([^/]*)/", 1).alias("job_key"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "json string, job_key string")
    return decode_checkpoints(lines)


def read_checkpoint(spark: SparkSession, path: str, job_key: str) -> DataFrame:
    """The checkpoint of a job, or no row; its folder alone is read."""
    return read_checkpoints(spark, f"{path.rstrip('/')}/job_key={job_key}").drop("job_key")


def clear_checkpoint(spark: SparkSession, path: str, job_key: str) -> None:
    """Removes a job's checkpoint; others stay."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/job_key={job_key}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


CHECKPOINT = ", ".join([*(f"{c} string" for c in ("jobKey", "inputFingerprint", "inputPath", "outputPath", "status", "currentChapter", "updatedAtIso8601")), *(f"{c} long" for c in COUNTS)])


def new_job_id(clock: Callable[[], float] = time.time) -> str:
    """Milliseconds since the epoch."""
    return str(int(clock() * 1000))


def iso_time(clock: Callable[[], float] = time.time) -> str:
    return datetime.fromtimestamp(clock()).isoformat()


class Checkpoints:
    """Saves of jobs' states: each job's when forced, after 20 more blocks of it or 10 seconds after its last one.

    A report has the states of any number of jobs and is one write; what was saved last, and when, is kept as a table beside
    it. One writer, in order, so that no older state comes after a newer one. A save that fails doesn't stop those after it.
    """

    BLOCKS, SECONDS = 20, 10.0

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time, work_path: str | None = None):
        self.spark, self.path, self.clock = spark, path, clock
        self.work_path = work_path or f"{path.rstrip('/')}-saves"
        self.saved: DataFrame | None = None
        self.writer = ThreadPoolExecutor(1)

    def report(self, states: DataFrame, force: bool = False) -> Future:
        """States as CHECKPOINT has them, but for updatedAtIso8601."""
        return self.writer.submit(self._save, states, self.clock(), iso_time(self.clock), force)

    def _save(self, states: DataFrame, now: float, at: str, force: bool) -> None:
        saved = self.saved if self.saved is not None else self.spark.createDataFrame([], "jobKey string, savedBlocks long, savedAt double")
        due = F.col("savedAt").isNull() | (F.col("completedBlocks") - F.col("savedBlocks") >= self.BLOCKS) | (now - F.col("savedAt") >= self.SECONDS) | F.lit(force)
        judged = states.withColumn("updatedAtIso8601", F.lit(at)).join(saved, "jobKey", "left").withColumn("due", due)
        path = f"{self.work_path}/{uuid.uuid4().hex}"
        judged.write.parquet(path)
        kept = self.spark.read.schema(judged.schema).parquet(path)
        write_checkpoints(kept.where("due").select(*(field.split()[0] for field in CHECKPOINT.split(", "))), self.path)
        blocks, seconds = F.when(F.col("due"), F.col("completedBlocks")).otherwise(F.col("savedBlocks")), F.when(F.col("due"), now).otherwise(F.col("savedAt"))
        self.saved = kept.select("jobKey", blocks.alias("savedBlocks"), seconds.alias("savedAt"))

    def close(self) -> None:
        """Waits for what is still to be written."""
        self.writer.shutdown(wait=True)


def load_session(path: str) -> dict[str, str]:
    """inputPath and outputDirectory of the last session; what isn't readable is empty."""
    try:
        read = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        read = {}
    read = read if isinstance(read, dict) else {}
    return {name: read[name] if isinstance(read.get(name), str) else "" for name in ("inputPath", "outputDirectory")}


def save_session(path: str, input_path: str, output_directory: str) -> None:
    Path(path).write_text(json.dumps({"inputPath": input_path, "outputDirectory": output_directory}), encoding="utf-8")


def accept_input(path: str) -> tuple[str, str] | None:
    """(path, its folder as the output directory) of a trimmed path to a book; None for anything else."""
    trimmed = path.strip()
    return (trimmed, os.path.dirname(trimmed)) if trimmed.lower().endswith(".epub") else None


def canonical_path(path: str, windows: bool = os.name == "nt") -> str:
    """Trimmed, absolute and normal; in lower case on Windows."""
    full = os.path.normpath(os.path.abspath(path.strip()))
    return full.lower() if windows else full


def load_settings(path: str) -> Config:
    file = Path(path)
    return Config.from_json(file.read_text(encoding="utf-8") if file.exists() else None)


def save_settings(config: Config, path: str) -> None:
    Path(path).write_text(config.to_json(), encoding="utf-8")
