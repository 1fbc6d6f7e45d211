"""Job records: history, summaries, progress and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.labels import PHASE_LABELS, STATUS_LABELS, display, progress_label
from quire.functions.numbers import blocks_per_minute, duration_label, remaining_ms
from quire.functions.paths import basename
from quire.functions.text import uni_trim

HISTORY, LOG_LINES = 20, 400


def keep_first(rows: DataFrame, key: str, order: list[str], limit: int | None = None) -> DataFrame:
    """The first row of each key by order; the first `limit` of those, as one top-k."""
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rank = 1").drop("_rank")
    return first.orderBy(*order).limit(limit) if limit else first


def merge_history(newer: DataFrame, older: DataFrame, limit: int = HISTORY) -> DataFrame:
    """newer before older, each by ord; the first of each id, at most `limit`."""
    return keep_first(newer.withColumn("source_no", F.lit(0)).unionByName(older.withColumn("source_no", F.lit(1))), "id", ["source_no", "ord"], limit)


def is_exportable() -> Column:
    return (F.col("status") == "completed") & (F.col("phase") == "translation") & F.lower(uni_trim("output_path")).endswith(".epub")


def can_resume() -> Column:
    done = (F.col("cached_blocks") > 0) | (F.col("resumed_blocks") > 0) | (F.col("completed_blocks") > 0)
    return (F.col("phase") == "translation") & F.col("status").isin("failed", "cancelled") & done


def summaries(jobs: DataFrame) -> DataFrame:
    """What a list of jobs shows."""
    state = F.when(F.col("status").isin("queued", "running"), "active").when(can_resume(), "can resume").otherwise(display(F.col("status"), STATUS_LABELS))
    return jobs.select(
        "id", basename("input_path").alias("title"), display(F.col("status"), STATUS_LABELS).alias("status_label"), progress_label().alias("progress_label"),
        F.col("status").isin("queued", "running").alias("is_active"), is_exportable().alias("can_open_output"), F.col("status").isin("failed", "cancelled").alias("can_retry"),
        can_resume().alias("can_resume"), display(F.col("phase"), PHASE_LABELS).alias("phase_label"), state.alias("line"),
        F.concat_ws("\n", progress_label(), F.nullif(F.col("error_message"), F.lit(""))).alias("detail"),
    )


def was_translation(stage: Column) -> Column:
    """Whether a failed job's retry has to translate again."""
    return F.lower(stage).contains("translation") | (F.col("completed_blocks") > 0) | (F.col("cached_blocks") > 0) | (F.col("resumed_blocks") > 0)


def running_progress(events: DataFrame, by: str, order: str, amount: str, total: Column | None = None) -> DataFrame:
    """done so far and its share of the key's total, capped at 1."""
    so_far = F.sum(amount).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    whole = total if total is not None else F.sum(amount).over(Window.partitionBy(by))
    return events.withColumns({"done": so_far, "progress": F.least(F.coalesce(F.try_divide(so_far, whole), F.lit(0.0)), F.lit(1.0))})


def log_tail(lines: DataFrame, order: str, n: int = LOG_LINES) -> DataFrame:
    """The last n lines, as a top-k."""
    return lines.orderBy(F.col(order).desc()).limit(n)


def run_metrics(steps: DataFrame, by: list[str]) -> DataFrame:
    """Sums over steps (elapsed_ms, blocks, cached), speed, time left and label of each run."""
    totals = steps.groupBy(*by).agg(F.sum("elapsed_ms").cast("long").alias("elapsed_ms"), F.sum("blocks").cast("long").alias("blocks"), F.sum("cached").cast("long").alias("cached"), F.count("*").alias("steps"))
    speed = blocks_per_minute(F.col("blocks"), F.col("elapsed_ms"))
    return totals.withColumns({"speed": speed, "left_ms": remaining_ms(F.col("blocks") + F.col("steps"), F.col("blocks"), speed), "took": duration_label(F.col("elapsed_ms"))})


class Unset:
    """Says that copy_with() leaves a column as it is; None sets it to null."""


UNSET = Unset()


def copy_with(jobs: DataFrame, **changes: object) -> DataFrame:
    """Records with some columns set: to a column or value, to null (None), or left as they are (UNSET)."""
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    set_to = {n: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[n]) for n, v in changes.items() if v is not UNSET}
    return jobs.withColumns(set_to) if set_to else jobs


def with_checkpoints(jobs: DataFrame, checkpoints: DataFrame, key: str) -> DataFrame:
    """Jobs and resumed: whether there is a checkpoint of their key."""
    known = checkpoints.select(key).distinct().withColumn("resumed", F.lit(True))
    return jobs.join(known, key, "left").withColumn("resumed", F.coalesce("resumed", F.lit(False)))


def find_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each id of `wanted` the first record with it; ids without a record are left out."""
    return keep_first(jobs.join(wanted.select("id").distinct(), "id", "left_semi"), "id", ["ord"])


def find_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """The first record with this id: the current job before the history."""
    return jobs.where(F.col("id") == job_id).orderBy("ord").limit(1)
