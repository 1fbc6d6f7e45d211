"""Budgets, bounded and lenient numbers, retry delays, labels of durations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import uni_trim, utf16_len

class Limits(NamedTuple):
    """Thresholds of the batch planner."""

    tiny_text: int = 80
    tiny_html: int = 360
    tiny_budget: int = 48
    tiny_extra: int = 24
    block_extra: int = 96
    before: int = 2  # neighbours of a batch
    after: int = 1
    context_chars: int = 240


def is_tiny(text: Column | str, html: Column | str, limits: Limits = Limits()) -> Column:
    return (utf16_len(text) <= limits.tiny_text) & (utf16_len(html) <= limits.tiny_html)


def block_budget(text: Column | str, html: Column | str, limits: Limits = Limits()) -> Column:
    """Characters that a block costs in a batch."""
    t, h = utf16_len(text), utf16_len(html)
    return F.when(is_tiny(text, html, limits), F.greatest(F.lit(limits.tiny_budget), t + limits.tiny_extra)).otherwise(F.greatest(h, t) + limits.block_extra)


def token_estimate(chars: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col(chars) if isinstance(chars, str) else chars) / 4)).cast("long")


def job_int(x: Column) -> Column:
    """A count of a job record: a whole number in text, else 0; never negative."""
    t = uni_trim(x)
    return F.greatest(F.coalesce(F.when(t.rlike("^[+-]?\\d+$"), t.try_cast("long")), F.lit(0)), F.lit(0)).cast("long")


def checkpoint_int(x: Column) -> Column:
    """A count of a checkpoint: any number in text, cut to whole, else 0; never negative."""
    t = uni_trim(x)
    return F.greatest(F.coalesce(F.when(t.rlike("^[+-]?\\d+$"), t.try_cast("long")), t.try_cast("double").try_cast("long"), F.lit(0)), F.lit(0)).cast("long")


def bounded_int(x: Column, low: int, high: int, otherwise: int) -> Column:
    """A setting: a number in text, rounded half away from zero, held within bounds; else the default."""
    t = uni_trim(x)
    read = F.coalesce(F.when(t.rlike("^[+-]?\\d+$"), t.try_cast("long")), F.round(t.try_cast("double")).try_cast("long"), F.lit(otherwise))
    return F.least(F.greatest(read, F.lit(low)), F.lit(high)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def progress(x: Column) -> Column:
    """Share of a run within 0 and 1; not finite: 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, clamp(x, 0.0, 1.0)).otherwise(0.0)


def max_attempts(status: Column, retries: Column) -> Column:
    normal = F.greatest(F.lit(1), retries)
    return F.when(status == 429, F.greatest(normal, F.lit(8))).otherwise(normal)


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After value asks for: whole seconds, or an ISO time from now on; else null."""
    t = uni_trim(value)
    at = F.when(t.rlike("^[+-]?\\d{4}-?\\d{2}-?\\d{2}"), F.try_to_timestamp(t))
    return F.coalesce(F.when(t.rlike("^[+-]?\\d+$"), t.try_cast("long")), F.when(at.isNotNull(), F.greatest(F.unix_timestamp(at) - F.unix_timestamp(now), F.lit(0))))


def retry_delay(status: Column, asked: Column, delay: Column, attempt: Column) -> Column:
    """Seconds before the next attempt."""
    grown = F.least(F.lit(90), F.greatest(F.lit(5), delay) * F.pow(F.lit(2), F.least(attempt - 1, F.lit(4))))
    limited = F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(0)), F.lit(120))).otherwise(grown)
    return F.when(status == 429, limited).otherwise(F.greatest(F.lit(1), delay)).cast("long")


def blocks_per_minute(blocks: Column, elapsed_ms: Column) -> Column:
    """Null where nothing is done or no time has passed."""
    return F.when((blocks > 0) & (elapsed_ms > 0), blocks / (elapsed_ms / 60000))


def completed_of(completed: Column, job_total: Column, total: Column) -> Column:
    """Blocks that count as done: at most the job's total, or the run's where the job has none."""
    return F.least(F.coalesce(completed, F.lit(0)), F.coalesce(job_total, total))


def remaining_ms(total: Column, completed: Column, speed: Column) -> Column:
    return F.round(F.try_divide(F.greatest(total - completed, F.lit(0)), speed) * 60000).cast("long")


def to_fixed(x: Column, digits: int) -> Column:
    """A number that isn't negative with so many decimals, rounded half up by its exact binary value.

    format_string() rounds the shortest decimal form instead: 31.365 is a little less than it reads and has to give 31.36.
    """
    scale = 10**digits
    x = x.cast("double")
    below = F.floor(x * scale)
    # x = near + rest; each term is exact, and so is their sum wherever it is close to a tie
    near = x.cast("float").cast("double")
    past_half = (near * (2 * scale) - (2 * below + 1)) + (x - near) * (2 * scale)
    n = below + (past_half >= 0).cast("long")
    return F.concat(F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def speed_label(speed: Column) -> Column:
    return F.coalesce(F.concat(to_fixed(speed, 1), F.lit(" blocks/min")), F.lit("Not enough data"))


def remaining_label(ms: Column) -> Column:
    seconds, minutes = F.floor(ms / 1000), F.floor(ms / 60000)
    rest = seconds - 60 * minutes
    return (
        F.when(ms.isNull(), "Calculating").when(seconds <= 0, "Less than 1 min").when(minutes <= 0, F.concat(F.greatest(F.lit(1), rest).cast("string"), F.lit(" sec")))
        .otherwise(F.concat(minutes.cast("string"), F.lit(" min"), F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), rest.cast("string"), F.lit(" sec")))))
    )


def duration_label(ms: Column) -> Column:
    minutes = F.floor(ms / 60000)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, F.concat(to_fixed(ms / 1000, 2), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), (F.floor(ms / 1000) - 60 * minutes).cast("string"), F.lit("s")))
    )
