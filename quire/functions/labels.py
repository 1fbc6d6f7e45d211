"""Categories, labels and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import redact, uni_trim

# Keywords of each category, first match wins; display names.
CATEGORIES = {
    "ancillary": ["cover", "copyright", "credit", "signup", "advert", "ad_", "promo", "z-lib", "1lib"],
    "reference": ["index", "endnote", "notes", "bibliography", "reference"],
    "backMatter": ["ack", "acknowledg", "authorbio", "about the author", "epilogue", "appendix"],
    "frontMatter": ["dedication", "prologue", "foreword", "preface", "title", "contents", "introduction", "fm0", "front"],
}
CATEGORY_LABELS = {"content": "Content", "frontMatter": "Front matter", "backMatter": "Back matter", "reference": "Reference", "ancillary": "Ancillary"}
STATUS_LABELS = {"idle": "Idle", "queued": "Queued", "running": "Running", "inspected": "Inspected", "cancelled": "Cancelled", "failed": "Failed", "completed": "Completed"}
PHASE_LABELS = {"inspection": "Inspection", "translation": "Translation"}


def _first(rules: list[tuple[Column, str]], otherwise: Column | str | None) -> Column:
    (condition, value), *more = rules
    return reduce(lambda c, r: c.when(r[0], r[1]), more, F.when(condition, value)).otherwise(otherwise)


def category(path: Column, title: Column) -> Column:
    """Category of a chapter, by substrings of its path and title."""
    token = F.concat_ws(" ", F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))))
    return _first([(token.rlike("|".join(words)), name) for name, words in CATEGORIES.items()], "content")


def display(x: Column, names: dict[str, str]) -> Column:
    """Display name of an enum value; unknown values stay."""
    return _first([(x == k, v) for k, v in names.items()], x)


def progress_label(job: str = "") -> Column:
    c = lambda name: F.col(f"{job}{name}")
    percent = F.least(F.greatest(F.round(c("progress") * 100), F.lit(0)), F.lit(100)).cast("long")
    return (
        F.when(c("total_blocks") > 0, F.concat(c("completed_blocks").cast("string"), F.lit(" / "), c("total_blocks").cast("string"), F.lit(" blocks")))
        .when(c("total_files") > 0, F.concat(c("completed_files").cast("string"), F.lit(" / "), c("total_files").cast("string"), F.lit(" chapters")))
        .otherwise(F.concat(percent.cast("string"), F.lit("% complete")))
    )


def error_action(message: Column) -> Column:
    """What helps against an error: openSettings, reduceConcurrency, retryInspection, retryTranslation, dismiss; null without a message."""
    m = F.lower(message)
    rules = [
        (m.rlike("api key|401|unauthorized|403|required before translation"), "openSettings"),
        (m.rlike("429|rate limit|too many requests"), "reduceConcurrency"),
        (m.contains("inspect"), "retryInspection"),
        (m.rlike("translation failed|translate|cancelled"), "retryTranslation"),
    ]
    return _first(rules, F.when(uni_trim(message) != "", "dismiss"))


def error_title(action: Column) -> Column:
    titles = {"openSettings": "API configuration issue", "reduceConcurrency": "Rate limited", "retryInspection": "Inspection failed", "retryTranslation": "Translation interrupted", "dismiss": "Run error"}
    return _first([(action == k, v) for k, v in titles.items()], None)


def diagnostic_kind(error: Column, key: str | None = None) -> Column:
    """Class of a failed connection test, by its redacted message."""
    raw = redact(error, key)
    lower, status = F.lower(raw), F.regexp_extract(raw, "HTTP\\s+(\\d{3})", 1).try_cast("int")
    rules = [
        (lower.contains("required before testing the connection"), "settings"),
        (status == 401, "authentication"), (status == 403, "permission"), (status == 404, "address"), (status == 429, "rate limit"), (status >= 500, "server"),
        (lower.contains("handshake"), "tls"),
        (lower.rlike("failed host lookup|nodename nor servname|dns"), "dns"),
        (lower.rlike("timeout|connection timed out"), "timeout"),
        (lower.contains("model") & lower.rlike("not found|does not exist"), "model"),
    ]
    return _first(rules, "other")


def api_host(url: Column) -> Column:
    full = F.when(uni_trim(url).contains("://"), uni_trim(url)).otherwise(F.concat(F.lit("https://"), uni_trim(url)))
    return F.coalesce(F.nullif(F.try_parse_url(full, F.lit("HOST")), F.lit("")), F.lit("the API host"))


def workflow_step(status: Column, phase: Column, exportable: Column, inspected: Column, ready: Column, has_input: Column) -> Column:
    """Step (1 to 4) of the guided workflow."""
    active = status.isin("queued", "running")
    rules = [(exportable, 4), (active & (phase == "translation"), 3), (inspected & ready, 3), (inspected, 2), (has_input & (status == "running"), 2)]
    return _first(rules, F.lit(1))


def glossary_instruction(glossary: Column) -> Column:
    g = uni_trim(F.coalesce(glossary, F.lit("")))
    return F.when(g == "", "").otherwise(F.concat(F.lit(" Locked terminology (always honor these mappings):\n"), g))


def checklist_summary(selected: Column, chapters: Column, blocks: Column) -> Column:
    return F.format_string("%d/%d chapters · %d blocks", selected, chapters, blocks)


def estimate_summary(batches: Column, tokens: Column) -> Column:
    return F.format_string("%d batches · %d tokens", batches, tokens)
