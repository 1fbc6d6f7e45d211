"""The content-addressed cache of results, and overlays of results on their sources."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.keys import key_prefix
from quire.functions.text import uni_trim


STORE = "cache_key string, translated_html string, written_at timestamp, key_prefix string"
#: Files of a prefix beyond which compact() rewrites it, if they are small.
MAX_FILES = 8
#: Bytes; a prefix whose files are larger than this on average stays as it is.
SMALL_FILE = 32 << 20


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """All entries of an append-only cache table, partitioned by key prefix; none where nothing was written yet."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def newest(entries: DataFrame) -> DataFrame:
    """key_prefix, cache_key, translated_html and written_at of the newest entry of each key; of equal times, the greatest text."""
    last = F.max(F.struct("written_at", "translated_html")).alias("e")
    return entries.groupBy("key_prefix", "cache_key").agg(last).select("key_prefix", "cache_key", "e.translated_html", "e.written_at")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key_prefix, cache_key and translated_html of the newest entry of every key."""
    return newest(stored_entries(spark, path)).drop("written_at")


def _sorted_by_prefix(keyed: DataFrame) -> DataFrame:
    """A prefix's rows in one task, in order of their keys; in several where they exceed Spark's advisory partition size."""
    return keyed.hint("rebalance", "key_prefix").sortWithinPartitions("key_prefix", "cache_key")


def write_cache(entries: DataFrame, path: str) -> None:
    """Appends cache_key, translated_html and written_at: one file for each prefix (more only beyond the advisory partition size), sorted by key."""
    keyed = entries.select("cache_key", "translated_html", "written_at", key_prefix(F.col("cache_key")).alias("key_prefix"))
    _sorted_by_prefix(keyed).write.mode("append").partitionBy("key_prefix").parquet(path)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """cache_key and translated_html of the newest entry of each key that `keys` (cache_key) asks for.

    Only the folders of the asked prefixes are read (there are 256 prefixes at most, so the driver may know them), and
    only entries of asked keys go on, so the history of other keys is neither grouped nor shuffled where the asked
    keys are few: Spark sends these to all tasks, or a Bloom filter of them where the cache is large.
    """
    prefix = key_prefix(F.col("cache_key"))
    asked = sorted(r[0] for r in keys.select(prefix.alias("p")).where("p is not null").distinct().collect())
    wanted = keys.select("cache_key").where(prefix.isin(asked))
    there = stored_entries(spark, path).where(F.col("key_prefix").isin(asked))
    return newest(there.join(wanted, "cache_key", "left_semi")).select("cache_key", "translated_html")


def compact(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> list[str]:
    """Rewrites each prefix that has more (small) files than that, with the newest entry of each key, in order of keys; returns these prefixes.

    A prefix is replaced when its new files are complete. It runs between runs: entries that are written to such a prefix meanwhile
    are lost, which costs their work again and nothing else.
    """
    entries = stored_entries(spark, path)
    many = sorted(prefix for prefix, n in Counter(re.findall("key_prefix=([^/]*)/", " ".join(entries.inputFiles()))).items() if n > max_files)
    if not many:
        return []
    files = entries.where(F.col("key_prefix").isin(many)).groupBy("key_prefix", "_metadata.file_path").agg(F.first("_metadata.file_size").alias("size"))
    worn = sorted(r[0] for r in files.groupBy("key_prefix").agg(F.avg("size").alias("size")).where(F.col("size") < SMALL_FILE).select("key_prefix").collect())  # 256 at most
    if worn:
        kept = newest(entries.where(F.col("key_prefix").isin(worn))).select("cache_key", "translated_html", "written_at", "key_prefix")
        _sorted_by_prefix(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key_prefix").parquet(path)
    return worn


def is_pending(html: Column) -> Column:
    """No usable translation: null or blank."""
    return uni_trim(F.coalesce(html, F.lit(""))) == ""


def probe(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks with the cached translation and pending."""
    return blocks.join(cache.select("cache_key", "translated_html"), "cache_key", "left").withColumn("pending", is_pending(F.col("translated_html")))


def pending_blocks(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """Blocks without a usable cache entry."""
    return blocks.join(cache.where(~is_pending(F.col("translated_html"))), "cache_key", "left_anti")


def pending_chapters(probed: DataFrame, book: list[str], order: str) -> DataFrame:
    """has_pending of each chapter, and pending_later: whether a later chapter of the book has any."""
    chapters = probed.groupBy(*book, order).agg(F.bool_or("pending").alias("has_pending"))
    # the last pending chapter of each book answers for all before it, so no book is put in order
    last = chapters.where("has_pending").groupBy(*book).agg(F.max(order).alias("last_pending"))
    return chapters.join(last, book, "left").withColumn("pending_later", F.coalesce(F.col(order) < F.col("last_pending"), F.lit(False))).drop("last_pending")


def overlay(base: DataFrame, changes: DataFrame, on: list[str], column: str, change: str) -> DataFrame:
    """`column` of the base, replaced where the changes have a row; changes without a base row are ignored."""
    return base.join(changes.select(*on, F.col(change).alias("_change")), on, "left").withColumn(column, F.coalesce("_change", column)).drop("_change")


def match_response(request: DataFrame, response: DataFrame, batch: list[str]) -> DataFrame:
    """html for each requested id, and needs_fallback of its batch.

    A batch falls back when the response has another number of blocks, lacks an id, or has blank html; of ids that
    come twice, the last counts.
    """
    counts = response.groupBy(*batch).agg(F.count("*").alias("_got"))
    last = response.groupBy(*batch, "block_id").agg(F.max_by("html", "pos").alias("html"))
    joined = request.join(last, [*batch, "block_id"], "left").withColumn("_blank", is_pending(F.col("html")))
    whole = joined.groupBy(*batch).agg(F.count("*").alias("_asked"), F.bool_or("_blank").alias("_lacks"))
    judged = whole.join(counts, batch, "left").select(*batch, (F.col("_lacks") | (F.coalesce("_got", F.lit(0)) != F.col("_asked"))).alias("needs_fallback"))
    return joined.drop("_blank").join(judged, batch)


def zip_positions(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """The i-th row of the left with the i-th of the right within each key; the longer side is cut."""
    numbered = lambda df: df.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return numbered(left).join(numbered(right).drop(order), [*by, "pos"])
