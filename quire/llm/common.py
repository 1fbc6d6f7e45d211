"""What the operators of this subpackage share: the shared folder, cut lineage, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by the rule that the word-based operators share (ASCII white space ends a word).
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one; a cluster must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder (or to `path` in it) and read again: cuts the lineage, outlives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")
