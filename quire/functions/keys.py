"""Content-addressed keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.paths import base_url
from quire.functions.text import uni_trim

#: Fixed value: what changes all keys when their meaning changes.
SCHEMA_VERSION = "v6-glossary-and-path-keys"


def _text(*parts: Column) -> Column:
    """The parts between bars; null counts as empty, as concat_ws would leave it out."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _joined(*parts: Column) -> Column:
    return F.sha2(_text(*parts), 256)


def _settings(url: Column, model: Column, language: Column) -> list[Column]:
    return [base_url(url), uni_trim(model), uni_trim(language)]


def block_key(url: Column, model: Column, language: Column, glossary: Column, residual: Column, chapter_path: Column, html: Column) -> Column:
    """Key of a block's translation; books don't enter it, so they share translations of equal blocks."""
    return _joined(F.lit(SCHEMA_VERSION), *_settings(url, model, language), uni_trim(glossary), residual, chapter_path, html)


def job_head(fingerprint: Column, url: Column, model: Column, language: Column, bilingual: Column, glossary: Column, residual: Column) -> Column:
    """What a job's key hashes before the paths of its chapters."""
    return F.concat(_text(F.lit(SCHEMA_VERSION), fingerprint, *_settings(url, model, language), bilingual, uni_trim(glossary), residual), F.lit("|"))


def job_keys(heads: DataFrame, paths: DataFrame, by: str, order: str, path: str) -> DataFrame:
    """`by` (text) and job_key: the SHA-256 of a job's head (column `head` of heads) and its paths in order, between bars.

    A key's paths are never held together: they are sorted by the shuffle, which spills, and hashed as they come. Null paths
    are left out, of equal orders the smaller path goes first; a job without any path has no key.
    """
    schema = T.StructType([paths.select(by).schema.fields[0], T.StructField("job_key", T.StringType())])
    # the head goes first, with a null path; it is not copied to each path
    rows = heads.select(by, F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("piece"), "head").union(
        paths.select(by, F.col(order).cast("long"), F.col(path).cast("string"), F.lit(None).cast("string"))
    )

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, n = None, None, 0
        for part in parts:
            done = []
            for this, piece, head in zip(part[by], part["piece"], part["head"], strict=True):
                if head is not None:
                    if n:
                        done.append((key, digest.hexdigest()))
                    key, digest, n = this, hashlib.sha256(head.encode()), 0
                elif digest is not None and this == key:
                    if piece is not None:
                        digest.update(("|" if n else "").encode() + piece.encode())
                    n += piece is not None
            yield pd.DataFrame(done, columns=[by, "job_key"])
        if n:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=[by, "job_key"])

    return rows.repartition(by).sortWithinPartitions(by, F.col("head").isNull(), "at", "piece").mapInPandas(hashed, schema)


def input_fingerprint(path: Column, size: Column, modified: Column) -> Column:
    """Of a file by path, size and time (milliseconds), as binaryFile reads them."""
    return _joined(F.lit(SCHEMA_VERSION), path, size, F.unix_millis(modified))


def key_prefix(key: Column) -> Column:
    """Partition of the cache that holds a key."""
    return F.substring(key, 1, 2)


def same_map(a: Column, b: Column) -> Column:
    """Whether two maps have the same keys with the same values, in whatever order."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return entries(a) == entries(b)
