"""HTML chapters as DataFrames: blocks, locked structure, rendering. Parsing runs in Arrow batches, chapter by chapter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quire.functions import html_tree as tree
from quire.functions.labels import category
from quire.functions.paths import stem
from quire.operators.blocks import resolve_title

BLOCK = T.StructType([T.StructField(n, T.IntegerType() if n == "block_idx" else T.StringType()) for n in ("block_idx", "block_id", "tag", "source_html", "source_text")])
HEAD = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "heading", "body_text")])


@pandas_udf(T.ArrayType(BLOCK))
def blocks_of(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [] if h is None else tree.blocks_of(h))


def head_of(html: Column, references: tuple[str, ...] | None = None) -> Column:
    @pandas_udf(HEAD)
    def head(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tree.chapter_head(h or "", references) for h in html], columns=["title", "heading", "body_text"])

    return head(html)


@pandas_udf(T.StringType())
def plain_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else tree.plain_text(h))


@pandas_udf(T.BooleanType())
def structure_matches(source: pd.Series, translated: pd.Series) -> pd.Series:
    return pd.Series([tree.structure_matches(s or "", t or "") for s, t in zip(source, translated, strict=True)])


@pandas_udf(T.StringType())
def lock_structure(source: pd.Series, translated: pd.Series) -> pd.Series:
    return pd.Series([tree.lock_structure(s or "", t or "") for s, t in zip(source, translated, strict=True)], dtype=object)


def chapter_blocks(chapters: DataFrame, html: str = "html") -> DataFrame:
    """All other columns and the blocks of each chapter."""
    others = [c for c in chapters.columns if c != html]
    return chapters.select(*others, F.explode(blocks_of(F.col(html))).alias("b")).select(*others, "b.*")


def chapter_heads(chapters: DataFrame, path: str, html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """title, category, recommended, include and body_text of each chapter. references: the names to decode, with their semicolon; None: as HTML does."""
    head = chapters.withColumn("head", head_of(F.col(html), references))
    title = resolve_title(F.col("head.title"), F.col("head.heading"), stem(path))
    kind = category(F.col(path), F.col("title"))
    rows = head.withColumn("title", title).withColumn("body_text", F.col("head.body_text")).withColumn("category", kind)
    return rows.withColumn("recommended", F.col("category") != "ancillary").withColumn("include", F.col("recommended")).drop("head")


def render_chapters(chapters: DataFrame, blocks: DataFrame, on: list[str], bilingual: bool = False) -> DataFrame:
    """on and rendered: chapters (with html) with their blocks' translations written in."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "translated_html"))), lambda b: b["translated_html"])
    joined = chapters.join(blocks.groupBy(*on).agg(ordered.alias("translations")), on, "left").select(*on, "html", "translations")

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["rendered"] = [tree.render_chapter(h, [] if t is None else list(t), bilingual) for h, t in zip(part["html"], part["translations"], strict=True)]
            yield part[[*on, "rendered"]]

    return joined.mapInPandas(render, T.StructType([*joined.select(*on).schema.fields, T.StructField("rendered", T.StringType())]))
