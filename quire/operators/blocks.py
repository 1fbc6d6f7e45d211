"""Blocks of chapters: projections, selections, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import collapse, english_words, shorten, strip_tags, uni_trim, utf16_len

PREVIEW_BLOCKS, EXCERPT_PARTS, MEMORY_CHARS = 12, 8, 2400
#: Places of a book that the last step of a median looks at.
MEDIAN_SPAN = 1 << 15
NO_TEXT = "No readable text found."


def line_blocks(documents: DataFrame, text: str = "text") -> DataFrame:
    """A block for each non-blank line: block_idx (from 0, kept lines only), block_id, source_text and all other columns.

    No shuffle: a document's lines stay in one row until they are kept and numbered.
    """
    kept = F.filter(F.transform(F.split(F.col(text), "\n"), collapse), lambda line: line != "")
    others = [c for c in documents.columns if c != text]
    rows = documents.select(*others, F.posexplode(kept).alias("block_idx", "source_text"))
    return rows.withColumn("block_id", F.concat(F.lit("p-"), (F.col("block_idx") + 1).cast("string")))


def select_chapters(chapters: DataFrame, preset: str) -> DataFrame:
    """Chapters with include set by a preset: recommended, contentOnly, allChapters or none."""
    rules = {"recommended": F.col("recommended"), "contentOnly": F.col("category") == "content", "allChapters": F.col("n_blocks") > 0, "none": F.lit(False)}
    return chapters.withColumn("include", rules[preset])


def toggle_chapter(chapters: DataFrame, path: str, include: bool) -> DataFrame:
    return chapters.withColumn("include", F.when(F.col("chapter_path") == path, F.lit(include)).otherwise(F.col("include")))


def resolve_title(title: Column, heading: Column, stem: Column) -> Column:
    """Title element (trimmed only), else first heading (collapsed), else file stem."""
    return F.coalesce(F.nullif(uni_trim(title), F.lit("")), F.nullif(collapse(heading), F.lit("")), stem)


def ordered_texts(text: str | Column, order: str, first: int | None = None, separator: str = "\n\n") -> Column:
    """Aggregate: texts in order, the first n of them, joined; null texts are left out."""
    text = F.col(text) if isinstance(text, str) else text
    texts = F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col(order).alias("o"), text.alias("t"))))), lambda x: x["t"])
    return F.array_join(F.slice(texts, 1, first) if first else texts, separator)


def preview_bodies(blocks: DataFrame, by: list[str]) -> DataFrame:
    """body: the first twelve block texts of a chapter."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("block_idx"))
    first = blocks.withColumn("rank", rank).where(F.col("rank") <= PREVIEW_BLOCKS)  # limited before the shuffle
    return first.groupBy(*by).agg(F.coalesce(F.nullif(ordered_texts("source_text", "block_idx"), F.lit("")), F.lit(NO_TEXT)).alias("body"))


def excerpts(blocks: DataFrame, by: list[str], html: str = "translated_html") -> DataFrame:
    """excerpt: the first eight non-blank translations without tags."""
    plain = collapse(strip_tags(F.coalesce(F.col(html), F.lit(""))))
    kept = blocks.withColumn("plain", plain).where("plain <> ''")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("block_idx"))
    first = kept.withColumn("rank", rank).where(F.col("rank") <= EXCERPT_PARTS)
    return first.groupBy(*by).agg(ordered_texts("plain", "block_idx").alias("excerpt"))


def line_memory_texts(documents: DataFrame, text: str = "text", limit: int = MEMORY_CHARS) -> DataFrame:
    """memory_texts() of chapters whose blocks are the lines of a text, with all other columns, and without a shuffle."""
    others = [c for c in documents.columns if c != text]
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), collapse), lambda line: line != "")
    # one row at a time: the joined lines are made once and then shortened
    joined = documents.select(*others, F.explode(F.array(F.array_join(lines, " "))).alias("memory_text"))
    return joined.where("memory_text <> ''").withColumn("memory_text", shorten("memory_text", limit))


def memory_texts(blocks: DataFrame, by: list[str], prefer_translated: bool = False, limit: int = MEMORY_CHARS) -> DataFrame:
    """memory_text: a chapter's text on one line, cut to the limit.

    Only the blocks that start within the limit are gathered, and the one that shows that there is more.
    """
    text = F.when(uni_trim(F.coalesce(F.col("translated_html"), F.lit(""))) != "", strip_tags("translated_html")).otherwise(F.col("source_text")) if prefer_translated else F.col("source_text")
    kept = blocks.withColumn("memory", collapse(text)).where("memory <> ''")
    before = F.coalesce(F.sum(utf16_len("memory") + 1).over(Window.partitionBy(*by).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = kept.withColumn("before", before).where(F.col("before") <= limit + 1)
    return near.groupBy(*by).agg(shorten(ordered_texts("memory", "block_idx", separator=" "), limit).alias("memory_text"))


def chapter_totals(blocks: DataFrame, by: list[str]) -> DataFrame:
    """n_blocks, n_translated (also empty translations), n_chars (UTF-16 units)."""
    return blocks.groupBy(*by).agg(F.count("*").alias("n_blocks"), F.count("translated_html").alias("n_translated"), F.sum(utf16_len("source_text")).cast("long").alias("n_chars"))


def preview_rows(chapters: DataFrame, totals: DataFrame, by: list[str], placeholder: dict | None = None) -> DataFrame:
    """Chapters with their block counts; if there are none, one row with the values of `placeholder` (others null, counts 0)."""
    rows = chapters.join(totals, by, "left").withColumns({"block_count": F.coalesce("n_blocks", F.lit(0)), "translated_block_count": F.coalesce("n_translated", F.lit(0))})
    rows = rows.drop("n_blocks", "n_translated", "n_chars")
    if placeholder is None:
        return rows
    values = {"block_count": 0, "translated_block_count": 0} | placeholder
    lone = chapters.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    none = chapters.limit(1).agg((F.count("*") == 0).alias("none"))
    return rows.unionByName(lone.join(none, F.col("none")).drop("none"))


def smallest_chapter(chapters: DataFrame, by: list[str]) -> DataFrame:
    """Content chapter with the fewest blocks of each book; the first of equals."""
    usable = chapters.where("category = 'content' and n_blocks > 0")
    return usable.groupBy(*by).agg(F.min_by(F.struct("spine_idx", "n_blocks"), F.struct("n_blocks", "spine_idx")).alias("c")).select(*by, "c.*")


def upper_median_chapter(chapters: DataFrame, by: list[str]) -> DataFrame:
    """Content chapter at place n / 2 (from 0) by number of blocks, of equals by place in the book.

    Selected by counts: first the number of blocks, then, among chapters with that number, a span of places, then the chapter
    in it. Windows go over counts and over one span, so no book is brought together; counts are combined before they are shuffled.
    """
    usable = chapters.where("category = 'content' and n_blocks > 0").withColumn("span", F.floor(F.col("spine_idx") / MEDIAN_SPAN))
    sizes = usable.groupBy(*by, "n_blocks").agg(F.count("*").alias("n"))
    middle = F.floor(F.sum("n").over(Window.partitionBy(*by)) / 2)  # chapters before the one that is sought
    size = _holding(sizes.withColumn("sought", middle), by, "n_blocks")
    tied = _joined_by(usable, size, [*by, "n_blocks"])
    span = _holding(tied.groupBy(*by, "n_blocks", "span").agg(F.count("*").alias("n"), F.first("sought").alias("sought")), by, "span")
    near = _joined_by(usable, span.drop("n"), [*by, "n_blocks", "span"])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("spine_idx")) - 1
    return near.withColumn("place", place).where("place = sought").select(*by, "spine_idx", "n_blocks")


def _joined_by(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the chosen keys with `sought`; null keys are equal to null."""
    right = chosen.select(*(F.col(c).alias(f"_{c}") for c in on), "sought")
    return rows.join(right, [rows[c].eqNullSafe(right[f"_{c}"]) for c in on]).drop(*(f"_{c}" for c in on))


def _holding(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of counts in order, the one that holds the row after `sought` others; sought becomes what is left of that number within it."""
    before = F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.where("before <= sought and sought < before + n").withColumn("sought", F.col("sought") - F.col("before")).drop("before")


def quality_sample(blocks: DataFrame, by: list[str], k: int = 3, least_words: int = 6) -> DataFrame:
    """The first k blocks of each book with enough English words; each map task sends its first k of a book only (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("spine_idx", "block_idx"))
    return blocks.where(english_words("source_text") >= least_words).withColumn("place", rank).where(F.col("place") <= k)
