"""Book memory: glossaries, recent chapters and their ordered fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GLOSSARY, RECENT, FRONT, CONTENT = 32, 2, 2, 2


def merge_glossary(entries: DataFrame, by: list[str], order: str, limit: int = GLOSSARY) -> DataFrame:
    """Entries of each book by lower-case source: the last target counts, at the place of the first; the first 32."""
    merged = entries.groupBy(*by, F.lower("source").alias("term")).agg(F.max_by(F.struct("source", "target"), order).alias("e"), F.min(order).alias("place"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= limit).select(*by, "rank", "e.source", "e.target")


def memory_sources(chapters: DataFrame, by: list[str]) -> DataFrame:
    """Chapters from which a book's first memory is made: two of the front, then two of the content; without any, the first four.

    Of chapters with one path, the first counts. Chapters without text are dropped after they were chosen.
    """
    limits = F.when(F.col("category") == "frontMatter", FRONT).when(F.col("category") == "content", CONTENT).otherwise(0)
    included = chapters.where("include")
    window = Window.partitionBy(*by)
    ranked = included.withColumns({
        "by_kind": F.row_number().over(Window.partitionBy(*by, "category").orderBy("spine_idx")),
        "overall": F.row_number().over(window.orderBy("spine_idx")),
    })
    marked = ranked.withColumn("chosen", F.col("by_kind") <= limits).withColumn("any_chosen", F.bool_or("chosen").over(window))
    taken = marked.where(F.col("chosen") | (~F.col("any_chosen") & (F.col("overall") <= FRONT + CONTENT)))
    kind = F.when(F.col("any_chosen") & (F.col("category") == "content"), 1).otherwise(0)
    once = taken.withColumn("kind", kind).withColumn("first", F.row_number().over(Window.partitionBy(*by, "chapter_path").orderBy("kind", "spine_idx"))).where("first = 1")
    return once.withColumn("place", F.row_number().over(window.orderBy("kind", "spine_idx"))).where("memory_text <> ''").select(*by, "place", "chapter_path", "category", "memory_text")


def recent_chapters(chapters: DataFrame, by: list[str], order: str, value: str, n: int = RECENT) -> DataFrame:
    """recent: the last n values up to each row."""
    return chapters.withColumn("recent", F.collect_list(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - n, 0)))


def fold(state: dict, chapter: dict) -> dict:
    """The memory after one more chapter; state: recent and glossary (term to entry, in order of first places)."""
    glossary = dict(state["glossary"])
    for e in chapter["glossary"]:
        glossary[e["source"].lower()] = e  # a known key keeps its place
    return {"recent": [*state["recent"], chapter["summary"]][-RECENT:], "glossary": dict(list(glossary.items())[:GLOSSARY])}


def fold_book(memory: dict, chapter: dict) -> dict:
    """A book's memory (see codecs.read_memory) after one more chapter (title, summary and glossary)."""
    terms = {e["source"].lower(): e for e in memory["glossary"]}
    after = fold({"recent": memory["recentChapters"], "glossary": terms}, {"summary": chapter, "glossary": chapter["glossary"]})
    return memory | {"glossary": list(after["glossary"].values()), "recentChapters": after["recent"]}


def rolling_memory(chapters: DataFrame) -> DataFrame:
    """recent and glossary after each chapter (book, chapter_no, summary, glossary), as fold() gives them one by one.

    A term is kept if it is among a book's first 32 by first place, and its entry is the last one so far. So the fold is
    a window over each term of each book, and no book is gathered; a chapter gets at most 32 rows.
    """
    recent = recent_chapters(chapters, ["book"], "chapter_no", "summary").select("book", "chapter_no", "recent")
    entries = chapters.select("book", "chapter_no", F.posexplode("glossary").alias("pos", "e")).withColumn("term", F.lower("e.source"))
    first = entries.groupBy("book", "term").agg(F.min(F.struct("chapter_no", "pos")).alias("place"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy("place"))
    terms = first.withColumn("rank", rank).where(F.col("rank") <= GLOSSARY)
    said = entries.groupBy("book", "term", "chapter_no").agg(F.max_by("e", "pos").alias("e"))
    known = chapters.select("book", "chapter_no").join(terms, "book").where("chapter_no >= place.chapter_no").join(said, ["book", "term", "chapter_no"], "left")
    so_far = Window.partitionBy("book", "term").orderBy("chapter_no").rowsBetween(Window.unboundedPreceding, 0)
    latest = known.withColumn("e", F.last("e", ignorenulls=True).over(so_far))
    lists = latest.groupBy("book", "chapter_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "e"))), lambda x: x["e"]).alias("glossary"))
    none = F.expr("cast(array() as array<struct<source: string, target: string>>)")
    return recent.join(lists, ["book", "chapter_no"], "left").withColumn("glossary", F.coalesce("glossary", none))
