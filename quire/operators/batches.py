"""Batches of blocks under a cost budget, their context, and run estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import Limits, block_budget, token_estimate
from quire.functions.text import ellipsis, utf16_len


def pack(costs: Column, limit: int) -> Column:
    """Batch number (from 1) of each cost in order: a new batch starts where the next cost would go over the limit.

    An array expression, so packing stays in the JVM and in one row; a cost over the limit is a batch by itself.
    The fold keeps where batches start, and the numbers follow from that.
    """
    limit = max(1, limit)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("starts"))

    def step(state: Column, cost: Column) -> Column:
        fresh = (state["at"] == 0) | (state["used"] + cost > limit)
        return F.struct((state["at"] + 1).alias("at"), F.when(fresh, cost).otherwise(state["used"] + cost).cast("long").alias("used"), F.when(fresh, F.array_append(state["starts"], state["at"])).otherwise(state["starts"]).alias("starts"))

    edges = F.aggregate(costs, zero, step, lambda s: F.array_append(s["starts"], s["at"]))
    sizes = F.zip_with(F.slice(edges, 2, F.size(edges)), edges, lambda stop, start: stop - start)  # one more than batches, the last null
    full = F.filter(sizes, lambda n: n.isNotNull())
    return F.flatten(F.transform(full, lambda n, k: F.array_repeat((k + 1).cast("long"), n.cast("int"))))


def count_batches(costs: Column, limit: int) -> Column:
    """Number of batches of pack(), without the list."""
    limit = max(1, limit)
    zero = F.struct(F.lit(0).cast("long").alias("no"), F.lit(0).cast("long").alias("used"))

    def step(state: Column, cost: Column) -> Column:
        fresh = (state["no"] == 0) | (state["used"] + cost > limit)
        return F.struct(F.when(fresh, state["no"] + 1).otherwise(state["no"]).alias("no"), F.when(fresh, cost).otherwise(state["used"] + cost).cast("long").alias("used"))

    return F.aggregate(costs, zero, step, lambda s: s["no"])


def plan_batches(blocks: DataFrame, by: list[str], chunk: int, limits: Limits = Limits()) -> DataFrame:
    """Blocks with batch_no: packed in order within each chapter, which is gathered as small structs."""
    cost = block_budget("source_text", "source_html", limits).cast("long")
    chapter = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block_idx", cost.alias("cost")))).alias("list"))
    numbered = chapter.withColumn("no", pack(F.transform("list", lambda x: x["cost"]), chunk))
    rows = numbered.select(*by, F.explode(F.arrays_zip("list", "no")).alias("x"))
    return rows.select(*by, "x.list.block_idx", F.col("x.list.cost").alias("cost"), F.col("x.no").alias("batch_no"))


def batch_ranges(planned: DataFrame, by: list[str]) -> DataFrame:
    """lo, hi, n_blocks and cost of each batch."""
    return planned.groupBy(*by, "batch_no").agg(F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"), F.count("*").alias("n_blocks"), F.sum("cost").alias("cost"))


def context_band(blocks: DataFrame, batches: DataFrame, by: list[str], limits: Limits = Limits()) -> DataFrame:
    """Neighbours of each batch in the whole chapter: two blocks before lo, one after hi (by default), shortened; blanks are left out.

    An equi-join on the chapter with one candidate index on each side, so no range join is planned.
    """
    wanted = batches.select(*by, "batch_no", "lo", F.explode(F.concat(F.expr(f"transform(sequence(1, {limits.before}), k -> lo - k)") if limits.before else F.array(), F.expr(f"transform(sequence(1, {limits.after}), k -> hi + k)") if limits.after else F.array())).alias("block_idx"))
    snippets = blocks.select(*by, "block_idx", ellipsis("source_text", limits.context_chars).alias("snippet"))
    near = wanted.join(snippets, [*by, "block_idx"]).where("snippet <> ''")
    return near.select(*by, "batch_no", "block_idx", F.when(F.col("block_idx") < F.col("lo"), "before").otherwise("after").alias("side"), "snippet")


def waves(batches: DataFrame, concurrency: int) -> DataFrame:
    """wave (from 0): batches of a chapter run in groups of so many at once."""
    return batches.withColumn("wave", F.floor((F.col("batch_no") - 1) / concurrency).cast("long"))


def run_estimate(blocks: DataFrame, book: list[str], chapter: list[str], chunk: int, limits: Limits = Limits()) -> DataFrame:
    """Chapters, blocks, batches, characters and tokens of the selected chapters of each book."""
    cost = block_budget("source_text", "source_html", limits).cast("long")
    chapters = blocks.groupBy(*book, *chapter).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block_idx", cost.alias("cost")))), lambda x: x["cost"]).alias("costs"), F.sum(utf16_len("source_text")).alias("chars")
    )
    totals = chapters.groupBy(*book).agg(
        F.count("*").alias("selected_chapters"), F.sum(F.size("costs")).cast("long").alias("total_blocks"), F.sum(count_batches(F.col("costs"), chunk)).cast("long").alias("batches"), F.sum("chars").cast("long").alias("source_chars")
    )
    return totals.withColumn("input_tokens", token_estimate("source_chars"))
