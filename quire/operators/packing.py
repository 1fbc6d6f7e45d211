"""Greedy packing of sequences of any length: a book of 10^7 blocks is packed by many tasks and gives what one fold gives.

What a run of blocks does to the batch that is open before it depends on one number, the room that is left in that batch.
So each segment of blocks becomes a table, a step function from room to (batches begun, room left at the end): prefix sums
give the place where the first new batch starts, pointer doubling what follows from there. Tables of neighbours compose to
a table of the same kind, level by level, up to one for each sequence; then the rooms go down again, and each segment
numbers its own blocks. A table has an entry for each place where the first batch may start, so no more than one batch
holds; a task holds a segment, or the tables of `fan` neighbours.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Blocks of a segment, and tables that one row holds.
SEGMENT, FAN = 1024, 256
#: Room when no batch is open, or one that is over the limit: not even a block without cost goes in.
CLOSED = -1
TABLE = "below array<long>, batches array<long>, room array<long>, total long"


class Table(NamedTuple):
    """The k-th entry holds for a room under below[k] (and not under below[k - 1]); a room beyond all is left `total` smaller."""

    below: np.ndarray
    batches: np.ndarray
    room: np.ndarray
    total: int

    def after(self, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(batches begun, room left) for each room."""
        if not len(self.below):
            return np.zeros_like(room), room - self.total
        k = np.searchsorted(self.below, room, "right")
        known, k = k < len(self.below), np.minimum(k, len(self.below) - 1)
        return np.where(known, self.batches[k], 0), np.where(known, self.room[k], room - self.total)


def _next_starts(costs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums through each block, where the batch after one that starts there would start)."""
    sums = np.cumsum(costs)
    return sums, np.maximum(np.arange(1, len(costs) + 1), np.searchsorted(sums, sums - costs + limit, "right"))


def table_of(costs: np.ndarray, limit: int) -> Table:
    sums, after = _next_starts(costs, limit)
    n = len(costs)
    last, more = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
    for _ in range(n.bit_length()):
        more, last = more + more[last], last[last]
    below, start = np.unique(sums, return_index=True)
    near = np.concatenate([[CLOSED], below[:-1]]) <= limit
    below, start = below[near], start[near]
    end = last[start]
    room = limit - (sums[-1] - sums[end] + costs[end]) if n else start
    return merged(Table(below, 1 + more[start], np.maximum(CLOSED, room), min(int(sums[-1]) if n else 0, limit + 1)))


def merged(table: Table) -> Table:
    """Neighbouring entries that agree as one."""
    below, batches, room, total = table
    if len(below) < 2:
        return table
    keep = np.append((np.diff(batches) != 0) | (np.diff(room) != 0), True)
    return Table(below[keep], batches[keep], room[keep], total)


def joined(first: Table, second: Table, limit: int) -> Table:
    """The table of two runs one after the other."""
    begun, room = second.after(first.room)
    below, batches = [first.below], [first.batches + begun]
    rooms = [room]
    if first.total <= limit:
        shifted = second.below + first.total
        lower = np.concatenate([[first.total], shifted[:-1]])
        near = (lower <= limit) & (shifted > first.total)
        below.append(shifted[near])
        batches.append(second.batches[near])
        rooms.append(second.room[near])
    return merged(Table(np.concatenate(below), np.concatenate(batches), np.concatenate(rooms), min(first.total + second.total, limit + 1)))


def numbers_of(costs: np.ndarray, limit: int, room: int, before: int) -> np.ndarray:
    """Batch number of each block, `before` batches having begun and the open one having so much room."""
    sums, after = _next_starts(costs, limit)
    starts, at, then = np.zeros(len(costs), np.int64), int(np.searchsorted(sums, room, "right")), after.tolist()
    while at < len(costs):
        starts[at] = 1
        at = then[at]
    return before + np.cumsum(starts)


def _tables(below: list, batches: list, room: list, total: list) -> list[Table]:
    return [Table(*(np.asarray(x, np.int64) for x in (b, c, r)), int(t)) for b, c, r, t in zip(below, batches, room, total, strict=True)]


def _frame(tables: list[Table]) -> pd.DataFrame:
    return pd.DataFrame({name: [getattr(t, name) for t in tables] for name in Table._fields})


def _of_children(*names: str) -> list[Column]:
    return [F.expr(f"transform(children, c -> c.{name})") for name in names]


def pack_sequence(rows: DataFrame, by: list[str], order: list[str], cost: str, limit: int, segment: int = SEGMENT, fan: int = FAN, stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """by, order, cost and batch_no (from 1) of each row: packed in order within each sequence, whatever its length.

    A new batch starts where the next cost would go over the limit; a cost over the limit is a batch by itself. `order` are whole
    numbers, nulls first; rows at one place go by cost (repeated rows all count). Null and negative costs are 0; null keys are
    a sequence like others; other columns are left out. Two small values for each of `order`, its bounds, come to the driver.
    Segments and the tables of each level are used twice, up and down: `stored` may write them and give them back.
    """
    limit = max(1, limit)

    @pandas_udf(TABLE)
    def of_costs(costs: pd.Series) -> pd.DataFrame:
        return _frame([table_of(np.asarray(c, np.int64), limit) for c in costs])

    @pandas_udf(TABLE)
    def of_tables(below: pd.Series, batches: pd.Series, room: pd.Series, total: pd.Series) -> pd.DataFrame:
        out = []
        for lists in zip(below, batches, room, total, strict=True):
            first, *others = _tables(*lists)
            for other in others:
                first = joined(first, other, limit)
            out.append(first)
        return _frame(out)

    @pandas_udf("room array<long>, before array<long>")
    def handed_down(below: pd.Series, batches: pd.Series, rooms: pd.Series, total: pd.Series, room: pd.Series, before: pd.Series) -> pd.DataFrame:
        out = []
        for *lists, here, begun in zip(below, batches, rooms, total, room, before, strict=True):
            states = [(here, begun)]
            for table in _tables(*lists):
                more, left = table.after(np.array([states[-1][0]]))
                states.append((int(left[0]), states[-1][1] + int(more[0])))
            out.append(tuple(zip(*states[:-1], strict=True)))
        return pd.DataFrame(out, columns=["room", "before"])

    @pandas_udf("array<long>")
    def numbered(costs: pd.Series, room: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([numbers_of(np.asarray(c, np.int64), limit, r, b) for c, r, b in zip(costs, room, before, strict=True)], dtype=object)

    bounds = rows.agg(*(f(c).cast("long").alias(f"{f.__name__}_{k}") for k, c in enumerate(order) for f in (F.min, F.max))).first()
    places = [F.coalesce(F.col(c).cast("long") - F.lit((bounds[2 * k] or 0) - 1), F.lit(0)) for k, c in enumerate(order)]
    spans = [(bounds[2 * k + 1] or 0) - (bounds[2 * k] or 0) + 1 for k in range(len(order))]
    spans[-1] //= segment
    keys = [f"_{k}" for k in range(len(order))]
    item = F.struct(places[-1].alias("_place"), F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(0)), F.lit(0)).alias("_cost"), *order)
    placed = rows.select(F.struct(F.lit(0).alias("_"), *by).alias("_by"), *(p.alias(k) for p, k in zip(places, keys, strict=True)), item.alias("item"))
    # a given number of partitions: small ones are not put together, as their rows cost more time than bytes
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn(keys[-1], F.expr(f"{keys[-1]} div {segment}")).repartition(n, "_by", *keys)
    leaves = stored(placed.groupBy("_by", *keys).agg(F.array_sort(F.collect_list("item")).alias("items")))
    costs = F.transform("items", lambda x: x["_cost"])

    tables = leaves.select("_by", *keys, of_costs(costs).alias("t"))
    levels: list[tuple[list[str], DataFrame | None]] = []
    for depth in range(len(keys), 0, -1):
        inner, name = keys[: depth - 1], keys[depth - 1]
        while spans[depth - 1]:
            groups = tables.groupBy("_by", *inner, F.expr(f"{name} div {fan}").alias("_up")).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), "t.*"))).alias("children"))
            groups = stored(groups.withColumnRenamed("_up", name))
            levels.append(([*inner, name], groups))
            tables = groups.select("_by", *inner, name, of_tables(*_of_children("below", "batches", "room", "total")).alias("t"))
            spans[depth - 1] //= fan
        levels.append(([*inner, name], None))  # one value is left for all
        tables = tables.drop(name)

    states = tables.select("_by", F.lit(CLOSED).cast("long").alias("room"), F.lit(0).cast("long").alias("before"))
    for at, groups in reversed(levels):
        if groups is None:
            states = states.withColumn(at[-1], F.lit(0).cast("long"))
            continue
        down = groups.join(states, ["_by", *at]).withColumn("s", handed_down(*_of_children("below", "batches", "room", "total"), F.col("room"), F.col("before")))
        lists = down.select("_by", *at[:-1], F.explode(F.arrays_zip(F.transform("children", lambda c: c["key"]).alias("key"), F.col("s.room").alias("room"), F.col("s.before").alias("before"))).alias("x"))
        states = lists.select("_by", *at[:-1], F.col("x.key").alias(at[-1]), "x.room", "x.before")
    done = leaves.join(states, ["_by", *keys]).withColumn("no", numbered(costs, F.col("room"), F.col("before")))
    rows_out = done.select("_by", F.explode(F.arrays_zip("items", "no")).alias("x"))
    return rows_out.select(*(F.col(f"_by.{c}") for c in by), *(F.col(f"x.items.{c}") for c in order), F.col("x.items._cost").alias(cost), F.col("x.no").alias("batch_no"))
