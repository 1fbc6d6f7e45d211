"""Greedy packing by tables of room equals a fold, at every size of segment and fan."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quire.operators import packing


def folded(costs, limit):
    out, no, used = [], 0, 0
    for c in costs:
        if no == 0 or used + c > limit:
            no, used = no + 1, 0
        used += c
        out.append(no)
    return out


def test_tables_tell_what_a_fold_does():
    rng = random.Random(3)
    for _ in range(400):
        limit = rng.choice([1, 7, 40])
        costs = np.array([rng.choice([0, 1, rng.randrange(1, 2 * limit + 2), limit]) for _ in range(rng.randrange(1, 30))], np.int64)
        cut = rng.randrange(len(costs) + 1)
        parts = [packing.table_of(c, limit) for c in (costs[:cut], costs[cut:]) if len(c)]
        table = packing.joined(*parts, limit) if len(parts) == 2 else parts[0]
        whole = packing.table_of(costs, limit)
        rooms = np.arange(-1, limit + 1)
        for room, *got in zip(rooms.tolist(), *map(np.ndarray.tolist, table.after(rooms)), *map(np.ndarray.tolist, whole.after(rooms)), strict=True):
            used, begun = (limit - room, 0) if room >= 0 else (limit + 1, 0)
            for c in costs.tolist():
                if used + c > limit:
                    begun, used = begun + 1, 0
                used += c
            assert got == [begun, max(-1, limit - used)] * 2
        assert len(table.below) <= limit + 2
        assert packing.numbers_of(costs, limit, -1, 0).tolist() == folded(costs.tolist(), limit)


@pytest.mark.parametrize(("segment", "fan"), [(1024, 64), (3, 2), (1, 3)])
def test_sequences_over_two_orders(spark, segment, fan):
    rng = random.Random(segment)
    rows = [(b, d, k, rng.choice([0, None, -2, 5, 17, 60, 200])) for b in ("a", "b", None) for d in rng.sample(range(-40, 90), 9) for k in rng.sample(range(50), rng.randrange(1, 12))]
    rows += [("b", None, None, 12), ("b", None, 4, 30), ("c", 1, 7, 9), ("c", 1, 7, 9), ("c", 1, 7, 90)]
    df = spark.createDataFrame(rows, "book string, doc int, k long, cost int").repartition(5)
    sequences = defaultdict(list)
    for b, d, k, c in rows:
        sequences[b].append((-100 if d is None else d, -100 if k is None else k, max(0, c or 0), d, k))
    want = []
    for b, listed in sequences.items():
        listed.sort(key=lambda r: r[:3])
        want += [(b, d, k, c, no) for (_, _, c, d, k), no in zip(listed, folded([r[2] for r in listed], 100), strict=True)]
    got = [tuple(r) for r in packing.pack_sequence(df.withColumn("_by", df.k), ["book"], ["doc", "k"], "cost", 100, segment, fan).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_long_chapter_is_packed_by_many_tasks(spark):
    n, limit = 300_000, 500
    df = spark.range(0, n, 1, 6).selectExpr("id as block_idx", "abs(hash(id)) % 173 as cost")
    out = packing.pack_sequence(df, [], ["block_idx"], "cost", limit, fan=8)
    got = out.orderBy("block_idx").toPandas()
    assert got["batch_no"].tolist() == folded(got["cost"].tolist(), limit)
    sizes = out.groupBy("batch_no").sum("cost").agg({"sum(cost)": "max"}).first()[0]
    assert len(got) == n and sizes <= limit
    assert packing.pack_sequence(df.limit(0), [], ["block_idx"], "cost", limit).count() == 0
