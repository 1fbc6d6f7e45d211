"""Medians and first blocks without bringing a book together; keys of jobs over many paths."""

import hashlib
import random

import pytest

from quire.functions import keys
from quire.operators import blocks


@pytest.mark.parametrize("span", [1 << 15, 4])
def test_upper_median_equals_a_sort(spark, monkeypatch, span):
    monkeypatch.setattr(blocks, "MEDIAN_SPAN", span)
    rng = random.Random(5)
    rows = [(b, k, rng.choice(["content", "content", "ancillary"]), rng.randrange(0, most)) for b, n, most in (("a", 60, 3), ("b", 41, 50), ("c", 1, 9), (None, 12, 2), ("d", 30, 1)) for k in range(n)]
    rows += [("e", 7, "content", 4), ("e", 9, "content", 4)]
    df = spark.createDataFrame(rows, "source string, spine_idx long, category string, n_blocks long")
    want = {}
    for book in {r[0] for r in rows}:
        usable = sorted((r[3], r[1]) for r in rows if r[0] == book and r[2] == "content" and r[3] > 0)
        if usable:
            want[book] = usable[len(usable) // 2]
    assert {r.source: (r.n_blocks, r.spine_idx) for r in blocks.upper_median_chapter(df.repartition(3), ["source"]).collect()} == want
    assert blocks.upper_median_chapter(df.limit(0), ["source"]).count() == 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_blocks_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("cast(id % 3 as string) as source", "id as spine_idx", "0 as block_idx", "'one two three four five six seven' as source_text")
    shown = plan(blocks.quality_sample(rows, ["source"]))
    assert shown.index("Final") < shown.index("Exchange hashpartitioning(source") < shown.index("Partial")


def test_job_key_of_many_paths(spark):
    paths = [(b, k, f"{b}/{k}.xhtml") for b in "xyz" for k in range(3000)] + [("x", 5000, None), ("unknown", 1, "p"), ("x", 0, "x/0.xhtml")]
    df = spark.createDataFrame(paths, "book string, spine_idx int, path string").repartition(5)
    heads = spark.createDataFrame([(b, f"{b}|head|") for b in "xyz"] + [("none", "h|")], "book string, head string")
    got = {r.book: r.job_key for r in keys.job_keys(heads, df, "book", "spine_idx", "path").collect()}
    listed = lambda b: "|".join(p for _, p in sorted((k, p) for q, k, p in paths if q == b and p))
    assert got == {b: hashlib.sha256(f"{b}|head|{listed(b)}".encode()).hexdigest() for b in "xyz"}
    assert "collect_list" not in plan(keys.job_keys(heads, df, "book", "spine_idx", "path"))
