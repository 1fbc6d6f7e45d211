"""The cache as a store: one file for each prefix, pruned reads, compaction."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import cache


def entries(spark, low, high, text="v", day="2024-01-01"):
    key = F.sha2(F.col("id").cast("string"), 256).alias("cache_key")
    return spark.range(low, high).select(key, F.concat(F.lit(text), F.col("id").cast("string")).alias("translated_html"), F.lit(day).cast("timestamp").alias("written_at"))


def files(path):
    return sorted(Path(path).rglob("*.parquet"))


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scanned(df, metric):
    """A metric of all scans of a frame that has run."""
    seen, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            seen.append(node.metrics().apply(metric).value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.length())]
    return seen


def test_a_file_for_each_prefix_and_run(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    for run in range(2):
        cache.write_cache(entries(spark, 0, 7200, f"r{run}-", f"2024-01-0{run + 1}").repartition(16), path)
        assert len(files(tmp_path)) == 256 * (run + 1)
    got = cache.read_cache(spark, path).agg(F.count("*"), F.count_if(F.col("translated_html").startswith("r1-"))).first()
    assert tuple(got) == (7200, 7200)
    for file in files(tmp_path)[:5]:
        keys = [r[0] for r in spark.read.parquet(f"file://{file}").select("cache_key").collect()]
        assert keys == sorted(keys)


def test_lookup_reads_the_asked_prefixes_only(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    cache.write_cache(entries(spark, 0, 1_000_000), path)
    asked = entries(spark, 5, 15).select("cache_key").unionByName(spark.sql("select 'ff-not-there' as cache_key union all select null"))
    found = cache.lookup(spark, path, asked)
    assert sorted(r.translated_html for r in found.collect()) == sorted(f"v{k}" for k in range(5, 15))
    prefixes = {r[0][:2] for r in asked.where("cache_key is not null").collect()}
    assert re.search(r"PartitionFilters: \[.*key_prefix#\d+ IN(SET)? ", plan(found)) and "ReadSchema: struct<cache_key:string,translated_html:string,written_at:timestamp>" in plan(found)
    assert scanned(found, "numFiles") == [len(prefixes)] and len(files(tmp_path)) == 256


def test_a_bloom_filter_spares_the_shuffle_of_a_large_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    cache.write_cache(entries(spark, 0, 50_000), path)
    asked = f"file://{tmp_path}/asked"
    entries(spark, 0, 2_000).select("cache_key").write.parquet(asked)
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        found = cache.lookup(spark, path, spark.read.parquet(asked))
        assert found.count() == 2_000
        assert "might_contain" in plan(found)
    finally:
        for k in small:
            spark.conf.unset(k)


def test_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert cache.compact(spark, path) == [] and cache.lookup(spark, path, entries(spark, 0, 3)).count() == 0
    for run in range(4):
        cache.write_cache(entries(spark, run * 500, run * 500 + 1000, f"r{run}-", f"2024-01-0{run + 1}"), path)
    before = {tuple(r) for r in cache.read_cache(spark, path).collect()}
    one = files(tmp_path)[0].parent.name.split("=")[1]
    assert cache.compact(spark, path, 10) == []
    worn = cache.compact(spark, path, 3)
    assert one in worn and len(files(tmp_path)) <= 256 * 3
    assert cache.compact(spark, path, 1) and len(files(tmp_path)) == 256
    assert {tuple(r) for r in cache.read_cache(spark, path).collect()} == before
    assert cache.stored_entries(spark, path).count() == 2_500  # older entries of a key are gone
    assert cache.compact(spark, path, 1) == []


@pytest.mark.parametrize("later,earlier,want", [("a", "b", "a"), (None, "b", None), (" ", "b", " ")])
def test_the_newest_entry_counts(spark, tmp_path, later, earlier, want):
    path = f"file://{tmp_path}/cache"
    rows = [("ab12", later, "2024-01-02"), ("ab12", earlier, "2024-01-01"), ("ab13", "x", "2024-01-01"), ("ab13", "y", "2024-01-01")]
    cache.write_cache(spark.createDataFrame(rows, "cache_key string, translated_html string, day string").withColumn("written_at", F.col("day").cast("timestamp")), path)
    for _ in range(2):
        got = dict(cache.lookup(spark, path, spark.createDataFrame([("ab12",), ("ab13",)], "cache_key string")).collect())
        assert got == {"ab12": want, "ab13": "y"}
        cache.compact(spark, path, 0)
