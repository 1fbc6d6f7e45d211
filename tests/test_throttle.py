"""Saves of streamed jobs: after so many blocks, after so much time, and the last one."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quire.sources.stores import read_checkpoint
from quire.streaming import progress

pytest.importorskip("google.protobuf")  # what state with timers needs in Python


def until(what, seconds: float = 60.0):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.2)
    assert what()


def feed(folder, name: str, *rows) -> None:
    """(job, seq, completed, status) of a job of 100 blocks."""
    lines = [json.dumps({"job_id": j, "seq": s, "completed": c, "total": 100, "status": t}) for j, s, c, t in rows]
    (folder / f".{name}").write_text("\n".join(lines))
    (folder / f".{name}").rename(folder / f"{name}.json")


def test_blocks_time_and_last_state(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress.ROCKSDB)
    try:
        saves = progress.throttled_saves(progress.read_events(spark, str(folder), 1), 20, 3.0)
        q = saves.writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    try:
        got = lambda job: [(r.completed, r.reason) for r in spark.table("saves").where(F.col("job_id") == job).orderBy("saved_at", "seq").collect()]
        feed(folder, "1", ("a", 1, 1, None), ("b", 1, 0, None), ("c", None, 5, None))
        until(lambda: got("a") and got("b"))
        feed(folder, "2", ("a", 2, 9, None), ("b", 2, 30, None))  # too little of a, enough of b
        until(lambda: len(got("b")) == 2)
        until(lambda: len(got("a")) == 2)  # by its timer: nothing more has come
        feed(folder, "3", ("b", 1, 99, None), ("a", 3, 10, "cancelled"))  # an old event, and an end
        until(lambda: len(got("a")) == 3)
        assert got("a") == [(1, "first"), (9, "time"), (10, "last")]
        assert got("b") == [(0, "first"), (30, "blocks")] and got("c") == []
        a = spark.table("saves").where("job_id = 'a'").orderBy("seq").collect()
        assert a[1].saved_at - a[0].saved_at >= 3000
    finally:
        q.stop()


def blocks_on_disk(path) -> set:
    """Blocks of what is stored at the moment; a file may be replaced while it is looked at."""
    try:
        return {json.loads(line)["completedBlocks"] for file in path.glob("job_key=*/*.json") for line in file.read_text().splitlines()}
    except OSError:
        return set()


def test_saved_checkpoints_are_read_back(spark, tmp_path):
    folder, path = tmp_path / "events", f"file://{tmp_path}/saved"
    folder.mkdir()
    feed(folder, "1", ("a", 1, 1, None), ("b", 1, 100, None))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    q = progress.save_throttled(progress.read_events(spark, str(folder), 1), path, str(tmp_path / "cp"))
    try:
        until(lambda: 1 in blocks_on_disk(tmp_path / "saved"))
        feed(folder, "2", ("a", 2, 40, None))
        until(lambda: 40 in blocks_on_disk(tmp_path / "saved"))
    finally:
        q.stop()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    rows = {job: read_checkpoint(spark, path, job).first() for job in "ab"}
    assert [(rows[j].completedBlocks, rows[j].totalBlocks) for j in "ab"] == [(40, 100), (100, 100)]
