"""Operators on small frames: stores, history, memory, context, streams."""

import json

from pyspark.sql import functions as F

from quire.functions import labels
from quire.functions.keys import same_map
from quire.functions.numbers import Limits, completed_of
from quire.operators import batches, blocks, cache, history, memory
from quire.sources import stores
from quire.streaming import progress


def test_tiny_blocks_share_a_batch(spark):
    html = lambda i: f'<li lang="en"><a id="back{i}" href="#below{i}">({i})</a></li>'
    rows = spark.createDataFrame([("c", i, f"({i})", html(i)) for i in range(4)], "chapter string, block_idx long, source_text string, source_html string")
    planned = batches.plan_batches(rows, ["chapter"], 220).collect()
    assert {(r.batch_no, r.cost) for r in planned} == {(1, 48)}


def test_context_of_a_middle_block(spark):
    texts = ["Rain fell on the quay.", "Two boats came in.", "Nobody was there to see."]
    rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "chapter string, block_idx long, source_text string")
    ranges = spark.createDataFrame([("c", 1, 1, 1)], "chapter string, batch_no long, lo long, hi long")
    got = {(r.side, r.snippet) for r in batches.context_band(rows, ranges, ["chapter"]).collect()}
    assert got == {("before", texts[0]), ("after", texts[2])}


def test_estimate(spark):
    rows = spark.createDataFrame([("b", 1, 0, "x" * 100), ("b", 1, 1, "x" * 100), ("b", 3, 0, "x" * 100)], "book string, ch int, block_idx long, source_text string").withColumn("source_html", F.col("source_text"))
    r = batches.run_estimate(rows, ["book"], ["ch"], 400).first()
    assert (r.selected_chapters, r.total_blocks, r.batches, r.source_chars, r.input_tokens) == (2, 3, 2, 300, 75)


def test_response_completeness(spark):
    request = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a")], "batch_no int, block_id string")
    response = spark.createDataFrame([(1, "a", "x", 0), (1, "b", "y", 1), (2, "a", " ", 0), (3, "a", "x", 0), (3, "a", "z", 1)], "batch_no int, block_id string, html string, pos int")
    got = {(r.batch_no, r.block_id, r.html, r.needs_fallback) for r in cache.match_response(request, response, ["batch_no"]).collect()}
    assert got == {(1, "a", "x", False), (1, "b", "y", False), (2, "a", " ", True), (3, "a", "z", True)}


def test_cache_upserts(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    for value, day in (("old", "2024-01-01"), ("new", "2024-01-02")):
        cache.write_cache(spark.sql(f"select 'ab12' as cache_key, '{value}' as translated_html, timestamp '{day} 00:00:00' as written_at"), path)
    assert [tuple(r) for r in cache.read_cache(spark, path).collect()] == [("ab", "ab12", "new")]


def test_history_limits_and_order(spark):
    newer = spark.createDataFrame([("a", 0, "n")], "id string, ord int, status string")
    older = spark.createDataFrame([(i, k, "o") for k, i in enumerate(["a", "b", *[f"j{n}" for n in range(40)]])], "id string, ord int, status string")
    rows = history.merge_history(newer, older).collect()
    assert len(rows) == 20 and rows[0][:3] == ("a", 0, "n") and rows[1].id == "b"


def test_stores_round_trip(spark, tmp_path):
    records = [{"id": "1", "status": "completed", "progress": 2, "completedBlocks": "2", "totalBlocks": 10.0}, {"status": "x"}, "no", {"id": "2", "completedBlocks": "10.0", "currentChapter": "c"}]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "{broken")], "ord int, json string")
    jobs = stores.decode_jobs(rows).orderBy("ord").collect()
    assert [(j.id, j.status, j.phase, j.progress, j.completedBlocks, j.currentChapter) for j in jobs] == [("1", "completed", "translation", 1.0, 2, None), ("2", "idle", "inspection", 0.0, 0, "c")]
    path = f"file://{tmp_path}/history"
    stores.write_history(stores.decode_jobs(rows), path)
    assert [r.id for r in stores.read_history(spark, path).collect()] == ["1", "2"]
    states = stores.decode_checkpoints(spark.createDataFrame([('{"jobKey": "k1", "completedBlocks": "10.0"}',), ('{"jobKey": "k2"}',)], "json string"))
    stores.write_checkpoints(states, f"file://{tmp_path}/jobs")
    got = stores.read_checkpoint(spark, f"file://{tmp_path}/jobs", "k1").collect()
    assert [(r.jobKey, r.status, r.completedBlocks) for r in got] == [("k1", "running", 10)]
    assert stores.read_checkpoint(spark, f"file://{tmp_path}/jobs", "k3").count() == 0


def test_settings_hold_no_secret(tmp_path):
    from quire.config import Config

    path = str(tmp_path / "settings.json")
    assert stores.load_settings(path) == Config()
    stores.save_settings(Config(api_key="sk-secret", model="m"), path)
    assert "sk-secret" not in open(path).read() and stores.load_settings(path).model == "m"


def test_glossary_keeps_first_place_and_last_value(spark):
    rows = spark.createDataFrame([("b", 1, "Alice", "x"), ("b", 2, "Bob", "y"), ("b", 3, "ALICE", "z")], "book string, seq int, source string, target string")
    got = [(r.rank, r.source, r.target) for r in memory.merge_glossary(rows, ["book"], "seq").orderBy("rank").collect()]
    assert got == [(1, "ALICE", "z"), (2, "Bob", "y")]


def test_stream_memory_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("b", k, f"s{k}", [("T" if k % 2 else "t", str(k))]) for k in range(5)], "book string, chapter_no long, summary string, glossary array<struct<source: string, target: string>>")
    expected = sorted((r.chapter_no, r.recent, [tuple(e) for e in r.glossary]) for r in memory.rolling_memory(rows).collect())
    source = str(tmp_path / "in")
    for k in range(5):
        rows.where(F.col("chapter_no") == k).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(source)
    q = progress.rolling_memory_stream(stream).writeStream.format("memory").queryName("rolled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.chapter_no, r.recent, [tuple(e) for e in r.glossary]) for r in spark.table("rolled").collect()) == expected


def test_progress_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    lines = [{"job_id": "j", "seq": k, "ts": f"2024-01-01T00:00:0{k}", "log_line": "api_key=x1", "completed": k, "total": 4} for k in range(3)]
    (source / "a.json").write_text("\n".join(map(json.dumps, lines)))
    events = progress.read_events(spark, str(source))
    q = progress.job_progress(events).writeStream.format("memory").queryName("progressed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.job_id, r.completed, r.progress) for r in spark.table("progressed").collect()] == [("j", 2, 0.5)]
    s = progress.save_checkpoints(events, str(tmp_path / "saved"), str(tmp_path / "cp2"), "0 seconds")
    s.processAllAvailable()
    s.stop()
    assert [(r.job_id, r.completed) for r in spark.read.parquet(str(tmp_path / "saved")).collect()] == [("j", 2)]


def test_chapters_can_be_toggled_and_previewed(spark):
    chapters = spark.createDataFrame([("b", "x", True), ("b", "y", False)], "book string, chapter_path string, include boolean")
    assert {r.chapter_path: r.include for r in blocks.toggle_chapter(chapters, "y", True).collect()} == {"x": True, "y": True}
    totals = spark.createDataFrame([("b", "x", 2, 1)], "book string, chapter_path string, n_blocks long, n_translated long")
    lone = {"chapter_path": "No chapter"}
    rows = blocks.preview_rows(chapters, totals, ["book", "chapter_path"], lone).collect()
    assert {r.chapter_path: (r.block_count, r.translated_block_count) for r in rows} == {"x": (2, 1), "y": (0, 0)}
    assert [tuple(r) for r in blocks.preview_rows(chapters.limit(0), totals, ["book", "chapter_path"], lone).collect()] == [(None, "No chapter", None, 0, 0)]
    assert blocks.preview_rows(chapters.limit(0), totals, ["book", "chapter_path"]).count() == 0


def test_memory_of_lines_is_that_of_their_blocks(spark):
    texts = ["one  two\n\n three\u0085\nfour", "\n \n", "😀 " * 2000, None, "x" * 2401, "a\n" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_line = {r.doc_id: r.memory_text for r in blocks.line_memory_texts(docs).collect()}
    by_block = {r.doc_id: r.memory_text for r in blocks.memory_texts(blocks.line_blocks(docs), ["doc_id"]).collect()}
    assert by_line == by_block and set(by_line) == {0, 2, 4, 5} and all(len(t.encode("utf-16-le")) <= 4800 for t in by_line.values())


def test_records_are_found_and_changed(spark):
    jobs = spark.createDataFrame([("a", 2, "running", "x"), ("a", 1, "failed", None), ("b", 3, "idle", "y")], "id string, ord long, status string, note string")
    found = history.find_jobs(spark.createDataFrame([("a",), ("c",)], "id string"), jobs)
    assert [(r.id, r.ord) for r in found.collect()] == [("a", 1)] and history.find_job(jobs, "a").first().ord == 1
    changed = history.copy_with(jobs, status=None, note=history.UNSET, ord=F.col("ord") + 1).orderBy("ord").collect()
    assert [tuple(r) for r in changed] == [("a", 2, None, None), ("a", 3, None, "x"), ("b", 4, None, "y")]
    assert history.copy_with(jobs).collect() == jobs.collect()
    marked = history.with_checkpoints(jobs, spark.createDataFrame([(1,), (1,)], "ord long"), "ord").collect()
    assert sorted((r.ord, r.resumed) for r in marked) == [(1, True), (2, False), (3, False)]


def test_planner_limits_and_small_labels(spark):
    rows = spark.createDataFrame([("c", k, f"[{k}]", f"<p>[{k}]</p>") for k in range(6)], "c string, block_idx long, source_text string, source_html string")
    batches_of = lambda limits: [r.batch_no for r in batches.plan_batches(rows, ["c"], 100, limits).orderBy("block_idx").collect()]
    assert batches_of(Limits()) == [1, 1, 2, 2, 3, 3] and batches_of(Limits(tiny_budget=30)) == [1, 1, 1, 2, 2, 2] and batches_of(Limits(tiny_text=0)) == [1, 2, 3, 4, 5, 6]
    ranges = batches.batch_ranges(batches.plan_batches(rows, ["c"], 100), ["c"])
    near = batches.context_band(rows, ranges, ["c"], Limits(before=1, after=0)).collect()
    assert sorted((r.batch_no, r.block_idx, r.side) for r in near) == [(2, 1, "before"), (3, 3, "before")]
    r = spark.range(1).select(
        labels.glossary_instruction(F.lit(" A => B ")), labels.glossary_instruction(F.lit(" ")), labels.error_title(F.lit("dismiss")), labels.estimate_summary(F.lit(2), F.lit(30)),
        completed_of(F.lit(7), F.lit(5), F.lit(9)), completed_of(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(9)), completed_of(F.lit(12), F.lit(None).cast("long"), F.lit(9)), same_map(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))),
    ).first()
    assert tuple(r) == (" Locked terminology (always honor these mappings):\nA => B", "", "Run error", "2 batches · 30 tokens", 5, 0, 9, False)


def test_pending_later_chapters(spark):
    rows = spark.createDataFrame([("b", 1, True), ("b", 2, False), ("b", 3, True), ("b", 4, False), ("c", 1, False)], "book string, k long, pending boolean")
    got = {(r.book, r.k): (r.has_pending, r.pending_later) for r in cache.pending_chapters(rows, ["book"], "k").collect()}
    assert got == {("b", 1): (True, True), ("b", 2): (False, True), ("b", 3): (True, False), ("b", 4): (False, False), ("c", 1): (False, False)}
