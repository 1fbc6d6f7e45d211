"""The flow over books: context, memory, checks, checkpoints, cancellation, retries."""

import json
import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from quire.config import Config
from quire.functions.codecs import read_chapter_memory, read_memory, write_memory
from quire.functions.text import keeps_source, suspicious_residual
from quire.operators.cache import read_cache
from quire.operators.memory import fold_book
from quire.operators.translate import Run, counting_memory, listing_memory, marking_translator, translate_batches
from quire.plans import engine as engine_module
from quire.plans.engine import Engine
from quire.sources import stores
from test_books import make_book, page

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
CONFIG = Config(api_base_url="api.example.com", api_key="k", model="m", chunk_size=1000)


def telling_translator(blocks, context):
    """Writes what it was told into each block."""
    told = json.dumps({k: context.get(k) for k in ("title", "before", "after", "memory", "locked_glossary")}, sort_keys=True, ensure_ascii=True).replace("<", "").replace(">", "").replace("&", "")
    return [{"id": b["id"], "html": f"<p>{told}</p>"} for b in blocks]


def lazy_translator(blocks, context):
    return blocks


def slow_translator(blocks, context):
    time.sleep(1.0)
    return marking_translator(blocks, context)


def failing_after(log, n):
    def translator(blocks, context):
        with open(log, "a") as f:
            f.write("x\n")
        if len(open(log).read().split()) > n:
            raise RuntimeError("no more")
        return marking_translator(blocks, context)

    return translator


def counting_requests(log):
    def translator(blocks, context):
        with open(log, "a") as f:
            f.write("".join(f"{b['id']}\n" for b in blocks))
        return marking_translator(blocks, context)

    return translator


def flying(log):
    def translator(blocks, context):
        began = time.time()
        time.sleep(0.05)
        with open(log, "a") as f:
            f.write(f"{began} 1\n{time.time()} -1\n")
        return marking_translator(blocks, context)

    return translator


def told_by(engine, config, book, tmp_path):
    """What each block was told, by chapter and place."""
    found = engine.inspect(book)
    engine.translate(found, config, str(tmp_path / "out")).collect()
    keyed = engine._keyed(found.blocks, config).join(read_cache(engine.spark, engine.cache_path), "cache_key")
    return {(r.spine_idx, r.block_idx): json.loads(r.translated_html[3:-4]) for r in keyed.collect()}


def test_context_and_memory(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(150))
    pages = {f"chapter{k}.xhtml": page("".join(f"<p>c{k} b{b} {long}</p>" for b in range(4)), f"Title {k}") for k in range(3)}
    book = make_book(tmp_path / "a.epub", pages)
    config = CONFIG.with_value("locked_glossary", "Ann => A").with_value("residual_quality_check", False)
    plain = told_by(Engine(spark, f"file://{tmp_path}/c1", telling_translator), config, book, tmp_path)
    assert plain[1, 1]["title"] == "Title 1" and plain[1, 1]["memory"] is None and plain[1, 1]["locked_glossary"] == "Ann = A"
    assert [len(plain[1, b]["before"] or []) for b in range(4)] == [0, 1, 2, 2] and [len(plain[1, b]["after"] or []) for b in range(4)] == [1, 1, 1, 0]
    assert all(len(n) == 240 for n in plain[1, 2]["before"])
    engine = Engine(spark, f"file://{tmp_path}/c2", telling_translator, listing_memory, counting_memory)
    told = told_by(engine, config, book, tmp_path)
    first, last = told[0, 0]["memory"], told[2, 0]["memory"]
    assert first["bookSummary"] == "OPS/chapter0.xhtml, OPS/chapter1.xhtml" and first["recentChapters"] == [] and told[0, 3]["memory"] == first
    assert [c["title"] for c in last["recentChapters"]] == ["OPS/chapter0.xhtml", "OPS/chapter1.xhtml"] and len(last["glossary"]) == 1


def test_text_that_was_left_is_refused(spark, tmp_path):
    english = "<p>This is a whole sentence that nobody has translated at all today.</p>"
    book = make_book(tmp_path / "a.epub", {"c.xhtml": page(english)})
    config = CONFIG.with_value("max_retries", 1)
    engine = Engine(spark, f"file://{tmp_path}/cache", lazy_translator)
    with pytest.raises(Exception, match="source text is left"):
        engine.translate(engine.inspect(book), config, str(tmp_path / "out"))
    key = engine.job_keys(engine.inspect(book), config).first()["job_key"]
    assert stores.read_checkpoint(spark, engine.checkpoint_path, key).first()["status"] == "failed"
    without = config.with_value("residual_quality_check", False)
    assert engine.translate(engine.inspect(book), without, str(tmp_path / "out")).first()["committed"]
    pairs = [(english, english), (english, "汉字 only here"), ("one two", english), (english, "汉" * 9 + " This is a whole sentence that nobody has seen."), (english, "HTTP API EPUB one two 汉 three four five 汉字汉字汉字汉字汉字汉字汉字汉字汉字")]
    rows = spark.createDataFrame(pairs, "s string, t string")
    for language in ("Chinese", "English", " 日本語 "):
        assert [r[0] for r in rows.select(suspicious_residual("s", "t", __import__("pyspark").sql.functions.lit(language))).collect()] == [keeps_source(s, t, language) for s, t in pairs]


def test_checkpoints_resume_and_clear(spark, tmp_path):
    book = make_book(tmp_path / "a.epub", {"c.xhtml": page("<p>One</p><p>Two</p>"), "d.xhtml": page("<p>Three</p>")})
    engine = Engine(spark, f"file://{tmp_path}/cache")
    found = engine.inspect(book)
    engine.translate(found, CONFIG, str(tmp_path / "out")).collect()
    key = engine.job_keys(found, CONFIG).first()["job_key"]
    read = lambda: stores.read_checkpoint(spark, engine.checkpoint_path, key)
    r = read().first()
    assert (r["status"], r["completedBlocks"], r["totalBlocks"], r["completedFiles"], r["cachedBlocks"], r["resumedBlocks"]) == ("completed", 3, 3, 2, 0, 0) and r["updatedAtIso8601"]
    stores.write_checkpoints(spark.createDataFrame([(key, "failed", 2, 3)], "jobKey string, status string, completedBlocks long, totalBlocks long"), engine.checkpoint_path)
    engine.translate(found, CONFIG, str(tmp_path / "out")).collect()
    r = read().first()
    assert (r["cachedBlocks"], r["resumedBlocks"], r["completedBlocks"]) == (1, 2, 3)
    engine.clear(key)
    assert read().count() == 0


def test_each_jobs_saves_are_throttled_and_in_order(spark, tmp_path, monkeypatch):
    now, saved = [0.0], []
    monkeypatch.setattr(stores, "write_checkpoints", lambda states, path: saved.append({r.jobKey: r.completedBlocks for r in states.collect()}))
    store = stores.Checkpoints(spark, f"file://{tmp_path}/c", lambda: now[0])
    names = [f.split()[0] for f in stores.CHECKPOINT.split(", ") if not f.startswith("updatedAt")]
    for seconds, a, b, force in ((0, 0, 0, False), (1, 5, 25, False), (2, 20, 26, False), (3, 30, 44, False), (4, 31, 45, True), (13, 32, 65, False), (14, 33, 66, False), (15, 53, 67, False)):
        now[0] = seconds
        rows = [{"jobKey": key, "completedBlocks": n} for key, n in (("a", a), ("b", b))]
        store.report(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f for f in stores.CHECKPOINT.split(", ") if not f.startswith("updatedAt"))), force)
    store.close()
    assert saved == [{"a": 0, "b": 0}, {"b": 25}, {"a": 20}, {}, {"a": 31, "b": 45}, {"b": 65}, {"a": 33}, {"a": 53}]


def test_two_books_have_their_own_saves_and_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "SLICE_SECONDS", 0.0)
    shared = "<p>shared line</p>"
    long = "word " * 150
    for name, n in (("a", 60), ("b", 55)):
        make_book(tmp_path / f"{name}.epub", {f"{name}{k}.xhtml": page(shared + "".join(f"<p>{name} {k} {b} {long}</p>" for b in range(n // 5))) for k in range(5)})
    engine = Engine(spark, f"file://{tmp_path}/cache")
    found = engine.inspect(str(tmp_path))
    saves = []
    write = stores.write_checkpoints
    monkeypatch.setattr(stores, "write_checkpoints", lambda states, path: (saves.append({r.inputPath[-6:-5]: (r.status, r.completedBlocks) for r in states.collect()}), write(states, path)))
    engine.translate(found, CONFIG.with_value("residual_quality_check", False), str(tmp_path / "out")).collect()
    for name, total in (("a", 65), ("b", 60)):
        own = [s[name] for s in saves if name in s]
        assert own[0] == ("running", 0) and own[-1] == ("completed", total) and len(own) >= 4
        assert [n for _, n in own] == sorted(n for _, n in own) and any(0 < n < total for status, n in own if status == "running")
    rows = stores.read_checkpoints(spark, engine.checkpoint_path).collect()
    assert sorted((r.status, r.completedBlocks, r.totalBlocks) for r in rows) == [("completed", 60, 60), ("completed", 65, 65)]
    assert set(engine.elapsed_ms) == {"plan", "translate", "write"} and all(v > 0 for v in engine.elapsed_ms.values())


def test_what_slices_have_done_outlives_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine_module, "SLICE_SECONDS", 0.0)
    long = "word " * 150
    book = make_book(tmp_path / "a.epub", {"c.xhtml": page("".join(f"<p>{k} {long}</p>" for k in range(40)))})
    log = f"{tmp_path}/asked"
    config = CONFIG.with_value("max_retries", 1).with_value("max_concurrent", 2).with_value("residual_quality_check", False)
    engine = Engine(spark, f"file://{tmp_path}/cache", failing_after(log, 25))
    found = engine.inspect(book)
    with pytest.raises(Exception, match="no more"):
        engine.translate(found, config, str(tmp_path / "out"))
    kept = read_cache(spark, engine.cache_path).count()
    state = stores.read_checkpoints(spark, engine.checkpoint_path).first()
    assert 0 < kept < 40 and (state.status, state.completedBlocks) == ("failed", kept)
    again = Engine(spark, f"file://{tmp_path}/cache", counting_requests(log2 := f"{tmp_path}/again"))
    assert again.translate(found, config, str(tmp_path / "out")).first().committed
    assert len(open(log2).read().split()) == 40 - kept
    state = stores.read_checkpoints(spark, engine.checkpoint_path).first()
    assert (state.status, state.resumedBlocks, state.cachedBlocks, state.completedBlocks) == ("completed", kept, 0, 40)


def test_a_run_has_one_bound_for_all_tasks(spark, tmp_path):
    rows = [("c", k, [(f"b{k}", f"<p>{k}</p>")]) for k in range(60)]
    batches = spark.createDataFrame(rows, "chapter_path string, batch_no long, blocks array<struct<id: string, html: string>>").repartition(8)
    for limit in (1, 3, 6):
        log = f"{tmp_path}/flights{limit}"
        done = translate_batches(batches, Run(flying(log), limit))
        assert done.count() == 60
        events = sorted((float(at), int(step)) for at, step in (line.split() for line in open(log)))
        under_way, most = 0, 0
        for _, step in events:
            under_way += step
            most = max(most, under_way)
        assert len(events) == 120 and most <= limit and (limit == 1 or most > 1)
    assert [[Run(None, n).share(k, lanes) for k in range(lanes)] for n, lanes in ((8, 3), (3, 3), (2, 1))] == [[3, 3, 2], [1, 1, 1], [2]]


def test_memory_goes_on_from_slice_to_slice(spark, tmp_path, monkeypatch):
    long = " ".join(f"word{k}" for k in range(150))
    pages = {f"chapter{k}.xhtml": page("".join(f"<p>c{k} b{b} {long}</p>" for b in range(2)), f"Title {k}") for k in range(6)}
    book = make_book(tmp_path / "a.epub", pages)
    config = CONFIG.with_value("residual_quality_check", False)
    told = {}
    for seconds in (0.0, 1000.0):
        monkeypatch.setattr(engine_module, "SLICE_SECONDS", seconds)
        engine = Engine(spark, f"file://{tmp_path}/c{seconds}", telling_translator, listing_memory, counting_memory)
        told[seconds] = told_by(engine, config, book, tmp_path)
    assert told[0.0] == told[1000.0] and len(told[0.0]) == 12
    assert [c["title"] for c in told[0.0][5, 0]["memory"]["recentChapters"]] == ["OPS/chapter3.xhtml", "OPS/chapter4.xhtml"]


def test_cancel_reaches_tasks_and_the_commit(spark, tmp_path):
    book = make_book(tmp_path / "a.epub", {"c.xhtml": page("".join(f"<p>{'word ' * 150}{k}</p>" for k in range(30)))})
    engine = Engine(spark, f"file://{tmp_path}/cache", slow_translator)
    config = CONFIG.with_value("max_concurrent", 1)
    found = engine.inspect(book)
    key = engine.job_keys(found, config).first()["job_key"]
    errors = []

    def run():
        try:
            engine.translate(found, config, str(tmp_path / "out"))
        except BaseException as e:
            errors.append(e)

    thread = threading.Thread(target=run)
    thread.start()
    time.sleep(8)
    began = time.time()
    engine.cancel()
    thread.join(60)
    assert errors and time.time() - began < 25 and not list((tmp_path / "out").glob("*.epub"))
    assert not list((tmp_path / "out").glob(".stop-*"))
    assert stores.read_checkpoint(spark, engine.checkpoint_path, key).first()["status"] == "cancelled"


def test_retry_and_recovery(spark, tmp_path):
    book = make_book(tmp_path / "a.epub", {"c.xhtml": page("<p>One</p>")})
    engine = Engine(spark, f"file://{tmp_path}/cache")
    out = str(tmp_path / "out")
    found, done = engine.retry({"inputPath": book, "phase": "inspection"}, CONFIG, out)
    assert found.blocks.count() == 1 and done is None
    assert engine.retry({"inputPath": book, "phase": "inspection", "completedBlocks": 1}, CONFIG, out)[1].first()["committed"]
    job = {"inputPath": book, "phase": "translation"}
    assert engine.recover("HTTP 429", job, CONFIG, out)[1].max_concurrent == CONFIG.max_concurrent - 1
    assert engine.recover("HTTP 401", job, CONFIG, out)[0] == "openSettings"
    assert engine.recover("Inspection failed", job, CONFIG, out)[2].blocks.count() == 1
    action, _, (_, done) = engine.recover("Translation failed", job, CONFIG, out)
    assert action == "retryTranslation" and done.first()["committed"]


def test_memory_codec():
    assert read_memory(None) == read_memory("[1]") == {"bookSummary": "", "styleGuide": [], "glossary": [], "recentChapters": []}
    raw = {"bookSummary": " s ", "styleGuide": [" a ", 1, ""] + ["x"] * 9, "glossary": [{"source": "A", "target": " "}, {"source": " B ", "target": "b"}, 3] + [{"source": f"t{k}", "target": "t"} for k in range(40)], "recentChapters": [{"title": 1}, {"summary": "one"}, "no", {"summary": "two"}, {"summary": "three"}]}
    m = read_memory(json.dumps(raw))
    assert m["bookSummary"] == "s" and len(m["styleGuide"]) == 8 and len(m["glossary"]) == 32 and m["glossary"][0] == {"source": "B", "target": "b"}
    assert [c["summary"] for c in m["recentChapters"]] == ["one", "two"] and read_memory(write_memory(m)) == m
    m = fold_book(m, read_chapter_memory({"summary": "three", "glossary": [{"source": "b", "target": "new"}, {"source": "late", "target": "x"}]}))
    assert [c["summary"] for c in m["recentChapters"]] == ["two", "three"] and m["glossary"][0]["target"] == "new" and len(m["glossary"]) == 32


def test_providers_session_and_paths(tmp_path):
    c = CONFIG.for_provider("deepseek")
    assert (c.matching_provider(), CONFIG.matching_provider(), c.for_provider("custom")) == ("deepseek", "custom", c)
    assert Config(api_base_url=" HTTPS://api.openai.com/v1 ").matching_provider() == "openAiCompatible"
    file = str(tmp_path / "s.json")
    assert stores.load_session(file) == {"inputPath": "", "outputDirectory": ""}
    stores.save_session(file, "/a.epub", "/out")
    assert stores.load_session(file) == {"inputPath": "/a.epub", "outputDirectory": "/out"}
    (tmp_path / "s.json").write_text('{"inputPath": 3, "outputDirectory": "/x"}')
    assert stores.load_session(file) == {"inputPath": "", "outputDirectory": "/x"}
    assert stores.accept_input(" /b/A.EPUB ") == ("/b/A.EPUB", "/b") and stores.accept_input("x.pdf") is None and stores.accept_input(" ") is None
    assert stores.canonical_path(" /A/../b/./c ") == "/b/c" and stores.canonical_path("/A/B", windows=True) == "/a/b"
    assert stores.new_job_id(lambda: 1.5) == "1500" and stores.iso_time(lambda: 0.0).startswith("19")
