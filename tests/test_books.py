"""Books: archive scan, inspection, translation, write-back, atomic commit."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.html_tree import lock_structure, render_chapter, structure_matches
from quire.operators.html_blocks import chapter_blocks
from quire.operators.translate import Cancelled, Retry, ServiceError, translate_batch
from quire.plans.engine import Engine
from quire.sources import epub

CONTAINER = '<container xmlns="urn:x"><rootfiles><rootfile full-path="OPS/content.opf"/></rootfiles></container>'


def make_book(path, chapters: dict, extra_items: str = "", spine: list | None = None) -> str:
    """chapters: href to html; the spine names them all unless it is given."""
    items = "".join(f'<item id="i{k}" href="{href}"/>' for k, href in enumerate(chapters))
    refs = "".join(f'<itemref idref="{r}" linear="no"/>' for r in (spine or [f"i{k}" for k in range(len(chapters))]))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OPS/content.opf", f'<package xmlns="urn:p"><manifest>{items}{extra_items}</manifest><spine>{refs}</spine></package>')
        for href, html in chapters.items():
            from quire.functions.paths import decode_full

            z.writestr(f"OPS/{decode_full(href)}", html)
    return str(path)


def page(body: str, title: str = "T") -> str:
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/cache")


def test_encoded_href_and_page_breaks(engine, tmp_path):
    body = '<p></p><p>Hello.</p><p><span epub:type="pagebreak">12</span></p><span epub:type="pagebreak">12</span><span epub:type="pagebreak">Some prose here.</span><ul><li><p>In a list</p></li></ul>'
    make_book(tmp_path / "a.epub", {"Text/chapter%201.xhtml": page(body), "style.css": "p{}"})
    found = engine.inspect(str(tmp_path))
    assert [r.chapter_path for r in found.chapters.collect()] == ["OPS/Text/chapter 1.xhtml"]
    rows = found.blocks.orderBy("block_idx").collect()
    assert [(r.block_id, r.source_text) for r in rows] == [("p-1", "Hello."), ("p-2", "12"), ("span-3", "Some prose here."), ("li-4", "In a list")]


def test_last_manifest_item_and_duplicate_spine(spark, tmp_path):
    make_book(tmp_path / "a.epub", {"a.xhtml": page("<p>A</p>"), "b.xhtml": page("<p>B</p>")}, '<item id="i0" href="b.xhtml"/>', ["i0", "i1", "i1", "gone"])
    rows = epub.chapters(epub.members(epub.read_archives(spark, str(tmp_path)))).orderBy("spine_idx").collect()
    assert [(r.spine_idx, r.chapter_path, r.total_files) for r in rows] == [(0, "OPS/b.xhtml", 3), (1, "OPS/b.xhtml", 3), (2, "OPS/b.xhtml", 3)]


def test_translate_round_trip_and_warm_cache(spark, engine, tmp_path):
    book = make_book(tmp_path / "b.epub", {"c1.xhtml": page("<p></p><p>Hello <em>you</em>.</p><p>World.</p>"), "cover.xhtml": page("<p>Cover</p>")})
    config = Config(api_base_url="api.example.com", api_key="k", model="m", chunk_size=1000)
    out = tmp_path / "out"
    result = engine.translate(engine.inspect(book), config, str(out)).collect()
    assert [r.committed for r in result] == [True]
    with zipfile.ZipFile(result[0].output_path) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "<p></p><p>HELLO <em>YOU</em>.</p><p>WORLD.</p>" in z.read("OPS/c1.xhtml").decode()
        assert "<p>Cover</p>" in z.read("OPS/cover.xhtml").decode()  # ancillary chapters aren't selected
    assert not [f for f in os.listdir(out) if ".tmp." in f or ".bak." in f]

    def refuse(blocks, context):
        raise AssertionError("everything is cached")

    again = Engine(spark, engine.cache_path, refuse)
    assert again.translate(again.inspect(book), config, str(out)).count() == 1


def test_commit_gate_keeps_the_old_file(tmp_path):
    final, temp = tmp_path / "x.epub", tmp_path / "x.tmp"
    final.write_text("old")
    temp.write_text("new")
    answers = iter([True, False])
    assert not epub.commit_file(str(temp), str(final), lambda: next(answers))
    assert final.read_text() == "old" and os.listdir(tmp_path) == ["x.epub"]
    temp.write_text("new")
    assert epub.commit_file(str(temp), str(final)) and final.read_text() == "new" and os.listdir(tmp_path) == ["x.epub"]


CITED = '<li>Bread <a href="#n7">(7)</a> rises.</li>'
PAGED = '<dd>One<span role="doc-pagebreak">iv</span>two<a href="#x">*</a>three</dd>'
LOCKS = [
    # other markup around: as many texts go slot by slot
    ('<h2 id="top">Red <b>and</b> blue</h2>', '<section><h2>Rouge <b>et</b> bleu</h2></section>', '<h2 id="top">Rouge <b>et</b> bleu</h2>'),
    # fewer texts: parted at the note, which stands there word for word, or as another bracketed note
    (CITED, "<li>Le pain (7) lève.</li>", '<li>Le pain <a href="#n7">(7)</a> lève.</li>'),
    (CITED, "<li>Le pain [sept] lève.</li>", '<li>Le pain <a href="#n7">(7)</a> lève.</li>'),
    (CITED, "Le pain (7) lève.", '<li>Le pain <a href="#n7">(7)</a> lève.</li>'),
    # the same markup: only the note is restored
    (CITED, '<li>Le pain <a href="#n7">(sept)</a> lève.</li>', '<li>Le pain <a href="#n7">(7)</a> lève.</li>'),
    # no note found: the first open text takes all
    (CITED, "<li>Le pain lève.</li>", '<li>Le pain lève.<a href="#n7">(7)</a></li>'),
    ("<td>Up <i>and</i> down</td>", "<td>haut et bas</td>", "<td>haut et bas<i></i></td>"),
    # two markers in order; out of order they are only taken out
    (PAGED, "<dd>un iv deux * trois</dd>", '<dd>un <span role="doc-pagebreak">iv</span> deux <a href="#x">*</a> trois</dd>'),
    (PAGED, "<dd>un * deux iv trois</dd>", '<dd>un deux trois<span role="doc-pagebreak">iv</span><a href="#x">*</a></dd>'),
    # links to other places and page breaks of prose are translated
    ('<p>Ask <a href="mailto:x">the desk</a>!</p>', '<p>Demandez <a href="mailto:x">au guichet</a> !</p>', '<p>Demandez <a href="mailto:x">au guichet</a> !</p>'),
    ('<p><span role="doc-pagebreak">Some words of prose.</span></p>', '<p><span role="doc-pagebreak">De la prose.</span></p>', '<p><span role="doc-pagebreak">De la prose.</span></p>'),
    # nothing but a note; no single root; no text
    ('<sup><a href="#n1">[1]</a></sup>', "<sup>un, deux</sup>", '<sup><a href="#n1">[1]</a></sup>'),
    ("one <b>two</b>", " un <b>deux</b> ", "un <b>deux</b>"),
    ("<hr>", "<p>x</p>", "<hr>"),
]


@pytest.mark.parametrize("source, translated, locked", LOCKS)
def test_lock_structure(source, translated, locked):
    assert lock_structure(source, translated) == locked
    assert lock_structure(source, locked) == locked


def test_structure_match():
    source = '<h3 lang="en" dir="ltr">Ten <i title="t">men</i><br> came</h3>'
    assert structure_matches(source, '<h3 dir="ltr" lang="en">Dix <i title="t">hommes</i><br>vinrent</h3>')
    for other in ('<h3 lang="fr" dir="ltr">Dix <i title="t">hommes</i><br> vinrent</h3>', '<h3 lang="en" dir="ltr">Dix <u title="t">hommes</u><br> vinrent</h3>', '<h3 lang="en" dir="ltr">Dix hommes<br> vinrent</h3>', source + source):
        assert not structure_matches(source, other)


def test_bilingual_keeps_the_original_and_its_ids():
    out = render_chapter('<html><body><p id="a">Hi</p></body></html>', ['<p id="a">Ho</p>'], bilingual=True)
    assert out == '<html><body><p id="a">Hi</p>\n<p data-translation="true">Ho</p></body></html>'


def test_blocks_of_ill_formed_pages(spark):
    df = spark.createDataFrame([("<nav><ul><li><a>One<li>Two</ul></nav><p>a<p><b>b<br>c<script>var x='</p>'</script><code>no</code>",), (None,)], "html string")
    assert [r.source_text for r in chapter_blocks(df.select("html", F.lit(1).alias("k"))).collect()][:2] == ["One", "Two"]


def answer(blocks, context):
    return [{"id": b["id"], "html": b["html"].replace("a", "b")} for b in blocks]


BLOCKS = [{"id": "1", "html": "<p>a</p>"}, {"id": "2", "html": "<p>ab</p>"}]


def failing(errors):
    calls = []

    def translator(blocks, context):
        calls.append(len(blocks))
        if errors:
            raise errors.pop(0)
        return answer(blocks, context)

    return translator, calls


def test_retries_and_rate_limits():
    quick = lambda **k: Retry(sleep=lambda s: None, **k)
    translator, calls = failing([ServiceError(500)])
    assert [b["html"] for b in translate_batch(BLOCKS, {}, translator, quick(max_retries=2))] == ["<p>b</p>", "<p>bb</p>"] and calls == [2, 2]
    retry = quick(max_retries=3)
    translator, calls = failing([ServiceError(429)] * 4)
    translate_batch(BLOCKS, {}, translator, retry)
    assert calls == [2] * 5 and retry.waits == [5, 10, 20, 40]
    translator, calls = failing([ServiceError(413)])
    translate_batch(BLOCKS, {}, translator, quick())
    assert calls == [2, 1, 1]
    translator, calls = failing([ServiceError(401)] * 3)
    with pytest.raises(ServiceError):
        translate_batch(BLOCKS, {}, translator, quick(max_retries=3))


def test_incomplete_answers_fall_back_and_cancel_stops():
    def half(blocks, context):
        return answer(blocks[:1], context) if len(blocks) > 1 else answer(blocks, context)

    assert len(translate_batch(BLOCKS, {}, half, Retry(max_retries=1, sleep=lambda s: None))) == 2
    with pytest.raises(Cancelled):
        translate_batch(BLOCKS, {}, answer, Retry(cancelled=lambda: True))


def test_preconditions():
    with pytest.raises(ValueError):
        Config().require_runnable(1, 1)
    with pytest.raises(ValueError):
        Config(api_base_url="x", api_key="k", model="m").require_runnable(0, 0)
