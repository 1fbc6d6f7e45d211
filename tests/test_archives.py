"""Archives by ranges: the index, members that are wanted, large files, other storage."""

import os
import sys
import zipfile

import pytest
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.paths import is_html
from quire.plans.engine import Engine, StopFlag
from quire.sources import epub
from quire.sources.storage import Storage
from test_books import make_book, page

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module


def spoil(path, member: str) -> None:
    """Breaks the stored bytes of a member, so that reading it fails."""
    with zipfile.ZipFile(path) as z:
        at = z.getinfo(member).header_offset + 30 + len(member)
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\xff\xff\xff")


def with_image(path, size: int = 5000) -> str:
    book = make_book(path, {"a.xhtml": page("<p>One.</p>"), "b.xhtml": page("<p>Two.</p>")})
    with zipfile.ZipFile(book, "a") as z:
        z.writestr("OPS/i.png", os.urandom(size), zipfile.ZIP_STORED)
    return book


def test_inspection_opens_no_images(spark, tmp_path):
    spoil(with_image(tmp_path / "a.epub"), "OPS/i.png")
    found = Engine(spark, f"file://{tmp_path}/cache").inspect(str(tmp_path))
    assert [r.source_text for r in found.blocks.orderBy("spine_idx").collect()] == ["One.", "Two."]
    assert epub.read_archives(spark, str(tmp_path), is_html("member_path")).count() == 2
    with pytest.raises(Exception, match="CRC|Bad"):
        epub.read_archives(spark, str(tmp_path)).collect()


def test_index_equals_the_archive_and_repeats_count(spark, tmp_path):
    book = with_image(tmp_path / "a.epub")
    with pytest.warns(UserWarning), zipfile.ZipFile(book, "a") as z:
        z.writestr("OPS/a.xhtml", page("<p>Later.</p>"))
        z.writestr("empty/", "")
    with zipfile.ZipFile(book) as z:
        expected = [(i.filename, i.is_dir(), i.file_size, b"" if i.is_dir() else z.read(i)) for i in z.infolist()]
    index = epub.read_index(spark, str(tmp_path))
    assert "content" not in index.columns
    rows = epub.fetch(index).join(index.select("book_path", "entry_ord", "size"), ["book_path", "entry_ord"]).orderBy("entry_ord").collect()
    assert [(r.member_path, r.is_dir, r.size, bytes(r.content)) for r in rows] == expected
    chapters = epub.chapters(epub.members(epub.readable_members(index))).orderBy("spine_idx").collect()
    assert ["Later" in r.html for r in chapters] == [True, False]


def test_archive_beyond_four_gigabytes(spark, tmp_path):
    path = tmp_path / "large.epub"
    with open(path, "wb") as f:
        f.truncate(5 << 30)  # a hole: it takes no room on the disk
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", '<package><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", page("<p>Far away.</p>"))
    index = epub.read_index(spark, str(path))
    assert index.agg(F.min("offset")).first()[0] >= 5 << 30
    assert [("Far away" in r.html) for r in epub.chapters(epub.members(epub.readable_members(index))).collect()] == [True]


def test_members_of_a_large_archive_are_shared(spark, tmp_path, monkeypatch):
    book = with_image(tmp_path / "a.epub")
    with zipfile.ZipFile(book, "a") as z:
        for k in range(20):
            z.writestr(f"OPS/{k}.png", os.urandom(5000), zipfile.ZIP_STORED)
    monkeypatch.setattr(epub, "SPAN", 1 << 10)
    monkeypatch.setattr(epub, "BATCH_BYTES", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = epub.read_archives(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
        assert tasks.select("task").distinct().count() > 1 and tasks.count() == 26
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    index = epub.read_index(spark, str(tmp_path))
    assert index.count() == 0 and epub.fetch(index).count() == 0 and epub.chapters(epub.members(epub.readable_members(index))).count() == 0


def shelf(tmp_path) -> Storage:
    """A storage by a scheme of its own."""
    root = f"{tmp_path}/shelf"
    os.makedirs(root, exist_ok=True)
    return Storage({"shelf": lambda authority: fs.SubTreeFileSystem(root, fs.LocalFileSystem())})


def test_round_trip_on_another_storage(spark, tmp_path):
    book, storage = with_image(tmp_path / "a.epub"), shelf(tmp_path)
    engine = Engine(spark, f"file://{tmp_path}/cache", storage=storage)
    config = Config(api_base_url="api.example.com", api_key="k", model="m", chunk_size=1000, residual_quality_check=False)
    for _ in range(2):  # the second time there is a file to replace
        row = engine.translate(engine.inspect(book), config, "shelf://any/out").first()
        assert row.committed and row.output_path.startswith("shelf://any/out/a")
    assert os.listdir(tmp_path / "shelf" / "out") == [os.path.basename(row.output_path)]  # no part, no old file, no flag
    with zipfile.ZipFile(storage.open(row.output_path)) as z, zipfile.ZipFile(book) as old:
        assert z.testzip() is None and z.namelist() == old.namelist()
        assert "<p>ONE.</p>" in z.read("OPS/a.xhtml").decode() and z.read("OPS/i.png") == old.read("OPS/i.png")


def test_stop_flag_on_another_storage_keeps_the_old_book(spark, tmp_path):
    book, storage = with_image(tmp_path / "a.epub"), shelf(tmp_path)
    stop = StopFlag("shelf://any/out/.stop", storage)
    assert not stop()
    stop.set()
    with storage.create("shelf://any/out/a.epub") as f:
        f.write(b"old")
    index = epub.read_index(spark, book)
    outputs = index.select("book_path").distinct().withColumn("output_path", F.lit("shelf://any/out/a.epub"))
    new = index.where("member_path = 'OPS/a.xhtml'").select("book_path", "member_path", F.lit("x").alias("html"))
    assert [r.committed for r in epub.write_books(index, new, outputs, lambda: not stop(), storage).collect()] == [False]
    assert sorted(os.listdir(tmp_path / "shelf" / "out")) == [".stop", "a.epub"] and storage.open("shelf://any/out/a.epub").read() == b"old"
    stop.clear()
    assert [r.committed for r in epub.write_books(index, new, outputs, lambda: not stop(), storage).collect()] == [True]
    assert os.listdir(tmp_path / "shelf" / "out") == ["a.epub"]


def test_a_failed_write_leaves_no_part(spark, tmp_path):
    spoil(with_image(tmp_path / "a.epub"), "OPS/i.png")
    index = epub.read_index(spark, str(tmp_path / "a.epub"))
    outputs = index.select("book_path").distinct().withColumn("output_path", F.lit(f"{tmp_path}/out/a.epub"))
    with pytest.raises(Exception, match="CRC|Bad"):
        epub.write_books(index, index.select("book_path", "member_path", F.lit("x").alias("html")).where("member_path = 'OPS/a.xhtml'"), outputs).collect()
    assert os.listdir(tmp_path / "out") == []
