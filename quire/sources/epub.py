"""Books as ZIP archives: index, members by ranges, package documents, and the repacking sink.

The index of an archive (its central directory) is a table of members without their contents. It is filtered as any table,
and what is left is fetched by ranges: tasks share the members of a large archive, and what isn't wanted isn't read. A book is
written by one task, member after member. Paths must be on storage that all executors share.
"""

from __future__ import annotations

import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.keys import input_fingerprint
from quire.functions.paths import dirname, is_epub, is_html, resolve_href
from quire.sources.storage import Storage

INDEX = "book_path string, member_path string, entry_ord int, is_dir boolean, stored boolean, size long, packed_size long, offset long"
MEMBERS = "book_path string, member_path string, entry_ord int, is_dir boolean, stored boolean, content binary"
CONTAINER = "META-INF/container.xml"
#: Bytes of an archive that one task fetches, and bytes of contents that make a batch.
SPAN, BATCH_BYTES = 64 << 20, 16 << 20


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_epub("path"))


def read_index(spark: SparkSession, path: str, storage: Storage = Storage()) -> DataFrame:
    """A row for each entry of each book, in archive order, by its central directory alone; archives may have any size (zip64)."""

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in INDEX.split(", ")]
        for part in parts:
            for book in part["path"]:
                with storage.open(book) as file, zipfile.ZipFile(file) as z:
                    rows = [(book, i.filename, k, i.is_dir(), i.compress_type == zipfile.ZIP_STORED, i.file_size, i.compress_size, i.header_offset) for k, i in enumerate(z.infolist())]
                yield pd.DataFrame(rows, columns=names)

    return _files(spark, path).select("path").mapInPandas(listed, INDEX)


def fetch(index: DataFrame, storage: Storage = Storage()) -> DataFrame:
    """The rows of an index (or of a part of it) with their contents, as MEMBERS has them.

    Members that lie in the same span of an archive go to one task, which opens the archive once and reads them in order.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in MEMBERS.split(", ")]
        rows, held, book, archive, entries = [], 0, None, None, []
        try:
            for part in parts:
                for r in part.itertuples(index=False):
                    if r.book_path != book:
                        if archive:
                            archive.close()
                        book, archive = r.book_path, zipfile.ZipFile(storage.open(r.book_path))
                        entries = archive.infolist()
                    content = b"" if r.is_dir else archive.read(entries[r.entry_ord])
                    rows.append((book, r.member_path, r.entry_ord, r.is_dir, r.stored, content))
                    held += len(content)
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)
        finally:
            if archive:
                archive.close()

    spread = index.repartition("book_path", F.floor(F.col("offset") / SPAN)).sortWithinPartitions("book_path", "offset")
    return spread.select("book_path", "member_path", "entry_ord", "is_dir", "stored").mapInPandas(read, MEMBERS)


def read_archives(spark: SparkSession, path: str, where: Column | str | None = None, storage: Storage = Storage()) -> DataFrame:
    """A row for each entry of each book with its content; of those that `where` (on INDEX) leaves out, nothing is read."""
    index = read_index(spark, path, storage)
    return fetch(index if where is None else index.where(where), storage)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """book_path and fingerprint by path, size and time; contents aren't read."""
    return _files(spark, path).select(F.col("path").alias("book_path"), input_fingerprint(F.col("path"), F.col("length"), F.col("modificationTime")).alias("fingerprint"))


def readable_members(index: DataFrame, storage: Storage = Storage()) -> DataFrame:
    """What chapters() needs of an index, with contents: containers, the package documents that they name, HTML. Images and fonts stay closed."""
    named = fetch(index.where(F.col("member_path") == CONTAINER), storage).select("book_path", _root_file().alias("member_path"))
    opf = index.join(named, ["book_path", "member_path"], "left_semi")
    return fetch(index.where((F.col("member_path") == CONTAINER) | is_html("member_path")).union(opf).dropDuplicates(["book_path", "entry_ord"]), storage)


def members(entries: DataFrame) -> DataFrame:
    """Files only; of entries with one name, the last."""
    last = F.max_by(F.struct("entry_ord", "content"), "entry_ord").alias("e")
    return entries.where("not is_dir").groupBy("book_path", "member_path").agg(last).select("book_path", "member_path", "e.*")


def _xml(content: Column) -> Column:
    return content.cast("string")


def _root_file() -> Column:
    """The package document that a container's content names, or an empty text."""
    return F.xpath_string(_xml(F.col("content")), F.lit('(//*[local-name()="rootfile"])[1]/@full-path'))


def packages(files: DataFrame) -> DataFrame:
    """book_path, opf_path, opf (text) of each book; a book without container or package document raises."""
    full = _root_file()
    opf = files.where(F.col("member_path") == CONTAINER).select("book_path", F.when(full != "", full).otherwise(F.raise_error(F.concat(F.lit("no package document: "), "book_path"))).alias("opf_path"))
    named = files.select("book_path", F.col("member_path").alias("opf_path"), _xml(F.col("content")).alias("opf"))
    return opf.join(named, ["book_path", "opf_path"], "left").withColumn("opf", F.coalesce("opf", F.raise_error(F.concat(F.lit("package document is missing: "), "opf_path"))))


def manifests(opf: DataFrame) -> DataFrame:
    """book_path, item_id and member_path: items anywhere in the document; of equal ids the last."""
    items = '//*[local-name()="item"][@id and @href]'
    rows = opf.select("book_path", "opf_path", F.posexplode(F.arrays_zip(F.xpath("opf", F.lit(f"{items}/@id")).alias("item_id"), F.xpath("opf", F.lit(f"{items}/@href")).alias("href"))).alias("pos", "i"))
    last = rows.groupBy("book_path", F.col("i.item_id").alias("item_id")).agg(F.max_by(F.struct("opf_path", "i.href"), "pos").alias("x"))
    return last.select("book_path", "item_id", resolve_href(dirname(F.col("x.opf_path")), F.col("x.href")).alias("member_path"))


def spines(opf: DataFrame) -> DataFrame:
    """book_path, spine_idx and idref, in reading order; linear="no" counts like any other."""
    return opf.select("book_path", F.posexplode(F.xpath("opf", F.lit('//*[local-name()="itemref"]/@idref'))).alias("spine_idx", "idref"))


def chapters(files: DataFrame) -> DataFrame:
    """book_path, spine_idx, chapter_path, html and total_files: HTML chapters of the spine that the archive holds."""
    opf = packages(files)
    spine = spines(opf).join(manifests(opf).withColumnRenamed("item_id", "idref"), ["book_path", "idref"]).where(is_html("member_path"))
    totals = spine.groupBy("book_path").agg(F.count("*").alias("total_files"))
    html = files.select("book_path", "member_path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    return spine.join(html, ["book_path", "member_path"]).join(totals, "book_path").select("book_path", "spine_idx", F.col("member_path").alias("chapter_path"), "html", "total_files")


def commit_file(temp: str, final: str, should_commit: Callable[[], bool] = lambda: True, storage: Storage = Storage()) -> bool:
    """Puts a finished file in place; an old one is kept aside and comes back if the new one can't be placed."""
    aside = f"{final}.bak.{uuid.uuid4().hex}"
    had = storage.exists(final)
    try:
        if not should_commit():
            return False
        if had:
            storage.move(final, aside)
        if not should_commit():
            return False
        storage.move(temp, final)
        return True
    finally:
        if had and storage.exists(aside):
            if storage.exists(final):
                storage.delete(aside)
            else:
                storage.move(aside, final)
        storage.delete(temp)


class _Book:
    """A book on its way to a task's output: members come in order, the file is put in place at the end."""

    def __init__(self, source: str, final: str, storage: Storage):
        self.source, self.final, self.storage = source, final, storage
        self.temp = f"{final}.tmp.{uuid.uuid4().hex}"
        self.file = storage.create(self.temp)
        self.target = zipfile.ZipFile(self.file, "w")
        self.archive: zipfile.ZipFile | None = None

    def add(self, row) -> None:
        info = zipfile.ZipInfo(row.member_path)
        info.compress_type = zipfile.ZIP_STORED if row.stored or row.is_dir or row.member_path == "mimetype" else zipfile.ZIP_DEFLATED
        if row.content is not None or row.is_dir:
            self.target.writestr(info, row.content or b"")
            return
        if self.archive is None:
            self.archive = zipfile.ZipFile(self.storage.open(self.source))
            self.entries = self.archive.infolist()
        old = self.entries[row.entry_ord]
        info.file_size = old.file_size  # tells whether zip64 is needed
        with self.archive.open(old) as content, self.target.open(info, "w") as copy:
            shutil.copyfileobj(content, copy, 1 << 20)

    def finish(self, should_commit: Callable[[], bool]) -> tuple[str, str, bool]:
        self.target.close()
        self.file.close()
        if self.archive:
            self.archive.close()
        return self.source, self.final, commit_file(self.temp, self.final, should_commit, self.storage)

    def drop(self) -> None:
        self.file.close()
        self.storage.delete(self.temp)


def write_books(entries: DataFrame, replacements: DataFrame, outputs: DataFrame, should_commit: Callable[[], bool] = lambda: True, storage: Storage = Storage()) -> DataFrame:
    """Writes each book with its replaced members (book_path, member_path, html) to its output (book_path, output_path).

    Entries are rows of an index, whose unreplaced members are copied from their archive piece by piece, or rows with contents. mimetype
    goes first and uncompressed. Returns book_path, output_path and committed. Of replacements for one member that with the largest
    spine_idx counts (if there is such a column), and those for unknown members are ignored. should_commit() is asked right before a file is
    put in place. A second attempt of a task writes the same file again; a task that fails leaves no part of one.
    """
    order = F.col("spine_idx") if "spine_idx" in replacements.columns else F.col("html")
    new = replacements.groupBy("book_path", "member_path").agg(F.max_by("html", order).alias("html"))
    old = F.col("content") if "content" in entries.columns else F.lit(None).cast("binary")
    overlaid = entries.join(new, ["book_path", "member_path"], "left").withColumn("content", F.coalesce(F.encode("html", "utf-8"), old)).join(outputs, "book_path")
    rows = overlaid.select("book_path", "output_path", "member_path", "entry_ord", "is_dir", "stored", "content", (F.col("member_path") != "mimetype").alias("later"))

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, names = None, ["book_path", "output_path", "committed"]
        try:
            for part in parts:
                for row in part.itertuples(index=False):
                    if book and book.source != row.book_path:
                        done, book = book, None
                        yield pd.DataFrame([done.finish(should_commit)], columns=names)
                    book = book or _Book(row.book_path, row.output_path, storage)
                    book.add(row)
            if book:
                done, book = book, None
                yield pd.DataFrame([done.finish(should_commit)], columns=names)
        finally:
            if book:
                book.drop()

    return rows.repartition("book_path").sortWithinPartitions("book_path", "later", "entry_ord").mapInPandas(write, "book_path string, output_path string, committed boolean")
