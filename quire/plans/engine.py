"""The whole flow over books: inspect, translate, write back."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions.keys import block_key, job_head, job_keys
from quire.functions.labels import error_action
from quire.functions.numbers import Limits
from quire.functions.paths import output_path
from quire.operators import batches, blocks, cache, html_blocks, memory
from quire.operators.translate import Cancelled, Run, Translator, marking_translator, translate_batches, translate_books
from quire.sources import epub
from quire.sources.storage import Storage
from quire.sources.stores import Checkpoints, clear_checkpoint, read_checkpoints

CHAPTER = ["book_path", "spine_idx", "chapter_path"]
#: Seconds that a slice of a run is meant to take, and for its first one, batches for each request under way.
SLICE_SECONDS, FIRST_BATCHES = 10.0, 4
FINISHED = "chapter_path string, batch_no long, block_id string, translated_html string, memory string"


@dataclass
class Inspection:
    entries: DataFrame  # the index of the books, without contents
    chapters: DataFrame
    blocks: DataFrame
    fingerprints: DataFrame
    elapsed_ms: int


class StopFlag:
    """A file that tells tasks to stop; it lies where all executors see it, as the books do."""

    def __init__(self, path: str, storage: Storage = Storage()):
        self.path, self.storage = path, storage

    def __call__(self) -> bool:
        return self.storage.exists(self.path)

    def set(self) -> None:
        self.storage.create(self.path).close()

    def clear(self) -> None:
        self.storage.delete(self.path)


@dataclass
class Engine:
    """Inspection and translation of books in a folder. Its parts (transforms, stores, planner limits, clock) can be replaced.

    A run has a job tag and a stop flag: cancel() sets the flag, which tasks ask between requests and before a book is
    put in place, and interrupts the run's Spark jobs; a new run cancels the one before.
    """

    spark: SparkSession
    cache_path: str
    translator: Translator = marking_translator
    first_memory: Callable[[list[dict]], dict] | None = None
    chapter_memory: Callable[[dict, dict], dict] | None = None
    limits: Limits = field(default_factory=Limits)
    work_path: str = ""  # of inspections, results and checkpoints
    clock: Callable[[], float] = time.time
    storage: Storage = field(default_factory=Storage)
    tag: str | None = None
    stop: StopFlag | None = None
    elapsed_ms: dict[str, int] = field(default_factory=dict)  # of the steps of the last run

    def __post_init__(self) -> None:
        self.work_path = self.work_path or f"{self.cache_path.rstrip('/')}-work"
        self.checkpoint_path = f"{self.work_path}/checkpoints"

    def _begin(self, name: str, output_dir: str) -> tuple[str, StopFlag]:
        self.cancel()
        tag = f"{name}-{uuid.uuid4().hex}"
        self.tag, self.stop = tag, StopFlag(f"{output_dir}/.stop-{tag}", self.storage)
        self.spark.addTag(tag)
        return self.tag, self.stop

    def _end(self, tag: str, stop: StopFlag) -> None:
        self.spark.removeTag(tag)
        stop.clear()
        if self.tag == tag:  # no later run has begun
            self.tag = self.stop = None

    def cancel(self) -> None:
        """From any thread; the run itself clears its flag when it has ended."""
        tag, stop = self.tag, self.stop
        if tag and stop:
            stop.set()
            self.spark.interruptTag(tag)

    def _stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.work_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def inspect(self, path: str) -> Inspection:
        """Chapters with title, category and selection, and their blocks; only indexes, package documents and chapters are read, and parsed once."""
        began = self.clock()
        entries = self._stored(epub.read_index(self.spark, path, self.storage))
        files = self._stored(epub.readable_members(entries, self.storage))
        chapters = self._stored(html_blocks.chapter_heads(epub.chapters(epub.members(files)), "chapter_path"))
        found = self._stored(html_blocks.chapter_blocks(chapters.select(*CHAPTER, "html")))
        return Inspection(entries, chapters, found, epub.read_fingerprints(self.spark, path), int((self.clock() - began) * 1000))

    def _keyed(self, found: DataFrame, config: Config) -> DataFrame:
        lit = F.lit
        key = block_key(lit(config.api_base_url), lit(config.model), lit(config.target_language), lit(config.locked_glossary), lit(config.residual_quality_check), F.col("chapter_path"), F.col("source_html"))
        return found.withColumn("cache_key", key)

    def job_keys(self, found: Inspection, config: Config) -> DataFrame:
        """book_path, fingerprint and job_key of each book with its selected chapters."""
        lit = F.lit
        head = job_head(F.col("fingerprint"), lit(config.api_base_url), lit(config.model), lit(config.target_language), lit(config.bilingual), lit(config.locked_glossary), lit(config.residual_quality_check))
        keys = job_keys(found.fingerprints.select("book_path", head.alias("head")), found.chapters.where("include"), "book_path", "spine_idx", "chapter_path")
        return found.fingerprints.join(keys, "book_path").select("book_path", "fingerprint", "job_key")

    def _planned(self, found: Inspection, pending: DataFrame, config: Config) -> DataFrame:
        """Batches with their blocks, neighbours in the chapter, title, first chapters of the book, and whether later chapters have anything to do."""
        plan = batches.plan_batches(pending, CHAPTER, config.chunk_size, self.limits).select(*CHAPTER, "block_idx", "batch_no")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", F.col("cache_key").alias("id"), F.col("source_html").alias("html")))), lambda b: F.struct(b["id"], b["html"]))
        numbered = pending.join(plan, [*CHAPTER, "block_idx"])
        ready = numbered.groupBy(*CHAPTER, "batch_no").agg(listed.alias("blocks"), F.min("block_idx").alias("lo"), F.max("block_idx").alias("hi"))
        near = batches.context_band(found.blocks, ready, CHAPTER, self.limits).groupBy(*CHAPTER, "batch_no").pivot("side", ["before", "after"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "snippet"))), lambda n: n["snippet"]))
        texts = found.chapters.where("include").join(blocks.memory_texts(found.blocks, CHAPTER), CHAPTER, "left").withColumn("memory_text", F.coalesce("memory_text", F.lit("")))
        first = memory.memory_sources(texts, ["book_path"]).groupBy("book_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chapter_path", "category", F.col("memory_text").alias("text")))), lambda c: F.struct(c["chapter_path"], c["category"], c["text"])).alias("sources"))
        last = pending.groupBy("book_path").agg(F.max("spine_idx").alias("last"))
        glossary = F.nullif(F.lit(config.locked_glossary.strip()), F.lit("")).alias("locked_glossary")
        joined = ready.join(near, [*CHAPTER, "batch_no"], "left").join(found.chapters.select(*CHAPTER, "title"), CHAPTER).join(first, "book_path", "left").join(last, "book_path")
        context = F.struct("title", "before", "after", F.lit(config.target_language).alias("language"), glossary)
        return joined.select(*CHAPTER, "batch_no", "blocks", context.alias("context"), "sources", (F.col("spine_idx") < F.col("last")).alias("pending_later"))

    def translate(self, found: Inspection, config: Config, output_dir: str, tag: str = "quire-translate") -> DataFrame:
        """Translates what the cache lacks, then writes the books; returns book_path, output_path and committed.

        Batches go in slices of about ten seconds, each a job of its own. What a slice has done is stored when it ends, so it counts
        once, whatever tasks were run again; and it is in the cache after the run, however the run ends. The states of all books' jobs
        are a table: they are saved at the start, after slices, and at the end, whatever it is. A checkpoint of an earlier run only
        tells how many blocks were resumed; what is reused comes from the cache.
        """
        tag, stop = self._begin(tag, output_dir)
        store = Checkpoints(self.spark, self.checkpoint_path, self.clock, f"{self.work_path}/saves")
        progress: Progress | None = None
        self.elapsed_ms = {}
        try:
            with self._timed("plan"):
                self._absorb()  # of a run whose driver was lost
                selected = found.chapters.where("include").select(*CHAPTER)
                keyed = self._stored(self._keyed(found.blocks.join(selected, CHAPTER), config))
                config.require_runnable(selected.count(), keyed.count())
                # equal blocks of a key are sent once; results are the same
                pending = self._stored(cache.pending_blocks(keyed, cache.lookup(self.spark, self.cache_path, keyed)))
                progress = Progress(self._stored(self._jobs(found, keyed, pending, output_dir, config)), pending, self._stored)
                store.report(progress.states("running"), force=True)
                plan = self._planned(found, pending.dropDuplicates(["cache_key"]), config)
            run = Run(
                self.translator, config.max_concurrent, config.max_retries, config.retry_delay_seconds, config.target_language if config.residual_quality_check else None,
                stop, self.first_memory, self.chapter_memory,
            )
            try:
                with self._timed("translate"):
                    for done in self._slices(plan, run):
                        progress.add(done)
                        store.report(progress.states("running"))
            finally:
                self._absorb()
            with self._timed("write"):
                translated = cache.probe(keyed.drop("translated_html"), cache.lookup(self.spark, self.cache_path, keyed))
                chapters = found.chapters.where("include").select(*CHAPTER, "html")
                rendered = html_blocks.render_chapters(chapters, translated, CHAPTER, config.bilingual)
                outputs = found.entries.select("book_path").distinct().withColumn("output_path", output_path(F.regexp_replace("book_path", "^file:/+", "/"), F.lit(output_dir), F.lit(config.output_suffix)))
                written = epub.write_books(found.entries, rendered.select("book_path", "spine_idx", F.col("chapter_path").alias("member_path"), F.col("rendered").alias("html")), outputs, lambda: not stop(), self.storage)
                result = self._stored(written)
            store.report(progress.states("cancelled" if stop() else "completed"), force=True)
            cache.compact(self.spark, self.cache_path)
            return result
        except BaseException:
            if progress:
                store.report(progress.states("cancelled" if stop() else "failed"), force=True)
            raise
        finally:
            store.close()
            self._end(tag, stop)

    @contextmanager
    def _timed(self, step: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.elapsed_ms[step] = int((self.clock() - began) * 1000)

    def _jobs(self, found: Inspection, keyed: DataFrame, pending: DataFrame, output_dir: str, config: Config) -> DataFrame:
        """A row for each book's job; cached blocks that an earlier, unfinished checkpoint already had count as resumed."""
        counts = keyed.groupBy("book_path").agg(F.count("*").alias("totalBlocks"), F.count_distinct("chapter_path").alias("totalFiles"))
        left = pending.groupBy("book_path").agg(F.count("*").alias("open"))
        before = read_checkpoints(self.spark, self.checkpoint_path).where(F.col("status").isin("running", "failed", "cancelled")).select("job_key", F.col("completedBlocks").alias("before"))
        jobs = self.job_keys(found, config).join(counts, "book_path").join(left, "book_path", "left").join(before, "job_key", "left")
        cached = F.col("totalBlocks") - F.coalesce("open", F.lit(0))
        resumed = F.least(F.coalesce("before", F.lit(0)), cached)
        return jobs.select(
            "book_path", F.col("job_key").alias("jobKey"), F.col("fingerprint").alias("inputFingerprint"), F.col("book_path").alias("inputPath"), F.lit(output_dir).alias("outputPath"), F.lit("").alias("currentChapter"),
            "totalFiles", "totalBlocks", (cached - resumed).alias("cachedBlocks"), resumed.alias("resumedBlocks"),
        )

    def _slices(self, plan: DataFrame, run: Run) -> Iterator[DataFrame]:
        """Runs the batches slice by slice, each as large as ten seconds allow at the speed of the one before; yields what each has done.

        A slice is a part of the batches by hash. With a book's memory, it is the next pending chapters of each book, and the
        memory that they leave goes on to the next slice.
        """
        remembers = bool(run.first_memory or run.chapter_memory)
        if remembers:
            turns = plan.select("book_path", "spine_idx").distinct().withColumn("at", F.row_number().over(Window.partitionBy("book_path").orderBy("spine_idx")) - 1.0)
            plan = plan.join(turns, ["book_path", "spine_idx"])
        else:
            plan = plan.withColumn("at", F.pmod(F.xxhash64(*CHAPTER, "batch_no"), F.lit(1 << 30)) / float(1 << 30))
        plan = self._stored(plan.repartitionByRange("at").sortWithinPartitions("at"))
        n, most = plan.agg(F.count("*"), F.max("at")).first()
        first, end = (1.0, (most or 0.0) + 1.0) if remembers else (run.concurrency * FIRST_BATCHES / max(n, 1), 1.0)
        begin, size, memories, folder = 0.0, first, None, f"{self.work_path}/results/{uuid.uuid4().hex}"
        while n and begin < end:
            if run.stopped():
                raise Cancelled
            began = time.monotonic()
            part = plan.where((F.col("at") >= begin) & (F.col("at") < begin + size))
            if remembers and memories is not None:
                part = part.join(memories, "book_path", "left")
            work = translate_books(part, run) if remembers else translate_batches(part, run).withColumn("memory", F.lit(None).cast("string"))
            work.write.parquet(path := f"{folder}/{begin:.9f}")
            done = self.spark.read.schema(FINISHED).parquet(path)
            if remembers:
                left = done.where("block_id is null").select(F.col("chapter_path").alias("book_path"), "memory")
                memories = left if memories is None else self._stored(left.unionByName(memories.join(left, "book_path", "left_anti")))
            yield done.where("block_id is not null").select(F.col("block_id").alias("cache_key"))
            begin += size
            size = max(first, size * min(8.0, SLICE_SECONDS / (time.monotonic() - began)))
            size = float(int(size)) if remembers else size

    def _absorb(self) -> None:
        """Moves what slices have done into the cache, in one append."""
        folder = f"{self.work_path}/results"
        try:
            done = self.spark.read.schema(FINISHED).option("recursiveFileLookup", "true").parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        cache.write_cache(done.where("block_id is not null").select(F.col("block_id").alias("cache_key"), "translated_html", F.current_timestamp().alias("written_at")), self.cache_path)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, key: str) -> None:
        """Forgets the checkpoint of a job."""
        clear_checkpoint(self.spark, self.checkpoint_path, key)

    def retry(self, job: dict, config: Config, output_dir: str) -> tuple[Inspection, DataFrame | None]:
        """A job of the history again: it is inspected, and translated too if it was a translation and chapters are selected."""
        found = self.inspect(job["inputPath"])
        was = "translation" in job.get("phase", "").lower() or any(job.get(c, 0) for c in ("completedBlocks", "cachedBlocks", "resumedBlocks"))
        ready = was and found.chapters.where("include").limit(1).count() > 0
        return found, self.translate(found, config, output_dir) if ready else None

    def recover(self, message: str, job: dict, config: Config, output_dir: str) -> tuple[str | None, Config, object]:
        """(action, settings to go on with, what a retry gave) for an error of a job."""
        action = self.spark.range(1).select(error_action(F.lit(message))).first()[0]
        if action == "reduceConcurrency":
            return action, config.fewer_at_once(), None
        if action == "retryTranslation":
            return action, config, self.retry(job, config, output_dir)
        if action == "retryInspection":
            return action, config, self.inspect(job["inputPath"])
        return action, config, None


class Progress:
    """How far the jobs of a run are, as tables: nothing of it is gathered on the driver."""

    def __init__(self, jobs: DataFrame, pending: DataFrame, stored: Callable[[DataFrame], DataFrame]):
        self.jobs, self.pending, self.stored = jobs, pending.select("book_path", "cache_key"), stored
        self.done: DataFrame | None = None  # book_path, done

    def add(self, keys: DataFrame) -> None:
        """These keys (cache_key) are done: so are all blocks of them, in whatever books."""
        counts = self.pending.join(keys, "cache_key").groupBy("book_path").agg(F.count("*").alias("done"))
        both = counts if self.done is None else counts.unionByName(self.done).groupBy("book_path").agg(F.sum("done").alias("done"))
        self.done = self.stored(both)

    def states(self, status: str) -> DataFrame:
        """A checkpoint of each job, but for its time."""
        known = self.jobs.withColumn("done", F.lit(0).cast("long")) if self.done is None else self.jobs.join(self.done, "book_path", "left")
        over = F.lit(status == "completed")
        blocks = F.when(over, F.col("totalBlocks")).otherwise(F.col("cachedBlocks") + F.col("resumedBlocks") + F.coalesce("done", F.lit(0)))
        return known.select(*(c for c in self.jobs.columns if c != "book_path"), F.lit(status).alias("status"), blocks.alias("completedBlocks"), F.when(over, F.col("totalFiles")).otherwise(0).alias("completedFiles"))
