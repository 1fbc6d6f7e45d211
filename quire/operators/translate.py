"""Batches through a pluggable transform, with retries, fallback and checks.

A translator is any callable that takes a list of {id, html} (and a context) and returns such a list. It runs inside
mapInPandas; results go to the content-addressed cache, so a task that runs twice does no harm.
"""

from __future__ import annotations

import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.codecs import read_chapter_memory, read_memory, write_memory
from quire.functions.html_tree import collapse, lock_structure, parse
from quire.functions.text import keeps_source
from quire.operators.memory import fold_book

Block = dict[str, str]
Translator = Callable[[list[Block], dict], list[Block]]


class ServiceError(Exception):
    """A failed request."""

    def __init__(self, status: int | None = None, retry_after: int | None = None):
        super().__init__(f"HTTP {status}")
        self.status, self.retry_after = status, retry_after


class Cancelled(Exception):
    """The run was cancelled; nothing is retried."""


def never() -> bool:
    return False


def no_sleep(seconds: float) -> None:
    """For services that are stand-ins: waits are counted only."""


@dataclass
class Retry:
    max_retries: int = 3
    delay: int = 5
    sleep: Callable[[float], None] = time.sleep
    cancelled: Callable[[], bool] = never
    waits: list[float] = field(default_factory=list)
    requests: int = 0  # that were sent

    def attempts(self, error: Exception) -> int:
        limited = isinstance(error, ServiceError) and error.status == 429
        return max(1, self.max_retries, 8 if limited else 1)

    def wait(self, error: Exception, attempt: int) -> float:
        if isinstance(error, ServiceError) and error.status == 429:
            if error.retry_after is not None:
                return min(120, max(0, error.retry_after))
            return min(90, max(5, self.delay) << min(attempt - 1, 4))
        return max(1, self.delay)

    def run(self, action: Callable[[], list[Block]]) -> list[Block]:
        """The action's result; retried unless it is too large (413) or the run is cancelled."""
        attempt = 1
        while True:
            if self.cancelled():
                raise Cancelled
            self.requests += 1
            try:
                return action()
            except Cancelled:
                raise
            except Exception as error:
                if falls_back(error) or attempt >= self.attempts(error):
                    raise
                seconds = self.wait(error, attempt)
                self.waits.append(seconds)
                while seconds > 0:  # a wait ends soon after a cancellation
                    if self.cancelled():
                        raise Cancelled from error
                    self.sleep(min(0.1, seconds))
                    seconds -= 0.1
                attempt += 1


def falls_back(error: Exception) -> bool:
    """Too large a request: its blocks go one by one, without retries."""
    return isinstance(error, ServiceError) and error.status == 413


def checked(blocks: list[Block], answer: list[Block], residual: Callable[[str, str], bool] | None) -> list[Block]:
    """The answer in order of the request, locked to the source's markup; ValueError if it isn't complete."""
    if len(answer) != len(blocks):
        raise ValueError("the answer has another number of blocks")
    by_id = {a.get("id"): a.get("html", "") for a in answer}
    out = []
    for b in blocks:
        html = by_id.get(b["id"])
        if not html or not html.strip():
            raise ValueError(f"no answer for {b['id']}")
        locked = lock_structure(b["html"], html)
        if residual and residual(b["html"], locked):
            raise ValueError(f"source text is left in {b['id']}")
        out.append({"id": b["id"], "html": locked})
    return out


def translate_batch(blocks: list[Block], context: dict, translator: Translator, retry: Retry, residual: Callable[[str, str], bool] | None = None) -> list[Block]:
    """A batch at once; if that is refused or stays incomplete, block by block.

    Each answer also tells how many requests its block was in (requests), how long they waited for another try (waited,
    seconds) and whether it went alone after its batch had failed (alone).
    """
    def answered(action: Callable[[], list[Block]], since: tuple[int, float] = (0, 0), alone: bool = False) -> list[Block]:
        sent, waited = retry.requests, sum(retry.waits)
        return [b | {"requests": since[0] + retry.requests - sent, "waited": int(since[1] + sum(retry.waits) - waited), "alone": alone} for b in retry.run(action)]

    try:
        return answered(lambda: checked(blocks, translator(blocks, context), residual))
    except (ServiceError, ValueError) as error:
        if len(blocks) == 1 or (isinstance(error, ServiceError) and not falls_back(error)):
            raise
        so_far = retry.requests, sum(retry.waits)
        return [b for one in blocks for b in answered(lambda one=one: checked([one], translator([one], context), residual), so_far, True)]


@dataclass(frozen=True)
class Run:
    """How a run translates: its transform, limits and checks. It goes to the tasks."""

    translator: Translator
    concurrency: int = 3  # requests side by side, in all tasks together
    max_retries: int = 3
    delay: int = 5
    language: str | None = None  # of the check for text that was left as it was; none: no check
    stopped: Callable[[], bool] = never
    first_memory: Callable[[list[dict]], dict] | None = None  # of a book's first chapters
    chapter_memory: Callable[[dict, dict], dict] | None = None  # of a chapter and the memory so far
    sleep: Callable[[float], None] = time.sleep

    def residual(self, source: str, translated: str) -> bool:
        return bool(self.language) and keeps_source(collapse(parse(source).text), collapse(parse(translated).text), self.language)

    def batch(self, blocks: list[Block], context: dict) -> list[Block]:
        return translate_batch(blocks, context, self.translator, Retry(self.max_retries, self.delay, self.sleep, self.stopped), self.residual if self.language else None)

    def lanes(self, slots: int) -> int:
        """Tasks among which the requests are dealt: no more than may be under way, nor than run at once."""
        return max(1, min(self.concurrency, slots))

    def share(self, lane: int, lanes: int) -> int:
        """Requests that this lane may have side by side; those of all lanes add up to `concurrency`."""
        return self.concurrency // lanes + (lane < self.concurrency % lanes)

    def batches(self, jobs: Iterator[tuple[list[Block], dict]], side_by_side: int) -> Iterator[list[Block]]:
        """Results in order, with at most so many batches under way."""
        with ThreadPoolExecutor(side_by_side) as pool:
            under_way: deque = deque()
            try:
                for job in jobs:
                    if len(under_way) == side_by_side:
                        yield under_way.popleft().result()
                    under_way.append(pool.submit(self.batch, *job))
                while under_way:
                    yield under_way.popleft().result()
            finally:
                for left in under_way:
                    left.cancel()


def plain(value: object) -> object:
    """Rows and arrays as dicts and lists, without nulls."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, (list, tuple, np.ndarray)) else value


#: requests, waited (seconds) and alone are those of translate_batch().
DONE = "chapter_path string, batch_no long, block_id string, translated_html string, requests long, waited long, alone boolean"
COLUMNS = [field.split()[0] for field in DONE.split(", ")]


def _done(chapter: str, batch_no: int, blocks: list[Block]) -> pd.DataFrame:
    return pd.DataFrame([(chapter, batch_no, b["id"], b["html"], b["requests"], b["waited"], b["alone"]) for b in blocks], columns=COLUMNS)


def _job(row: dict, **more: object) -> tuple[list[Block], dict]:
    context = plain(row.get("context")) or {}
    return [{"id": b["id"], "html": b["html"]} for b in row["blocks"]], {"chapter": row["chapter_path"], **context, **more}


def _dealt(rows: DataFrame, run: Run, by: list[str], order: list[str]) -> tuple[DataFrame, int]:
    """Rows in as many partitions as the run has lanes, each with its rows in order.

    A stage has one task for each lane, so the lanes' shares bound the requests of the whole run, whatever
    the size of the cluster; a task that is run again has its lane's share again.
    """
    lanes = run.lanes(rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(lanes, *by).sortWithinPartitions(*order), lanes


def _records(parts: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for part in parts:
        yield from part.to_dict("records")


def _lane(run: Run, lanes: int) -> int:
    return run.share(TaskContext.get().partitionId() % lanes, lanes)


def translate_batches(batches: DataFrame, run: Run) -> DataFrame:
    """The columns of DONE; batches have blocks, an array of (id, html), and maybe context, a struct."""
    optional = [c for c in ("context",) if c in batches.columns]
    rows, lanes = _dealt(batches.select("chapter_path", "batch_no", "blocks", *optional), run, ["chapter_path", "batch_no"], ["chapter_path", "batch_no"])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: deque = deque()

        def jobs() -> Iterator[tuple[list[Block], dict]]:
            for row in _records(parts):
                asked.append((row["chapter_path"], row["batch_no"]))
                yield _job(row)

        for done in run.batches(jobs(), _lane(run, lanes)):
            yield _done(*asked.popleft(), done)

    return rows.mapInPandas(work, DONE)


def translate_books(batches: DataFrame, run: Run) -> DataFrame:
    """As translate_batches(), with a book's memory: a book's chapters follow one another, books go side by side.

    Batches also have book_path, spine_idx, pending_later (whether a later chapter has anything to do), sources, the
    chapters of the first memory, and maybe memory (JSON), what earlier chapters have left. Memory is made when the first
    batch needs it, goes into the context of each batch, and takes in each chapter that later ones can use. The result
    has a column memory besides: null, but for one row of each book (no block_id; book_path as its chapter_path) with
    the memory after its last chapter here. A task holds one chapter's batches at a time.
    """
    if "memory" not in batches.columns:
        batches = batches.withColumn("memory", F.lit(None).cast("string"))
    rows, lanes = _dealt(batches, run, ["book_path"], ["book_path", "spine_idx", "batch_no"])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side_by_side = _lane(run, lanes)
        for path, book in groupby(_records(parts), key=lambda r: r["book_path"]):
            memory = None
            for _, chapter in groupby(book, key=lambda r: r["spine_idx"]):
                chapter = list(chapter)
                head = chapter[0]
                if memory is None:
                    first = head["memory"]
                    if first is None and run.first_memory:
                        first = json.dumps(run.first_memory(plain(head["sources"]) or []))
                    memory = read_memory(first)
                done = list(run.batches((_job(r, memory=memory) for r in chapter), side_by_side))
                yield pd.concat([_done(r["chapter_path"], r["batch_no"], d) for r, d in zip(chapter, done, strict=True)]).assign(memory=None)
                if run.chapter_memory and head["pending_later"]:
                    text = " ".join(collapse(parse(b["html"]).text) for d in done for b in d)
                    made = run.chapter_memory({"chapter": head["chapter_path"], **(plain(head.get("context")) or {}), "text": text}, memory)
                    memory = fold_book(memory, read_chapter_memory(made))
            yield pd.DataFrame([(path, *[None] * (len(COLUMNS) - 1), write_memory(memory))], columns=[*COLUMNS, "memory"])

    return rows.mapInPandas(work, f"{DONE}, memory string")


def marking_translator(blocks: list[Block], context: dict) -> list[Block]:
    """A deterministic stand-in: texts in upper case inside their markup; character references stay as they are."""
    return [{"id": b["id"], "html": "".join(p if p.startswith(("<", "&")) else p.upper() for p in re.split("(<[^>]*>|&[#a-zA-Z0-9]+;)", b["html"]))} for b in blocks]


def listing_memory(sources: list[dict]) -> dict:
    """A deterministic stand-in for a book's first memory: its chapters' paths as the summary."""
    return {"bookSummary": ", ".join(s["chapter_path"] for s in sources)}


def counting_memory(chapter: dict, memory: dict) -> dict:
    """A deterministic stand-in for a chapter's memory: its length, and its first word as a term."""
    words = chapter["text"].split()
    return {"title": chapter["chapter"], "summary": f"{len(words)} words", "glossary": [{"source": words[0], "target": words[0].lower()}] if words else []}


class UnsteadyTranslator:
    """A deterministic stand-in for a service with faults, which follow from the chapter's number alone (modulo 6).

    1: the first two requests for a batch are refused as too many (429), the second time with a wait of 2 seconds; 2: batches
    of several blocks are too large (413); 3: they always leave the last block's answer blank; 4: only their first answer
    lacks a block; 5: the first request fails without a status. It counts requests within a task, so a task that runs again begins anew.
    """

    def __init__(self) -> None:
        self.asked: dict[tuple, int] = {}

    def __call__(self, blocks: list[Block], context: dict) -> list[Block]:
        key = context["chapter"], *(b["id"] for b in blocks)
        self.asked[key] = tries = self.asked.get(key, 0) + 1
        fault, several = int(context["chapter"]) % 6, len(blocks) > 1
        if fault == 1 and tries <= 2:
            raise ServiceError(429, 2 if tries == 2 else None)
        if fault == 2 and several:
            raise ServiceError(413)
        if fault == 5 and tries == 1:
            raise ServiceError
        answer = marking_translator(blocks, context)
        if fault == 3 and several:
            return [*answer[:-1], answer[-1] | {"html": " "}]
        return answer[1:] if fault == 4 and several and tries == 1 else answer
