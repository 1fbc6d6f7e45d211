"""Suffix-array dedup: a depth-limited radix sort of suffixes, from the most significant digit on.

Suffixes (one starts at each byte) are ordered only through `depth` bytes; those that are equal so far are exactly
the repeated windows.

The sort. A suffix's digits are its bytes from its start: the first eighth of the depth, those up to the half, and the rest.
All suffixes start in one group; each pass splits the groups by the next digit, so a group is a common prefix. A
suffix alone in its group leaves; what is in a group of two or more after the last digit is repeated. Digits are
compared by hashes of the prefix that they end (64 bits, in the last pass 128), so the order of groups is that of hashes, not
of the alphabet. Suffixes are held in blocks. A block asks once for each of its distinct prefixes, whatever number of suffixes
has it, at the bucket of its hash; buckets only say which prefixes there are two of. So neither a hot prefix nor
a hot passage loads one task with more than a row from each block.

The sieve. Most suffixes of a corpus are alone, so before the sort those leave that can be told to be: in the first `depth` bytes
of a suffix, take the least gram (by hash, leftmost). Neighbours share it, so a run of suffixes is one row, and
suffixes that are equal through `depth` have equal least grams at equal places. Runs whose gram occurs once leave. Runs
with equal bytes under all of their suffixes are decided at once, and one of them goes on to the sort as a partner for
the others. Only runs whose gram stands in unlike surroundings are sorted.

Defined cases: null text counts as empty; texts shorter than `depth` have no windows; repeated rows (also equal
doc_ids, or null ones) count as further places; equal rows get equal results; empty tables give no rows; other
columns are ignored. Windows never cross documents. Whole texts are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored, text_bytes
from quire.llm.word_hashes import BASE, BASE_INVERSE, finish, powers

DEPTH = 400
GRAM = 100
#: Ends of the digits, as shares of the depth: the first eighth, up to the half, the whole.
DIGITS = (1, 4, 8)
#: Suffixes of a block.
BLOCK_SUFFIXES = 400_000
#: Suffixes that one bucket is meant to hold, and buckets of small inputs.
BUCKET_SUFFIXES, LEAST_BUCKETS = 1_000_000, 32
#: Primes below 2^31, and bases, of the hashes that are added for the last digit.
PRIMES = ((2147483647, 1540483477), (2147483629, 1103515245))
#: Suffixes whose first digits are found at once.
CHUNK = 1_000_000
PLACE_BITS = 24

RUNS = "doc_id long, h long, gram long, hull binary, anchor long, low int, high int"
BLOCKS = "block long, n long, doc_ids binary, known binary, hs binary, starts binary, counts binary, settled binary, raw binary"
QUESTIONS = "bucket int, block long, n int, keys binary, twice binary, active binary"
ANSWERS = "block long, bucket int, n int, repeated binary, active binary"
SPANS = "doc_id long, h long, start long, stop long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours (len(x) - width + 1 of them), from minima within blocks."""
    n = len(x)
    filled = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    up = np.minimum.accumulate(filled, axis=1).ravel()
    down = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - width + 1], up[width - 1 : n])


def first_digits(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs (text index, gram hash, anchor, first and last suffix) of concatenated texts; starts and stops: theirs in raw."""
    none = np.zeros(0, np.int64)
    if len(raw) < depth:
        return none, none.astype(np.uint64), none, none, none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64)])
    hashes = finish((sums[gram:] - sums[:-gram]) * powers(BASE_INVERSE, len(raw))[: len(raw) - gram + 1])
    place = np.uint64((1 << PLACE_BITS) - 1)
    best = sliding_min(hashes & ~place | np.arange(len(hashes), dtype=np.uint64), depth - gram + 1)
    long = stops - starts >= depth
    counts = np.where(long, stops - starts - depth + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    suffix = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    anchor = (best[suffix] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(suffix) else none
    last = np.append(new[1:], len(suffix)) - 1 if len(new) else none
    return text[new], hashes[anchor[new]], anchor[new], suffix[new], suffix[last]


def pieces(texts: list[bytes], depth: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Chunks of (text index, offset in the text, bytes); a long text is cut so that each suffix is in one piece."""
    chunk, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - depth + 1), CHUNK):
            part = t[at : at + CHUNK + depth - 1] if len(t) > CHUNK else t
            if size and size + len(part) > CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append((k, at, part))
            size += len(part)
            if len(t) <= CHUNK:
                break
    if chunk:
        yield chunk


def _runs(depth: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                ids, marks = part.column("doc_id"), part.column("h").to_numpy()
                texts = [t.as_py() for t in part.column("text")]
                for chunk in pieces(texts, depth):
                    joined = b"".join(p for _, _, p in chunk)
                    stops = np.cumsum([len(p) for _, _, p in chunk])
                    starts = stops - np.array([len(p) for _, _, p in chunk])
                    k, hashes, anchor, first, last = first_digits(np.frombuffer(joined, np.uint8), starts, stops, depth, gram)
                    if not len(k):
                        continue
                    low, high = anchor - last, anchor - first
                    digest = xxhash.xxh3_128_digest
                    hulls = [digest(joined[a : b + depth], seed=s) for a, b, s in zip(first.tolist(), last.tolist(), (low << 20 | high).tolist(), strict=True)]
                    owner = np.array([c[0] for c in chunk])[k]
                    place = anchor - starts[k] + np.array([c[1] for c in chunk])[k]
                    yield pa.record_batch(
                        [ids.take(pa.array(owner)), pa.array(marks[owner]), pa.array(hashes.view(np.int64)), pa.array(hulls, pa.binary()), pa.array(place), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                        names=["doc_id", "h", "gram", "hull", "anchor", "low", "high"],
                    )

    return runs


class Block(NamedTuple):
    """Suffixes of many open runs, run by run, each in the order of its text."""

    block: int
    n: int  # suffixes
    doc_ids: bytes  # of the runs
    known: bytes
    hs: bytes
    starts: bytes  # place of the first suffix in its text
    counts: bytes  # suffixes
    settled: bytes
    raw: bytes  # counts[k] + depth - 1 bytes of each run


def task_number() -> int:
    """Number of the task's partition, so that blocks are told apart (they are stored at once)."""
    return TaskContext.get().partitionId()


def _blocks(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the open runs, with the bytes under their suffixes."""

    def pack(runs: list[tuple], no: int) -> pa.RecordBatch:
        doc_ids, hs, starts, counts, settled, raws = zip(*runs, strict=True)
        known = np.array([d is not None for d in doc_ids], np.uint8)
        n = np.array(counts, np.int64)
        b = Block(
            (task_number() << 33) + no, int(n.sum()), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), known.tobytes(), np.array(hs, np.int64).tobytes(), np.array(starts, np.int64).tobytes(),
            n.tobytes(), np.array(settled, np.uint8).tobytes(), b"".join(raws),
        )
        return pa.record_batch([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in b], names=list(Block._fields))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = no = 0
        for batch in batches:
            for doc_id, h, text, runs in zip(*(batch.column(c) for c in ("doc_id", "h", "text", "runs")), strict=True):
                raw = text.as_py()
                for r in runs.as_py():
                    first = r["anchor"] - r["high"]
                    n = r["high"] - r["low"] + 1
                    held.append((doc_id.as_py(), h.as_py(), first, n, r["settled"], raw[first : first + n + depth - 1]))
                    size += n
                    if size >= BLOCK_SUFFIXES:
                        yield pack(held, no)
                        held, size, no = [], 0, no + 1
        if held:
            yield pack(held, no)

    return blocks


def starts_of(counts: np.ndarray, depth: int) -> np.ndarray:
    """Where each suffix starts in a block's bytes."""
    lengths = counts + depth - 1
    ends = np.cumsum(counts)
    return np.arange(counts.sum()) + np.repeat(np.cumsum(lengths) - lengths - (ends - counts), counts)


def prefix_keys(raw: np.ndarray, starts: np.ndarray, length: int, wide: bool) -> np.ndarray:
    """Hashes of the first `length` bytes of suffixes: one column of 64 bits; if wide, a second with two hashes modulo primes."""
    x = raw.astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, len(raw)), dtype=np.uint64)])
    columns = [finish((sums[starts + length] - sums[starts]) * powers(BASE_INVERSE, len(raw))[starts])]
    if wide:
        parts = []
        for prime, base in PRIMES:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers_modulo(base, len(raw), prime) % np.uint64(prime), dtype=np.uint64)]) % np.uint64(prime)
            parts.append((sums[starts + length] + np.uint64(prime) - sums[starts]) * powers_modulo(pow(base, -1, prime), len(raw), prime)[starts] % np.uint64(prime))
        columns.append(parts[0] << np.uint64(32) | parts[1])
    return np.stack(columns, axis=1)


def powers_modulo(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def group_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the keys, first place of each distinct key in this order)."""
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


class Pass:
    """One pass over one block: the digits up to `length` of its suffixes that are still in a group."""

    def __init__(self, block: Block, active: np.ndarray, length: int, depth: int):
        self.block, self.active = block, active
        self.counts = np.frombuffer(block.counts, np.int64)
        starts = starts_of(self.counts, depth)[active]
        self.keys = prefix_keys(np.frombuffer(block.raw, np.uint8), starts, length, length == depth)
        self.order, self.first = group_keys(self.keys)
        # a settled run stands for two or more
        self.settled = np.repeat(np.frombuffer(block.settled, np.uint8), self.counts)[active]

    def questions(self, n_buckets: int) -> list[dict]:
        """A row for each bucket with the block's distinct keys, in order, and whether each is there twice; and a row with the active suffixes."""
        rows = [{"bucket": self.block.block % n_buckets, "block": self.block.block, "active": np.packbits(self.active).tobytes()}]
        if not len(self.keys):
            return rows
        twice = np.add.reduceat((self.settled + 1).astype(np.int64)[self.order], self.first) > 1
        keys = self.keys[self.order][self.first]
        bucket = (keys[:, 0] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
        used, begin = np.unique(bucket, return_index=True)  # keys are in order, so buckets are; only those that occur count
        ends = np.append(begin[1:], len(keys))
        for b, start, stop in zip(used.tolist(), begin.tolist(), ends.tolist(), strict=True):
            rows.append({"bucket": b, "block": self.block.block, "n": stop - start, "keys": keys[start:stop].tobytes(), "twice": np.packbits(twice[start:stop]).tobytes()})
        return rows

    def answered(self, repeated: np.ndarray) -> np.ndarray:
        """The suffixes whose group has two or more members, from an answer for each distinct key."""
        of_key = np.empty(len(self.keys), bool)
        of_key[self.order] = np.repeat(repeated, np.diff(np.append(self.first, len(self.keys))))
        out = self.active.copy()
        out[out] = of_key
        return out


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _ask(lengths: tuple[int, ...], n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The first pass: all suffixes are in one group."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(**row)
                yield from _table(QUESTIONS, Pass(block, np.ones(block.n, bool), lengths[0], lengths[-1]).questions(n_buckets)).to_batches()

    return ask


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Of one bucket: which keys of each block are there twice or more, in all blocks together."""
    rows = [r for r in asked.to_pylist() if r["keys"] is not None]
    out = [{"block": r["block"], "active": r["active"]} for r in asked.select(["block", "active"]).to_pylist() if r["active"] is not None]
    if rows:
        width = len(rows[0]["keys"]) // rows[0]["n"] // 8
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]).reshape(-1, width)
        weight = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=r["n"]) for r in rows]).astype(np.int64) + 1
        order, first = group_keys(keys)
        repeated = np.empty(len(keys), bool)
        repeated[order] = np.repeat(np.add.reduceat(weight[order], first) > 1, np.diff(np.append(first, len(keys))))
        ends = np.cumsum([r["n"] for r in rows]).tolist()
        out += [{"block": r["block"], "bucket": key[0].as_py(), "n": r["n"], "repeated": np.packbits(repeated[a:b]).tobytes()} for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True)]
    return _table(ANSWERS, out)


def _settle(block: pa.Table, answers: pa.Table, length: int, depth: int) -> tuple[Block, np.ndarray]:
    """A block and its suffixes that are left in groups after the pass that ended at `length`."""
    own = Block(**block.to_pylist()[0])
    rows = answers.to_pylist()
    active = next(np.unpackbits(np.frombuffer(r["active"], np.uint8), count=own.n).astype(bool) for r in rows if r["active"] is not None)
    told = sorted((r for r in rows if r["repeated"] is not None), key=lambda r: r["bucket"])
    if not told:
        return own, active
    repeated = np.concatenate([np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]) for r in told]).astype(bool)
    return own, Pass(own, active, length, depth).answered(repeated)


def _advance(lengths: tuple[int, ...], k: int, n_buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def advance(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        """Suffixes alone in their group leave; the others are asked about with the next digit."""
        own, active = _settle(block, answers, lengths[k], lengths[-1])
        return _table(QUESTIONS, Pass(own, active, lengths[k + 1], lengths[-1]).questions(n_buckets))

    return advance


def _finish(depth: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def spans(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        """What the suffixes cover that are in groups of two or more after the last digit."""
        own, active = _settle(block, answers, depth, depth)
        counts = np.frombuffer(own.counts, np.int64)
        active &= np.repeat(np.frombuffer(own.settled, np.uint8) == 0, counts)
        run = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(own.n) - np.repeat(np.cumsum(counts) - counts, counts) + np.frombuffer(own.starts, np.int64)[run]
        at = np.flatnonzero(active)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (run[at[1:]] != run[at[:-1]])
        first = at[new]
        last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1:])
        doc_ids = pa.array(np.frombuffer(own.doc_ids, np.int64)[run[first]], mask=np.frombuffer(own.known, np.uint8)[run[first]] == 0)
        return pa.table([doc_ids, pa.array(np.frombuffer(own.hs, np.int64)[run[first]]), pa.array(place[first]), pa.array(place[last] + depth)], names=["doc_id", "h", "start", "stop"])

    return spans


def sieve(rows: DataFrame, depth: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(spans under runs that are settled, blocks of the suffixes to be sorted). `rows`: doc_id, h (hash of the text), text (bytes)."""
    runs = stored(rows.where(F.octet_length("text") >= depth).mapInArrow(_runs(depth, gram), RUNS))
    grams = stored(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    runs = stored(runs.join(grams, "gram"))
    # equal bytes under all suffixes: settled at once if there are two; one of them goes on as a partner
    hulls = stored(runs.groupBy("gram", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "anchor", "low", "high")).alias("run")))
    spans = runs.join(stored(hulls.where("n > 1").select("gram", "hull")), ["gram", "hull"]).select("doc_id", "h", F.expr("anchor - high").cast("long").alias("start"), F.expr(f"anchor - low + {depth}").cast("long").alias("stop"))
    unclear = stored(hulls.groupBy("gram").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1").select("gram"))
    open_runs = hulls.join(unclear, "gram").select((F.col("n") > 1).alias("settled"), "run.*")
    per_text = stored(open_runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("anchor", "low", "high", "settled")).alias("runs")))
    with_text = per_text.join(rows.withColumnsRenamed({"doc_id": "d", "h": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    return spans, stored(with_text.select("doc_id", "h", "text", "runs").mapInArrow(_blocks(depth), BLOCKS))


def radix_spans(blocks: DataFrame, depth: int) -> DataFrame:
    """doc_id, h, start and stop of what the suffixes cover that equal another through `depth` bytes."""
    lengths = tuple(depth * part // DIGITS[-1] for part in DIGITS)
    n_buckets = max(LEAST_BUCKETS, (blocks.agg(F.sum("n")).first()[0] or 0) // BUCKET_SUFFIXES)
    asked = blocks.mapInArrow(_ask(lengths, n_buckets), QUESTIONS)
    for k in range(len(lengths)):
        answers = stored(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS))
        pair = blocks.groupBy("block").cogroup(answers.groupBy("block"))
        if k + 1 < len(lengths):
            asked = pair.applyInArrow(_advance(lengths, k, n_buckets), QUESTIONS)
    return pair.applyInArrow(_finish(depth), SPANS)


def text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_bytes()).alias("h"), text_bytes().alias("text"))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, h (hash of the text), start and stop (bytes): the spans under repeated windows, overlapping."""
    settled, blocks = sieve(text_rows(docs), depth, gram)
    return settled.union(radix_spans(blocks, depth))


def remove(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """(the bytes that no span covers, number of maximal removed runs)."""
    if not spans:
        return text, 0
    ordered = np.array(sorted((s["start"], s["stop"]) for s in spans), np.int64)
    reach = np.maximum.accumulate(ordered[:, 1])
    new = np.flatnonzero(np.concatenate([[True], ordered[1:, 0] > reach[:-1]]))
    starts, stops = ordered[new, 0].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist()
    kept = [text[a:b] for a, b in zip([0, *stops], [*starts, len(text)], strict=True)]
    return b"".join(kept), len(starts)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
            raw = text.as_py()
            kept, n = remove(raw, spans.as_py())
            out.append((doc_id.as_py(), len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text (bytes) and spans (array of start and stop, null: none) of each row."""
    per_text = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnsRenamed({"doc_id": "d", "h": "g"})
    return text_rows(docs).join(per_text, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select("doc_id", "text", "spans")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    return with_spans(docs, repeated_spans(docs, depth, gram)).mapInArrow(_removed, RESULT)
