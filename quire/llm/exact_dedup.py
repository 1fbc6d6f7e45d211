"""Exact dedup with a sharded cuckoo-filter index.

An index has one shard for each part of the digest space. A shard holds a cuckoo filter (16-bit
fingerprints, four to a bucket) and, bucketed with it, the content records of the live texts: SHA-256,
a second independent 64-bit hash and the byte length. A new digest is looked up in the filter first: a
miss is inserted without a look at the records; a hit is verified against them, and a false hit is
inserted as a text of its own. Deletion takes the record and one fingerprint. When an insertion finds no
room, the filter is made anew at twice the size from the stored records.

Defined cases: null text counts as empty; equal doc_ids with equal texts are counted as rows; a null
doc_id never beats another; empty tables give empty results; columns other than doc_id and text are
ignored; the text may have any length (only digests move).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, text_bytes

SLOTS = 4
MAX_KICKS = 200
#: Rows that a shard takes at once.
BATCH = 512
#: Live texts that one shard is meant to hold; the number of shards follows from it.
KEYS_PER_SHARD = 50_000
INDEX = "shard int, digest binary, check long, n_bytes long, keep_id long, copies long, n_buckets int, slots binary"
PARTIAL = "shard int, digest binary, check long, n_bytes long, keep_id long, copies long"


class CuckooFilter:
    """Partial-key cuckoo filter over 64-bit hashes, with batches as numpy arrays."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.n_buckets = n_buckets  # a power of two
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(n, 1) / (0.84 * SLOTS)))) if n else 4))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets."""
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (hashes & np.uint64(self.n_buckets - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)).astype(np.int64) & (self.n_buckets - 1))

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(hashes)
        return ((self.slots[one] == prints[:, None]) | (self.slots[two] == prints[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there was no room; the filter is then to be made anew from the stored keys."""
        prints, one, two = self.places(hashes)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            if not (self._put(a, p) or self._put(b, p) or self._kick(b, p)):
                return False
        return True

    def _put(self, bucket: int, fingerprint: int) -> bool:
        row = self.slots[bucket]
        for k in range(SLOTS):
            if row[k] == 0:
                row[k] = fingerprint
                return True
        return False

    def _kick(self, bucket: int, fingerprint: int) -> bool:
        for step in range(MAX_KICKS):
            slot = (fingerprint + step) % SLOTS
            fingerprint, self.slots[bucket, slot] = int(self.slots[bucket, slot]), fingerprint
            bucket = int(self.other(np.array([bucket]), np.array([fingerprint], np.uint16))[0])
            if self._put(bucket, fingerprint):
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        prints, one, two = self.places(hashes)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for bucket in (a, b):
                if (hit := np.flatnonzero(self.slots[bucket] == p)).size:
                    self.slots[bucket, hit[0]] = 0
                    break


def hashes_of(digests: list[bytes]) -> np.ndarray:
    """64 bits of each SHA-256 digest, other than those that choose the shard."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), ">u8").astype(np.uint64)


class Shard:
    """The filter and the content records of one shard, in one task."""

    def __init__(self, records: dict[bytes, list], cuckoo: CuckooFilter | None):
        self.records, self.cuckoo, self.lookups = records, cuckoo or CuckooFilter.for_keys(len(records)), 0
        if cuckoo is None and records:
            self.resize()

    @classmethod
    def read(cls, table: pa.Table) -> Shard:
        records, cuckoo = {}, None
        for r in table.to_pylist():
            if r["slots"] is not None:
                cuckoo = CuckooFilter(r["n_buckets"], np.frombuffer(r["slots"], np.uint16).reshape(-1, SLOTS).copy())
            else:
                records[r["digest"]] = [r["check"], r["n_bytes"], r["keep_id"], r["copies"]]
        return cls(records, cuckoo)

    def resize(self) -> None:
        """A new filter from the stored keys, twice as large until all fit."""
        size = max(self.cuckoo.n_buckets, CuckooFilter.for_keys(len(self.records)).n_buckets)
        keys = hashes_of(list(self.records))
        while not (fresh := CuckooFilter(size)).insert(keys):
            size *= 2
        self.cuckoo = fresh

    def insert(self, table: pa.Table) -> None:
        """Adds partial counts (a digest may come from many map tasks), batch by batch.

        Only within a batch are equal digests added up first. Whether one was seen in an earlier batch, or an earlier insertion, the
        filter says: a miss goes in without a look at the records, a hit is looked up and verified.
        """
        columns = table.select(["digest", "check", "n_bytes", "keep_id", "copies"])
        for begin in range(0, len(columns), BATCH):
            t = columns.slice(begin, BATCH).group_by(["digest", "check", "n_bytes"]).aggregate([("keep_id", "max"), ("copies", "sum")])
            if pc.count_distinct(t["digest"]).as_py() < len(t):
                raise ValueError("two texts share a SHA-256 digest")
            rows = t.to_pydict()
            hits = self.cuckoo.contains(hashes_of(rows["digest"])).tolist()
            new = []
            for hit, digest, *record in zip(hits, *(rows[c] for c in ("digest", "check", "n_bytes", "keep_id_max", "copies_sum")), strict=True):
                known = self.record(digest) if hit else None
                if known is None:  # a miss, or a false hit
                    self.records[digest] = record
                    new.append(digest)
                    continue
                if known[:2] != record[:2]:
                    raise ValueError("two texts share a SHA-256 digest")
                known[2] = max((x for x in (known[2], record[2]) if x is not None), default=None)
                known[3] += record[3]
            if new and not self.cuckoo.insert(hashes_of(new)):
                self.resize()

    def record(self, digest: bytes) -> list | None:
        """The content record of a digest that the filter holds."""
        self.lookups += 1
        return self.records.get(digest)

    def delete(self, digests: list[bytes]) -> None:
        gone = [d for d in dict.fromkeys(digests) if self.records.pop(d, None) is not None]
        self.cuckoo.delete(hashes_of(gone))

    def rows(self, shard: int) -> pa.Table:
        keys, values = list(self.records), list(self.records.values())
        columns = [[shard] * len(keys), keys, *([v[i] for v in values] for i in range(4)), [None] * len(keys), [None] * len(keys)]
        for column, last in zip(columns, [shard, None, None, None, None, None, self.cuckoo.n_buckets, self.cuckoo.slots.tobytes()], strict=True):
            column.append(last)
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["shard", "digest", "check", "n_bytes", "keep_id", "copies", "n_buckets", "slots"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digests(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, digest (SHA-256), check (second hash) and n_bytes of each row, and the columns `carried`."""
    text = text_bytes()
    return docs.select(*carried, F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch become one row with a count, so that a hot text doesn't load one shard."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["shard", "digest", "check", "n_bytes"]).aggregate([("doc_id", "max"), ("doc_id", "count", pc.CountOptions(mode="all"))])
        t = t.select(["shard", "digest", "check", "n_bytes", "doc_id_max", "doc_id_count"]).rename_columns(["shard", "digest", "check", "n_bytes", "keep_id", "copies"])
        yield from t.combine_chunks().to_batches()


def _insert(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
    shard = Shard.read(old)
    shard.insert(new)
    return shard.rows(key[0].as_py())


def _delete(key: tuple, old: pa.Table, gone: pa.Table) -> pa.Table:
    shard = Shard.read(old)
    shard.delete(gone["digest"].to_pylist())
    return shard.rows(key[0].as_py())


def _lookup(key: tuple, old: pa.Table, asked: pa.Table) -> pa.Table:
    shard, want = Shard.read(old), asked["digest"].to_pylist()
    hits = shard.cuckoo.contains(hashes_of(want)).tolist()
    found = [shard.record(d) if hit else None for d, hit in zip(want, hits, strict=True)]
    return pa.table({"doc_id": asked["doc_id"], "keep_id": pa.array([f and f[2] for f in found], pa.int64()), "copies": pa.array([f[3] if f else 0 for f in found], pa.int64())})


class CuckooIndex:
    """A stored index; insert and delete give a new one."""

    def __init__(self, spark: SparkSession, n_shards: int, table: DataFrame | None = None):
        self.spark, self.n_shards = spark, n_shards
        self.table = spark.createDataFrame([], INDEX) if table is None else table

    @classmethod
    def sized_for(cls, spark: SparkSession, n_keys: int, keys_per_shard: int = KEYS_PER_SHARD) -> CuckooIndex:
        return cls(spark, max(8, -(-n_keys // keys_per_shard)))

    def _sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.n_shards)).cast("int"))

    def _with(self, rows: DataFrame, change, schema: str = INDEX) -> DataFrame:
        return self.table.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(change, schema)

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """The index with all rows of digests() added."""
        partial = self._sharded(rows).select("shard", "digest", "check", "n_bytes", "doc_id").mapInArrow(_combine, PARTIAL)
        return CuckooIndex(self.spark, self.n_shards, stored(self._with(partial, _insert)))

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """The index without the texts of these rows of digests()."""
        return CuckooIndex(self.spark, self.n_shards, stored(self._with(self._sharded(rows).select("shard", "digest").distinct(), _delete)))

    def lookup(self, rows: DataFrame) -> DataFrame:
        """doc_id, keep_id (null: not live) and copies for each row of digests()."""
        return self._with(self._sharded(rows).select("shard", "digest", "doc_id"), _lookup, "doc_id long, keep_id long, copies long")

    def groups(self) -> DataFrame:
        """digest, keep_id and copies of each live text."""
        return self.table.where("slots is null").select("digest", "keep_id", "copies")


def exact_groups(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD, carried: tuple[str, ...] = ()) -> DataFrame:
    """`carried`, doc_id, keep_id, group_size, kept and text_sha256 for each row; the largest doc_id of a group stays.

    Of rows that share both text and doc_id, all carry kept. Rows alone need no join; those with copies
    get their group by a join whose hot keys Spark can split, as only the wide side is skewed.
    """
    rows = stored(digests(docs, *carried))
    groups = CuckooIndex.sized_for(docs.sparkSession, rows.count(), keys_per_shard).insert(rows).groups().where("copies > 1")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "digest", "left").select(*carried, "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
