"""The cuckoo index against plain sets, and op2's groups against brute force."""

import hashlib

from pyspark.sql import functions as F

from quire.llm.exact_dedup import CuckooFilter, CuckooIndex, Shard, digests, exact_groups, hashes_of

DOCS = "doc_id long, text string, keep_id string, digest int"


def keys(n, start=0):
    return [hashlib.sha256(str(k).encode()).digest() for k in range(start, start + n)]


def test_filter_has_no_false_negatives_and_forgets():
    cuckoo, ks = CuckooFilter.for_keys(5000), hashes_of(keys(5000))
    assert cuckoo.insert(ks) and cuckoo.contains(ks).all()
    assert cuckoo.contains(hashes_of(keys(20000, 10**6))).mean() < 0.01
    cuckoo.delete(ks[:2500])
    assert cuckoo.contains(ks[2500:]).all() and cuckoo.contains(ks[:2500]).mean() < 0.01


def test_overflow_resizes_from_the_stored_keys():
    import pyarrow as pa

    shard = Shard({}, None)
    before = shard.cuckoo.n_buckets
    n = 3000
    shard.insert(pa.table({"digest": pa.array(keys(n), pa.binary()), "check": [0] * n, "n_bytes": [1] * n, "keep_id": list(range(n)), "copies": [1] * n}))
    assert shard.cuckoo.n_buckets > before and shard.cuckoo.contains(hashes_of(keys(n))).all() and len(shard.records) == n


def test_the_filter_decides_what_is_looked_up():
    import pyarrow as pa

    n = 20_000
    table = lambda ks: pa.table({"digest": pa.array(ks, pa.binary()), "check": [0] * len(ks), "n_bytes": [1] * len(ks), "keep_id": list(range(len(ks))), "copies": [1] * len(ks)})
    shard = Shard({}, None)
    shard.insert(table(keys(n) + keys(n // 2)))  # the copies come in later batches
    assert len(shard.records) == n and n // 2 <= shard.lookups < 0.51 * n and sum(r[3] for r in shard.records.values()) == n + n // 2
    shard.lookups = 0
    shard.insert(table(keys(500)))
    assert shard.lookups == 500 and len(shard.records) == n


def test_a_filter_that_misses_spoils_the_counts(monkeypatch):
    """The filter alone tells a new text from a repeat in a later batch."""
    import numpy as np
    import pyarrow as pa

    texts = keys(2_000) * 4
    rows = pa.table({"digest": pa.array(texts, pa.binary()), "check": [0] * 8_000, "n_bytes": [1] * 8_000, "keep_id": list(range(8_000)), "copies": [1] * 8_000})
    counts = lambda s: sorted({r[3] for r in s.records.values()})
    shard = Shard({}, None)
    shard.insert(rows)
    assert counts(shard) == [4] and shard.lookups >= 6_000
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, hashes: np.zeros(len(hashes), bool))
    blind = Shard({}, None)
    blind.insert(rows)
    assert counts(blind) != [4] and blind.lookups == 0


def test_groups(spark):
    rows = [(k, f"t{k % 7}") for k in range(60)] + [(100, None), (101, ""), (102, "x" * 200_000), (103, "x" * 200_000), (None, "t1"), (5, "t5"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    want = {}
    for i, t in rows:
        want.setdefault(t or "", []).append(i)
    got = exact_groups(docs, keys_per_shard=3).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in want.items()}
    for r in got:
        group = by_sha[r.text_sha256]
        keep = max((g for g in group if g is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), r.doc_id == keep)
    assert exact_groups(docs.limit(0)).count() == 0


def test_index_insert_delete_lookup(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    rows = digests(docs)
    index = CuckooIndex.sized_for(spark, 50, 10).insert(rows.where("doc_id < 30")).insert(rows.where("doc_id between 20 and 39"))
    assert {r.doc_id for r in index.lookup(rows).where("copies > 0").collect()} == set(range(40))
    assert index.lookup(rows.where("doc_id = 25")).first().copies == 2
    index = index.delete(rows.where("doc_id < 10"))
    assert {r.doc_id for r in index.lookup(rows).where("copies > 0").collect()} == set(range(10, 40))
    again = index.insert(rows.where("doc_id = 3"))
    assert again.lookup(rows.where("doc_id = 3")).first().keep_id == 3
    assert again.groups().agg(F.count("*")).first()[0] == 31
