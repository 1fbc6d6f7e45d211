"""Removed spans against a dictionary of all windows."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.suffix_dedup import pieces, prefix_keys, remove, remove_repeats, sliding_min


def brute(texts, depth):
    seen = {}
    for k, t in enumerate(texts):
        for p in range(len(t) - depth + 1):
            seen.setdefault(t[p : p + depth], []).append((k, p))
    covered = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                covered[k][p : p + depth] = True
    out = []
    for t, c in zip(texts, covered, strict=True):
        kept = bytes(b for b, x in zip(t, c, strict=True) if not x)
        runs = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((len(t), int(c.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "ä", "the", "of", "x"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(5, 300))) for _ in range(14)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts = base + [base[0], base[1][:400] + " edit " + base[1][400:], "q " + passage + " r", "s " + passage, passage[7:] + base[2], "a" * 900, "ab" * 300, "", None, base[3] + base[3], base[4][1:]]
    rows = [(k, t, "clash", 1.0) for k, t in enumerate(texts)] + [(None, base[5], "n", None), (None, passage, "n", None), (6, base[6], "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, h double")
    for depth, gram in ((120, 40), (80, 30), (33, 32), (16, 2)):
        want = brute([(r[1] or "").encode() for r in rows], depth)
        got = remove_repeats(docs, depth, gram).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted((str(i[0]), *w) for i, w in zip(rows, want, strict=True))


def test_query_goes_by_400_bytes_and_not_by_words(spark, tmp_path):
    """All passages have over 50 words; n_bytes is the input's length, whatever is removed."""
    from quire.llm.queries import op1_suffix_dedup

    passage = lambda mark, n: " ".join(f"{mark}{k:03d}" for k in range(100))[:n]
    short, exact, twice = passage("p", 399), passage("q", 400), passage("ä", 400)
    texts = [f"{a}{t}{a}" for t in (short, exact) for a in "01"] + [f"2{twice}2 3{twice}3"]
    assert all(len(t.split()) > 50 for t in (short, exact, twice))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.text) for r in got] == [
        (401, 0, 0, texts[0]), (401, 0, 0, texts[1]), (402, 400, 1, "00"), (402, 400, 1, "11"), (len(texts[4].encode()), 2 * len(twice.encode()), 2, "22 33"),
    ]
    assert [r.kept_sha256 for r in got] == [w[3] for w in brute([t.encode() for t in texts], 400)]


def test_small_blocks_and_buckets(spark, monkeypatch):
    """Groups that reach over many blocks, and more buckets than prefixes."""
    import quire.llm.suffix_dedup as m

    rng = random.Random(4)
    shared = bytes(rng.randrange(97, 123) for _ in range(90)).decode()
    rows = [(k, "".join(rng.choice("abc") for _ in range(30)) + shared[k % 7 :] + "".join(rng.choice("xyz") for _ in range(k))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted((k, *w) for (k, _), w in zip(rows, brute([t.encode() for _, t in rows], 40), strict=True))
    monkeypatch.setattr(m, "LEAST_BUCKETS", 500)
    settled, blocks = m.sieve(m.text_rows(docs), 40, 13)
    assert blocks.count() > 1
    assert sorted(tuple(r) for r in remove_repeats(docs, 40, 13).collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 12))
def test_prefix_keys_group_as_the_bytes_do(raw, length):
    starts = np.arange(max(0, len(raw) - length + 1))
    for wide in (False, True):
        keys = prefix_keys(np.frombuffer(raw, np.uint8), starts, length, wide)
        assert len({tuple(k) for k in keys.tolist()}) == len({raw[s : s + length] for s in starts.tolist()})


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_sliding_min(values, width):
    x = np.array(values, np.uint64)
    want = [min(values[k : k + width]) for k in range(len(values) - width + 1)]
    if want:
        assert sliding_min(x, width).tolist() == want


def test_pieces_hold_each_window_once(monkeypatch):
    import quire.llm.suffix_dedup as m

    monkeypatch.setattr(m, "CHUNK", 100)
    texts = [bytes(range(256)) * 2, b"short", b""]
    found = {}
    for chunk in pieces(texts, 30):
        for k, at, part in chunk:
            for p in range(max(0, len(part) - 29)):
                found[(k, at + p)] = found.get((k, at + p), 0) + 1
    assert found == {(0, p): 1 for p in range(512 - 29)}


def test_remove_merges_touching_spans():
    spans = [{"start": 2, "stop": 4}, {"start": 4, "stop": 6}, {"start": 8, "stop": 9}]
    assert remove(b"0123456789", spans) == (b"01679", 2)
    assert remove(b"abc", None) == (b"abc", 0)
