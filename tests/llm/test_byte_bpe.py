"""Byte-level BPE against the library, and a plain merge loop."""

import os
import random

import public_tokenizers
import pytest
import tiktoken

from quire.llm import byte_bpe
from quire.llm.byte_bpe import Encoder, PairTree, decode, encode, read_ranks
from quire.llm.queries import op13_byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def plain_merges(piece, ranks):
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return parts
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_tree_merges_the_leftmost_least_pair():
    draw = random.Random(2)
    ranks = {bytes([c]): c for c in range(97, 101)} | {t: 200 + k for k, t in enumerate([b"ab", b"ba", b"aa", b"abab", b"baa", b"cd", b"abcd", b"aaa", b"dcd"])}
    for _ in range(500):
        piece = bytes(draw.choices(b"abcd", k=draw.randrange(1, 40)))
        tree = PairTree(piece, ranks, list(range(256)))
        while tree.merge(1):
            live = [k for k in range(tree.n - 1) if tree.least[tree.leaves + k] < byte_bpe.NO_PAIR]
            assert tree.least[1] == min((tree.least[tree.leaves + k] for k in live), default=byte_bpe.NO_PAIR)
        assert tree.tokens() == [ranks[t] for t in plain_merges(piece, ranks)]


def test_every_character_as_the_library(library):
    coder = Encoder(PATH, public_tokenizers.PATTERN)
    for c in range(0, 0x30000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}.\n"
            assert list(coder.encode(text)) == library.encode_ordinary(text)


def test_long_pieces(library):
    coder = Encoder(PATH, public_tokenizers.PATTERN)
    for text in ("x" * 30_001, "abé" * 9_000, " " * 20_000 + "a", "=-" * 8_000, "\n" * 5_000):
        assert list(coder.encode(text)) == library.encode_ordinary(text)


def test_texts_beyond_the_limit_of_a_list(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG", 50)
    coder = Encoder(PATH, public_tokenizers.PATTERN)
    for text in ("one two three, " * 30, "short", "x" * 50, "x" * 49):
        assert list(coder.encode(text)) == library.encode_ordinary(text)


def test_kept_pieces_are_bounded(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 10)
    coder = Encoder(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"word{k} {'long' * 30}{k}" for k in range(200))
    assert list(coder.encode(text)) == library.encode_ordinary(text)
    assert len(coder) + len(coder.older) <= 10 and all(len(p) <= byte_bpe.SHORT for p in coder)


def test_table(spark, library):
    texts = [None, "", "a", "<|endoftext|>", "one  two\r\n three", "one  two\r\n three", "中文 и русский", "\x00\x1c\x85", "don't I'LL 12 345"]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, ids string, source string")
    rows = sorted(decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows] == [None if t is None else library.encode_ordinary(t) for t in texts]
    assert [None if r.decoded is None else bytes(r.decoded).decode() for r in rows] == texts
    assert [r.source for r in rows] == ["y"] * len(texts)
    assert encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_query(spark, library):
    import hashlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in op13_byte_bpe(spark, DATA).collect()} == want
