"""Token files against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm.arrow_tokens import ChunkEncoder, open_arrow, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a\x1cb c", "x<|endoftext|>y z", "  é ́f g h\x85i", "İstanbul ΑΣ ΑΣ.", "it's we'll 12 3$$ 😀😀 a", "", "<|end", None, "Don't!! stop-me... (now)", "ẛ̣  x"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_files_and_index(spark, whole):
    rows = [(k * 7 % 101, ODD[k % len(ODD)] if k % 3 else f"word{k} " * (k * 9), "clash", 5) for k in range(101)] + [(500, "long text " * 20_000, "x", 1), (None, "no id", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int")
    manifest = write_tokens(docs, PATH, length=64).persist()
    got = read_tokens(manifest).collect()
    start, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text) + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    first = open_arrow(manifest.first().file)
    assert first.schema.field("ids").type == pa.list_(pa.uint16(), 64) and first.schema.field("mask").type == pa.list_(pa.bool_(), 64)
    masks = [m for f in manifest.collect() for k in range(open_arrow(f.file).num_record_batches) for m in open_arrow(f.file).get_batch(k).column("mask").flatten().to_pylist()]
    assert sum(masks) == start
    assert read_tokens(write_tokens(docs.limit(0), PATH)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabcdeé'’.,<|>12")), max_size=50))
def test_chunks_give_the_ids_of_the_whole_text(text):
    state = test_chunks_give_the_ids_of_the_whole_text.__dict__
    coder, t = state.setdefault("coder", ChunkEncoder(PATH)), state.setdefault("t", Tokenizer.from_file(PATH))
    assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == t.encode(text, add_special_tokens=False).ids
