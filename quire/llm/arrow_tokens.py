"""Token ids in Arrow IPC files with fixed-size-list batches.

Each range of doc_ids becomes one Arrow file in the shared folder: its documents' ids, each document ended by
`end_id`, one after another in ascending doc_id order, cut into sequences of `length`; column `ids` is
fixed_size_list<uint16> where the vocabulary allows it, else uint32; column `mask` is fixed_size_list<bool>
(true: an id, false: the padding of a file's last sequence). As all sequences are equally long, the id at place p of a file is found by arithmetic, and a
batch is read as a zero-copy view of a memory map (or of one ranged read). Beside it, an index file has doc_id, start (in
the file) and n_tokens. A manifest table names the files of the task attempts that succeeded; files of lost
attempts are in no manifest.

Text is encoded with the tokenizers library. The tokenizer drops white space and never joins across it,
so a text's ids are those of its white-space-delimited chunks in order. A worker encodes a chunk once and keeps its ids,
from task to task, up to a number of chunks.

Defined cases: null text counts as empty (its document has the end id alone); null doc_ids come first;
equal doc_ids are in order of their texts; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import shared_dir, stored

LENGTH = 1024
#: Sequences of one record batch.
BATCH = 128
END_ID = 1
MANIFEST = "part int, file string, n_tokens long, n_docs long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000
#: Chunks whose ids a worker keeps.
KEPT_CHUNKS = 500_000
KEPT_WORDS = 300_000
JOINT = "<|endoftext|>"


def slices(batch: pa.RecordBatch, limit: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of consecutive rows with about `limit` characters together."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class ChunkEncoder:
    """Encodes texts chunk by chunk; gives little-endian ids of `kind` as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.kept, self.words = Tokenizer.from_file(path), {}, {}
        # the same model for words in normal form that spaces part
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.joint = self.tokenizer.token_to_id(JOINT)
        self.ends_word = np.array([bool(w) and w.endswith("</w>") for w in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))])
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    #: Letters without marks, then perhaps signs (no apostrophe, which may bind letters): one or two words of the tokenizer,
    #: which lower case makes its normal form.
    SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&()*+,./:;=?@_|-]+)?")

    @staticmethod
    def chunks(text: str) -> list[str]:
        # str.split() also splits at the four ASCII separators, which the tokenizer takes for symbols
        return [c for c in re.split("[ \t\n\r]+", text) if c] if re.search("[\x1c-\x1f]", text) else text.split()

    def _learn_words(self, words: list[str]) -> None:
        """Ids of words in normal form; where each ends shows in its last piece."""
        for at in range(0, len(words), 500):
            group = words[at : at + 500]
            ids = np.array(self.bare.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.kind)
            stops = (self.kind.itemsize * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for w, a, b in zip(group, [0, *stops[:-1]], stops, strict=True):
                self.words[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        if len(self.kept) > KEPT_CHUNKS:
            self.kept.clear()
        self._learn([c for c in set(chain.from_iterable(split)) if c not in self.kept])
        ids = self.kept.__getitem__
        return [b"".join(map(ids, chunks)) for chunks in split]

    def _learn(self, chunks: list[str]) -> None:
        simple, other, of = [], [], self.SIMPLE.fullmatch
        for c in chunks:
            if m := of(c):
                simple.append((c, m[1].lower(), m[2]))
            else:
                other.append(c)
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        words = self.words
        self._learn_words([w for w in {w for _, a, b in simple for w in (a, b)} if w is not None and w not in words])
        for c, letters, signs in simple:
            self.kept[c] = words[letters] if signs is None else words[letters] + words[signs]
        odd = [c for c in other if "<|" in c]  # may hold an added token
        for c, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, self.kind).tobytes()
        plain = [c for c in other if "<|" not in c]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group in groups:
            e = self.tokenizer.encode_batch_fast([JOINT.join(group)], add_special_tokens=False)[0]
            ids, width = np.array(e.ids, self.kind), self.kind.itemsize
            raw, cuts = ids.tobytes(), np.flatnonzero(ids == self.joint)
            for c, a, b in zip(group, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                self.kept[c] = raw[width * a : width * b]


@lru_cache(1)
def encoder_of(path: str) -> ChunkEncoder:
    """The worker's encoder."""
    return ChunkEncoder(path)


class SequenceWriter:
    """One Arrow file and its index."""

    def __init__(self, uri: str, length: int, kind: np.dtype):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self.length, self.kind, self.rest, self.n = length, kind, [], 0
        self.out = [self.fs.open_output_stream(path), self.fs.open_output_stream(f"{path}.index")]
        lists = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.files = [pa.ipc.new_file(self.out[0], lists), pa.ipc.new_file(self.out[1], INDEX)]

    def add(self, doc_ids: list, encoded: list[bytes]) -> None:
        n = np.array([len(e) // self.kind.itemsize for e in encoded], np.int64)
        starts = self.n + np.cumsum(n) - n
        self.files[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(n)], schema=INDEX))
        self.n += int(n.sum())
        ids = np.frombuffer(b"".join([*self.rest, *encoded]), self.kind)
        whole = len(ids) // (BATCH * self.length) * BATCH * self.length
        for at in range(0, whole, BATCH * self.length):
            self._write(ids[at : at + BATCH * self.length])
        self.rest = [ids[whole:].tobytes()]

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        values, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
        values[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)]
        self.files[0].write_batch(pa.record_batch(lists, names=["ids", "mask"]))

    def close(self) -> None:
        if len(ids := np.frombuffer(b"".join(self.rest), self.kind)):
            self._write(ids)
        for f in (*self.files, *self.out):
            f.close()


def _writer(folder: str, tokenizer: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, n_docs = None, None, 0
        part, file = TaskContext.get().partitionId(), ""
        for batch in batches:
            for doc_ids, texts in slices(batch):
                encoder = encoder or encoder_of(tokenizer)
                if out is None:
                    file = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    out, end = SequenceWriter(file, length, encoder.kind), np.array([end_id], encoder.kind).tobytes()
                out.add(doc_ids, [e + end for e in encoder.encode(texts)])
                n_docs += len(doc_ids)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([part], pa.int32()), [file], [out.n], [n_docs]], names=["part", "file", "n_tokens", "n_docs"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Writes the files; returns the manifest: part, file, n_tokens, n_docs and base (ids in all files before)."""
    folder = shared_dir(docs.sparkSession)
    filesystem, path = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(path)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(dealt.mapInArrow(_writer(folder, tokenizer, length, end_id), MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over the files, not the documents
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def open_arrow(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A memory map for a local file, else ranged reads."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def document_ids(reader: pa.ipc.RecordBatchFileReader, start: int, n: int) -> Iterator[np.ndarray]:
    """The ids of one document as zero-copy views, one for each record batch that it touches."""
    length = reader.schema.field("ids").type.list_size
    per = BATCH * length
    while n > 0:
        k, at = divmod(start, per)
        view = reader.get_batch(k).column("ids").flatten().to_numpy()[at : at + n]
        yield view
        start, n = start + len(view), n - len(view)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            data, index = open_arrow(row["file"]), open_arrow(row["file"] + ".index")
            for k in range(index.num_record_batches):
                docs, sums = index.get_batch(k), []
                for start, n in zip(docs["start"].to_pylist(), docs["n_tokens"].to_pylist(), strict=True):
                    crc = 0
                    for view in document_ids(data, start, n):
                        crc = zlib.crc32(view.astype("<u4"), crc)
                    sums.append(crc)
                starts = pa.array(docs["start"].to_numpy() + row["base"])
                yield pa.record_batch([docs["doc_id"], starts, docs["n_tokens"], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian uint32) of each document, from the files."""
    return manifest.select("file", "base").repartition(max(1, manifest.count())).mapInArrow(_read, READ)
