"""Byte-level BPE: texts to the ids of a ranked vocabulary, and back.

A text is cut by a pattern; each piece is merged on its own, the adjacent pair with the least rank first, the leftmost
of equal ones. A segment tree over the byte positions of a piece holds, at each node, the least (rank, position) of
the pairs that start below it. A merge takes the root's pair and makes point updates for what it changed: the pair that is
gone, the grown one, and that of the live neighbour before it, each up to the root. So a piece of n bytes
(a line of a million letters, say) takes n log n steps. A piece that is a token as a whole is this token at once.

Workers keep the ids of short pieces, at most KEPT of them.

Defined cases: a null text has null ids and decodes to null, an empty one has none; equal texts have equal ids, and each
row is its own; ids decode to the bytes they were made from, and to text where these are UTF-8; empty tables give
no rows; a column with the name of a result is replaced, all others stay as they are.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces whose ids a worker keeps, and how many characters such a piece has at most.
KEPT, SHORT = 600_000, 64
#: Characters from which a text's pieces are found one by one.
LONG = 1 << 20
#: More than any rank times the positions of a piece.
NO_PAIR = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks: a line for each, the token in base64."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTree:
    """The live byte positions of a piece, and the least pair among them."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int], single: list[int]):
        """single: the ids of all bytes."""
        self.piece, self.rank_of, self.n = piece, ranks.get, len(piece)
        n, rank_of = self.n, ranks.get
        self.ids = [single[c] for c in piece]  # of the token at each live position
        self.after = list(range(1, n + 1))  # the live position after each live one; n at the end
        self.before = list(range(-1, n))
        # a pair is its rank and its position in one number, so of equal ranks the leftmost is the least
        pairs = [NO_PAIR if (rank := rank_of(piece[k : k + 2])) is None else rank * n + k for k in range(n - 1)]
        self.leaves = leaves = 1 << (n - 1).bit_length()
        self.least = least = [NO_PAIR] * leaves + pairs + [NO_PAIR] * (leaves - n + 1)
        for node in range(leaves - 1, 0, -1):
            left, right = least[2 * node], least[2 * node + 1]
            least[node] = left if left < right else right

    def merge(self, most: int = NO_PAIR) -> int:
        """Merges the least pair, again and again, at most so many times; tells how often.

        A merge changes three leaves: the pair that is gone, the grown one, and that of the live neighbour before it. Their ancestors
        are renewed level by level, those that they share once.
        """
        piece, rank_of, n, ids, after, before, least, leaves = self.piece, self.rank_of, self.n, self.ids, self.after, self.before, self.least, self.leaves
        done = 0
        while done < most and (top := least[1]) != NO_PAIR:
            rank, at = divmod(top, n)
            ids[at] = rank
            gone = after[at]
            after[at] = end = after[gone]
            before[end] = at
            rank = None if end == n else rank_of(piece[at : after[end]])
            high, middle = leaves + gone, leaves + at
            least[high] = NO_PAIR
            least[middle] = NO_PAIR if rank is None else rank * n + at
            if (back := before[at]) >= 0:
                rank = rank_of(piece[back:end])
                low = leaves + back
                least[low] = NO_PAIR if rank is None else rank * n + back
            else:
                low = middle
            while high > 1:
                low, middle, high = low >> 1, middle >> 1, high >> 1
                left, right = least[2 * high], least[2 * high + 1]
                least[high] = left if left < right else right
                if middle != high:
                    left, right = least[2 * middle], least[2 * middle + 1]
                    least[middle] = left if left < right else right
                if low != middle:
                    left, right = least[2 * low], least[2 * low + 1]
                    least[low] = left if left < right else right
            done += 1
        return done

    def tokens(self) -> list[int]:
        """The ids of the live positions."""
        out, at = [], 0
        while at < self.n:
            out.append(self.ids[at])
            at = self.after[at]
        return out


class Encoder(dict):
    """Ids of pieces, by piece; what isn't kept is worked out.

    Kept are the pieces used since the last change of generations, and those of the generation before.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.single = [self.ranks[bytes([c])] for c in range(256)]
        self.older: dict[str, tuple[int, ...]] = {}

    def worked_out(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        tree = PairTree(data, self.ranks, self.single)
        tree.merge()
        return tuple(tree.tokens())

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.worked_out(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        # the pieces of a long text are never all there at once
        pieces = self.pattern.findall(text) if len(text) < LONG else map(itemgetter(0), self.pattern.finditer(text))
        return array("i", chain.from_iterable(map(self.__getitem__, pieces)))


@lru_cache(1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return Encoder(path, pattern)


def _encode(path: str, pattern: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coder = encoder_of(path, pattern)
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = part.column(at).to_pylist()
                coded = [coder.encode(text or "") for text in texts]
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.frombuffer(c, np.int32) for c in coded])), mask=pa.array([t is None for t in texts]))
                yield pa.record_batch([*part.columns, ids], names=[*part.schema.names, "ids"])

    return encode


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns and ids (array of int)."""
    rows = docs.drop("ids").withColumn("text", F.make_valid_utf8(docs["text"].cast("string")))
    schema = T.StructType([*rows.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return rows.mapInArrow(_encode(path, pattern, rows.columns.index("text")), schema)


@lru_cache(1)
def tokens_of(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _decode(path: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = tokens_of(path)
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = part.column(at)
                values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
                data = [b"".join(map(tokens.__getitem__, values[a:b].tolist())) if known else None for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
                yield pa.record_batch([*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "decoded"])

    return decode


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns and decoded (bytes)."""
    rows = encoded.drop("decoded")
    return rows.mapInArrow(_decode(path, rows.columns.index("ids")), T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))
