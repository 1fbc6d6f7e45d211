"""Fill-in-middle: a text's prefix, middle and suffix, put in the order in which a model learns to fill the gap.

A text is cut between units (runs of ASCII letters, and single other characters). It is gone through once, in windows, to
count its units; meanwhile a sparse index keeps the byte and the code-point offset of every EVERY-th unit. Each cut is
then found by a binary search among these checkpoints and a scan of fewer than EVERY units from there, so a text of
any length needs 24 bytes for each EVERY units, and no list of its units.

A hash of the document's id draws the cuts and the form: plain (the text as it is), psm (prefix, suffix, middle) or spm
(suffix, prefix, middle), each part after its sentinel. A text that holds a sentinel stays plain, so restored() is exact.

Defined cases: a null text counts as empty; an empty text has no units and is plain; a null id is drawn as an empty one;
rows with equal id and text give equal rows, and each row is its own; bytes that aren't UTF-8 belong to the character
before them; empty tables give no rows; of further columns only those named in `carried` are kept, and one of these with
the name of a result is an error.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import text_bytes

#: Units from one checkpoint to the next.
EVERY = 128
#: Bytes that are counted at once.
WINDOW = 1 << 20
#: Of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
#: Per cent of the texts that are cut, and of these those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20

RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")
UNIT = re.compile(rb"(?:[A-Za-z]+|[^A-Za-z])[\x80-\xbf]*")
LATER_BYTES = bytes(range(0x80, 0xC0))
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def n_chars(data: bytes) -> int:
    return len(data.translate(None, LATER_BYTES))


class Checkpoints:
    """Counts the units of a text and keeps where every `every`-th one starts."""

    def __init__(self, data: bytes, every: int = EVERY, window: int = WINDOW):
        self.data, self.n, self.chars = data, 0, 0
        self.units: list[int] = []
        self.at_bytes: list[int] = []
        self.at_chars: list[int] = []
        after_letter = False
        for begin in range(0, len(data), window):
            codes = np.frombuffer(data, np.uint8, min(window, len(data) - begin), begin)
            letter = IS_LETTER[codes]
            first = (codes & 0xC0) != 0x80  # of a character
            starts = first.copy()
            starts[1:] &= ~(letter[1:] & letter[:-1])
            starts[0] = begin == 0 or (first[0] and not (letter[0] and after_letter))
            after_letter = bool(letter[-1])
            places = np.flatnonzero(starts)
            kept = places[-self.n % every :: every]
            self.units += range(self.n + -self.n % every, self.n + len(places), every)
            self.at_bytes += (kept + begin).tolist()
            self.at_chars += (np.cumsum(first)[kept] - first[kept] + self.chars).tolist()
            self.n += len(places)
            self.chars += int(np.count_nonzero(first))

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the place before this unit (or of the end)."""
        if unit >= self.n:
            return len(self.data), self.chars
        k = bisect_right(self.units, unit) - 1
        at = begin = self.at_bytes[k]
        for found in islice(UNIT.finditer(self.data, begin), unit - self.units[k]):
            at = found.end()
        return at, self.at_chars[k] + n_chars(self.data[begin:at])


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def arranged(doc_id: int | None, data: bytes, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, ...] = SENTINELS) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    index = Checkpoints(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = (x.encode() for x in sentinels)
    if not data or p in data or s in data or m in data or h3 % 100 >= cut:
        return index.n, "plain", None, None, data
    first, last = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(first), index.cut(last)
    if h4 % 100 < suffix_first:
        form, output = "spm", [s, data[b:], p, data[:a], m, data[a:b]]
    else:
        form, output = "psm", [p, data[:a], s, data[b:], m, data[a:b]]
    return index.n, form, a_chars, b_chars - a_chars, b"".join(output)


def _arrange(carried: int, options: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, form, prefix, middle, output = zip(*map(arranged, part.column(0).to_pylist(), part.column(1).to_pylist(), *([x] * part.num_rows for x in options)), strict=True)
                told = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.record_batch([part.column(0), *part.columns[2 : 2 + carried], *told], names=["doc_id", *part.schema.names[2 : 2 + carried], *RESULT])

    return arrange


def fill_in_middle(docs: DataFrame, carried: tuple[str, ...] = (), seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, the carried columns, n (units), form, prefix_chars, middle_chars (null if plain) and output of each row."""
    if clash := {"doc_id", "text", *RESULT} & set(carried):
        raise ValueError(f"carried columns with the name of a result: {sorted(clash)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), *carried)
    kept = [field for field in rows.schema.fields if field.name != "text"]
    kinds = zip(RESULT, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType()), strict=True)
    told = rows.mapInArrow(_arrange(len(carried), (seed, cut, suffix_first, sentinels)), T.StructType([*kept, *(T.StructField(name, kind) for name, kind in kinds)]))
    return told.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output was made."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    psm, spm = (F.concat(*(F.get(parts, F.lit(k)) for k in places)) for places in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
