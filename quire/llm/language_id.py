"""Language identification with a byte convolutional network.

Filters of several widths run over the bytes of a window (as sums of table rows, one table for each offset in
the filter), each filter's maximum over the window goes to a softmax layer. The network is trained with numpy on
a bounded sample of labelled rows (SAMPLE rows of each language by hash order, WINDOWS windows of each), and its
weights, a few hundred KB whatever the input, go to the tasks. A text is cut into windows of WIDTH bytes from its start to
its end; the mean of their probabilities, weighted by their bytes, is the text's.

Defined cases: a null text, or one without a letter, is `und` with score 0; rows with a null lang are not
learned from; without any labelled text all are `und`; a null doc_id is never held out; repeated rows and
equal ids are kept; empty tables give no rows; other columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 256
#: (filter width, number of filters), widest first.
FILTERS = ((4, 8), (3, 8), (2, 8))
SAMPLE = 1000
WINDOWS = 2
#: Parts of a language that are ranked side by side.
SPREAD = 64
EPOCHS = 12
SEED = 11
UNKNOWN = "und"


class Network(NamedTuple):
    labels: list[str]
    tables: list[np.ndarray]  # for each offset in a filter: 256 bytes x the filters that reach so far
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray


def empty_network(labels: list[str], rng: np.random.Generator) -> Network:
    reach = [sum(n for w, n in FILTERS if w > offset) for offset in range(FILTERS[0][0])]
    n = reach[0]
    return Network(labels, [rng.normal(0, 0.3, (256, r)).astype(np.float32) for r in reach], np.zeros(n, np.float32), rng.normal(0, 0.3, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))


def responses(net: Network, x: np.ndarray) -> np.ndarray:
    """Filter responses at all places: windows x places x filters."""
    places = x.shape[1] - len(net.tables) + 1
    out = net.tables[0][x[:, :places]]
    for offset, table in enumerate(net.tables[1:], 1):
        out[:, :, : table.shape[1]] += table[x[:, offset : offset + places]]
    return out


def probabilities(net: Network, pooled: np.ndarray) -> np.ndarray:
    z = np.maximum(pooled + net.bias, 0) @ net.dense + net.dense_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> Network:
    """Adam on the mean cross-entropy, languages weighted alike; x: windows of bytes, y: indexes of labels."""
    rng = np.random.default_rng(seed)
    net = empty_network(labels, rng)
    params = [*net.tables, net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / (len(labels) * np.maximum(np.bincount(y, minlength=len(labels)), 1)))[y].astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // 128)):
            xb, yb = x[rows], y[rows]
            at = responses(net, xb)
            best = at.argmax(axis=1)
            pooled = np.take_along_axis(at, best[:, None], axis=1)[:, 0]
            hidden = np.maximum(pooled + net.bias, 0)
            p = probabilities(net, pooled)
            p[np.arange(len(yb)), yb] -= 1
            p *= weight[rows][:, None] / len(yb)
            back = (p @ net.dense.T) * (hidden > 0)
            grads = []
            for offset, table in enumerate(net.tables):
                g, k = np.zeros_like(table), table.shape[1]
                np.add.at(g, (np.take_along_axis(xb, best[:, :k] + offset, axis=1), np.arange(k)[None]), back[:, :k])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(raw: bytes) -> np.ndarray:
    """All bytes in rows of WIDTH, the last filled up with zeros."""
    return np.frombuffer(raw + bytes(-len(raw) % WIDTH), np.uint8).reshape(-1, WIDTH)


def score_texts(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = [k for k, t in enumerate(texts) if t and net.labels and any(map(str.isalpha, t))]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    raws = [texts[k].encode("utf-8", "surrogatepass") for k in known]
    if not known:
        return langs, scores
    x = np.concatenate([windows_of(r) for r in raws])
    counts = np.array([-(-len(r) // WIDTH) for r in raws])
    p = np.concatenate([probabilities(net, responses(net, x[i : i + 128]).max(axis=1)) for i in range(0, len(x), 128)])
    weight = np.full(len(x), float(WIDTH))
    ends = np.cumsum(counts)
    weight[ends - 1] = [len(r) - (c - 1) * WIDTH for r, c in zip(raws, counts, strict=True)]
    mean = np.add.reduceat(p * weight[:, None], ends - counts) / np.array([len(r) for r in raws])[:, None]
    for k, row in zip(known, mean, strict=True):
        langs[k], scores[k] = net.labels[int(row.argmax())], min(1.0, float(row.max()))
    return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, windows: int = WINDOWS) -> list:
    """At most `rows` labelled rows of each language, by hash order, each as a few windows of its text.

    The rank is limited in each map task before the shuffle, then in each of SPREAD parts of a language, so a
    frequent language moves few rows and no task gets more than SPREAD times `rows` of them in the end.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    start = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.char_length("text") - WIDTH // 2, F.lit(1))) + 1).cast("int")
    cut = F.array(*(F.substring("text", start(k), F.lit(WIDTH)) for k in range(windows)))
    rank = lambda *parts: F.row_number().over(Window.partitionBy("lang", *parts).orderBy("h", "doc_id", "cuts"))
    cuts = labelled.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), cut.alias("cuts"))
    part = F.pmod("h", F.lit(SPREAD))
    few = cuts.withColumn("part", part).withColumn("rank", rank("part")).where(F.col("rank") <= rows)
    return few.withColumn("rank", rank()).where(F.col("rank") <= rows).orderBy("lang", "rank").collect()


def learn(docs: DataFrame, rows: int = SAMPLE) -> Network:
    """A network trained on the driver from the bounded sample."""
    taken = sample(docs, rows)
    labels = sorted({r["lang"] for r in taken})
    x, y = np.zeros((len(taken) * WINDOWS, WIDTH), np.uint8), np.zeros(len(taken) * WINDOWS, np.int64)
    for k, (r, c) in enumerate((r, c) for r in taken for c in r["cuts"]):
        raw = c.encode("utf-8", "surrogatepass")[: WIDTH if k % 4 else 1 + k % 97]  # some are short, as short texts are
        x[k, : len(raw)], y[k] = np.frombuffer(raw, np.uint8), labels.index(r["lang"])
    return train(x, y, labels) if labels else empty_network(labels, np.random.default_rng(SEED))


def _predict(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs, scores = score_texts(net, part.column("text").to_pylist())
                yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, net: Network, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, text, lang_pred and score of each row; only text is looked at."""
    rows = docs.select(*columns, F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(net), schema)


def identify(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""
    told = predict(docs.select(F.col("doc_id").cast("long"), "text"), learn(docs, rows))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
