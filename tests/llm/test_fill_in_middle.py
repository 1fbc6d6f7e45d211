"""Fill-in-middle against a plain version that lists all units."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm.fill_in_middle import Checkpoints, arranged, fill_in_middle, restored


def plainly(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    draw = random.Random(5)
    letters = ["a", "Bc", "zebra", " ", "\n", "é", "中", "\U0001f600", "<", "P>", "<S>", "1", "\x00", "ſ", "K"]
    out = ["", "a", "é", "word", "\n", "<P>", "x<M>y", "<<S", "a" * 5000, "é" * 5000, "ab é" * 5000]
    return out + ["".join(draw.choices(letters, [5, 5, 5, 5, 2, 2, 2, 2, 1, 1, 0.01, 2, 1, 1, 1], k=draw.randrange(600))) for _ in range(200)]


@pytest.mark.parametrize("every,window", [(1, 3), (7, 64), (128, 1 << 20), (1000, 5)])
def test_checkpoints(every, window):
    for text in texts()[:60]:
        data = text.encode()
        index = Checkpoints(data, every, window)
        ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
        assert (index.n, index.chars) == (len(ends) - 1, len(text))
        assert len(index.units) == -(-index.n // every)
        for unit in {0, 1, every, every + 1, index.n // 2, index.n - 1, index.n} & set(range(index.n + 1)):
            assert index.cut(unit) == (len(text[: ends[unit]].encode()), ends[unit])


def test_against_plain_version():
    for k, text in enumerate(texts()):
        n, form, prefix, middle, output = arranged(k, text.encode())
        assert (n, form, prefix, middle, output.decode()) == plainly(k, text)


def test_table(spark):
    rows = [(k, t, "s") for k, t in enumerate(texts())] + [(900, None, "s"), (None, "one two three", "s"), (None, None, None), (3, "word", "s"), (3, "word", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    told = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in told.collect()), key=repr)
    want = sorted(((k, *plainly(k, t or ""), t or "") for k, t, _ in rows), key=repr)
    assert got == want
    assert {"plain", "psm", "spm"} == {r[2] for r in got}


def test_carried_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 5)], "doc_id long, text string, source string, form int")
    assert fill_in_middle(docs, ("source",)).columns[:3] == ["doc_id", "source", "n"]
    with pytest.raises(ValueError):
        fill_in_middle(docs, ("form",))
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_bytes_that_are_not_utf8():
    data = b"ab\x80\x80 c\xff\xff\x80d"
    index = Checkpoints(data, 2, 3)
    assert index.n == 6  # ab.., blank, c, two odd bytes, d
    assert [index.cut(k)[0] for k in range(7)] == [0, 4, 5, 6, 7, 9, 10]
