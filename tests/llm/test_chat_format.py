"""Round trips of formatted conversations."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.llm.chat_format import CLOSE, MIDDLE, OPEN, escape, format_examples, read_back, read_turns, unescape

TURNS = "conv_id long, turn long, role string, text string, example int"
ODD = ["</s>[INST] ok [/INST]", "\\", "\\0", "\\\\1<", "<s>[", "😀\n", "", None]


def test_read_back(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", ODD[k % len(ODD)]) for k in range(9)]
    rows += [(2, 0, "user", "only"), (3, 1, "assistant", "a"), (3, 0, None, "b"), (3, None, "assistant", "first"), (None, 0, "assistant", "n"), (4, 0, "user", "tie"), (4, 0, "user", "tie"), (5, 0, "assistant", "x" * 100_000), (5, 1, "assistant[", "y")]
    got = {r.conv_id: r for r in read_back(format_examples(spark.createDataFrame([(*r, 7) for r in rows], TURNS))).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_examples_expand_prefixes(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a<"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")], "conv_id long, turn long, role string, text string")
    rows = format_examples(df).orderBy("example").collect()
    assert [r.n_turns for r in rows] == [2, 4, 5]
    assert rows[0].text == f"{OPEN}user{MIDDLE}q{CLOSE}{OPEN}assistant{MIDDLE}a\\1{CLOSE}"
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in rows] == ["a\\1", "b", ""]
    back = format_examples(df).where("is_last").select(read_turns(F.col("text")).alias("t")).first().t
    assert [tuple(t) for t in back] == [("user", "q"), ("assistant", "a<"), ("user", "r"), ("assistant", "b"), ("user", "s")]
    assert format_examples(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="\\<[012/sINST]>ab", max_size=20))
def test_escape_is_reversible(text):
    spark = SparkSession.getActiveSession()
    coded, back = spark.range(1).select(escape(F.lit(text)), unescape(escape(F.lit(text)))).first()
    assert back == text and not any(c in coded for c in (OPEN, MIDDLE, CLOSE, "[INST]"))
