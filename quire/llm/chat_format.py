"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, its reply as the one trainable
span. Turns after the last assistant turn (or all turns of a conversation without one) become a last
example with an empty span, so that no turn is lost. A turn is written as
`<s>[INST]role[/INST]text</s>`. In roles and texts each `\\`, `<` and `[` is written as `\\0`, `\\1` and
`\\2`, so that no control string occurs in them; unescape() takes that back.

Defined cases: null text or role counts as empty; a null conv_id is a conversation of its own; rows
are put in order by turn (nulls first), then role, then text; repeated rows stay repeated; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\0"), ("<", "\\1"), ("[", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\1"), ("[", "\\2"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_examples(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """conv_id, example (from 0), n_turns (turns in it), text, loss_start, loss_chars (code points; 0 and 0: no
    span) and is_last (it has all turns).

    One shuffle, by conv_id. A conversation's turns are held in one array, its examples are then made
    one by one.
    """
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), clean("role").alias("role"), clean("text").alias("text"))
    written = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE))
    conversations = (
        turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .withColumn("parts", F.transform("t", written))
        .withColumn("reply", F.transform("t", lambda t: F.when(t["role"] == trained, F.char_length(escape(t["text"]))).otherwise(-1)))
    )
    # the last turn always ends an example: as its span if trained, else as context alone
    ends = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda k: (F.element_at("reply", k) >= 0) | (k == F.size("parts")))
    examples = conversations.select("conv_id", "parts", "reply", F.posexplode(ends).alias("example", "n_turns"))
    last = F.element_at("reply", F.col("n_turns"))
    return examples.select(
        "conv_id", "example", F.col("n_turns").cast("long"), F.array_join(F.slice("parts", 1, F.col("n_turns")), "").alias("text"), last.alias("span"),
        (F.col("n_turns") == F.size("parts")).alias("is_last"),
    ).select(
        "conv_id", "example", "n_turns", "text",
        F.when(F.col("span") >= 0, F.char_length("text") - len(CLOSE) - F.col("span")).otherwise(0).cast("long").alias("loss_start"),
        F.greatest("span", F.lit(0)).cast("long").alias("loss_chars"), "is_last",
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text), read back from an example."""
    parts = F.split(text, "</s>", -1)  # each turn ends with it, so a last empty part follows
    body = lambda p: F.split(F.substring(p, len(OPEN) + 1, F.char_length(p)), "\\[/INST\\]", 2)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape(body(p)[0]).alias("role"), unescape(body(p)[1]).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the examples alone.

    Examples are already dealt out by conv_id, so this adds no shuffle. All turns are read from the
    longest example, each reply from the span of its own.
    """
    told = F.array_join(F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = unescape(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_chars as int))"))
    read = examples.select(
        "conv_id", "example", "n_turns", F.char_length("text").alias("chars"),
        F.when(F.col("loss_chars") > 0, loss).otherwise("").alias("loss"),
        F.when(F.col("is_last"), F.sha2(told, 256)).alias("turns_sha256"),
    )
    spans = F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"])
    return (
        read.groupBy("conv_id")
        .agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_join(spans, "").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )
