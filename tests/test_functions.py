"""Expressions against literal cases."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.config import Config
from quire.functions import keys, labels, numbers, paths, text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_utf16_and_white_space(spark):
    r = one(
        spark, n=text.utf16_len(F.lit("😀abc")), c=text.collapse(F.lit("﻿ a 　b \t c\u0085")), keep=text.collapse(F.lit("a\u0085b")), t=text.uni_trim(F.lit("\u0085﻿ x　")),
        e=text.ellipsis(F.lit("abcdefghij"), 8), s=text.ellipsis(F.lit("abc"), 8),
    )
    assert r == (5, "a b c", "a\u0085b", "x", "abcde...", "abc")


def test_suffixes_and_names(spark):
    r = one(spark, a=text.sanitize_suffix(F.lit(" :bad/name? ")), b=text.sanitize_suffix(F.lit("   ")), c=text.sanitize_suffix(F.lit("..x. . ")), d=text.sanitize_secret_name(F.lit("a b/c")), e=text.sanitize_file_name(F.lit("  ")))
    assert r == ("_bad_name_", "_translated", "x", "a_b_c", "translated.epub")


def test_residual(spark):
    english = "this is a sentence that was not translated into the target at all"
    r = one(
        spark, a=text.suspicious_residual(F.lit(english), F.lit(english), F.lit("Chinese")), b=text.suspicious_residual(F.lit(english), F.lit("Alice 在 EPUB 和 API 文档中找到了线索。"), F.lit("Chinese")),
        c=text.suspicious_residual(F.lit(english), F.lit(english), F.lit("English")), d=text.checks_residual(F.lit("Hungarian")), e=text.checks_residual(F.lit("日本語")), f=text.longest_english_run(F.lit("a b 12 c 汉 d")),
    )
    assert r == (True, False, False, True, True, 3)


def test_categories(spark):
    names = ["black.xhtml", "cover_index.xhtml", "index_split_001.html", "subtitle.html", "chapter.html"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(labels.category(F.col("p"), F.lit("")).alias("c")).collect()
    assert [r.c for r in rows] == ["backMatter", "ancillary", "reference", "frontMatter", "content"]


def test_urls_and_paths(spark):
    r = one(spark, a=paths.base_url(F.lit(" api.x.com/v1/Chat/Completions ")), b=paths.base_url(F.lit("http://x//")), c=paths.base_url(F.lit("")), d=paths.output_path(F.lit("/in/a.b.epub"), F.lit("/out/"), F.lit("-zh")), e=paths.output_path(F.lit("/in/a-zh.epub"), F.lit("/in"), F.lit("")), f=paths.stem(F.lit("/x/.hidden")), g=paths.is_epub(F.lit(" /a/B.EPUB ")))
    assert r == ("https://api.x.com/v1", "http://x/v1", "", "/out/a.b-zh.epub", "/in/a-zh_translated.epub", ".hidden", True)
    assert paths.resolve("OPS", "Text/chapter%201.xhtml#x") == "OPS/Text/chapter 1.xhtml"
    assert paths.resolve("OPS/a", "../b%2Fc.html?q") == "OPS/b%2Fc.html"
    assert paths.decode_full("100%") == "100%"


def test_keys_follow_the_glossary(spark):
    key = lambda g: keys.block_key(F.lit("x"), F.lit("m"), F.lit("l"), F.lit(g), F.lit(True), F.lit("c"), F.lit("<p>"))
    r = one(spark, a=key(""), b=key("Alice => A"))
    assert len(r.a) == 64 and r.a != r.b


def test_back_off(spark):
    rows = spark.range(1, 9).select(numbers.retry_delay(F.lit(429), F.lit(None).cast("long"), F.lit(5), F.col("id")).alias("s")).collect()
    assert [r.s for r in rows] == [5, 10, 20, 40, 80, 80, 80, 80]
    now = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp")
    r = one(spark, a=numbers.retry_after(F.lit("7"), now), b=numbers.retry_after(F.lit("2024-01-01T00:00:30Z"), now), c=numbers.retry_after(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"), now), d=numbers.retry_delay(F.lit(429), F.lit(500), F.lit(5), F.lit(1)))
    assert r == (7, 30, None, 120)


def test_labels_of_time(spark):
    labels_of = lambda *ms: [one(spark, x=numbers.remaining_label(F.lit(m))).x for m in ms]
    assert labels_of(None, 900, 5000, 60000, 65000) == ["Calculating", "Less than 1 min", "5 sec", "1 min", "1 min 5 sec"]
    r = one(spark, a=numbers.duration_label(F.lit(999)), b=numbers.duration_label(F.lit(1500)), c=numbers.duration_label(F.lit(61000)), d=numbers.blocks_per_minute(F.lit(30), F.lit(120000)), e=numbers.remaining_ms(F.lit(60), F.lit(30), F.lit(15.0)))
    assert r == ("999ms", "1.50s", "1m 1s", 15.0, 120000)


def test_fixed_decimals_are_rounded_as_the_exact_number(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [k / 1000 for k in range(5, 60000, 10)] + [0.05, 0.15, 0.25, 0.35, 12.25, 12.35, 1e6 + 0.05, 7.0, 0.96, 0.99999]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", numbers.to_fixed(F.col("v"), 1).alias("one"), numbers.to_fixed(F.col("v"), 2).alias("two")).collect()
    for r in rows:
        assert (r.one, r.two) == tuple(str(Decimal(r.v).quantize(Decimal(q), ROUND_HALF_UP)) for q in ("0.1", "0.01"))
    r = one(spark, a=numbers.duration_label(F.lit(31365)), b=numbers.duration_label(F.lit(1125)), c=numbers.duration_label(F.lit(59999)), d=numbers.speed_label(F.lit(12.34)), e=numbers.speed_label(F.lit(None).cast("double")))
    assert r == ("31.36s", "1.13s", "60.00s", "12.3 blocks/min", "Not enough data")


def test_cuts_count_utf16_units(spark):
    smile, units = "\U0001f600", lambda t: len(t.encode("utf-16-le")) // 2
    for raw in (smile * 300, "ab" + smile * 5 + "\uffff" + smile + "c", "x" * 9, smile + "\uffff" * 3, ""):
        for n in (1, 2, 3, 6, 7, 12, 240):
            got = one(spark, x=text.cut_units(F.lit(raw), n)).x
            assert raw.startswith(got) and units(got) <= n and (got == raw or units(got) + units(raw[len(got)]) > n)
    r = one(spark, a=text.ellipsis(F.lit(smile * 300), 240), b=text.sanitize_suffix(F.lit(smile * 100)))
    assert units(r.a) == 239 and r.a.endswith(smile + "...") and units(r.b) == 80


def test_lenient_counts(spark):
    read = lambda f, v: one(spark, x=f(F.lit(v))).x
    assert [read(numbers.job_int, v) for v in ("2", "-1", "10.0", None, "x")] == [2, 0, 0, 0, 0]
    assert [read(numbers.checkpoint_int, v) for v in ("2", "-1", "10.0", None, "x")] == [2, 0, 10, 0, 0]
    assert one(spark, a=numbers.progress(F.lit(float("nan"))), b=numbers.progress(F.lit(2.0))) == (0.0, 1.0)


def test_redaction(spark):
    r = one(spark, x=text.redact(F.lit("Authorization: Bearer abc, api_key=zzz sk-abcdefgh1 my-key"), "my-key"))
    assert r.x == "Authorization: Bearer [redacted], api_key=[redacted] sk-[redacted] [redacted]"


def test_config_reading():
    c = Config.from_json('{"chunk_size": 8000.0, "max_concurrent": "12", "timeout_seconds": 5, "max_retries": 0, "retry_delay_seconds": "20", "model": " m\\r\\n", "theme": "neon", "text_scale": 9, "api_key": "secret"}')
    assert (c.chunk_size, c.max_concurrent, c.timeout_seconds, c.max_retries, c.retry_delay_seconds) == (8000, 8, 30, 1, 15)
    assert (c.model, c.theme, c.text_scale, c.api_key) == ("m", "dark", 1.3, "")
    assert Config.from_json('{"bilingual": "yes", "model": "m"}') == Config() == Config.from_json("[1]") == Config.from_json(None)
    assert "secret" not in Config(api_key="secret").to_json()
    assert Config().tuned("fast").matching_preset() == "fast" and Config().fewer_at_once().max_concurrent == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=30), st.integers(1, 600))
def test_packing_keeps_order_and_budget(costs, limit):
    pytest.importorskip("pyspark")
    from pyspark.sql import SparkSession

    from quire.operators.batches import count_batches, pack

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("needs the session of the other tests")
    array = F.array(*map(F.lit, costs)).cast("array<bigint>") if costs else F.expr("cast(array() as array<bigint>)")
    r = one(spark, no=pack(array, limit), n=count_batches(array, limit))
    assert list(r.no) == sorted(r.no) and r.n == (r.no[-1] if r.no else 0)
    for k in set(r.no):
        batch = [c for c, b in zip(costs, r.no, strict=True) if b == k]
        assert len(batch) == 1 or sum(batch) <= limit
