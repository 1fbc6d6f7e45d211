"""The stages against brute force on a small corpus."""

import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as p
from quire.llm.mixing import mix

FR = "le chat est sur la table avec une souris dans les mains et il mange du pain blanc demain".split()
DE = "der Hund ist auf dem Tisch und die Katze schläft nicht mit einer Maus auf dem Bett heute".split()


def corpus():
    rng = random.Random(1)
    rows = []
    for k in range(120):
        words = [rng.choice(FR if k % 2 else DE) + str(rng.randrange(30)) for _ in range(20 + k)]
        rows.append((k, " ".join(words), "fr" if k % 2 else "de", f"s{k % 4}"))
    rows += [(200 + k, rows[k][1], rows[k][2], "s0") for k in range(10)]  # exact copies
    rows += [(300 + k, rows[50 + k][1] + " encore", "fr", None) for k in range(10)]  # near copies
    rows += [(400, None, None, "s1"), (401, "12 ?!", "de", "s1"), (402, "", "fr", "s2"), (200, rows[0][1], "de", "s0"), (None, "nur dieser Text hat keine Nummer", None, "s3")]
    return [(*r, len(r[1] or ""), "extra") for r in rows]


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long, score string")
    columns = docs.columns
    assert [len(p.STAGES), [callable(f) for _, f in p.STAGES]] == [5, [True] * 5]
    told = p.language_id(spark, docs, "")
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
    assert told.columns == columns and set(ids(docs)) - set(ids(told)) == {400, 401, 402} and told.where("lang is null").count() == 0
    once = p.exact_dedup(spark, told, "")
    assert once.columns == columns and ids(once) == [-1, *range(10, 120), *range(200, 210), *range(300, 310)]
    apart = p.near_dedup(spark, once, "")
    assert apart.columns == columns and ids(apart) == [-1, *range(10, 120), *range(200, 210)]
    mixed = p.mixing(spark, apart, "")
    assert mixed.columns == columns and set(ids(mixed)) <= set(ids(apart)) and max(Counter(ids(mixed)).values()) == 2
    want = {r.source: r for r in mix(apart).groupBy("source").agg(F.max("target").alias("target"), F.min("size").alias("least")).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - r.target) <= r.least for s, r in want.items())
    coded = p.sentencepiece(spark, mixed, "").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in apart.collect()}
    assert len(coded) == mixed.count() and all(model.decode(list(r.ids)) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in coded)
    copies = {}
    for r in coded:
        copies.setdefault(r.doc_id, set()).add(tuple(r.ids))
    twice = [d for d, n in Counter(ids(mixed)).items() if n == 2 and d >= 0]
    assert sum(len(copies[d]) == 2 for d in twice) > 0.9 * len(twice) > 0


def test_run_and_empty(spark, tmp_path):
    docs = spark.createDataFrame(corpus()[:40], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, f"file://{tmp_path}").count() > 0
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_clashing_names_repeats_and_nulls(spark):
    """Columns named as the stages' own, one doc_id with several texts, equal rows, null ids."""
    own = ["id", "row", "kept", "stays", "component", "copies", "ids", "text_sha256", "n", "lang_pred", "in_text"]
    texts = [(1, "eins zwei drei vier fünf sechs sieben acht neun zehn"), (1, "ganz andere Worte stehen hier in diesem einen kurzen Text da"), (1, "ganz andere Worte stehen hier in diesem einen kurzen Text da"), (None, "eins zwei drei vier fünf sechs sieben acht neun zehn"), (2, None), (None, None)]
    rows = [(d, t, "de", "s", *(f"{c}{k}" for c in own)) for k, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in own))
    key = lambda r: (r.doc_id or -1, r.text or "")
    for name, want in (("language_id", [0, 1, 2, 3]), ("exact_dedup", [0, 1, 4]), ("near_dedup", [0, 1, 4, 5])):
        got = dict(p.STAGES)[name](spark, docs, "")
        assert got.columns == docs.columns
        found = got.collect()
        assert sorted(map(key, found)) == sorted(((texts[k][0] or -1), texts[k][1] or "") for k in want)
        assert all(tuple(r) in {tuple(x) for x in rows} for r in found)
    mixed = p.mixing(spark, docs, "").collect()
    assert mixed and all(tuple(r) in {tuple(x) for x in rows} for r in mixed)


def test_numbers_of_rows(spark, tmp_path):
    """Rows of Parquet files are numbered by file and place, others once and for all; a row that is there twice has two numbers."""
    docs = spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "cast(id as string) as text", "id % 3 as row")
    path = f"file://{tmp_path}/docs"
    docs.write.parquet(path)
    read = spark.read.parquet(path)
    for df, n in ((read, 1000), (read.where("row = 1").select("text", "doc_id"), 333), (read.union(read), 2000), (docs, 1000), (read.limit(0), 0)):
        rows = p.numbered(df)
        assert rows.select("id").distinct().count() == rows.count() == n and rows.select("row.*").columns == df.columns
        if n:
            first, again = (sorted((r.id, r.doc_id) for r in rows.select("id", "row.doc_id").collect()) for _ in range(2))
            assert first == again
    assert "quire-" not in "".join(p.numbered(read).inputFiles())  # no copy
