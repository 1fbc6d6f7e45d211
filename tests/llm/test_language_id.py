"""Held-out accuracy, and the gradient's direction on a toy problem."""

import numpy as np
import pytest

from quire.llm.language_id import UNKNOWN, WIDTH, identify, learn, sample, score_texts, train, windows_of

FR = "le chat est sur la table avec une souris dans les mains et il mange du pain "
DE = "der Hund ist auf dem Tisch und die Katze schläft nicht mit einer Maus auf dem Bett "


def text(k, base):
    words = base.split()
    rng = np.random.default_rng(k)
    return " ".join(rng.choice(words, 5 + k % 60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text(k, FR if k % 3 else DE), "fr" if k % 3 else "de", "s") for k in range(400)]
    rows += [(900, None, "fr", "s"), (901, "12 34 !!", "de", "s"), (902, "", None, "s"), (None, FR, None, "s"), (903, FR * 3000, None, "s"), (904, "x", None, None)]
    return spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy(docs):
    got = identify(docs, rows=150).toPandas()
    assert len(got) == docs.count()
    known = got[got.doc_id < 400]
    right = known.lang_pred == known.doc_id.map(lambda k: "fr" if k % 3 else "de")
    assert right[known.held_out].mean() > 0.97 and 0.15 < known.held_out.mean() < 0.35
    odd = got[got.doc_id.isin([900, 901, 902])]
    assert (odd.lang_pred == UNKNOWN).all() and (odd.score == 0).all()
    assert (got[got.doc_id == 903].lang_pred == "fr").all() and got.score.between(0, 1).all()


def test_the_sample_is_the_first_by_hash(docs):
    rows = docs.where("doc_id is not null and lang is not null and text is not null").selectExpr("lang", "xxhash64(doc_id) as h", "doc_id", "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false) as held").collect()
    for n in (3, 50):
        want = sorted(x for lang in ("fr", "de") for x in sorted((r.lang, r.h, r.doc_id) for r in rows if r.lang == lang and not r.held)[:n])
        assert sorted((r.lang, r.h, r.doc_id) for r in sample(docs, n)) == want


def test_whole_texts_count(docs):
    net = learn(docs, rows=150)
    langs, _ = score_texts(net, [DE * 2 + FR * 40, FR * 2 + DE * 40, None])
    assert langs == ["fr", "de", UNKNOWN]


def test_windows_cover_all_bytes():
    raw = bytes(range(1, 256)) * 3
    assert windows_of(raw).reshape(-1)[: len(raw)].tobytes() == raw and windows_of(raw).shape == (3, WIDTH)


def test_training_separates_bytes():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 110, (300, WIDTH)).astype(np.uint8)
    y = np.arange(300) % 2
    x[y == 1, 40:44] = np.frombuffer(b"zqzq", np.uint8)
    net = train(x, y, ["no", "yes"], epochs=60)
    from quire.llm.language_id import probabilities, responses

    assert (probabilities(net, responses(net, x).max(axis=1)).argmax(axis=1) == y).mean() > 0.97


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in identify(docs).collect()] == [(UNKNOWN, 0.0)]
    assert identify(docs.limit(0)).count() == 0
