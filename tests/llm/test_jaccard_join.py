"""Components against all pairs."""

import random
import re
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.jaccard_join import from_six_bytes, from_steps, join_documents, signatures, six_bytes, to_steps
from quire.llm.word_hashes import shingle_sets

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_words=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(n_words)]
    common = [rng.choice(words) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 9, 14, 40, 120, 400]))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(["NEW", "new", "é", *words])
            rows.append(" ".join(copy))
    return list(enumerate([*rows, None, "", " \t\n", "One", "one", "a b", "A  B"]))


@pytest.mark.parametrize("width, percent, rare", [(4, 85, 64), (5, 80, 64), (4, 85, 2), (5, 80, 2), (3, 90, 3)])
def test_components(spark, monkeypatch, width, percent, rare):
    import quire.llm.jaccard_join as m

    monkeypatch.setattr(m, "RARE", rare)  # so that many tokens of a small table are frequent
    monkeypatch.setattr(m, "LEADERS", (1, 2))
    rows = corpus(width * 1000 + percent)
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, component_id string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(docs, width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_repeats_nulls_and_empty(spark):
    text = " ".join(f"x{k}" for k in range(30))
    other = " ".join(f"z{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (2, text + " y"), (None, text), (9, "a " * 50_000), (5, other), (None, other + " v"), (7, ""), (7, None), (None, "alone")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id) for r in join_documents(docs).collect()), key=str)
    assert got == sorted([(5, 27, 2), (5, 27, 2), (2, 28, 2), (-1, 27, 2), (9, 1, 9), (5, 27, 5), (-1, 28, 5), (7, 0, 7), (7, 0, 7), (-1, 1, None)], key=str)
    assert join_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        join_documents(docs, percent=50)


@settings(max_examples=300, deadline=None)
@given(st.integers(6, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([80, 85, 95]))
def test_similar_sets_share_a_signature(n, only_a, only_b, seed, percent):
    rng = np.random.default_rng(seed)
    universe = np.unique(rng.integers(1, 2**63, n + only_a + only_b + 5).astype(np.uint64))
    classes = dict(zip(universe.tolist(), rng.choice([3, 50, 70, 120, 255], len(universe)).tolist(), strict=True))
    both, a, b = universe[:n], universe[n : n + only_a], universe[n + only_a : n + only_a + only_b]
    if 100 * len(both) < percent * (len(both) + len(a) + len(b)):
        return

    def marks(tokens):
        tokens = np.sort(tokens)
        c = np.array([classes[t] for t in tokens.tolist()], np.uint8)
        order = np.lexsort((tokens, c))
        return set(signatures(len(tokens), tokens[order], c[order], percent).tolist())

    assert marks(np.concatenate([both, a])) & marks(np.concatenate([both, b]))


@given(st.lists(st.text(alphabet="aAbÉé \n\t\x0b", max_size=25), max_size=6), st.integers(2, 5))
@settings(max_examples=100, deadline=None)
def test_shingle_counts(texts, width):
    got = shingle_sets([t.encode() for t in texts], width)
    assert [len(g) for g in got] == [len(shingles(t, width)) for t in texts]


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """One base with edits: light ones link, heavy ones don't, and the pivot tells without comparing them all."""
    import quire.llm.jaccard_join as m

    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 9, 12])):
            copy[rng.randrange(120)] = f"e{rng.randrange(200)}"
        rows.append((k, " ".join(copy)))
    compared = []
    whole = m.judged
    monkeypatch.setattr(m, "judged", lambda pairs, lists, percent: (compared.append(pairs.count()), whole(pairs, lists, percent))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85) and sum(compared) < 12_000  # of 79,800 pairs


def test_rounds_dont_grow_with_those_before(spark, monkeypatch):
    """A group that takes many rounds: plans stay as large as in the first ones, and components are worked on where links were found."""
    import quire.llm.jaccard_join as m

    monkeypatch.setattr(m, "LEADERS", (1, 2))
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(24):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 4, 5])):
            copy[at] = f"e{rng.randrange(50)}"
        rows.append((k, " ".join(copy)))
    scans, worked = [], []
    whole, parts = m.judged, m.components

    def judged(pairs, lists, percent):
        scans.append(str(pairs._jdf.queryExecution().analyzed()).count("Relation"))
        return whole(pairs, lists, percent)

    monkeypatch.setattr(m, "judged", judged)
    monkeypatch.setattr(m, "components", lambda links: (worked.append(1), parts(links))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 4, 85)
    assert len(scans) >= 5 and len(set(scans[1:])) == 1, scans
    assert len(worked) < len(scans) - 1


@given(st.lists(st.integers(0, 400_000), unique=True, max_size=40))
def test_steps(places):
    places = np.array(sorted(places), np.int64)
    assert from_steps(to_steps(places)).tolist() == places.tolist()


def test_six_bytes():
    x = np.array([0, 1, 2**48 - 1, 12345678901234], np.uint64)
    assert from_six_bytes(six_bytes(x)).tolist() == x.tolist()
