"""The Merkle manifest against a plain version that keeps whole trees in lists."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from quire.llm.merkle_manifest import folded, prove, siblings

FIELDS = ("doc_id", "source", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(hashes, arity):
    """Root, and the siblings and slot of each leaf at each level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k : k + arity] for k in range(0, len(hashes), arity)]
        for leaf, node in enumerate(at):
            run, slot = runs[node // arity], node % arity
            paths[leaf].append((run[:slot], run[slot + 1 :]))
        at, hashes = [node // arity for node in at], [sha(*run) for run in runs]
    return hashes[0], paths


def plainly(rows, tampered, arity=3):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(*r))):
        groups.setdefault(row[1], []).append(row)
    trees = [climb([leaf_of(*r) for r in group], arity) for group in groups.values()]
    root, over = climb([subroot for subroot, _ in trees], arity)
    out = []
    for (subroot, paths), group, above in zip(trees, groups.values(), over, strict=True):
        for row, path in zip(group, paths, strict=True):
            fold = leaf_of(*tampered(row))
            for before, after in path + above:
                fold = sha(*before, fold, *after)
            proof = sha(*itertools.chain.from_iterable((*b, *a) for b, a in path + above))
            out.append((row[0], leaf_of(*row), subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def told(docs, **options):
    found = {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    rows = prove(docs, FIELDS, found=found, **options).withColumn("fold", folded(F.col("found"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256)
    return sorted((tuple(r) for r in rows.select("key", "leaf", "subroot", "root", proof, "fold", F.col("fold") == F.col("root")).collect()), key=repr)


def without_line_ends(row):
    return (*row[:2], row[2] and row[2].replace("\n", ""))


@pytest.mark.parametrize("step,arity", [(1, 3), (2, 3), (5, 3), (2, 2)])
def test_sizes_of_groups(spark, step, arity):
    sizes = {"a": 1, "é": 2, "b": 3, "c": 4, "d": 9, "e": 10, "f": 27, "z": 28, None: 82, "": 5}
    rows = [(1000 * g + k, name, f"text {k}\n" if k % 3 else f"text{k}") for g, (name, n) in enumerate(sizes.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert told(docs, step=step, arity=arity) == plainly(rows, without_line_ends, arity)


def test_many_groups(spark):
    rows = [(k, f"site{k % 100}.example", f"{k}") for k in range(300)]
    assert told(spark.createDataFrame(rows, "doc_id long, source string, text string"), step=1) == plainly(rows, without_line_ends)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(None, "s", "a\nb"), (None, "s", None), (1, "s", "x"), (1, "s", "x"), (1, "s", ""), (2, "s", "\n"), (-5, "s", "neg"), (3, None, None), (7, "t", "y" * 100_000 + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for name in ("tree", "place", "hash", "path", "block", "levels", "root", "key", "n"):
        docs = docs.withColumn(name, F.lit(1))
    got = told(docs)
    assert got == plainly(rows, without_line_ends)
    assert [r[-1] for r in got if r[0] == 7] == [False] and [r[-1] for r in got if r[0] == 1] == [True] * 3


def test_one_leaf_and_none(spark):
    docs = spark.createDataFrame([(1, "s", "x")], "doc_id long, source string, text string")
    ((key, leaf, subroot, root, proof, fold, verified),) = told(docs)
    assert (leaf, root, proof, verified) == (leaf_of(1, "s", "x"), subroot, sha(), True) and leaf == root == fold and key == 1
    assert told(docs.limit(0)) == []


def test_reruns_and_partitions_agree(spark):
    rows = [(k * 7919 % 1000, f"s{k % 3}", str(k)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert told(docs.coalesce(1), step=2) == told(docs.repartition(7), step=2)


def test_ranges_share_a_hot_group(spark):
    """A group's leaves come from several ranges, and no window or group holds them all."""
    rows = [(k, "hot", str(k)) for k in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    assert told(docs, step=2) == plainly(rows, without_line_ends)
