"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

The manifest holds parents by their preimages, the concatenated hashes of their children. Each leaf joins the preimages of its
ancestors: its own 64 characters cut out, they give the siblings (the proof); with another hash put in the place of
these, they give the parent's hash that would follow from it, and so on up to the root.

Preimages are stored in blocks, STEP levels of ARITY**STEP nodes to a row, so a leaf finds those of many levels by
one join, and a block row takes those above it from its own parent's row. There is one turn for each STEP levels
(three for 14 million leaves of a group). A leaf's place among its group's is a count of the range partitions before
and a place within its own, so no group, however large, is ordered in one task.

A hash is the lowercase hex SHA-256 of the concatenated inputs, digests as their hex text. A leaf is that of the row's
fields, each `-` if null, otherwise its length in bytes, `:`, and its value as text.

Defined cases: null ids come first; a null group is a group of its own, the first one; rows with equal ids are ordered by
their hashes, and equal rows are leaves of their own; a group of one leaf has this leaf as its root, and one group its
root as that of all; an empty table gives no rows; columns that aren't named as fields are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels in a block.
STEP = 5
DIGEST = 64
NO_PATH = "cast(array() as array<struct<preimage: binary, slot: int>>)"


def field(value: Column) -> Column:
    """A field's part of what is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", found: dict[str, Column] | None = None) -> DataFrame:
    """tree (the group's name, "" if null, otherwise after `=`), key, leaf, and the leaf of the row as found, with these columns instead of the fields of their names."""
    found = found or {}
    leaf = digest(*(field(F.col(name)) for name in fields))
    now = digest(*(field(found.get(name, F.col(name))) for name in fields)) if found else leaf
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(key).alias("key"), leaf.alias("hash"), now.alias("found"))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` (tree, key, hash, found) with n (leaves of the tree) and place (from 0, by key).

    Rows are sorted by ranges of tree and key; each range has a stretch of places in each of its trees. What is summed up over a
    tree is a row for each range.
    """
    ranges = [F.col("tree"), F.col("key").asc_nulls_first()]
    sorted_rows = rows.repartitionByRange(*ranges).sortWithinPartitions(*ranges, "hash", "found")
    dealt = stored(sorted_rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    stretches = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return dealt.join(stretches, ["tree", "part"]).select("tree", "n", (F.col("at") + F.col("shift")).alias("place"), "key", "hash", "found")


def n_levels(n: Column, arity: int, step: int) -> Column:
    """Levels of a block of n nodes: all of them below another block, otherwise as many as leave one node."""
    needed = F.lit(0)
    for k in range(step):
        needed = needed + (n > arity**k).cast("int")
    return F.when(n > arity**step, step).otherwise(needed)


def blocks(nodes: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """tree, n (nodes of the tree at this height), block, levels (all preimages of a level in one text) and hash (of the block's own node)."""
    kids = F.array_join(F.array_sort(F.collect_list(F.struct("place", "hash")))["hash"], "").cast("binary")
    out = nodes.groupBy("tree", "n", F.floor(F.col("place") / arity**step).alias("block")).agg(kids.alias("now")).withColumn("height", n_levels(F.col("n"), arity, step)).withColumn("levels", F.expr("cast(array() as array<binary>)"))
    wide = arity * DIGEST
    for k in range(step):
        runs = F.sequence(F.lit(0), F.floor((F.octet_length("now") - 1) / wide).cast("int"))
        parents = F.array_join(F.transform(runs, lambda r: F.sha2(F.substring("now", r * wide + 1, F.lit(wide)), 256)), "").cast("binary")
        there = F.col("height") > k
        out = out.withColumns({"levels": F.when(there, F.concat("levels", F.array("now"))).otherwise(F.col("levels")), "now": F.when(there, parents).otherwise(F.col("now"))})
    return out.select("tree", "n", "block", "levels", F.col("now").cast("string").alias("hash"))


def path_in_block(place: Column, arity: int = ARITY, step: int = STEP) -> Column:
    """The preimages of a node's parents in its block row (column levels), each with the node's slot in it."""
    inside, wide = place % arity**step, arity * DIGEST
    powers = F.array(*(F.lit(arity**k) for k in range(step)))

    def parent(level: Column, k: Column) -> Column:
        node = F.floor(inside / F.get(powers, k)).cast("int")
        return F.struct(F.substring(level, F.floor(node / arity).cast("int") * wide + 1, F.lit(wide)).alias("preimage"), (node % arity).alias("slot"))

    return F.transform("levels", parent)


def siblings(path: Column) -> Column:
    """What the preimages hold besides the node's own slots, from the leaf up, left to right."""
    own = lambda x: F.concat(F.substring(x["preimage"], F.lit(1), x["slot"] * DIGEST), F.substring(x["preimage"], (x["slot"] + 1) * DIGEST + 1, F.octet_length(x["preimage"])))
    return F.array_join(F.transform(path, lambda x: own(x).cast("string")), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of a path."""

    def up(node: Column, x: Column) -> Column:
        before = F.substring(x["preimage"], F.lit(1), x["slot"] * DIGEST)
        after = F.substring(x["preimage"], (x["slot"] + 1) * DIGEST + 1, F.octet_length(x["preimage"]))
        return F.sha2(F.concat(before, node.cast("binary"), after), 256)

    return F.aggregate(path, leaf, up)


@dataclass
class Forest:
    """Trees over placed nodes: the block rows of each height, from the lowest, and each tree's root."""

    nodes: DataFrame  # tree, n, place, hash, and columns of their own
    heights: list[DataFrame]
    arity: int
    step: int

    @classmethod
    def grow(cls, nodes: DataFrame, arity: int = ARITY, step: int = STEP) -> Forest:
        wide, heights, now = arity**step, [], nodes
        most = nodes.agg(F.max("n")).first()[0] or 0
        while True:
            heights.append(stored(blocks(now, arity, step)))
            if most <= wide:
                return cls(nodes, heights, arity, step)
            most = -(-most // wide)
            now = heights[-1].where(F.col("n") > wide).select("tree", F.ceil(F.col("n") / wide).alias("n"), F.col("block").alias("place"), "hash")

    def top(self, height: int) -> DataFrame:
        """The rows of this height that end their trees."""
        return self.heights[height].where(F.col("n") <= self.arity**self.step)

    def roots(self) -> DataFrame:
        """tree and root."""
        out = self.top(0)
        for height in range(1, len(self.heights)):
            out = out.unionByName(self.top(height))
        return out.select("tree", F.col("hash").alias("root"))

    def paths(self, crown: DataFrame) -> DataFrame:
        """The nodes with path, subroot and what `crown` (tree, above, and columns of its own) has for their trees; `above` is the path beyond a tree's root."""
        kept = [c for c in crown.columns if c not in ("tree", "above")]
        above = None
        for height in reversed(range(len(self.heights))):
            ends = self.top(height).withColumnRenamed("hash", "subroot").join(crown, "tree")
            if above is None:
                rows = ends
            else:
                rows = self.heights[height].where(F.col("n") > self.arity**self.step).select("tree", "n", "levels", F.col("block").alias("place"))
                rows = self._below(rows, above, kept).select("tree", "n", F.col("place").alias("block"), "levels", "subroot", F.col("path").alias("above"), *kept).unionByName(ends)
            above = stored(rows) if height else rows
        return self._below(self.nodes, above, kept)

    def _below(self, rows: DataFrame, above: DataFrame, kept: list[str]) -> DataFrame:
        own = [c for c in rows.columns if c not in ("tree", "block")]
        parents = above.select("tree", "block", F.col("levels").alias("in_block"), "above", "subroot", *kept)
        joined = rows.withColumn("block", F.floor(F.col("place") / self.arity**self.step)).join(parents, ["tree", "block"])
        mine = joined.withColumnRenamed("levels", "own_levels") if "levels" in own else joined
        mine = mine.withColumnRenamed("in_block", "levels").withColumn("path", F.concat(path_in_block(F.col("place"), self.arity, self.step), "above"))
        return mine.select("tree", *(F.col("own_levels" if c == "levels" else c).alias(c) for c in own), "subroot", "path", *kept)


def prove(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", found: dict[str, Column] | None = None, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """key, leaf, found (the leaf of the row as found), subroot, root and path (preimages and slots, from the leaf up to the root) of each row."""
    grown = Forest.grow(stored(placed(stored(leaves(docs, fields, group, key, found)))), arity, step)
    # the groups' roots are the leaves of one more tree
    roots = grown.roots().select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("hash"), F.col("root").alias("found"))
    over = Forest.grow(stored(placed(roots)), arity, step)
    top = over.roots().select("tree", "root", F.expr(NO_PATH).alias("above"))
    crown = stored(over.paths(top).select(F.col("key").alias("tree"), F.col("path").alias("above"), "root"))
    return grown.paths(crown).select("key", F.col("hash").alias("leaf"), "found", "subroot", "root", "path")
