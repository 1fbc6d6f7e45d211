"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate, the exponentially tilted one that stays nearest to 1 (in the entropy of rates
bounded by `cap`) while the words of its source meet the source's target: rate = cap / (1 + exp(-l * c)
* (cap - 1)), with c the document's size over the mean size of its source, and l the source's dual
variable. The dual is convex. Its Newton steps are aggregations over a table of (source, size, number of
documents), to which the documents are reduced exactly. Rates then become whole copies: documents of a
source are dealt by hash into as many bounded groups as the source's own documents fill, and each group is gone through
from the largest document to the smallest. The words that are owed so far decide the copies of each: those among 0
to `cap` that leave the smallest error which the smaller documents can still make good. What a group misses in the end is
about one or two of its smallest sizes, unless its documents are too few to come so near.

Defined cases: null text has size 0; a null source is a source of its own, the last one; sources without
words have target 0; documents of size 0 take no words; rows that agree in doc_id (also null), source and size
are interchangeable and are counted together, in pieces of at most as many as a group holds; how the rows are
split into partitions decides nothing; ties go by doc_id; empty tables give no rows; other columns than doc_id, source and text are left out, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
#: Documents that one group of the rounding is meant to hold.
GROUP = 500
#: Steps after which each second one halves the bracket, so that the steps end.
HALVING = 16
#: Newton stops when each source's expected words are within this share of its target.
TOLERANCE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) of each row."""
    return docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(histogram: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs and target of each source.

    A source is full once the common level times its weight reaches cap times its size. Sources get full in
    the order of size over weight; one pass over the sources (not the documents) in this order finds the
    level at which the rest meets what is left.
    """
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("weight", weight).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    level = F.try_divide(budget * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    # the common level is that of the first source in this order which it doesn't fill
    levelled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(filling))
    share = F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("place"))).over(everything)
    target = F.coalesce(F.least(cap * F.col("source_size"), F.col("weight") * share), cap * F.col("source_size"))
    return levelled.withColumn("target", target.cast("double")).select("source", "source_size", "n_docs", "target")


def rate(dual: Column, size: Column, mean: Column, cap: float = CAP) -> Column:
    """The tilted rate; 1 where the dual is 0, below cap. An infinite dual means a full source: cap itself."""
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -dual * size / mean))
    return F.when(size == 0, 0.0).when(dual == math.inf, cap).otherwise(cap / (1 + F.exp(tilt) * (cap - 1)))


def solve(histogram: DataFrame, wanted: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """source, source_size, n_docs, target, mean (size) and dual: Newton steps on all sources at once.

    Each step is one aggregation of the histogram; the driver sees only the worst error. A source's
    step is held inside the bracket that earlier steps have left it (the gradient is monotone), and goes to the
    middle of it when Newton would leave it; after HALVING steps, each second one goes there in any case. A source is done
    within the tolerance, or when no number is left between the ends of its bracket.
    """
    duals = stored(
        wanted.select(
            "source", "source_size", "n_docs", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"),
            F.when(F.col("target") >= cap * F.col("source_size"), F.lit(math.inf)).otherwise(F.lit(0.0)).alias("dual"),
        )
    )
    for turn in itertools.count(1):
        r = rate(F.col("dual"), F.col("size"), F.col("mean"), cap)
        words = (
            histogram.where("size > 0").join(duals.select("source", "dual", "mean").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source").agg(F.sum(F.col("n") * F.col("size") * r).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r * (1 - r / cap)).alias("slope"))
            .select(F.col("source").alias("s"), "words", "slope")
        )
        error = F.coalesce("words", F.lit(0.0)) - F.col("target")
        free = (F.col("dual") != math.inf) & (F.col("target") > 0)
        low, high = F.when(error < 0, F.col("dual")).otherwise(F.col("low")), F.when(error > 0, F.col("dual")).otherwise(F.col("high"))
        newton = F.col("dual") - F.try_divide(error, F.col("slope"))
        middle = (low + high) / 2
        to = F.when((newton > low) & (newton < high) & F.lit(turn <= HALVING or turn % 2 > 0), newton).otherwise(middle)
        done = (F.abs(error) <= tolerance * F.col("target")) | (middle == low) | (middle == high)
        step = duals.join(words, F.col("source").eqNullSafe(F.col("s")), "left")
        duals = stored(step.select("source", "source_size", "n_docs", "target", "mean", low.alias("low"), high.alias("high"), F.when(free & ~done, to).otherwise(F.col("dual")).alias("dual"), F.coalesce(free & ~done, F.lit(False)).alias("open")))
        if not duals.where("open").limit(1).count():
            return duals.select("source", "source_size", "n_docs", "target", "mean", "dual")
        duals = duals.drop("open")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (0 to cap) of each row."""
    alike = sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("all"))
    pieces = alike.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / group))))
    rows = stored(pieces.select("doc_id", "source", "size", "piece", F.least(F.lit(group), F.col("all") - F.col("piece") * group).alias("rows")))
    histogram = stored(rows.groupBy("source", "size").agg(F.sum("rows").alias("n"), F.count("*").alias("pieces")))
    groups = histogram.groupBy(F.col("source").alias("of")).agg(F.ceil(F.sum("pieces") / group).alias("groups"))
    duals = solve(histogram, targets(histogram, weights, budget, cap), cap)
    # sums of doubles hang on their order; beyond these digits the duals may differ from run to run
    duals = duals.withColumn("dual", F.round("dual", 6)).join(groups, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    dealt = rows.join(duals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = rate(F.col("dual"), F.col("size"), F.col("mean"), cap)
    entry = F.struct((-F.col("size")).alias("less"), "doc_id", "piece", "size", F.col("rows").alias("n"), wanted.alias("rate"))
    part = F.pmod(F.xxhash64("doc_id", "size", "piece", F.lit("part")), F.col("groups")).alias("part")
    lists = dealt.groupBy("source", "source_size", "target", part).agg(F.array_sort(F.collect_list(entry)).alias("list"))
    words = lambda x: x["rate"] * x["n"] * x["size"]
    most = lambda x: cap * x["n"] * x["size"]
    total = lambda f: F.aggregate("list", F.lit(0.0), lambda t, x: t + f(x))

    def carry(state: Column, x: Column) -> Column:
        """The smaller documents can still take `up` words more than their rates say, or `down` words less."""
        owed, up, down = state["owed"] + words(x), state["up"] - (most(x) - words(x)), state["down"] - words(x)
        near = F.greatest(F.lit(0.0), F.least(F.floor(F.lit(cap) * x["n"]).cast("double"), F.round(owed / F.greatest(x["size"], F.lit(1)))))

        def cost(copies: Column) -> Column:
            error = owed - copies * x["size"]
            return F.struct(F.round(F.greatest(error - up, -error - down, F.lit(0.0)), 6).alias("lost"), F.abs(error).alias("error"), copies.alias("copies"))

        # the nearest number of copies, one less and one more: any other leaves more that can't be made good
        tried = F.filter(F.array(near, near - 1, near + 1), lambda c: (c >= 0) & (c <= F.floor(F.lit(cap) * x["n"])))
        copies = F.when(x["size"] == 0, 0.0).otherwise(F.array_min(F.transform(tried, cost))["copies"])
        return F.struct((owed - copies * x["size"]).alias("owed"), up.alias("up"), down.alias("down"), F.concat(state["out"], F.array(copies.cast("long"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("owed"), total(lambda x: most(x) - words(x)).alias("up"), total(words).alias("down"), F.expr("cast(array() as array<bigint>)").alias("out"))
    copies = lists.select("source", "source_size", "target", "list", F.aggregate("list", start, carry, lambda s: s["out"]).alias("copies"))
    rounded = copies.select("source", "source_size", "target", F.explode(F.arrays_zip("list", "copies")).alias("x"))
    # rows that were counted together share their copies as evenly as can be
    single = rounded.select("source", "source_size", "target", "x.list", "x.copies", F.explode(F.sequence(F.lit(1), F.col("x.list.n"))).alias("k"))
    share = F.floor(F.col("copies") / F.col("list.n")) + (F.col("k") <= F.col("copies") % F.col("list.n")).cast("long")
    return single.select("list.doc_id", "source", "list.size", "source_size", "target", "list.rate", share.cast("int").alias("copies"))
