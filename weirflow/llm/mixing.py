"""Mixing sources to target weights by Pareto order sampling.

Each source's target comes from a share of all sizes split by weight; a source stops
at ``cap`` times its own size and the excess goes to the others by weight. The level that
the others reach is found by raising it over sums of all sources, so sources may be many.
What a target holds of whole copies of its source is certain. The rest is a Pareto order
sample of unequal probabilities: a document's odds of inclusion are those of its source's rest
times the square root of its size over the source's mean (or a column that the caller
prefers); every document gets a uniform number from its id, whose odds are divided by the odds of
inclusion, and documents are taken in that order until half of the next one would pass
the remaining words.

The order is never sorted whole. Sizes are summed per source and slice of the rank
axis (a fixed number of slices), the slice that holds the cut is found by a running
sum, and only its places are ordered, which gives one cut per source. Taking documents
is then a comparison with that cut, so texts are never shuffled and a source with any
share of all rows is read where it lies. Repeated rows share a place; where the cut falls
among them, as many are taken as fit, counted over parts of them.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; null ids draw their number from the text; a source of size 0 has target 0 and
gives nothing; an empty table gives an empty result; the columns that ``mix`` adds replace
clashing ones, and ``mixed_rows`` returns the columns of ``docs`` as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import WS, side
from weirflow.plans.runtime import Scratch

#: Slices of the rank axis.
SLICES = 4096
#: Parts in which repeated rows at a cut are counted.
TIE_PARTS = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def numbered(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``k``, the place of each source by code point, null last, from ranges that are numbered by themselves."""
    ranged = scratch.keep(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("held"))  # a row for each range
    ahead = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("own", own).join(F.broadcast(ahead), "part").withColumn("k", F.col("ahead") + F.col("own")).drop("part", "own", "ahead")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """From (source, source_size, n), a row each, to (source, k, source_size, n, target, base, rest).

    A source stops at its cap if the level reaches cap over weight. Leaving out those that stop
    raises the level for the others, until none is left to stop. ``base`` is the number of
    certain copies and ``rest`` the words that the sample has to add.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int"))
    capped = numbered(sizes, scratch).withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("limit_ratio", F.col("most") / F.col("w"))
    capped = scratch.keep(capped)
    wanted = share * (capped.agg(F.sum("source_size").alias("all")).first()["all"] or 0)
    level, stopped = float("-inf"), -1
    while level is not None:
        stops = F.col("limit_ratio") <= F.lit(level)
        at = capped.agg(F.count_if(stops).alias("n"), F.sum(F.when(stops, F.col("most"))).alias("most"), F.sum(F.when(~stops, F.col("w"))).alias("w")).first()
        if at["n"] == stopped:
            break
        stopped = at["n"]
        level = (wanted - (at["most"] or 0.0)) / at["w"] if at["w"] else None
    reached = F.lit(True) if level is None else F.col("limit_ratio") <= F.lit(level)
    target = F.when(reached, F.col("most")).otherwise(F.lit(level) * F.col("w"))
    return (
        capped.withColumn("target", target)
        .withColumn("base", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
        .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        .select("source", "k", "source_size", "n", "target", "base", "rest")
    )


def inclusion_odds(size: Column, prefer: Column | None) -> Column:
    """Odds of a document of this size in a source with (source_size, n, rest)."""
    share = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("rest") / F.col("source_size")))
    like = F.sqrt(F.greatest(size, F.lit(1)).cast("double") / (F.col("source_size").cast("double") / F.col("n"))) if prefer is None else prefer
    return share / (1 - share) * like


def rank_point(u: Column, odds: Column) -> Column:
    """Pareto rank (random odds over inclusion odds), moved into (0, 1)."""
    q = (u / (1 - u)) / odds
    return q / (1 + q)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    prefer: str | None = None,
    slices: int = SLICES,
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).

    ``prefer`` names a positive column that takes the place of the size in a document's inclusion odds.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    taken = _taken(docs, weights, share, cap, seed, prefer, slices)
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def _taken(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: str, prefer: str | None, slices: int) -> DataFrame:
    """(row, size, source_size, target, copies, taken): ``row`` is the input row."""
    scratch = Scratch(docs.sparkSession)
    like = F.col(prefer).cast("double") if prefer else F.lit(None).cast("double")
    facts = [F.col("source"), F.col("doc_id"), n_words(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"), like.alias("like")]
    narrow = scratch.keep(docs.select(*facts))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = scratch.keep(targets(sizes, weights, share, cap, scratch))
    n_sources = goal.count()
    point = rank_point(F.col("u"), inclusion_odds(F.col("size"), F.col("like") if prefer else None))
    slice_of = F.least(F.floor(F.col("p") * slices), F.lit(slices - 1)).cast("int")
    place = F.struct("p", F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("doc_id"), "size")

    def placed(df: DataFrame, table: DataFrame) -> DataFrame:
        """``df`` with its source's row of ``table`` and its place in the order."""
        joined = df.alias("d").join(side(table.withColumnRenamed("source", "__source"), n_sources), F.col("d.source").eqNullSafe(F.col("__source"))).drop("__source")
        return joined.withColumn("p", point).withColumn("slice", slice_of).withColumn("place", place)

    ordered = placed(narrow, goal.where("rest > 0"))
    along = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = (
        ordered.groupBy("k", "slice", "rest").agg(F.sum("size").alias("in_slice"))
        .withColumn("ahead", F.coalesce(F.sum("in_slice").over(along), F.lit(0)))
        .where((F.col("ahead") <= F.col("rest")) & (F.col("ahead") + F.col("in_slice") > F.col("rest")))
        .select("k", F.col("slice").alias("cut_slice"), "ahead")
    )
    held = scratch.keep(held)
    # Rows with one place are one here, so repeated rows are summed before they meet.
    places = ordered.join(side(held, n_sources), "k").where("slice = cut_slice").groupBy("k", "rest", "ahead", "place").agg(F.count(F.lit(1)).alias("m"))
    inside = Window.partitionBy("k").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("place.size")
    left = F.col("rest") - (F.col("ahead") + F.coalesce(F.sum(size * F.col("m")).over(inside), F.lit(0)) + size / 2)
    fit = F.when(left < 0, 0).when(size == 0, F.col("m")).otherwise(F.least(F.floor(F.try_divide(left, size)) + 1, F.col("m"))).cast("long")
    last = places.withColumn("fit", fit).where("fit > 0").groupBy("k").agg(F.max(F.struct("place", "fit", "m")).alias("last"))
    cuts = goal.join(held.drop("ahead"), "k", "left").join(last, "k", "left").select(*goal.columns, "cut_slice", F.col("last.place").alias("last"), F.col("last.fit").alias("fit"), F.col("last.m").alias("m"))
    cuts = scratch.keep(cuts)

    rows = placed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *facts), cuts)
    at_cut = F.col("slice") == F.col("cut_slice")
    some = F.coalesce(at_cut & (F.col("place") == F.col("last")) & (F.col("fit") < F.col("m")), F.lit(False))
    chosen = (F.col("rest") > 0) & (F.col("cut_slice").isNull() | (F.col("slice") < F.col("cut_slice")) | (at_cut & F.coalesce(F.col("place") <= F.col("last"), F.lit(False))))
    rows = rows.withColumn("some", some).withColumn("chosen", F.coalesce(chosen, F.lit(False)))
    if cuts.where("fit < m").limit(1).count():  # the cut of a source falls among repeated rows
        tied = scratch.keep(rows.where("some").withColumn("part", (F.monotonically_increasing_id() % TIE_PARTS).cast("int")))
        parts = tied.groupBy("k", "part").agg(F.count(F.lit(1)).alias("held"))
        before = parts.select("k", "part", F.coalesce(F.sum("held").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        own = F.row_number().over(Window.partitionBy("k", "part").orderBy("place"))
        tied = tied.withColumn("own", own).join(side(before, n_sources * TIE_PARTS), ["k", "part"]).withColumn("chosen", F.col("before") + F.col("own") <= F.col("fit"))
        rows = rows.where(~F.col("some")).unionByName(tied.select(*rows.columns))
    copies = (F.col("base") + F.col("chosen").cast("long")).cast("long")
    return rows.select("row", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", prefer: str | None = None, slices: int = SLICES) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of ``docs``."""
    out = _taken(docs, weights, share, cap, seed, prefer, slices).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
