"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle up to a fixed fraction of the hash
range, by default the whole range, in order and once each. Since the threshold is the same for all texts,
sketches of parts merge into the sketch of the whole by set union, and similarity and
containment are read off two sketches even when one text is far longer.

Defined cases: null and empty texts have an empty sketch; a text of one to four words
has one shingle, all of its words; two empty sketches are alike (1.0) only if neither text
has words, and of unknown likeness (null) if a smaller fraction kept nothing of them; an
empty sketch against another is 0.0; equal texts have equal sketches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import WS, whole

#: One of so many hashes is kept: all of them, so that texts of few shingles have a sketch and likenesses are exact.
SCALE = 1
#: Words in a shingle.
SHINGLE = 5

_LOW = -(2**63)


def threshold(scale: int = SCALE) -> int:
    """Hashes up to this signed 64-bit value are kept."""
    return _LOW + 2**64 // scale - 1


def with_sketch(df: DataFrame, text: str, to: str, scale: int = SCALE, n: int = SHINGLE) -> DataFrame:
    """Adds ``to``, the sketch of column ``text`` as a sorted array of hashes."""
    df = df.withColumn("__words", F.split(F.trim(F.regexp_replace(whole(F.col(text)), f"[{WS}]+", " ")), " "))
    w = F.col("__words")
    one = F.when(w[0] == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    hashes = F.when(F.size(w) < n, one).otherwise(many)
    kept = F.filter(hashes, lambda h: h <= F.lit(threshold(scale))) if scale > 1 else hashes
    return df.withColumn(to, F.sort_array(F.array_distinct(kept))).drop("__words")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts' shingles together."""
    return F.sort_array(F.array_union(a, b))


def wordless(text: Column) -> Column:
    """Whether a text has no words, so that its sketch is empty at any scale."""
    return F.trim(F.regexp_replace(whole(text), f"[{WS}]+", " ")) == ""


def likeness(a: Column, b: Column, both_wordless: Column) -> Column:
    """Estimated Jaccard similarity of two sketches; two empty ones are alike only if neither text has words, else nothing is known."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.when(both_wordless, F.lit(1.0))).otherwise(both / every)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, F.hex), " ")


# --- the next row in a global order, without one partition holding everything ---------------

#: Cut points taken from the order column's distribution: at most so many, in so many groups; and ranges made inside each.
QUANTILES, GROUPS, MOST_RANGES = 4096, 64, 64


def _position(order: Column, text: Column, bounds: list[int], ranges: int) -> Column:
    """The number of a row's range in descending order; rows without a key come last, by hash."""
    width = -(-max(1, len(bounds) - 1) // GROUPS)
    groups = [bounds[i : i + width + 1] for i in range(0, max(1, len(bounds) - 1), width)]

    def group_of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(order < groups[mid][0], group_of(lo, mid - 1)).otherwise(group_of(mid, hi))

    top = (len(bounds) - 1) * ranges
    if len(bounds) > 1:
        group = group_of(0, len(groups) - 1)
        own = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group + 1)
        # Bounds of the group that are not above the key; the last bound of all closes the last range.
        inside = F.least(F.greatest(F.size(F.filter(own, lambda b: b <= order)), F.lit(1)), F.size(own) - 1)
        low, high = F.element_at(own, inside), F.element_at(own, inside + 1)
        step = F.floor((order.cast("double") - low) * ranges / (high - low)).cast("int")
        keyed = F.lit(top) - ((group * width + inside - 1) * ranges + F.least(F.greatest(step, F.lit(0)), F.lit(ranges - 1)))
    else:
        keyed = F.lit(0)
    by_hash = F.lit(top + 1) + F.shiftrightunsigned(F.xxhash64(text), 58).cast("int")
    return F.when(order.isNull(), by_hash).otherwise(keyed).cast("int")


def with_next(df: DataFrame, order: str, text: str, carry: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d, rows_per_range: int = 256) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: its value in the next row by descending ``order``, and after the last row in the first.

    Rows are dealt into ranges of the order column, each range is ordered by itself,
    and the first row of every range is also given to the range before it. Ranges follow the number of
    rows: quantiles of the order column and, beyond those, equal steps between them, at
    most ``QUANTILES * MOST_RANGES + 64``, which bounds the table of first rows.
    ``prepare`` adds columns to be carried; it runs once a row, before the shuffle.
    """
    held = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(order).isNull()).alias("nulls")).first()
    cuts = min(QUANTILES, max(1, held["n"] // rows_per_range))
    quantiles = df.agg(F.percentile_approx(order, [i / cuts for i in range(cuts + 1)], 10 * max(1000, cuts)).alias("q")).first()["q"]
    bounds = sorted(set(quantiles or []))
    if len(bounds) == 1:
        bounds.append(bounds[0] + 1)
    ranges = min(MOST_RANGES, max(1, held["n"] // (QUANTILES * rows_per_range)))
    placed = df.withColumn("__range", _position(F.col(order), F.col(text), bounds, ranges))
    sort = [F.col(order).desc_nulls_last(), F.xxhash64(text), F.col(text)]
    unkeyed = F.min(F.when(F.col(order).isNull(), F.xxhash64(text))) if held["nulls"] else F.lit(None).cast("long")
    # The first key of every range: a few thousand rows at most, from the order column alone.
    firsts = placed.groupBy("__range").agg(F.max(order).alias("__top"), unkeyed.alias("__hash")).orderBy("__range").collect()
    before = {r["__range"]: firsts[i - 1]["__range"] for i, r in enumerate(firsts)}
    if not firsts:
        return prepare(placed).withColumns({f"next_{c}": F.col(c) for c in carry}).drop("__range")
    spark = df.sparkSession
    heads = spark.createDataFrame([(r["__range"], r["__top"], r["__hash"], before[r["__range"]], r["__range"] == firsts[0]["__range"]) for r in firsts], "r int, top long, h long, owner int, wraps boolean")
    is_head = (F.col("__range") == F.col("r")) & F.col("top").eqNullSafe(F.col(order)) & (F.col("top").isNotNull() | (F.xxhash64(text) == F.col("h")))
    lent = placed.join(F.broadcast(heads), is_head).withColumn("__range", F.col("owner")).withColumn("__lent", F.lit(1)).select(*placed.columns, "__lent")
    along = Window.partitionBy("__range").orderBy("__lent", *sort)
    both = prepare(placed.withColumn("__lent", F.lit(0)).unionByName(lent))
    out = both.withColumns({f"next_{c}": F.lead(c).over(along) for c in carry})
    return out.where("__lent = 0").drop("__range", "__lent")


def fingerprint_edits(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """For (doc_id, text): the fingerprints of each text, of its edited form, and of the next document, compared.

    The edited text has its last third replaced by as much of the next document's start.
    """
    base = docs.select("doc_id", whole(F.col("text")).alias("text"))
    out = with_next(base, "doc_id", "text", ["text"])
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    out = out.withColumn("edited", edited)
    for c in ("text", "edited", "next_text"):  # sketches are larger than texts, so the next row's is made again and not carried
        out = with_sketch(out, c, f"{c}_sketch", scale)
    near = lambda c: likeness(F.col("text_sketch"), F.col(f"{c}_sketch"), wordless(F.col("text")) & wordless(F.col(c)))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("text_sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next_text").alias("near_next"),
    )
