"""Text and vector operators, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The prepositions counted.
PREPOSITIONS = (
    "aboard about above across after against along amid among around as at before behind below beneath beside between beyond by "
    "concerning considering despite down during except excepting excluding following for from in inside into like minus near of off on onto "
    "opposite outside over past per plus regarding round save since than through to toward towards under underneath unlike until up upon "
    "versus via with within without"
).split()


def clean_lines(text: Column, tags: list[str]) -> Column:
    """Without tags, each line trimmed, empty lines dropped, joined by spaces."""
    for tag in tags:
        text = F.replace(text, F.lit(tag), F.lit(""))
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != ""), " ")


#: A token's edges that are no letters, inside white space.
_EDGE = r"[^\p{L}\s]*+"


def prepositions(docs: DataFrame) -> DataFrame:
    """Adds word count, distinct prepositions, and hits for each hundred words, 0 without words.

    Words are tokens that have a letter, without what is no letter at their edges. Both are read off the
    text by one pass of an expression each, and no token becomes a row or an array element but the hits.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.regexp_extract_all(low, F.lit(rf"(?<!\S){_EDGE}({'|'.join(PREPOSITIONS)}){_EDGE}(?!\S)"), F.lit(1))
    words = F.regexp_count(low, F.lit(rf"(?<!\S){_EDGE}\p{{L}}")).cast("long")
    counted = docs.withColumn("hits", hits).withColumn("total_words", words)
    density = F.when(F.col("total_words") > 0, F.round(F.size("hits").cast("double") * 100 / F.col("total_words"), 6)).otherwise(0.0)
    return counted.withColumn("unique_prepositions", F.size(F.array_distinct("hits")).cast("long")).withColumn("density", density)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def vector_stats(df: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    n = F.size("embedding")
    out = df.withColumn("v", v).withColumn("s", _sum(F.col("v"))).withColumn("m", F.col("s") / n)
    spread = F.aggregate("v", F.struct(F.lit(0.0).alias("q"), F.col("m").alias("m")), lambda a, x: F.struct((a["q"] + (x - a["m"]) * (x - a["m"])).alias("q"), a["m"].alias("m")), lambda a: a["q"])
    return out.select("vec_id", F.round("s", 6).alias("total"), F.round("m", 6).alias("mean"), F.round(spread / n, 6).alias("variance"))


def vector_pairs(df: DataFrame) -> DataFrame:
    """Neighbours in pairs: inner product, and the sum of their middle."""
    v = df.select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("v"))
    pairs = v.groupBy("pair").agg(F.max_by("v", F.when(F.col("side") == 0, 1)).alias("a"), F.max_by("v", F.when(F.col("side") == 1, 1)).alias("b"), F.countDistinct("side").alias("n")).where("n = 2")
    dot = _sum(F.zip_with("a", "b", lambda x, y: x * y))
    return pairs.select("pair", F.round(dot, 6).alias("dot"), F.round(_sum(F.col("a")) * 0.5 + _sum(F.col("b")) * 0.5, 6).alias("mid_sum"))


def matrix_products(df: DataFrame, n: int) -> DataFrame:
    """Vectors of ``n * n`` components as square matrices, neighbours multiplied: sum of the product's entries and its trace."""
    v = df.select(F.floor(F.col("vec_id") / 2).cast("long").alias("pair"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").cast("array<double>").alias("v"))
    pairs = v.groupBy("pair").agg(F.max_by("v", F.when(F.col("side") == 0, 1)).alias("a"), F.max_by("v", F.when(F.col("side") == 1, 1)).alias("b"), F.countDistinct("side").alias("m")).where("m = 2")
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("a", i * n + 1, n))
    columns = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.element_at("b", (k * n + j).cast("int"))))
    cells = F.transform("rows", lambda r: F.transform("columns", lambda c: _sum(F.zip_with(r, c, lambda x, y: x * y))))
    made = pairs.withColumn("rows", rows).withColumn("columns", columns).withColumn("cells", cells)
    trace = _sum(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(F.element_at("cells", i), i)))
    return made.select("pair", F.round(_sum(F.flatten("cells")), 6).alias("total"), F.round(trace, 6).alias("trace"))
