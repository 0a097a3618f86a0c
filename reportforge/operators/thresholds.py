"""Where a near-duplicate threshold should lie: cosines of pairs that are duplicates, share a template, or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import threshold_grid
from .mining import numbered


def duplicate_pairs(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """(a, b): each later row of a text with the first one; linear in the copies."""
    first = rows.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("__t")).agg(F.min(id_).alias("a"))
    return rows.join(first, F.col(text) == F.col("__t")).filter(F.col("a") < F.col(id_)).select("a", F.col(id_).alias("b"))


def template_pairs(rows: DataFrame, id_: str, by: str, kind: str) -> DataFrame:
    """(a, b): of each value of `by` with two kinds at least, the first row and the first of another kind."""
    held = rows.filter(F.col(by).isNotNull() & (F.col(by) != "") & F.col(kind).isNotNull())
    firsts = held.groupBy(F.col(by).alias("__g"), F.col(kind).alias("__k")).agg(F.min(id_).alias("id"))  # a row a kind
    lead = firsts.groupBy("__g").agg(F.min(F.struct("id", "__k")).alias("a"))
    other = firsts.join(lead, "__g").filter(F.col("__k") != F.col("a.__k")).groupBy("__g").agg(F.first("a.id").alias("a"), F.min("id").alias("b"))
    return other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def random_pairs(rows: DataFrame, id_: str, text: str, seed: int = 42) -> DataFrame:
    """(a, b): rows in the order of a hash of their ids, two by two, if their texts differ. Each row stands in one pair at most."""
    order = [F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("id")]
    placed = numbered(rows.select(F.col(id_).alias("id"), F.xxhash64(text).alias("h")), order, "nth").withColumn("pair", F.floor(F.col("nth") / 2))
    sides = placed.groupBy("pair").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"), F.min("h").alias("x"), F.max("h").alias("y"))
    return sides.filter("n = 2 and x <> y").select("a", "b")


def pair_cosines(pairs: DataFrame, vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """`pairs` (a, b) with the cosine of their vectors, 0 for a zero vector. Pairs go without a vector for either, or of
    two lengths, or with a null component. Two keyed joins; ids of `vectors` are unique."""
    bad = F.exists(vector, lambda x: x.isNull())
    clean = vectors.filter(F.col(vector).isNotNull() & ~bad).select(F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    both = pairs.join(clean.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(clean.select(F.col("id").alias("b"), F.col("v").alias("y")), "b").filter(F.size("x") == F.size("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))
    return both.withColumn("cosine", F.when(norm > 0, dot("x", "y") / norm).otherwise(0.0)).drop("x", "y")


def measured(duplicates: DataFrame, others: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """threshold, recall of the duplicates, false-positive rate of the others, f1, over a short grid of cosines."""
    both = duplicates.select("cosine", F.lit(1).alias("y")).unionByName(others.select("cosine", F.lit(0).alias("y")))
    return threshold_grid(both, "y", "cosine", grid or [round(0.8 + 0.005 * k, 3) for k in range(40)])
