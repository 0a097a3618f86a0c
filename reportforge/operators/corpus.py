"""Corpus building: labels, dedup, splits, samples, screens and their accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import content_hash, era, prefix, rounded


def positive(code: Column, day: Column) -> Column:
    """The code's prefix counts as positive in the day's era."""
    v1, v2 = C.POSITIVE_PREFIXES["v1"], C.POSITIVE_PREFIXES["v2"]
    return F.when(era(day) == "v2", prefix(code).isin(v2)).otherwise(prefix(code).isin(v1))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, found by a partial minimum, so a key with most rows is no hot window."""
    rest = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__x"))
    return picked.select(*key, "__x.__row.*").select(*rows.columns)


def duplicate_excess(rows: DataFrame, text: str, part: Column) -> DataFrame:
    """Rows beyond the first of equal texts, by the part of the kept row and of the dropped one."""
    firsts = rows.groupBy(content_hash(F.col(text)).alias("h")).agg(F.min(F.struct(F.col("order_key"), part.alias("part"))).alias("f"))
    joined = rows.select(content_hash(F.col(text)).alias("h"), "order_key", part.alias("part")).join(firsts, "h").filter(F.col("order_key") > F.col("f.order_key"))
    return joined.groupBy(F.col("f.part").alias("kept"), F.col("part").alias("dropped")).agg(F.count("*").alias("n"))


def occurrence_uid(rows: DataFrame, id_: str, order: list[str], stem: str) -> Column:
    """stem-id, or stem-id-a, -b, .. in order where the id repeats."""
    nth, many = F.row_number().over(W.partitionBy(id_).orderBy(*order)), F.count("*").over(W.partitionBy(id_))
    bare = F.concat(F.lit(f"{stem}-"), F.col(id_).cast("string"))
    return F.when(many == 1, bare).otherwise(F.concat(bare, F.lit("-"), F.char(96 + nth)))


def temporal_split(rows: DataFrame, day: str, test_from: str, test_to: str) -> DataFrame:
    """'test' within the bounds (inclusive), 'train' before; rows after or without a day are left out."""
    d = F.col(day)
    return rows.withColumn("split", F.when(d < test_from, "train").when(d <= test_to, "test")).filter(F.col("split").isNotNull())


def group_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Whole groups in hash order go to 'val' while fewer rows than the share are taken; the others are 'train'.

    Groups are counted first. Cumulative sums run within hash buckets and over bucket totals, so no window sees all
    groups in one task.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("c")).withColumn("h", F.xxhash64(F.lit(seed), F.col(group))).withColumn("b", F.shiftright("h", 52))
    buckets = sizes.groupBy("b").agg(F.sum("c").alias("s"))
    bases = buckets.select("b", F.coalesce(F.sum("s").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = F.broadcast(sizes.agg(F.sum("c").alias("total")))
    inner = F.coalesce(F.sum("c").over(W.partitionBy("b").orderBy("h", group).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = sizes.withColumn("inner", inner).join(F.broadcast(bases), "b").crossJoin(total)
    chosen = marked.select(group, F.when(F.col("base") + F.col("inner") < share * F.col("total"), "val").otherwise("train").alias("split"))
    return rows.join(chosen, group)


def exact_sample(rows: DataFrame, n: int, id_: str, seed: int) -> DataFrame:
    """Exactly n rows (all, if fewer), the first in the order of a seeded hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_).limit(n)


def first_of_each(rows: DataFrame, stratum: str, k: int, order: list[Column]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).filter(F.col("__r") <= k).drop("__r")


def round_robin(rows: DataFrame, order: list[str], hands: int) -> DataFrame:
    """`rows` with a hand dealt in turn, in rising order; rows are numbered by ranges, not in one task."""
    from .mining import numbered

    return numbered(rows, [F.col(c) for c in order], "hand").withColumn("hand", F.col("hand") % hands)


def leakage(train: DataFrame, other: DataFrame, group: str) -> DataFrame:
    """Groups in both, rows of `other` and how many have a group of `train`; a null group is in none."""
    seen = train.filter(F.col(group).isNotNull()).select(F.col(group).alias("g")).distinct().withColumn("hit", F.lit(1))
    joined = other.join(seen, F.col(group) == F.col("g"), "left")
    return joined.agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("g"))).alias("groups"), F.count("*").alias("n"), F.count("hit").alias("hits"), rounded(F.avg(F.coalesce("hit", F.lit(0)).cast("double"))).alias("share"))


def mix_ratio(rows: DataFrame, source: str, quotas: dict[str, int]) -> DataFrame:
    """Rows per source against its quota, and the shortfall in per cent."""
    wanted = F.broadcast(rows.sparkSession.createDataFrame(list(quotas.items()), "source string, quota long"))
    counts = rows.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    short = F.greatest(F.lit(0), F.col("quota") - F.coalesce("n", F.lit(0)))
    return wanted.join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), "quota", rounded(100.0 * short / F.col("quota"), 2).alias("shortfall"))


def staged_drops(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """`rows` with the first rule that drops each as `drop_stage`; null where it stays."""
    stage = F.lit(None).cast("string")
    for name, hit in reversed(rules):
        stage = F.when(F.coalesce(hit, F.lit(False)), name).otherwise(stage)
    return rows.withColumn("drop_stage", stage)


def length_bins(rows: DataFrame, length: str, reference: DataFrame) -> DataFrame:
    """`rows` with the decile (0..9) of another corpus that their length falls in."""
    edges = F.broadcast(reference.agg(F.percentile(length, [k / 10 for k in range(1, 10)]).alias("edges")))
    return rows.crossJoin(edges).withColumn("bin", F.size(F.filter("edges", lambda e: F.col(length) >= e))).drop("edges")


def length_matched(rows: DataFrame, length: str, reference: DataFrame, n: int, id_: str, seed: int) -> DataFrame:
    """About n rows with a tenth from each length decile of `reference`."""
    binned = length_bins(rows, length, reference)
    order = W.partitionBy("bin").orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_)
    return binned.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n // 10).drop("__r")


def coverage(rows: DataFrame, text: str, terms: list[str], gate: int) -> DataFrame:
    """Rows that hold each term, and whether that reaches the gate."""
    hits = rows.agg(*[F.count_if(F.lower(text).contains(t)).alias(t) for t in terms])
    long = hits.select(F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("n")) for t in terms])).alias("x")).select("x.*")
    return long.withColumn("enough", F.col("n") >= gate)


def new_rows(rows: DataFrame, stored_hashes: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each content that no stored row has."""
    hashed = rows.withColumn("content_hash", content_hash(F.col(text)))
    return keep_first(hashed, ["content_hash"], order).join(stored_hashes.select("content_hash").distinct(), "content_hash", "left_anti")
