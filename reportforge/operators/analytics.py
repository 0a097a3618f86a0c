"""Aggregates over reports and their optional predictions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import double, facet, flagged, month, rate, rounded, week, wilson


def facet_density(reports: DataFrame, predictions: DataFrame, key: str, by: str, threshold: float = C.FLAG) -> DataFrame:
    """Reports per facet: n, flagged, mean score with a missing score as 0, and rate over all reports, scored or not."""
    joined = reports.join(predictions.select(key, "score"), key, "left")
    grouped = joined.groupBy(facet(F.col(by)).alias("facet")).agg(
        F.count("*").alias("n"), F.sum(flagged(F.col("score"), threshold)).alias("flagged"), F.avg(F.coalesce("score", double(0))).alias("mean"))
    return grouped.select("facet", "n", "flagged", rounded(F.col("mean")).alias("mean_score"), rounded(rate(F.col("flagged"), F.col("n"))).alias("rate"))


def lifted(cells: DataFrame, baseline: DataFrame, min_n: int) -> DataFrame:
    """Cells (.., n, flagged) of enough rows with rate, lift over the one-row `baseline` (base) and Wilson bounds."""
    share = rate(F.col("flagged"), F.col("n"))
    low, high = wilson(share, F.col("n"))
    kept = cells.filter(F.col("n") >= min_n).crossJoin(F.broadcast(baseline))
    lift = F.when(F.col("base") > 0, share / F.col("base")).otherwise(double(0))
    return kept.withColumns({"rate": rounded(share), "lift": rounded(lift, 3), "ci_low": rounded(low), "ci_high": rounded(high)}).drop("base")


def baseline_of(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.agg(F.coalesce(F.avg(flagged(F.col("score"), threshold).cast("double")), double(0)).alias("base"))


def pattern_cells(scored: DataFrame, first: str, second: str, min_n: int = 2, threshold: float = C.FLAG) -> DataFrame:
    """Pairs of facets over scored reports."""
    cells = scored.groupBy(facet(F.col(first)).alias("first"), facet(F.col(second)).alias("second")).agg(F.count("*").alias("n"), F.sum(flagged(F.col("score"), threshold)).alias("flagged"))
    return lifted(cells, baseline_of(scored, threshold), min_n)


def barrier_cells(scored: DataFrame, key: str, activity: str, gates: str = "gates", min_n: int = 2, threshold: float = C.FLAG) -> DataFrame:
    """Activity by triggered barrier gate; a report counts once a barrier, the baseline is over all scored reports."""
    exploded = scored.select(key, facet(F.col(activity)).alias("first"), flagged(F.col("score"), threshold).alias("f"), F.explode_outer(gates).alias("g"))
    hits = exploded.filter(F.col("g.triggered") & F.col("g.name").isin(C.BARRIERS) & ~F.col("g.detail").ilike("gate error:%"))
    once = hits.select(key, "first", "f", F.col("g.name").alias("second")).distinct()
    cells = once.groupBy("first", "second").agg(F.count("*").alias("n"), F.sum("f").alias("flagged"))
    return lifted(cells, baseline_of(scored, threshold), min_n)


def summary(reports: DataFrame, predictions: DataFrame, key: str, threshold: float = C.FLAG) -> DataFrame:
    """One row: reports, scored, flagged, rate over scored rows, mean score of scored rows."""
    joined = reports.select(key).join(predictions.select(key, "score"), key, "left")
    out = joined.agg(F.count("*").alias("reports"), F.count("score").alias("scored"), F.coalesce(F.sum(flagged(F.col("score"), threshold)), F.lit(0)).alias("flagged"), F.coalesce(F.avg("score"), double(0)).alias("mean"))
    return out.select("reports", "scored", "flagged", rounded(rate(F.col("flagged"), F.col("scored"))).alias("flag_rate"), rounded(F.col("mean")).alias("mean_score"))


def trigger_counts(gated: DataFrame, gates: str = "gates") -> DataFrame:
    return gated.select(F.explode_outer(gates).alias("g")).filter("g.triggered").groupBy(F.col("g.name").alias("gate")).agg(F.count("*").alias("n"))


def dominant(rows: DataFrame, by: list[str], values: str, order: str) -> DataFrame:
    """The most frequent element of an array column per group; ties to the one seen first in `order`."""
    seen = rows.select(*by, order, F.posexplode(values).alias("at", "value"))
    counted = seen.groupBy(*by, "value").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    return counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("s"), "first", "value")).alias("x")).select(*by, F.col("x.value").alias("dominant"), (-F.col("x.s")).alias("support"))


def trend(scored: DataFrame, day: Column, unit: str, threshold: float = C.FLAG) -> DataFrame:
    """Weeks (their Monday) or months without gaps: n, flagged, rate per 100 (null without rows) and its interval."""
    bucket = week(day) if unit == "week" else F.date_trunc("month", day).cast("date")
    counts = scored.filter(day.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(flagged(F.col("score"), threshold)).alias("flagged"))
    step = F.expr("interval 7 days" if unit == "week" else "interval 1 month")
    spine = counts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", step)).alias("bucket"))
    full = spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flagged", F.lit(0)).alias("flagged"))
    share = F.when(F.col("n") > 0, F.col("flagged") / F.col("n"))
    low, high = wilson(share, F.col("n"), empty="null")
    return full.select("bucket", "n", "flagged", rounded(100 * share, 2).alias("rate"), rounded(100 * low, 2).alias("ci_low"), rounded(100 * high, 2).alias("ci_high"))


def trend_delta(buckets: DataFrame, k: int) -> DataFrame:
    """Rate of the last k buckets, of the k before, and the difference. One row a bucket: a window over few rows."""
    back = buckets.withColumn("r", F.row_number().over(W.orderBy(F.desc("bucket"))))
    part = lambda c, a, b: F.coalesce(F.sum(F.when(F.col("r").between(a, b), F.col(c))), F.lit(0))
    sums = back.agg(part("n", 1, k).alias("n_now"), part("flagged", 1, k).alias("f_now"), part("n", k + 1, 2 * k).alias("n_before"), part("flagged", k + 1, 2 * k).alias("f_before"))
    now, before = (100 * rate(F.col(f"f_{x}"), F.col(f"n_{x}")) for x in ("now", "before"))
    return sums.select("n_now", "n_before", rounded(now, 2).alias("rate_now"), rounded(before, 2).alias("rate_before"), rounded(now - before, 2).alias("delta"))


def ranking(cells: DataFrame, min_n: int) -> DataFrame:
    """Keys (key, n, flagged) with their Wilson lower bound; rank among those of enough rows, others quarantined."""
    low, _ = wilson(rate(F.col("flagged"), F.col("n")), F.col("n"))
    scored = cells.withColumn("lower", rounded(low)).withColumn("quarantined", F.col("n") < min_n)
    order = W.partitionBy("quarantined").orderBy(F.when(F.col("quarantined"), double(0)).otherwise(-F.col("lower")), F.desc("n"), "key")
    return scored.withColumn("rank", F.row_number().over(order))


def rank_change(now: DataFrame, before: DataFrame) -> DataFrame:
    """Ranks by rate, count and key, and how far each key rose since `before`; a new key did not move."""
    order = W.orderBy(F.desc("rate"), F.desc("n"), "key")
    old = before.select("key", F.row_number().over(order).alias("previous"))
    ranked = now.withColumn("rank", F.row_number().over(order)).join(old, "key", "left")
    return ranked.withColumn("previous", F.coalesce("previous", "rank")).withColumn("change", F.col("previous") - F.col("rank"))


def queue(
    rows: DataFrame, fields: list[str], search: str = "", band: str | None = None, equal: dict[str, str] | None = None, gray: Column | None = None,
    rule: str | None = None, least: float = 0.5, rules: str = "rules", first: str | None = None, last: str | None = None, day: str = "date",
) -> DataFrame:
    """Rows whose joined fields hold `search` (literally, case-blind), of a band, with facets equal, gray-listed, with a
    rule's probability (a map column) of `least` or more, and of a range of days."""
    out = rows
    if search:
        out = out.filter(F.lower(F.concat_ws(" ", *fields)).contains(search.lower()))
    if band:
        out = out.filter(F.col("band") == band)
    for name, value in (equal or {}).items():
        out = out.filter(F.col(name) == value)
    if rule:
        out = out.filter(F.try_element_at(F.col(rules), F.lit(rule)) >= least)
    if first or last:
        out = ranged(out, day, first, last)
    return out if gray is None else out.filter(gray)


def page(rows: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit lies in 1..1000, offset is not negative")
    return rows.orderBy(F.desc(key)).offset(offset).limit(limit)


def ranged(rows: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Inclusive ISO days, either end open; rows without a day go only where an end is given. An end that is no day is an error."""
    for end in (first, last):
        if end and (len(end) != 10 or date.fromisoformat(end).isoformat() != end):
            raise ValueError(f"{end!r} is not YYYY-MM-DD")
    if first and last and first > last:
        raise ValueError("the range is upside down")
    if first:
        rows = rows.filter(F.col(day) >= first)
    return rows.filter(F.col(day) <= last) if last else rows


def months(day: str) -> Column:
    return month(F.col(day))
