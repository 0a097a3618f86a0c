"""The register that reviewers work on: stored rows and their defaults, filters, orders, options, decisions and clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import band, double, flagged


def decoded(predictions: DataFrame) -> DataFrame:
    """Stored predictions with the defaults of columns that older rows lack: spread 0, one variant, stability 1, no scores.

    `variant_scores` may be stored as JSON text; numbers that are zero stay zero.
    """
    scores = "array<double>"
    told = F.from_json("variant_scores", scores) if dict(predictions.dtypes).get("variant_scores") == "string" else F.col("variant_scores")
    return predictions.withColumns({
        "spread": F.coalesce("spread", double(0)), "n_variants": F.coalesce("n_variants", F.lit(1)), "stability": F.coalesce("stability", double(1)),
        "variant_scores": F.coalesce(told, F.array().cast(scores)),
    })


def rebanded(rows: DataFrame, score: str, flag: float, low: float = C.GRAY_LOW) -> DataFrame:
    """Stored scores under the current operating point: `band` and `flagged` are derived anew, scores are not touched."""
    return rows.withColumns({"band": band(F.col(score), flag, low), "flagged": flagged(F.col(score), flag)})


def has_facet(c: Column) -> Column:
    """A value that says something: not null, blank or a phrase for 'missing'."""
    return F.coalesce(~F.trim(c).isin("", *C.MISSING_WORDS), F.lit(False))


def options(rows: DataFrame, c: str) -> DataFrame:
    """The distinct values that say something, in order."""
    return rows.filter(has_facet(F.col(c))).select(F.col(c).alias("option")).distinct().orderBy("option")


def rule_reached(probabilities: Column, rule: str, thresholds: dict[str, float] | None = None) -> Column:
    """A rule's probability is known and reaches its threshold (a half where none is set)."""
    return F.coalesce(probabilities[rule] >= double((thresholds or {}).get(rule, 0.5)), F.lit(False))


def ordered(rows: DataFrame, by: str, score: str, key: str) -> DataFrame:
    """score-desc, score-asc, id-desc or id-asc; an unscored row sorts as -1; ties by id."""
    s = F.coalesce(F.col(score), double(-1))
    orders = {"score-desc": [s.desc(), F.asc(key)], "score-asc": [s.asc(), F.asc(key)], "id-desc": [F.desc(key)], "id-asc": [F.asc(key)]}
    if by not in orders:
        raise ValueError(f"unknown order {by}")
    return rows.orderBy(*orders[by])


def density_ordered(cells: DataFrame, key: str = "facet") -> DataFrame:
    """By falling rate, then falling count, then key."""
    return cells.orderBy(F.desc("rate"), F.desc("n"), key)


def shortlist(rows: DataFrame, order: list[Column], top: int, bench: int = 10) -> DataFrame:
    """The first `top` rows and the `bench` after them, told apart by `listed`: 'shortlist' or 'bench'. Not more leave the sort."""
    from pyspark.sql import Window as W

    few = rows.orderBy(*order).limit(top + bench)
    place = F.row_number().over(W.orderBy(*order))  # over top + bench rows
    return few.withColumn("place", place).withColumn("listed", F.when(F.col("place") <= top, "shortlist").otherwise("bench"))


def health(reports: DataFrame, predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """One row of table sizes."""
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(reports, "reports").crossJoin(one(predictions, "predictions")).crossJoin(one(actions, "actions"))


def compressed(groups: DataFrame, members: str, visible: DataFrame, key: str) -> DataFrame:
    """How many rows a queue is shorter by when each group shows as one: the visible rows of groups of two or more, less one a group."""
    seen = groups.withColumn("__group", F.monotonically_increasing_id()).select("__group", F.explode(members).alias(key)).join(visible.select(key).distinct(), key)
    sizes = seen.groupBy("__group").agg(F.count("*").alias("n")).filter("n >= 2")
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hidden"), F.count("*").alias("groups"))


def drifted(rows: DataFrame, score: str, server_flagged: Column, flag: float) -> DataFrame:
    """Rows that a client's threshold flags, that the server flagged, and whether these counts differ."""
    both = rows.agg(F.coalesce(F.sum(flagged(F.col(score), flag)), F.lit(0)).alias("client"), F.coalesce(F.sum(server_flagged.cast("int")), F.lit(0)).alias("server"))
    return both.withColumn("drift", F.col("client") != F.col("server"))


def display_date(event: Column, ingested: Column) -> tuple[Column, Column]:
    """The event's day, else the day it came in, and whether it is the latter."""
    return F.coalesce(event, ingested), event.isNull()


def window_start(last: Column, days: int) -> Column:
    """A preset window's first day: so many days before the last."""
    return F.date_sub(last, days)


def plain_detail(detail: Column) -> Column:
    """A gate's detail without vector arithmetic."""
    out = detail
    for pattern in C.VECTOR_TALK:
        out = F.regexp_replace(out, "(?i)" + pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\(\s*\)", ""), r"\s{2,}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([,.;:)])", "$1"), r"^[,;:\s]+|[,;:\s]+$", "")
    return F.trim(out)


def effective_word(band: Column, spread: Column, most: float = 0.15) -> Column:
    """A verdict that rephrasing moves much does not clear a report: LOW and CLEAR become REVIEW."""
    return F.when(F.coalesce(spread > double(most), F.lit(False)) & band.isin("LOW", "CLEAR"), "REVIEW").otherwise(band)


def severity_rank(band: Column) -> Column:
    return F.when(band == "HIGH", 3).when(band == "MODERATE", 2).when(band == "LOW", 1).otherwise(0)


def track(well_control: Column) -> Column:
    """The clock of a corrective action: 'fir' (a day) for well control, else 'iir' (30 days)."""
    return F.when(F.coalesce(well_control, F.lit(False)), "fir").otherwise("iir")


def default_due(track: Column, today: Column) -> Column:
    return F.date_add(today, F.when(track == "fir", 1).otherwise(30))


def decision_word(value: Column) -> Column:
    """What the latest label of a report decides: reject or confirm; null without one."""
    return F.when(value.isNotNull(), F.when(value == "not_sif_potential", "reject").otherwise("confirm"))


def latest_decision(overrides: DataFrame, report: str, ts: str, id_: str) -> DataFrame:
    """Each report's decision by its latest override of the label; ties to the greater id."""
    last = overrides.filter(F.col("field") == "sif_label").groupBy(report).agg(F.max_by(F.col("new_value"), F.struct(ts, id_)).alias("value"))
    return last.select(report, decision_word(F.col("value")).alias("decision"))


def decisions(overrides: DataFrame, reports: DataFrame, actions: DataFrame, report: str = "report_id", override: str = "override_id") -> DataFrame:
    """Every override with what is known of its report and of its action; either may be missing."""
    return overrides.join(reports, report, "left").join(actions, override, "left")


def rewritten(rows: DataFrame, c: str, new: Column, error: Column) -> DataFrame:
    """Rows with `c` as `new` says, but as it was where `error` is not null; `changed` tells rows that now differ."""
    value = F.when(error.isNull(), new).otherwise(F.col(c))
    return rows.withColumn("__new", value).withColumn("changed", ~F.col(c).eqNullSafe(F.col("__new"))).withColumn(c, F.col("__new")).drop("__new")
