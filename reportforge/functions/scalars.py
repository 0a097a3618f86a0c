"""Column functions: facets, flags, bands, intervals, hashes, dates."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def double(x: float) -> Column:
    return F.lit(float(x))


def facet(c: Column) -> Column:
    """A facet's key: null and the empty string are one; nothing is trimmed."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(C.UNSPECIFIED))


def flagged(score: Column, threshold: float = C.FLAG) -> Column:
    """1 where the score reaches the threshold, else 0, also for null."""
    return F.when(score >= double(threshold), 1).otherwise(0)


def band(score: Column, flag: float = C.FLAG, low: float = C.GRAY_LOW) -> Column:
    return F.when(score >= double(flag), "HIGH").when(score >= double(low), "MODERATE").when(score.isNotNull(), "LOW")


def rounded(c: Column, places: int = 4) -> Column:
    """Half up by one rule that other engines can repeat: floor(c * 10^places + 0.5) / 10^places."""
    scale = double(10**places)
    return F.floor(c * scale + double(0.5)).cast("double") / scale


def rate(k: Column, n: Column) -> Column:
    """k / n, 0 where n is 0."""
    return F.when(n > 0, k.cast("double") / n.cast("double")).otherwise(double(0))


def wilson(p: Column, n: Column, z: float = 1.96, empty: str = "zero") -> tuple[Column, Column]:
    """Bounds of a proportion's Wilson interval. Without trials: 'zero' (0, 0), 'null' (null, null) or 'unit' (0, 1)."""
    n = n.cast("double")
    share = double(1) + double(z * z) / n
    centre = (p + double(z * z) / (double(2) * n)) / share
    half = double(z) * F.sqrt(p * (double(1) - p) / n + double(z * z) / (double(4) * n * n)) / share
    none = {"zero": (double(0), double(0)), "null": (F.lit(None).cast("double"),) * 2, "unit": (double(0), double(1))}[empty]
    lower, upper = F.greatest(centre - half, double(0)), F.least(centre + half, double(1))
    return F.when(n > 0, lower).otherwise(none[0]), F.when(n > 0, upper).otherwise(none[1])


def tempered(p: Column, t: float) -> Column:
    """sigmoid(logit(p) / t)."""
    return double(1) / (double(1) + F.exp(-F.log(p / (double(1) - p)) / double(t)))


def normalised(text: Column) -> Column:
    """White space of every kind, control separators included, as single blanks; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def employer(name: Column) -> Column:
    """Lower case, every sign but a-z, 0-9 a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +", " "))


def prefix(code: Column) -> Column:
    return F.substring(F.trim(code), 1, 2)


def era(day: Column) -> Column:
    return F.when(day >= F.lit(C.ERA_BOUNDARY).cast("date"), "v2").otherwise("v1")


def iso_date(text: Column) -> Column:
    """A date only where the string is exactly its ISO form."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when((F.length(text) == 10) & (F.date_format(day, "yyyy-MM-dd") == text), day)


def month_start(text: Column) -> Column:
    """YYYYMM -> YYYY-MM-01, else null."""
    return F.when(text.rlike("^[0-9]{6}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.lit("01")))


def report_date(text: Column) -> Column:
    """An ISO start is sliced off as it is; D.M.YYYY becomes ISO where it is a real day; else null."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    made = F.concat_ws("-", F.get(parts, 2), F.lpad(F.get(parts, 1), 2, "0"), F.lpad(F.get(parts, 0), 2, "0"))
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(text, 1, 10)).when(
        text.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$") & F.try_to_date(made, "yyyy-MM-dd").isNotNull(), made)


def week(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.date_trunc("week", day).cast("date")


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def snippet(text: Column, most: int = 160) -> Column:
    """One line of at most `most` characters and an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def severity_rank(name: Column) -> Column:
    return F.when(name == "HIGH", 3).when(name == "MODERATE", 2).when(name == "LOW", 1).otherwise(0)


def composite(plus: list[Column], minus: list[Column]) -> Column:
    """Sum of the positive axes less the negative ones; a missing axis counts 0."""
    total = double(0)
    for c in plus:
        total = total + F.coalesce(c.cast("double"), double(0))
    for c in minus:
        total = total - F.coalesce(c.cast("double"), double(0))
    return total


def canonical_json(said: Column) -> Column:
    """JSON with sorted keys at every depth, without blanks and in ASCII; null for what does not parse. Of equal keys the last counts."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        except ValueError:
            return None

    def all_of(s: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in s], dtype=object)

    return F.pandas_udf(all_of, "string")(said)


def payload_hash(payload: Column) -> Column:
    """The name of a payload: its canonical JSON's hash. Equal content in another order of keys has the same one."""
    return F.sha2(canonical_json(payload), 256)
