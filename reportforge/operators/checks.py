"""Checks of rows before they are used: keys, training texts, reworded explanations, texts that were seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import content_hash


def key_difference(said: Column, required: list[str]) -> Column:
    """(missing, unknown) keys of a JSON object against those required, both sorted; all are missing where it is none."""
    held = F.coalesce(F.json_object_keys(said), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    return F.struct(F.array_sort(F.array_except(want, held)).alias("missing"), F.array_sort(F.array_except(held, want)).alias("unknown"))


def training_text(rows: DataFrame, masked: bool, fallback: bool = False, text: str = "text", masked_text: str = "masked_text") -> tuple[DataFrame, DataFrame]:
    """`rows` with `input`, the text to train on, and one row that counts what was taken in its place.

    With `masked` it is the masked text; a row without one is an error where it is read, or with `fallback` gives its plain
    text. Else it is the plain text, or where that is null or empty the masked one.
    """
    plain, hidden = F.col(text), F.col(masked_text)
    if masked:
        other = plain if fallback else F.raise_error(F.lit("a row has no masked text; allow the fallback to use its plain one")).cast("string")
        chosen, taken = F.when(hidden.isNotNull(), hidden).otherwise(F.coalesce(other, F.lit(""))), hidden.isNull()
    else:
        chosen, taken = F.coalesce(F.nullif(plain, F.lit("")), hidden, F.lit("")), plain.isNull()
    return rows.withColumn("input", chosen), rows.agg(F.count("*").alias("n"), F.count_if(taken).alias("fallbacks"))


def reworded_problems(explanation: Column, spans: Column, text: Column, score: Column) -> Column:
    """What is wrong with a reworded explanation: 'score' is missing (alone, not within a longer number), 'meta' talk about the
    task in its first 300 signs, 'spans' or 'quotes' that do not stand in the report's text. None: it may be shown."""
    said = F.coalesce(explanation, F.lit(""))
    number = F.concat(F.lit(r"(?<![\d.])\Q"), score, F.lit(r"\E(?!\d)"))
    stands = lambda s: F.coalesce((F.length(s) > 0) & F.contains(text, s), F.lit(False))
    quotes = F.concat(F.regexp_extract_all(said, F.lit('"([^"]+)"'), F.lit(1)), F.regexp_extract_all(said, F.lit("“([^”]+)”"), F.lit(1)))
    found = [
        F.when(~F.coalesce(F.regexp_like(said, number), F.lit(False)), "score"), F.when(F.substring(said, 1, 300).rlike("(?iU)" + C.META_TALK), "meta"),
        F.when(~F.forall(F.coalesce(spans, F.array().cast("array<string>")), stands), "spans"), F.when(~F.forall(quotes, stands), "quotes"),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def unseen_texts(rows: DataFrame, seen: DataFrame | None, id_: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The first row (by id) of each text that `seen` does not hold, white space aside; and counts of rows, repeats and seen ones.

    Null texts are one text, as empty ones are.
    """
    keyed = rows.withColumn("__h", content_hash(F.coalesce(F.col(text), F.lit(""))))
    first = keyed.groupBy("__h").agg(F.min(id_).alias("__first"), F.count("*").alias("__n"))
    if seen is None:
        known = first.limit(0).select("__h")
    else:
        known = seen.select(content_hash(F.coalesce(F.col(text), F.lit(""))).alias("__h")).distinct()
    fresh = first.join(known, "__h", "left_anti")
    told = first.join(known.withColumn("__old", F.lit(True)), "__h", "left").agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("repeats"), F.count_if("__old").alias("seen"))
    kept = keyed.join(fresh.select("__h", "__first"), "__h").filter(F.col(id_) == F.col("__first")).drop("__h", "__first")
    return kept, told

