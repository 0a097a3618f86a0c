"""A summary that reads new batches only: partial sums of each entry of a store's manifest, kept beside it and added up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import rate, rounded
from ..sources.publish import Store

PARTIAL = "measure string, n long, total double"


def report_sums(reports: DataFrame, threshold: float = C.FLAG) -> DataFrame:
    """(measure, n, total) of scored and gated reports: sums that can be added to those of other reports."""
    score = F.col("score")
    gates = F.transform(F.filter(F.coalesce("gates", F.array()), lambda g: g["triggered"]), lambda g: F.concat(F.lit("gate:"), g["name"]))
    marks = F.concat(F.array(F.lit("reports")), F.when(score.isNotNull(), F.array(F.lit("scored"))).otherwise(F.array()), F.when(score >= threshold, F.array(F.lit("flagged"))).otherwise(F.array()), gates)
    flat = reports.select(F.explode(marks).alias("measure"), "score")
    return flat.groupBy("measure").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("measure") == "scored", F.col("score"))), F.lit(0.0)).alias("total"))


def partials(store: Store, name: str, schema: str, sums: Callable[[DataFrame], DataFrame], kind: str) -> tuple[DataFrame, int]:
    """All entries' partial sums, and how many entries had to be read for them.

    An entry of the manifest never changes, so its sums are written once under its folder's name. Entries that compaction
    swapped away are not listed any more, and neither are their sums. A batch that was cancelled never was.
    """
    entries = [e for e in store.snapshot()[1] if name in e["tables"]]
    held = set(store.names(f"sums/{kind}"))
    missing = [e for e in entries if e["folder"].replace("/", "-") not in held]
    for e in missing:
        store.put_once(f"sums/{kind}/{e['folder'].replace('/', '-')}", sums(store.of([e], name, schema)).select("measure", "n", "total").coalesce(1))
    paths = [f"{store.root}/sums/{kind}/{e['folder'].replace('/', '-')}" for e in entries]
    read = store.spark.read.schema(PARTIAL)
    return (read.parquet(*paths) if paths else store.spark.createDataFrame([], PARTIAL)), len(missing)


def summed(parts: DataFrame) -> DataFrame:
    """One row: reports, scored, flagged, flag_rate over scored ones, mean_score, and triggered (gate -> reports)."""
    per = parts.groupBy("measure").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    of = lambda m, c="n": F.coalesce(F.max(F.when(F.col("measure") == m, F.col(c))), F.lit(0))
    gates = F.array_sort(F.filter(F.collect_list(F.when(F.startswith("measure", F.lit("gate:")), F.struct(F.expr("substring(measure, 6)").alias("gate"), "n"))), lambda x: x.isNotNull()))  # a row a gate
    out = per.agg(of("reports").alias("reports"), of("scored").alias("scored"), of("flagged").alias("flagged"), of("scored", "total").alias("total"), F.map_from_entries(gates).alias("triggered"))
    mean = F.when(F.col("scored") > 0, F.col("total") / F.col("scored")).otherwise(F.lit(0.0))
    return out.select("reports", "scored", "flagged", rounded(rate(F.col("flagged"), F.col("scored"))).alias("flag_rate"), rounded(mean).alias("mean_score"), "triggered")


def refreshed(store: Store, schema: str, name: str = "reports", threshold: float = C.FLAG) -> tuple[DataFrame, int]:
    """The summary of a store's reports, and how many entries were read for it."""
    parts, new = partials(store, name, schema, lambda rows: report_sums(rows, threshold), f"reports-{threshold}")
    return summed(parts), new
