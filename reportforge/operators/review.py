"""Review logs: latest decisions and their lineage, actions, workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A key's rows meet as one partial maximum, not as a sorted group."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*rest).alias("__row"))).alias("__x")).select(*keys, "__x.__row.*")


def overrides(log: DataFrame, keys: list[str], id_: str, signature: list[str]) -> DataFrame:
    """The standing decision of each key: its id, and the ids it supersedes.

    A row that repeats the standing decision's signature does not replace it: its id goes to the end of the list. A
    row that differs becomes the decision; the one before it heads the list. Rows are taken in the order of `id_`, one
    after another: only the ids that are given back are held together.
    """
    sig, before = F.struct(*signature), F.lag(F.struct(*signature)).over(W.partitionBy(*keys).orderBy(id_))
    told = log.select(*keys, F.col(id_).alias("__id"), sig.alias("__sig"), (before.isNull() | ~before.eqNullSafe(sig)).alias("__new"))
    new, again = F.when(F.col("__new"), F.col("__id")), F.when(~F.col("__new"), F.col("__id"))
    out = told.groupBy(*keys).agg(
        F.max(new).alias("winner"), F.max_by("__sig", new).alias("decision"), F.array_sort(F.collect_list(new)).alias("__won"), F.array_sort(F.collect_list(again)).alias("__again"))
    # Decisions that gave way, the latest first, then repeats in their order.
    gone = F.concat(F.reverse(F.slice("__won", F.lit(1), F.size("__won") - 1)), F.col("__again"))
    return out.select(*keys, "winner", "decision", gone.alias("supersedes"))


def superseded(log: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Rows that are not the last of their key."""
    last = log.groupBy(*keys).agg(F.max(id_).alias("__last"))
    return log.join(last, keys).filter(F.col(id_) != F.col("__last")).drop("__last")


def workload(actions: DataFrame, today: Column) -> DataFrame:
    """Actions (owner, due, status) by owner: open, in progress, closed, overdue."""
    return actions.groupBy(F.coalesce("owner", F.lit("(none)")).alias("owner")).agg(
        F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.count_if(F.col("status") == "closed").alias("closed"), F.count_if((F.col("status") != "closed") & (F.col("due") < today)).alias("overdue"))


def action_state(log: DataFrame) -> DataFrame:
    """Versioned actions (action_id, version, deleted, ..) as they stand: the last version, none where that deletes."""
    return latest(log, ["action_id"], ["version"]).filter(~F.coalesce("deleted", F.lit(False)))


def audit(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The log with each row's place in its key, and whether it stands."""
    w = W.partitionBy(*keys).orderBy(*order)
    return log.withColumn("nth", F.row_number().over(w)).withColumn("standing", F.lead(F.lit(1)).over(w).isNull())
