"""Drops of a pass in order, where what counts depends on what was kept before, solved by rounds over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .overlap import shared_runs
from .work import Work


def earliest(posts: DataFrame, most: int, of: str) -> DataFrame:
    """(class, of): the first most + 1 holders of each class as (id, size), in order. Partitions pass on as many each."""
    place = F.row_number().over(W.partitionBy("class").orderBy("id"))
    few = posts.withColumn("place", place).filter(F.col("place") <= most + 1)
    return few.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("id", "size"))).alias(of))


def jaccard(c: Column) -> Column:
    return c / (F.col("size") + F.col("a.size") - c)


def cross_file_drops(rows: DataFrame, prior: DataFrame, id_: str, text: str, n: int = 8, at: float = 0.5, most: int = 50) -> DataFrame:
    """(id, kept, keeper, jaccard): what a pass in order of id drops, each row of a Jaccard of `at` or more with a kept one.

    `prior` rows stand before all others; they are never dropped nor given back. A shingle counts for a row while at most
    `most` *kept* rows before it hold it, beyond that in sizes only; so the bound grows as the pass goes on, and depends on
    its own verdicts. `jaccard` is the greatest with a kept earlier row, `keeper` the earliest that reaches it, for rows
    that go. Ids are longs; rows without shingles (null or empty texts) stay. Equal ids: their texts are taken together.

    Shingles with the same holders are one class with a weight (`shared_runs`). First verdicts are guessed, as if a shingle
    counted while at most `most` rows before hold it of those that are kept by now: a row goes if it reaches `at` with one of
    them, it stays if no earlier open row shares with it one of the rare shingles of which two such rows must share
    one, or later if none may reach `at`. Each round settles the first open row at least, and a whole family of copies of
    a kept row. Then every verdict is reckoned anew from the kept rows before, until none changes: as a row's verdict
    follows from those of earlier rows, there is one such state, that of the pass; each time one more row is right at least.
    """
    spark, work = rows.sparkSession, Work(rows.sparkSession, "drops")
    base, last = rows.agg(F.min(id_)).first()[0] or 0, prior.agg(F.max(id_)).first()[0]
    shift = 0 if last is None else max(0, int(last) + 1 - int(base))
    both = prior.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("t"), F.lit(1).alias("old")).unionByName(
        rows.select((F.col(id_) + shift).cast("long").alias("id"), F.col(text).alias("t"), F.lit(0).alias("old")))
    posts, size = shared_runs(both, "id", "t", n, work)
    rest = F.sum("w").over(W.partitionBy("id").orderBy(F.desc("df"), F.desc("class")))  # of a class and those ordered after it
    ranked = posts.join(size, "id").withColumn("lead", F.col("size") - rest + 1 <= F.col("size") - F.ceil(F.col("size") * at) + 1)
    met = work.write(ranked.select("class", "id", "w", "size", "lead"))
    old = both.groupBy("id").agg(F.max("old").alias("old"))
    state = work.write(met.select("id").distinct().join(old, "id").select("id", (F.col("old") == 1).alias("old"), F.when(F.col("old") == 1, 1).alias("kept")))
    before = lambda c: F.coalesce(F.filter(c, lambda x: x["id"] < F.col("id")), F.array())
    no = lambda c: F.coalesce(F.col(c), F.lit(False))

    def near(c: Column) -> Column:
        """Without the holders that are too large or too small to reach `at`."""
        return F.filter(c, lambda x: F.least("size", x["size"]) >= F.greatest("size", x["size"]) * at)

    def pairs(posted: DataFrame, of: str) -> DataFrame:
        each = posted.select("id", "w", "size", F.explode(of).alias("a"))
        return each.groupBy("id", "size", "a").agg(F.sum("w").alias("c"))

    first = True
    while True:
        open_ = state.filter("kept is null").select("id")
        if open_.isEmpty():
            break
        waiting = met.join(open_, "id", "left_semi")
        index = earliest(met.join(state.filter("kept = 1").select("id"), "id", "left_semi"), most, "k")
        index = index.join(waiting.filter("lead").groupBy("class").agg(F.min("id").alias("first")), "class", "full_outer")
        if not first:
            index = index.join(earliest(waiting, most, "u"), "class", "full_outer")
        posted = waiting.join(index, "class").withColumn("a", before(F.col("k"))).filter(F.size("a") <= most)
        posted = posted.withColumns({"a": near(F.col("a")), "blocked": F.col("lead") & F.coalesce(F.col("first") < F.col("id"), F.lit(False))})
        if first:  # while all rows are open, a shared class is enough to wait for
            waits = posted.groupBy("id").agg(F.bool_or("blocked").alias("blocked"))
        else:
            posted = posted.withColumn("u", before(F.col("u"))).withColumn("cut", F.size("u") > most)
            posted = work.write(posted.select("id", "w", "size", "a", "blocked", "cut", F.when(~F.col("cut"), near(F.col("u"))).alias("u")))
            cut = posted.groupBy("id").agg(F.bool_or(F.col("blocked") & F.col("cut")).alias("sure"), F.sum(F.when(F.col("cut"), F.col("w")).otherwise(0)).alias("more"))
            able = pairs(posted, "u").join(cut.select("id", "more"), "id").groupBy("id").agg(F.bool_or(jaccard(F.col("c") + F.col("more")) >= at).alias("able"))
            waits = cut.join(able, "id", "left").select("id", (F.col("sure") | no("able")).alias("blocked"))
        goes = pairs(posted, "a").groupBy("id").agg(F.bool_or(jaccard(F.col("c")) >= at).alias("goes"))
        joined = state.join(goes, "id", "left").join(waits, "id", "left")
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(no("goes"), 0).when(~no("blocked"), 1)
        state, first = work.write(joined.select("id", "old", now.cast("int").alias("kept"))), False

    while True:
        index = earliest(met.join(state.filter("kept = 1").select("id"), "id", "left_semi"), most, "k")
        posted = met.join(state.filter("not old").select("id"), "id", "left_semi").join(index, "class").withColumn("a", before(F.col("k"))).filter(F.size("a") <= most)
        best = pairs(posted, "a").groupBy("id").agg(F.max(F.struct(jaccard(F.col("c")).alias("j"), (-F.col("a.id")).alias("m"))).alias("best"))
        reckoned = state.join(best, "id", "left").withColumn("now", F.when(~F.col("old") & F.coalesce(F.col("best.j") >= at, F.lit(False)), 0).otherwise(1))
        reckoned = work.write(reckoned.select("id", "old", "kept", "now", "best"))
        if reckoned.filter("kept <> now").isEmpty():
            break
        state = reckoned.select("id", "old", F.col("now").alias("kept"))

    asked = rows.select((F.col(id_) + shift).cast("long").alias("id"), F.col(id_).cast("long").alias("own")).distinct()
    told = asked.join(reckoned, "id", "left")
    gone = F.coalesce(F.col("kept") == 0, F.lit(False))
    out = told.select(F.col("own").alias("id"), (~gone).alias("kept"), F.when(gone, -F.col("best.m") - shift).alias("keeper"), F.coalesce(F.col("best.j"), F.lit(0.0)).alias("jaccard"))
    out = work.write(out)
    work.drop(keep=1)
    return out
