"""Evaluation of scores and labels: confusion, curves, calibration, agreement, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import double, rate, rounded, tempered, wilson
from .work import checkpointed


def counts4(y: Column, hit: Column) -> list[Column]:
    return [F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn")]


def rates4(cells: DataFrame) -> DataFrame:
    """tp, fp, fn, tn with prevalence, precision, recall, f1, flag rate and Wilson bounds of precision and recall."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n, precision, recall = tp + fp + fn + tn, rate(tp, tp + fp), rate(tp, tp + fn)
    (pl, ph), (rl, rh) = wilson(precision, tp + fp), wilson(recall, tp + fn)
    return cells.withColumns({
        "prevalence": rounded(rate(tp + fn, n)), "precision": rounded(precision), "recall": rounded(recall), "f1": rounded(rate(2 * tp, 2 * tp + fp + fn)),
        "flag_rate": rounded(rate(tp + fp, n)), "precision_low": rounded(pl), "precision_high": rounded(ph), "recall_low": rounded(rl), "recall_high": rounded(rh),
    })


def confusion(rows: DataFrame, y: str, score: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    return rates4(rows.groupBy(*(by or [])).agg(*counts4(F.col(y), F.col(score) >= threshold)))


def pooled(rows: DataFrame, stratum: str, real: list[str], name: str = "real_pooled") -> DataFrame:
    """Every row under its stratum; rows of the `real` strata also under the pool."""
    both = F.when(F.col(stratum).isin(real), F.array(F.col(stratum), F.lit(name))).otherwise(F.array(F.col(stratum)))
    return rows.withColumn(stratum, F.explode(both))


def per_rule(rows: DataFrame, truth: str, found: str, least: int) -> DataFrame:
    """One against the rest for each rule of two array columns; rules of fewer than `least` true rows merge as 'Other'."""
    either = rows.withColumn("rule", F.explode(F.array_union(truth, found)))
    t, p = F.array_contains(F.col(truth), F.col("rule")), F.array_contains(F.col(found), F.col("rule"))
    cells = either.groupBy("rule").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    named = F.when(F.col("tp") + F.col("fn") >= least, F.col("rule")).otherwise("Other")
    merged = cells.groupBy(named.alias("rule")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return merged.withColumn("f1", rounded(rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def ranged(steps: DataFrame, key: str, rising: bool) -> DataFrame:
    """`steps` with `__bin`: ranges of the key of about equal numbers of rows, in order. Written down, as ranges are drawn from samples."""
    way = F.asc if rising else F.desc
    parts = max(1, int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return checkpointed(steps.repartitionByRange(parts, way(key)).withColumn("__bin", F.spark_partition_id()))


def sums_before(steps: DataFrame, key: str, of: list[str], rising: bool) -> DataFrame:
    """`steps` with `<c>_before`: the sum of c over all keys before it, and `<c>_all`.

    A task orders one range's steps, however the keys crowd; one row a range goes before.
    """
    way = F.asc if rising else F.desc
    binned = ranged(steps, key, rising)
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    bins = binned.groupBy("__bin").agg(*[F.sum(c).alias(f"__{c}") for c in of])
    bins = bins.select("__bin", *[F.coalesce(F.sum(f"__{c}").over(before(W.orderBy("__bin"))), F.lit(0)).alias(f"__{c}_base") for c in of], *[F.sum(f"__{c}").over(W.partitionBy()).alias(f"{c}_all") for c in of])
    own = W.partitionBy("__bin").orderBy(way(key))
    joined = binned.join(bins, "__bin")
    return joined.select(*steps.columns, *[(F.col(f"__{c}_base") + F.coalesce(F.sum(c).over(before(own)), F.lit(0))).alias(f"{c}_before") for c in of], *[f"{c}_all" for c in of])


def pr_curve(rows: DataFrame, y: str, score: str) -> DataFrame:
    """threshold, tp, fp, precision, recall at every distinct score, the highest first.

    Rows are counted per score before the running sums, which are taken bin by bin.
    """
    steps = rows.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("q"))
    run = sums_before(steps, "threshold", ["p", "q"], False).select("threshold", (F.col("p_before") + F.col("p")).alias("tp"), (F.col("q_before") + F.col("q")).alias("fp"), F.col("p_all").alias("all"))
    return run.select("threshold", "tp", "fp", rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("all")).alias("recall"))


def average_precision(curve: DataFrame, prevalence: float | None = None) -> DataFrame:
    """Sum of recall steps times precision, the highest threshold first. With `prevalence`, what the curve does not recall
    is taken at that precision: the tail that flags everything.

    A step's recall before it is that of the row before, or of the ranges before: recall only rises along the curve.
    """
    binned = ranged(curve.select("threshold", "precision", "recall"), "threshold", False)
    tops = binned.groupBy("__bin").agg(F.max("recall").alias("__top"))
    bases = tops.select("__bin", F.coalesce(F.max("__top").over(W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), double(0)).alias("__base"))  # a row a range
    before = F.coalesce(F.lag("recall").over(W.partitionBy("__bin").orderBy(F.desc("threshold"))), F.col("__base"))
    told = binned.join(bases, "__bin").withColumn("gain", (F.col("recall") - before) * F.col("precision")).agg(F.sum("gain").alias("ap"), F.max("recall").alias("top"))
    tail = F.lit(0.0) if prevalence is None else (1 - F.coalesce("top", double(0))) * F.lit(float(prevalence))
    return told.select(rounded(F.col("ap") + tail, 6).alias("average_precision"))


def strided_f1(curve: DataFrame, many: int = 400) -> DataFrame:
    """The threshold of the greatest F1 among distinct scores, every n-th of them from the lowest on, so that about `many`
    are tried; of equals the lowest. The curve's counts serve: no row is looked at again."""
    from .mining import numbered

    stride = max(1, curve.count() // many)
    tried = numbered(curve.select("threshold", "tp", "fp", "precision", "recall"), [F.col("threshold")], "__place").filter(F.col("__place") % stride == 0)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(double(0))
    best = tried.select(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("m"), "tp", "fp", "precision", "recall").alias("x")).agg(F.max("x").alias("x"))
    return best.select((-F.col("x.m")).alias("threshold"), *[F.col(f"x.{c}") for c in ("tp", "fp")], *[rounded(F.col(f"x.{c}")).alias(c) for c in ("precision", "recall", "f1")])


def paired(labels: DataFrame, scores: DataFrame, id_: str, y: str, score: str) -> DataFrame:
    """(id, y, score) of ids that both tables hold."""
    return labels.select(id_, y).join(scores.select(id_, score), id_)


def orphans(tables: dict[str, DataFrame], id_: str) -> DataFrame:
    """For every two tables how many ids of the first the second does not hold, and the smallest of them."""
    out = None
    for a, left in tables.items():
        for b, right in tables.items():
            if a != b:
                lost = left.select(id_).distinct().join(right.select(id_), id_, "left_anti").agg(F.count("*").alias("n"), F.min(id_).alias("first"))
                row = lost.select(F.lit(a).alias("held_by"), F.lit(b).alias("missing_in"), "n", "first")
                out = row if out is None else out.unionByName(row)
    return out


def auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    """ROC area by ranks; equal scores share their mean rank. Running sums are taken bin by bin over distinct scores."""
    steps = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y)).alias("p"), F.count("*").alias("n"))
    ranked = sums_before(steps, "s", ["n"], True).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    return sums.select(rounded((F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg")), 6).alias("auc"))


def operating_point(curve: DataFrame, floor: float) -> DataFrame:
    """The threshold of most recall with precision >= floor (ties: precision, threshold); none: reachable is false."""
    best = curve.filter(F.col("precision") >= floor).agg(F.max(F.struct("recall", "precision", "threshold")).alias("b"))
    return best.select(F.col("b.threshold").alias("threshold"), rounded(F.col("b.precision")).alias("precision"), rounded(F.col("b.recall")).alias("recall"), F.col("b").isNotNull().alias("reachable"))


def calibration(rows: DataFrame, y: str, score: str, bins: int = 15) -> DataFrame:
    """Equal-width bins, the last one closed: n, mean score, share of positives."""
    bin_ = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))


def ece_brier(rows: DataFrame, y: str, score: str, bins: int = 15) -> DataFrame:
    table = calibration(rows, y, score, bins)
    ece = table.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("e"))
    brier = rows.agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("b"))
    return ece.crossJoin(F.broadcast(brier)).select(rounded(F.col("e"), 6).alias("ece"), rounded(F.col("b"), 6).alias("brier"))


def threshold_grid(rows: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """Recall and false-positive rate at every threshold of a short grid."""
    points = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in grid], "threshold double"))
    cells = rows.crossJoin(points).groupBy("threshold").agg(*counts4(F.col(y), F.col(score) >= F.col("threshold")))
    return cells.select("threshold", rounded(rate(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"), rounded(rate(F.col("fp"), F.col("fp") + F.col("tn"))).alias("fpr"), rounded(rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def fit_temperature(rows: DataFrame, y: str, score: str, low: float = 0.01, high: float = 100.0, rounds: int = 6) -> float:
    """The temperature of least log loss, by narrowing a grid; each round is one aggregate over all rows."""
    for _ in range(rounds):
        grid = [low * (high / low) ** (k / 20) for k in range(21)]
        points = F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in grid], "t double"))
        logit = F.log(F.col(score) / (1 - F.col(score)))
        p = 1 / (1 + F.exp(-logit / F.col("t")))
        loss = rows.crossJoin(points).groupBy("t").agg(F.avg(-F.log(F.when(F.col(y) == 1, p).otherwise(1 - p))).alias("nll"))
        best = loss.orderBy("nll", "t").first()["t"]
        k = min(range(21), key=lambda i: abs(grid[i] - best))
        low, high = grid[max(0, k - 1)], grid[min(20, k + 1)]
    return best


def cooled(rows: DataFrame, score: str, t: float) -> DataFrame:
    return rows.withColumn(score, tempered(F.col(score), t))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    at = F.percentile(value, [0.05, 0.5, 0.95, 0.99])
    out = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), at.alias("q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select("n", rounded(F.col("mean"), 6).alias("mean"), *[rounded(F.col("q")[i], 6).alias(f"p{p}") for i, p in enumerate((5, 50, 95, 99))], rounded(F.col("min"), 6).alias("min"), rounded(F.col("max"), 6).alias("max"))


def consensus(labels: DataFrame, item: str, label: str, unsure: str = "unsure") -> DataFrame:
    """The label that all raters of an item share, else why there is none."""
    kinds = labels.groupBy(item).agg(F.collect_set(label).alias("k"), F.count("*").alias("raters"))
    one = F.get("k", 0)
    reason = F.when(F.size("k") > 1, "disagree").when(one == unsure, "unsure")
    return kinds.select(item, "raters", F.when(reason.isNull(), one).alias("consensus"), reason.alias("reason"))


def fleiss_kappa(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Kappa for each number of raters: raters, items, kappa (null where chance alone agrees fully)."""
    cells = labels.groupBy(item, label).agg(F.count("*").alias("c"))
    sized = cells.withColumn("raters", F.sum("c").over(W.partitionBy(item))).filter("raters >= 2")
    items = sized.groupBy("raters", item).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("agree"))
    observed = items.groupBy("raters").agg(F.count("*").alias("items"), (F.sum("agree") / (F.count("*") * F.col("raters") * (F.col("raters") - 1))).alias("po"))
    shares = sized.groupBy("raters", label).agg(F.sum("c").alias("c"))
    chance = shares.withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("raters"))).groupBy("raters").agg(F.sum(F.col("p") * F.col("p")).alias("pe"))
    both = observed.join(chance, "raters")
    return both.select("raters", "items", rounded(F.when(F.abs(1 - F.col("pe")) > 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def majority(votes: DataFrame, item: str, label: str, tie: str = "tie") -> DataFrame:
    counted = votes.groupBy(item, label).agg(F.count("*").alias("c"))
    best = counted.groupBy(item).agg(F.max("c").alias("m"), F.sum("c").alias("votes"), F.max(F.struct("c", label)).alias("x"), F.collect_list("c").alias("all"))
    ties = F.size(F.filter("all", lambda c: c == F.col("m"))) > 1
    return best.select(item, "votes", F.when(ties, tie).otherwise(F.col(f"x.{label}")).alias("majority"))


def raw_agreement(labels: DataFrame, item: str, label: str) -> DataFrame:
    """Share of items of several raters on which all agree."""
    kinds = labels.groupBy(item).agg(F.count_distinct(label).alias("k"), F.count("*").alias("n")).filter("n >= 2")
    return kinds.agg(F.count("*").alias("items"), rounded(F.avg((F.col("k") == 1).cast("double"))).alias("agreement"))


def mcnemar(rows: DataFrame, y: str, first: str, second: str) -> DataFrame:
    """Discordant counts of two classifiers (b: only the first is right, c: only the second) and the corrected statistic."""
    a, b = F.col(first) == F.col(y), F.col(second) == F.col(y)
    out = rows.agg(F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    n = F.col("b") + F.col("c")
    return out.withColumn("chi2", rounded(F.when(n > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1, 2) / n).otherwise(0.0), 6))


def chi2_tail(x: float) -> float:
    """Upper tail of a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2))


def exact_binomial(b: int, c: int) -> float:
    """Two-sided exact p of b against c under even odds."""
    n, k = b + c, min(b, c)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Step-down adjusted p-values; one row a test, few of them."""
    order = W.orderBy(p, "test")
    ranked = tests.withColumn("r", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy()))
    scaled = F.least(double(1), F.col(p) * (F.col("m") - F.col("r") + 1))
    return ranked.withColumn("adjusted", F.max(scaled).over(order.rowsBetween(W.unboundedPreceding, 0))).drop("r", "m")


def class_weights(rows: DataFrame, rules: str, names: list[str], cap: float = 10.0) -> DataFrame:
    """min(negatives / positives, cap) of each rule in an array column."""
    marked = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.array_contains(F.col(rules), n).cast("int").alias("on")) for n in names])).alias("x"))
    sums = marked.groupBy("x.rule").agg(F.sum("x.on").alias("pos"), F.count("*").alias("n"))
    return sums.select("rule", "pos", rounded(F.when(F.col("pos") > 0, F.least(double(cap), (F.col("n") - F.col("pos")) / F.col("pos"))).otherwise(double(cap))).alias("weight"))


def macro_f1(rules: DataFrame) -> DataFrame:
    """The mean F1 of a per-rule table."""
    return rules.agg(rounded(F.coalesce(F.avg("f1"), double(0))).alias("macro_f1"), F.count("*").alias("rules"))


def best_of_grid(grid: DataFrame, by: str = "f1") -> DataFrame:
    """The threshold of the greatest value; the smallest threshold of equals."""
    best = grid.agg(F.max(F.struct(F.col(by), (-F.col("threshold")).alias("m"))).alias("x"))
    return best.select((-F.col("x.m")).alias("threshold"), F.col(f"x.{by}").alias(by))


def session_spread(log: DataFrame, who: str, ts: str, cut: int = 600) -> DataFrame:
    """Per rater: median and 90th percentile of the gaps within sessions, in seconds."""
    gap = F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(W.partitionBy(who).orderBy(ts))
    within = F.when(F.col("gap") <= cut, F.col("gap"))
    return log.withColumn("gap", gap).groupBy(who).agg(F.percentile(within, 0.5).alias("median_gap"), F.percentile(within, 0.9).alias("p90_gap"))


def bootstrap_kappa(labels: DataFrame, item: str, label: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """Fleiss' kappa over resamples of items: mean, standard error, and the middle 95 percent.

    Each item stands in a resample as often as a Poisson draw of mean 1 says, by a hash of (draw, item): resamples are
    sums over rows, worked out side by side.
    """
    counts = labels.groupBy(item, label).agg(F.count("*").alias("c"))
    per = counts.groupBy(item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string").alias("k"), "c"))).alias("of"))
    per = per.filter("n > 1").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", item), F.lit(1 << 30)) / float(1 << 30)
    total, p, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(8):
        total += p
        weight = weight + F.when(u >= total, 1).otherwise(0)
        p /= k + 1
    drawn = per.withColumn("w", weight).filter("w > 0")
    agree = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("same") / (F.col("n") * (F.col("n") - 1))) / F.sum("w")).alias("p"))
    shares = drawn.select("draw", "w", "n", F.explode("of").alias("k", "c")).groupBy("draw", "k").agg(F.sum(F.col("w") * F.col("c")).alias("c"))
    sizes = drawn.groupBy("draw").agg(F.sum(F.col("w") * F.col("n")).alias("n"))
    chance = shares.join(sizes, "draw").groupBy("draw").agg(F.sum(F.pow(F.col("c") / F.col("n"), 2)).alias("e"))
    kappa = agree.join(chance, "draw").select(F.when(F.col("e") < 1, (F.col("p") - F.col("e")) / (1 - F.col("e"))).otherwise(double(1)).alias("kappa"))
    return kappa.agg(F.count("*").alias("draws"), F.avg("kappa").alias("mean"), F.stddev("kappa").alias("error"), F.percentile("kappa", 0.025).alias("low"), F.percentile("kappa", 0.975).alias("high"))


def session_gaps(log: DataFrame, who: str, ts: str, cut: int = 600) -> DataFrame:
    """Per rater: events, median gap in seconds within sessions, sessions (a gap over `cut` starts one)."""
    gap = F.unix_timestamp(ts) - F.lag(F.unix_timestamp(ts)).over(W.partitionBy(who).orderBy(ts))
    return log.withColumn("gap", gap).groupBy(who).agg(
        F.count("*").alias("events"), F.percentile(F.when(F.col("gap") <= cut, F.col("gap")), 0.5).alias("median_gap"), (F.count_if(F.col("gap") > cut) + 1).alias("sessions"))
