"""Building and mining labelled corpora: pattern families, mixes, screens, samples, labels of several raters, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import double, rate, rounded, wilson
from .analytics import dominant
from .work import checkpointed


def base_rate(rows: DataFrame, label: str) -> DataFrame:
    return rows.agg(F.coalesce(F.avg((F.coalesce(F.col(label), F.lit(0)) == 1).cast("double")), double(0)).alias("base"))


def pattern_family(rows: DataFrame, keys: list[str], label: str, rules: str, order: str, least: int) -> DataFrame:
    """Cells of `keys` (none null, blank or the placeholder 'none'): n, n_sif, rate, lift over all rows, interval, top rule.

    The top rule is the most frequent one, ties to the one seen first in `order`.
    """
    told = rows
    for k in keys:
        told = told.filter(F.col(k).isNotNull() & ~F.col(k).isin("", "none"))
    cells = told.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_sif")).filter(F.col("n") >= least)
    top = dominant(told, keys, rules, order).select(*keys, F.col("dominant").alias("rule"))
    p = rate(F.col("n_sif"), F.col("n"))
    low, high = wilson(p, F.col("n"))
    lift = F.when(F.col("base") > 0, rounded(p / F.col("base"), 3)).otherwise(double(0))
    out = cells.join(top, keys, "left").crossJoin(F.broadcast(base_rate(rows, label)))  # the base is one row
    return out.select(*keys, "rule", "n", "n_sif", rounded(p).alias("sif_rate"), lift.alias("lift"), rounded(low).alias("ci_low"), rounded(high).alias("ci_high"))


def barrier_modes(rows: DataFrame, barrier: str, label: str, rules: str, order: str, top: int = 50) -> DataFrame:
    """The commonest barriers, by falling n, then lift, then name."""
    return pattern_family(rows, [barrier], label, rules, order, 1).orderBy(F.desc("n"), F.desc("lift"), barrier).limit(top)


def density_seed(rows: DataFrame, site: str, activity: str, label: str) -> DataFrame:
    """Counts and rates of site x activity, of rows that have both."""
    both = rows.filter(F.coalesce(F.length(site), F.lit(0)) * F.coalesce(F.length(activity), F.lit(0)) > 0)
    cells = both.groupBy(site, activity).agg(F.count("*").alias("n_reports"), F.count_if(F.col(label) == 1).alias("n_flagged"))
    return cells.withColumn("sif_rate", rounded(rate(F.col("n_flagged"), F.col("n_reports"))))


def top_value(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each key's most frequent value and its count; ties to the smaller value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x"))
    return best.select(*keys, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def rule_shares(rows: DataFrame, rules: str) -> DataFrame:
    """One row: rows, the share of each rule, of rows without a rule and of rows with several."""
    share = lambda c: rounded(F.coalesce(F.avg(c.cast("double")), double(0)))
    held = F.coalesce(F.col(rules), F.array().cast("array<string>"))
    return rows.agg(F.count("*").alias("n"), *[share(F.array_contains(held, r)).alias(r) for r in C.RULES], share(F.size(held) == 0).alias("unmatched"), share(F.size(held) >= 2).alias("several"))


def composition(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each category and their share of all."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("all")))).select(*by, "n", rounded(F.col("n") / F.col("all")).alias("share"))


def split_audit(rows: DataFrame, split: str, source: str, label: str) -> DataFrame:
    """Rows, positives and prevalence of every split and source, and of every split over all sources (source null)."""
    cells = rows.groupBy(split, source).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    whole = cells.groupBy(split).agg(F.sum("n").alias("n"), F.sum("positives").alias("positives")).withColumn(source, F.lit(None).cast("string"))
    return cells.unionByName(whole).withColumn("prevalence", rounded(rate(F.col("positives"), F.col("n"))))


def mix_sizes(binding: int, of_binding: float, shares: dict[str, float], pools: dict[str, int]) -> dict[str, int]:
    """How many rows of each part go with all `binding` rows of the scarcest part, by shares, as far as the pools go."""
    return {k: min(pools.get(k, 1 << 62), round(binding * v / of_binding)) for k, v in shares.items()}


def latest_labels(log: DataFrame, item: str, labeler: str, order: list[str], fields: list[str]) -> DataFrame:
    """Each item's map of labeler to its latest record."""
    last = log.groupBy(item, labeler).agg(F.max(F.struct(*order, F.struct(*fields).alias("rec"))).alias("x"))
    return last.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(labeler).alias("key"), F.col("x.rec").alias("value"))))).alias("labels"))


def rater_pairs(votes: DataFrame, item: str, rater: str, vote: str) -> DataFrame:
    """Agreement of each pair of raters on the items both judged. An item's raters are few, so are its pairs."""
    a, b = votes.select(item, F.col(rater).alias("a"), F.col(vote).alias("va")), votes.select(item, F.col(rater).alias("b"), F.col(vote).alias("vb"))
    both = a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("agree"))
    return both.withColumn("share", rounded(rate(F.col("agree"), F.col("n"))))


def first_pairs(rows: DataFrame, group: str, kind: str, id_: str) -> DataFrame:
    """Each group's first two rows of different kinds: the smallest id, and the smallest id of another kind after it."""
    seen = rows.filter(F.col(group).isNotNull())
    first = seen.groupBy(group).agg(F.min(F.struct(F.col(id_).alias("i"), F.col(kind).alias("k"))).alias("f"))
    later = seen.join(first, group).filter(~F.col(kind).eqNullSafe(F.col("f.k"))).groupBy(group, "f").agg(F.min(id_).alias("b"))
    return later.select(group, F.col("f.i").alias("a"), "b")


def f1_grid(rows: DataFrame, y: str, score: str, low: int = 5, high: int = 95) -> DataFrame:
    """The threshold in hundredths of greatest F1, the smallest of equals; a half where none is above 0.

    Rows are counted per step of the grid first; the grid is `high - low + 1` rows, whatever the input.
    """
    step = F.floor(F.col(score) * 100 + 1e-9).cast("int")
    steps = rows.groupBy(F.least(F.greatest(step, F.lit(low - 1)), F.lit(high)).alias("s")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("q"))
    run = W.orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)  # over the grid
    grid = rows.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("s")).join(F.broadcast(steps), "s", "left")
    summed = grid.select("s", F.coalesce(F.sum("p").over(run), F.lit(0)).alias("tp"), F.coalesce(F.sum("q").over(run), F.lit(0)).alias("fp"), F.coalesce(F.sum("p").over(W.partitionBy()), F.lit(0)).alias("all")).filter(F.col("s") >= low)
    f1 = rate(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all"))
    best = summed.select("s", f1.alias("f1")).agg(F.max(F.struct(F.col("f1"), (-F.col("s")).alias("m"))).alias("x"))
    found = F.col("x.f1") > 0
    return best.select(F.when(found, -F.col("x.m") / 100.0).otherwise(double(0.5)).alias("threshold"), rounded(F.coalesce("x.f1", double(0)), 6).alias("f1"))


def gold_enriched(sample: DataFrame, spare: DataFrame, id_: str, label: str, target: float, seed: int) -> DataFrame:
    """`sample` with as many negatives swapped for spare positives as the target prevalence asks, as far as these go.

    Which go and come is settled by a seeded hash of the id. The swap is worked out from counts: n rows need
    ceil(target * n) positives.
    """
    order = lambda salt: [F.xxhash64(F.lit(seed), F.lit(salt), F.col(id_)), F.col(id_)]
    n, have = sample.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    more = spare.filter(F.col(label) == 1)
    swap = max(0, min(-(-round(target * n * 1e9) // 10**9) - have, n - have, more.count()))
    if not swap:
        return sample
    out = sample.filter(F.col(label) != 1).orderBy(*order("out")).limit(swap).select(id_)
    return sample.join(out, id_, "left_anti").unionByName(more.orderBy(*order("in")).limit(swap))


def second_loads(doubles: list[int]) -> list[list[int]]:
    """How many doubly labelled items of each first labeler go to each other one, so that loads are as even as can be.

    The largest groups are filled first, each to the least loaded; then items move while that evens loads out.
    """
    k = len(doubles)
    x, load = [[0] * k for _ in range(k)], [0] * k
    for f in sorted(range(k), key=lambda i: (-doubles[i], i)):
        left = doubles[f]
        while left and k > 1:
            low = min(load[s] for s in range(k) if s != f)
            at = [s for s in range(k) if s != f and load[s] == low]
            above = min((load[s] - low for s in range(k) if s != f and load[s] > low), default=left)
            each = min(above, left // len(at))
            for n, s in enumerate(at):
                more = each if each else int(n < left)
                x[f][s] += more
                load[s] += more
            left -= each * len(at) if each else min(left, len(at))
    while k > 1:
        moves = [((load[s] - load[t]) // 2, f, s, t) for f in range(k) for s in range(k) for t in range(k) if f != t and s != t and x[f][s] and load[s] - load[t] > 1]
        if not moves:
            break
        n, f, s, t = max(moves)
        n = min(n, x[f][s])
        x[f][s], x[f][t], load[s], load[t] = x[f][s] - n, x[f][t] + n, load[s] - n, load[t] + n
    return x


def assigned(items: DataFrame, id_: str, double_flag: str, labelers: list[str], seed: int, first: str | None = None) -> DataFrame:
    """Each item's labeler, in turns by a seeded order, and of doubly labelled items a second one, the least loaded other.

    With `first` the labelers are those of that column, as uneven as they may be. Seconds are settled by counts: of each
    first labeler's doubly labelled items, in a seeded order, ranges go to the others, so that loads differ by one at most
    where the firsts allow it. Items are numbered by hash ranges, not in one task; of a few labelers only counts are sent.
    """
    k = len(labelers)
    names = F.array(*map(F.lit, labelers))
    if first is None:
        turns = numbered(items, [F.xxhash64(F.lit(seed), F.lit("first"), F.col(id_)), F.col(id_)], "__i").withColumn("__f", F.pmod(F.col("__i"), F.lit(k)).cast("int")).drop("__i")
    else:
        turns = items.withColumn("__f", (F.array_position(names, F.col(first)) - 1).cast("int"))
    twice = turns.filter(double_flag).select(id_, "__f")
    counts = {r["__f"]: r["n"] for r in twice.groupBy("__f").agg(F.count("*").alias("n")).collect()}  # a row a labeler
    doubles = [counts.get(f, 0) for f in range(k)]
    placed = numbered(twice, [F.col("__f"), F.xxhash64(F.lit(seed), F.lit("second"), F.col(id_)), F.col(id_)], "__j")
    second, at = F.lit(None).cast("int"), 0
    for f, row in enumerate(second_loads(doubles)):
        for s, n in enumerate(row):
            second = F.when(F.col("__j").between(at, at + n - 1), s).otherwise(second) if n else second
            at += n
    other = placed.select(id_, second.alias("__s"))
    return turns.join(other, id_, "left").select(*[c for c in items.columns if c != first or first != "labeler"], F.get(names, F.col("__f")).alias("labeler"), F.get(names, F.col("__s")).alias("second_labeler"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with a number from 0 in rising order of some values: range partitions number their rows, and sums of partitions go before.

    Tasks see a range of rows; only one count a partition is summed up by a window.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumns({f"__o{i}": c for i, c in enumerate(order)})
    by = [F.col(f"__o{i}") for i in range(len(order))]
    placed = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    placed = checkpointed(placed.withColumn("__nth", F.col("__id") - F.shiftleft(F.col("__part").cast("long"), 33)).drop("__id"))
    sums = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    bases = sums.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return placed.join(F.broadcast(bases), "__part").withColumn(name, F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__base", *[f"__o{i}" for i in range(len(order))])


def labeler_queue(items: DataFrame, labeler: str, fields: list[str], id_: str, seed: int) -> DataFrame:
    """What one labeler sees, blind: the pilot block first, then the rest, each in a seeded order."""
    own = items.filter((F.col("labeler") == labeler) | F.coalesce(F.col("second_labeler") == labeler, F.lit(False)))
    return own.orderBy(~F.col("is_pilot"), F.xxhash64(F.lit(seed), F.lit(labeler), F.col(id_)), id_).select(*fields)


def sliced(rows: DataFrame, bucket: str, targets: dict[str, int], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The first rows of each bucket, as many as its target; and each bucket's target, rows taken and shortfall."""
    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    numbered_ = rows.filter(F.col(bucket).isin(*targets)).withColumn("__r", F.row_number().over(W.partitionBy(bucket).orderBy(*order)))
    taken = numbered_.filter(F.col("__r") <= want[F.col(bucket)]).drop("__r")
    spine = rows.sparkSession.createDataFrame(list(targets.items()), f"{bucket} string, target long")
    counts = rows.groupBy(bucket).agg(F.count("*").alias("have"))
    report = spine.join(counts, bucket, "left").select(bucket, "target", F.least(F.coalesce("have", F.lit(0)), "target").alias("taken"), F.greatest(F.col("target") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("shortfall"))
    return taken, report


def working_days(first: str, last: str, seed: int) -> Column:
    """Mondays to Saturdays between two days, in a seeded order."""
    days = F.filter(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")), lambda d: F.weekday(d) < 6)
    return F.transform(F.array_sort(F.transform(days, lambda d: F.struct(F.xxhash64(F.lit(seed), d).alias("h"), d.alias("d")))), lambda x: x["d"])


def schema_error(row: dict[str, Column]) -> Column:
    """Why a synthetic row is refused, the first reason; null for a good one. `row`: id, text, sif_potential, rules, register, source."""
    missing = [F.when(row[k].isNull(), f"missing field '{k}'") for k in ("id", "text", "sif_potential", "rules", "register", "source")]
    unknown = F.array_sort(F.array_distinct(F.filter(row["rules"], lambda r: ~r.isin(*C.RULES))))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    return F.coalesce(
        *missing, F.when(~F.startswith(row["id"], F.lit("syn-")), F.concat(F.lit("id "), quoted(row["id"]), F.lit(" missing syn- prefix"))),
        F.when(F.trim(row["text"]) == "", "empty text"), F.when(~row["sif_potential"].isin(0, 1), F.concat(F.lit("sif_potential "), row["sif_potential"].cast("string"), F.lit(" not in {0,1}"))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown rules ['"), F.array_join(unknown, "', '"), F.lit("']"))),
        F.when(~row["register"].isin(*C.REGISTERS), F.concat(F.lit("register "), quoted(row["register"]), F.lit(" not in ['" + "', '".join(sorted(C.REGISTERS)) + "']"))),
        F.when(row["source"] != "synthetic", F.concat(F.lit("source "), quoted(row["source"]), F.lit(" != 'synthetic'"))),
    )


def machine_phrase(text: Column) -> Column:
    """A phrase that generated text is known by."""
    return F.coalesce(text.rlike(r"(?iU)\b(?:" + "|".join(C.MACHINE_PHRASES) + r")\b"), F.lit(False))


def anomaly_dropped(anomaly: Column) -> Column:
    """The first of the dropped prefixes that an element of a ;-list begins with; null for none."""
    parts = F.transform(F.split(F.coalesce(anomaly, F.lit("")), ";"), lambda p: F.trim(p))
    return F.coalesce(*[F.when(F.exists(parts, lambda p: F.startswith(p, F.lit(x))), x) for x in C.ANOMALY_PREFIXES])  # noqa: B023


def low_energy(code: Column, amputated: Column) -> Column:
    """Codes that begin with 42 or 7, without an amputation."""
    return F.coalesce((F.startswith(code, F.lit("42")) | F.startswith(code, F.lit("7"))) & (F.coalesce(amputated, F.lit(0)) <= 0), F.lit(False))


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    return F.coalesce(*[F.when(F.startswith(c, F.lit(p)), True) for p in prefixes], F.lit(False))


def overlap_screen(screened: DataFrame, report_at: float = 0.3, drop_at: float = 0.5) -> DataFrame:
    """Rows of a Jaccard screen: how many are at the reporting and the dropping threshold, and how many stay."""
    j = F.col("max_jaccard")
    return screened.agg(F.count("*").alias("n"), F.count_if(j >= report_at).alias("reported"), F.count_if(j >= drop_at).alias("dropped"), F.count_if(~(j >= drop_at)).alias("kept"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    """No key stands in both."""
    return a.select(key).filter(F.col(key).isNotNull()).intersect(b.select(key)).isEmpty()


def same_texts(rows: DataFrame, others: list[DataFrame], text: str) -> DataFrame:
    """Distinct texts of `rows`, trimmed but else as they are, that stand in any of the others."""
    bare = lambda df: df.select(F.trim(F.col(text)).alias("text")).distinct()
    held = bare(others[0])
    for df in others[1:]:
        held = held.unionByName(bare(df))
    return bare(rows).join(held, "text", "left_semi")


def two_tier_top(base: DataFrame, session: DataFrame, k: int) -> DataFrame:
    """The best k of two tiers' lists (query_id, id, cosine), by cosine; equal ones from the base first, then by id."""
    both = base.select("query_id", "id", "cosine", F.lit(0).alias("tier")).unionByName(session.select("query_id", "id", "cosine", F.lit(1).alias("tier")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "tier", "id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)


def corpus_profile(rows: DataFrame, split: str, label: str, rules: str, text: str) -> DataFrame:
    """Of each split: rows, positives, mean words, and rows of each rule."""
    from .gates import word_count

    held = F.coalesce(F.col(rules), F.array().cast("array<string>"))
    return rows.groupBy(split).agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"), rounded(F.avg(word_count(F.col(text)))).alias("mean_words"),
        *[F.count_if(F.array_contains(held, r)).alias(r) for r in C.RULES])


def probe_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of probe rows (flagged, routed, score, band): recalls, mean, population spread, verdicts and the commonest (ties: by name)."""
    cells = rows.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(F.avg(F.col("flagged").cast("double"))).alias("flag_recall"), rounded(F.avg(F.col("routed").cast("double"))).alias("routed_recall"),
        rounded(F.avg("score")).alias("mean"), rounded(F.stddev_pop("score")).alias("sd"), F.count_distinct("band").alias("distinct_verdicts"))
    return cells.join(top_value(rows, by, "band").select(*by, F.col("band").alias("majority_verdict")), by, "left")
