"""Corpus building, similarity fixpoints and text functions."""

import random

import pytest
from pyspark.sql import functions as F

from reportforge.functions import text as X
from reportforge.operators import corpus as K
from reportforge.operators import similarity as M

MASKED = [
    ("He was hospitalized with a fracture", "He was [OUTCOME] with a [OUTCOME]"), ("several men saw it", "several men saw it"), ("a second-degree burn", "a [OUTCOME]"),
    ("killed, died and deaths", "[OUTCOME], [OUTCOME] and [OUTCOME]"), ("severe injury", "[OUTCOME]"), ("struck by a crane", "struck by a crane"), (None, None),
]


def test_masking(spark):
    rows = spark.createDataFrame([(t,) for t, _ in MASKED], "t string")
    assert [r[0] for r in rows.select(X.mask_text(F.col("t"))).collect()] == [m for _, m in MASKED]
    assert [r[0] for r in rows.select(X.mask_count(F.col("t"))).collect()] == [2, 0, 1, 3, 2, 0, 0]


def test_rules(spark):
    t = "A welder entered the tank near a crane when the forklift ran over the hose; h2s alarm"
    r = spark.createDataFrame([(t,)], "t string").select(X.keyword_rules(F.col("t")), X.primary_rule(F.col("t")), X.well_control(F.col("t")), X.rules_with_code(F.col("t"), F.lit("working_at_height")), X.primary_of(F.array(F.lit("driving"), F.lit("line_of_fire")))).first()
    assert r[0] == ["confined_space", "hot_work", "safe_mechanical_lifting", "driving", "line_of_fire"]
    assert r[1] == "confined_space" and r[2] is True and r[3][1] == "working_at_height" and r[4] == "driving"


def test_spans(spark):
    t = "😀 gas leak, gas test and Gas"
    row = spark.createDataFrame([(t,)], "t string")
    spans = row.select(X.find_spans(F.col("t"), r"(?i)\bgas\b").alias("s")).first()["s"]
    assert [(s["start"], s["end"], s["text"]) for s in spans] == [(2, 5, "gas"), (12, 15, "gas"), (25, 28, "Gas")]
    arr = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(5, 8), (0, 3), (3, 4), (7, 9)]])
    loose, tight = row.select(X.merged_spans(arr), X.merged_spans(arr, touching=True)).first()
    assert [tuple(x) for x in loose] == [(0, 3), (3, 4), (5, 9)] and [tuple(x) for x in tight] == [(0, 4), (5, 9)]
    scored = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("score")) for a, b, c in [(0, 5, 0.9), (1, 3, 0.8), (6, 9, 0.2), (10, 12, 0.7), (13, 14, 0.1)]])
    assert [tuple(x)[:2] for x in row.select(X.top_spans(scored)).first()[0]] == [(0, 5), (10, 12), (6, 9)]
    w = spark.createDataFrame([(0,), (126,), (127,), (300,)], "n int").select(X.sliding_windows(F.col("n"))).collect()
    assert [[tuple(x) for x in r[0]] for r in w] == [[], [(0, 126)], [(0, 126), (64, 127)], [(0, 126), (64, 190), (128, 254), (192, 300), (256, 300)]]


def test_site(spark):
    said = [("Location: North Yard - west. Valve leaked", "North Yard - west"), ("A valve leaked at the pump, near the Old Rig 4 today.", "Old Rig 4 today"), ("Tank farm area. Leak", "Tank farm area"), ("A man fell at noon", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in said], "t string").select(X.site(F.col("t"))).collect()] == [s for _, s in said]


def greedy(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[max(a, b)].add(min(a, b))
    kept, keeper = [], {}
    for i in range(n):
        before = sorted(near[i] & set(kept))
        if before:
            keeper[i] = before[0]
        else:
            kept.append(i)
    return kept, keeper


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_fixpoint(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    nodes = spark.range(25)
    got = M.first_independent(nodes, spark.createDataFrame(list(edges), "a long, b long")).collect()
    kept, keeper = greedy(25, edges)
    assert sorted(r["id"] for r in got if r["kept"]) == kept and {r["id"]: r["keeper"] for r in got if not r["kept"]} == keeper


def test_star_clusters(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 1.0]), (5, [-1.0, -1.0]), (6, [0.0, 0.0])]
    got = {r["exemplar"]: r["members"] for r in M.star_clusters(spark.createDataFrame(rows, "id long, v array<double>"), 0.9, "id", "v").collect()}
    assert got == {1: [1, 2], 3: [3, 4]}


@pytest.mark.parametrize("parts", [1, 5])
def test_jaccard_screen(spark, parts):
    words = [f"w{i}" for i in range(30)]
    train = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "id long, text string").repartition(parts)
    test = spark.createDataFrame([(7, " ".join(words[:20])), (8, " ".join(words[::-1])), (9, None)], "id long, text string")
    assert {r["id"]: r["max_jaccard"] for r in M.jaccard_screen(test, train, "id", "text").collect()} == {7: round(13 / 23, 6), 8: 0.0, 9: 0.0}


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 90).alias("g"))
    out = K.group_split(rows, "g", 0.1, 42)
    by = {r["split"]: (r["n"], set(r["g"])) for r in out.groupBy("split").agg(F.count("*").alias("n"), F.collect_set("g").alias("g")).collect()}
    assert not by["val"][1] & by["train"][1] and 100 <= by["val"][0] <= 112
    assert K.exact_sample(rows, 17, "id", 3).count() == 17
    left = K.new_rows(spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "id long, text string"), spark.createDataFrame([], "content_hash string"), "text", ["id"])
    assert sorted(r["id"] for r in left.collect()) == [1, 3]


def test_drops_add_up(spark):
    rows = spark.range(100)
    out = K.staged_drops(rows, [("even", F.col("id") % 2 == 0), ("third", F.col("id") % 3 == 0)])
    assert {r[0]: r[1] for r in out.groupBy("drop_stage").count().collect()} == {"even": 50, "third": 17, None: 33}
