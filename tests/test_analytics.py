"""Aggregates with answers worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from reportforge import constants as C
from reportforge.functions import scalars as S
from reportforge.operators import analytics as A
from reportforge.operators import review as R

GATE = "array<struct<name:string,triggered:boolean,detail:string,action:string>>"


@pytest.fixture(scope="module")
def stored(spark):
    scores = [0.8, 0.7, 0.6, 0.2, 0.65, 0.1, 0.1, 0.1, 0.1, 0.1]
    rows = []
    for i, s in enumerate(scores):
        gates = [("gas_test_absent", True, "", "gray")] if i < 4 else []
        if i == 0:
            gates = [*gates, *[(n, True, "", "gray") for n in C.BARRIERS], ("permit_absent", True, "Gate Error: x", "gray"), ("drill", False, "", "gray")]
        rows.append((i, "S" if i < 4 else "T", "A" if i < 4 else "", s, gates))
    return spark.createDataFrame(rows, f"id long, site string, activity string, score double, gates {GATE}")


def test_pattern_cells(stored):
    got = {(r["first"], r["second"]): r for r in A.pattern_cells(stored, "site", "activity", 2, 0.6).collect()}
    cell = got["S", "A"]
    assert (cell["n"], cell["rate"], cell["lift"], cell["ci_low"], cell["ci_high"]) == (4, 0.75, 1.875, 0.3006, 0.9544)
    assert got["T", C.UNSPECIFIED]["n"] == 6
    high = {(r["first"], r["second"]): r for r in A.pattern_cells(stored, "site", "activity", 2, 0.75).collect()}["S", "A"]
    assert (high["rate"], high["lift"]) == (0.25, 2.5)
    assert A.pattern_cells(stored.limit(0), "site", "activity").count() == 0


def test_barriers_count_a_report_once(stored):
    got = {(r["first"], r["second"]): r for r in A.barrier_cells(stored, "id", "activity", threshold=0.6).collect()}
    assert set(got) == {("A", "gas_test_absent")} and got["A", "gas_test_absent"]["n"] == 4 and got["A", "gas_test_absent"]["lift"] == 1.875


def test_density_keeps_unscored_reports(spark):
    reports = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "id long, site string")
    scores = spark.createDataFrame([(1, 0.9), (4, 0.2)], "id long, score double")
    got = {r["facet"]: r for r in A.facet_density(reports, scores, "id", "site").collect()}
    assert (got["x"]["n"], got["x"]["flagged"], got["x"]["rate"], got["x"]["mean_score"]) == (2, 1, 0.5, 0.45)
    assert got[C.UNSPECIFIED]["n"] == 2
    s = A.summary(reports, scores, "id").first()
    assert (s["reports"], s["scored"], s["flagged"], s["flag_rate"], s["mean_score"]) == (4, 2, 1, 0.5, 0.55)


def test_wilson(spark):
    rows = spark.createDataFrame([(51 / 60, 60), (85 / 100, 100), (0.75, 4), (0.0, 0)], "p double, n long")
    low, high = S.wilson(F.col("p"), F.col("n"), empty="null")
    got = [tuple(r) for r in rows.select(F.round(low, 3), F.round(high, 3)).collect()]
    assert got == [(0.739, 0.919), (0.767, 0.907), (0.301, 0.954), (None, None)]
    zero, unit = (rows.filter("n = 0").select(*S.wilson(F.col("p"), F.col("n"), empty=e)).first() for e in ("zero", "unit"))
    assert tuple(zero) == (0, 0) and tuple(unit) == (0, 1)


def test_trend_fills_gaps(spark):
    d = datetime.date
    rows = spark.createDataFrame([(d(2024, 1, 3), 0.9), (d(2024, 1, 24), 0.1), (None, 0.9)], "day date, score double")
    got = [(r["bucket"], r["n"], r["rate"]) for r in A.trend(rows, F.col("day"), "week").orderBy("bucket").collect()]
    assert got == [(d(2024, 1, 1), 1, 100.0), (d(2024, 1, 8), 0, None), (d(2024, 1, 15), 0, None), (d(2024, 1, 22), 1, 0.0)]


def test_override_lineage(spark):
    log = spark.createDataFrame([(1, 7, "A"), (2, 7, "A"), (3, 7, "B"), (4, 7, "A"), (5, 7, "A"), (6, 8, None), (7, 8, None)], "id long, report long, value string")
    got = {r["report"]: (r["winner"], r["decision"]["value"], r["supersedes"]) for r in R.overrides(log, ["report"], "id", ["value"]).collect()}
    # 2 repeats 1; 3 replaces 1; 4 replaces 3; 5 repeats 4.
    assert got == {7: (4, "A", [3, 1, 2, 5]), 8: (6, None, [7])}
    assert sorted(r["id"] for r in R.superseded(log, ["report"], "id").collect()) == [1, 2, 3, 4, 6]


def test_actions(spark):
    log = spark.createDataFrame([(1, 1, "a", "open", False), (1, 2, "a", "closed", False), (2, 1, "b", "open", False), (2, 2, "b", "open", True)], "action_id long, version long, owner string, status string, deleted boolean")
    assert [(r["action_id"], r["status"]) for r in R.action_state(log).collect()] == [(1, "closed")]


def test_dates_and_facets(spark):
    rows = spark.createDataFrame([("2024-02-30",), ("2024-02-29",), ("3.4.2024",), ("31.2.2024",), ("202401",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(S.iso_date(F.col("t")).cast("string"), S.report_date(F.col("t")), S.month_start(F.col("t"))).collect()]
    assert got == [(None, "2024-02-30", None), ("2024-02-29", "2024-02-29", None), (None, "2024-04-03", None), (None, None, None), (None, None, "2024-01-01"), (None, None, None)]
    with pytest.raises(ValueError):
        A.ranged(rows, "t", "2024-02-02", "2024-01-01")
