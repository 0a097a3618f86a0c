"""Evaluation against hand-worked constants."""

import pytest
from pyspark.sql import functions as F

from reportforge.operators import evaluate as E


def rows(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, score double")


def test_confusion(spark):
    r = E.confusion(rows(spark, [(1, 0.9)] * 4 + [(1, 0.1)] + [(0, 0.8)] * 2 + [(0, 0.2)] * 3), "y", "score", 0.5).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"]) == (4, 1, 2, 3)
    assert (r["precision"], r["recall"], r["f1"]) == (0.6667, 0.8, 0.7273)


@pytest.mark.parametrize(("matrix", "kappa"), [([[3, 0], [0, 3], [2, 1], [1, 2]], 0.333333), ([[3, 0], [0, 3]], 1.0), ([[2, 0], [2, 0]], None)])
def test_kappa(spark, matrix, kappa):
    votes = [(i, k) for i, row in enumerate(matrix) for k, n in enumerate(row) for _ in range(n)]
    assert E.fleiss_kappa(spark.createDataFrame(votes, "item long, label long"), "item", "label").first()["kappa"] == kappa


def test_curves(spark):
    data = rows(spark, [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.4), (0, 0.3), (0, 0.1)])
    curve = E.pr_curve(data, "y", "score")
    assert [(r["threshold"], r["tp"], r["fp"]) for r in curve.orderBy(F.desc("threshold")).collect()] == [(0.9, 1, 0), (0.8, 2, 1), (0.4, 3, 1), (0.3, 3, 2), (0.1, 3, 3)]
    assert E.auc(data, "y", "score").first()["auc"] == pytest.approx((3 + 2.5 + 2) / 9, abs=1e-6)
    assert E.average_precision(curve).first()[0] == pytest.approx(1 / 3 + 2 / 9 + 1 / 4, abs=1e-6)
    best = E.operating_point(curve, 0.7).first()
    assert (best["threshold"], best["reachable"]) == (0.4, True)
    assert not E.operating_point(curve, 1.1).first()["reachable"]


def test_calibration(spark):
    got = E.ece_brier(rows(spark, [(1, 1.0), (0, 0.0), (1, 0.5), (0, 0.5)]), "y", "score").first()
    assert (got["ece"], got["brier"]) == (0.0, 0.125)


def test_paired(spark):
    data = spark.createDataFrame([(1, 1, 0)] * 5 + [(1, 0, 1)] * 1 + [(0, 0, 0)] * 4, "y int, a int, b int")
    r = E.mcnemar(data, "y", "a", "b").first()
    assert (r["b"], r["c"], r["chi2"]) == (5, 1, 1.5)
    assert E.exact_binomial(5, 1) == pytest.approx(0.21875) and E.chi2_tail(3.841459) == pytest.approx(0.05, abs=1e-6)
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    assert [round(r["adjusted"], 9) for r in E.holm(tests).orderBy("test").collect()] == [0.03, 0.06, 0.06]


def test_temperature(spark):
    data = rows(spark, [(1, 0.9)] * 7 + [(0, 0.9)] * 3 + [(0, 0.1)] * 7 + [(1, 0.1)] * 3)
    t = E.fit_temperature(data, "y", "score")
    # The best map sends 0.9 to 0.7.
    assert t == pytest.approx(2.5932, abs=0.02)


def test_consensus(spark):
    labels = spark.createDataFrame([(1, "sif"), (1, "sif"), (2, "sif"), (2, "non_sif"), (3, "unsure")], "item long, label string")
    assert {r["item"]: (r["consensus"], r["reason"]) for r in E.consensus(labels, "item", "label").collect()} == {1: ("sif", None), 2: (None, "disagree"), 3: (None, "unsure")}
    assert {r["item"]: r["majority"] for r in E.majority(labels, "item", "label").collect()} == {1: "sif", 2: "tie", 3: "unsure"}


def test_curves_of_crowded_scores(spark):
    """Scores near nought, all within a thousandth, and a tail that flags everything."""
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.integers(1, 80, 500) / 1e6
    y = (rng.random(500) < 0.3 + 3000 * p).astype(int)
    data = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, score double")
    curve = E.pr_curve(data, "y", "score")
    rows = []
    for t in sorted(set(p), reverse=True):
        tp, fp = int(y[p >= t].sum()), int((1 - y[p >= t]).sum())
        rows.append((t, tp, fp, tp / (tp + fp), tp / y.sum()))
    assert np.allclose([tuple(r) for r in sorted(curve.collect(), reverse=True)], rows, rtol=1e-9, atol=1e-12)
    steps = [(r - (rows[i - 1][4] if i else 0)) * q for i, (_, _, _, q, r) in enumerate(rows)]
    assert E.average_precision(curve).first()[0] == pytest.approx(sum(steps), abs=1e-6)
    part = [x for x in rows if x[0] > 4e-5]
    want = sum(steps[: len(part)]) + (1 - part[-1][4]) * 0.3
    assert E.average_precision(curve.filter("threshold > 4e-5"), 0.3).first()[0] == pytest.approx(want, abs=1e-6)
    assert E.average_precision(curve.limit(0), 0.3).first()[0] is None
    tried = sorted(rows)[:: max(1, len(rows) // 10)]
    best = max(tried, key=lambda x: (2 * x[3] * x[4] / (x[3] + x[4]) if x[3] + x[4] else 0, -x[0]))
    got = E.strided_f1(curve, 10).first()
    assert np.allclose((got.threshold, got.tp, got.fp), best[:3])


def test_orphans(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = {(r.held_by, r.missing_in): (r.n, r.first) for r in E.orphans({"a": ids(1, 2, 2, 5), "b": ids(2, 3)}, "id").collect()}
    assert got == {("a", "b"): (2, 1), ("b", "a"): (1, 3)}
