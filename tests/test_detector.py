"""The detector against a plain fit of dense features."""

import re

import numpy as np
import pytest

from reportforge.operators import detector as D

POOL = [f"w{i}" for i in range(60)]


def corpus(seed, n=120):
    rng = np.random.default_rng(seed)
    weights = [rng.dirichlet(np.full(60, 0.6)), None]
    weights[1] = 0.5 * weights[0] + 0.5 * rng.dirichlet(np.full(60, 0.3))
    return [(i, " ".join(rng.choice(POOL, int(rng.integers(3, 25)), p=weights[i % 2])), i % 2) for i in range(n)]


def plain_features(texts, most):
    docs = []
    for t in texts:
        w = re.findall(r"\b\w\w+\b", (t or "").lower())
        docs.append(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    total, df = {}, {}
    for d in docs:
        for g in d:
            total[g] = total.get(g, 0) + 1
        for g in set(d):
            df[g] = df.get(g, 0) + 1
    names = sorted(sorted(total, key=lambda g: (-total[g], g))[:most])
    x = np.array([[d.count(g) * (1 + np.log((1 + len(docs)) / (1 + df[g]))) for g in names] for d in docs])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return names, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def plain_fit(x, y, c):
    """Newton's method on c * loss + |w|^2 / 2 with a free intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-12])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(c * (x.T * (p * (1 - p))) @ x + ridge, c * x.T @ (p - y) + ridge @ w)
    return w


def test_folds_side_by_side_equal_plain_fits(spark):
    rows = corpus(1) + [(500, None, 0), (501, "", 1)]
    found = D.detect(spark.createDataFrame(rows, "id long, text string, made int").repartition(4), "id", "text", "made", folds=4, most=150, near=1e-6)
    scores = {r.id: r for r in found.scores.collect()}
    assert set(scores) == {r[0] for r in rows}
    sizes = [[sum(r.fold == f and r.y == y for r in scores.values()) for f in range(4)] for y in (0, 1)]
    assert all(max(s) - min(s) <= 1 for s in sizes)
    names, x = plain_features([r[1] for r in rows], 150)
    y, fold = np.array([r[2] for r in rows]), np.array([scores[r[0]].fold for r in rows])
    for f in range(4):
        w = plain_fit(x[fold != f], y[fold != f], 1.0)
        want = 1 / (1 + np.exp(-(x[fold == f] @ w[:-1] + w[-1])))
        assert [scores[r[0]].p for r, k in zip(rows, fold, strict=True) if k == f] == pytest.approx(list(want), abs=1e-5)
    w = plain_fit(x, y, 1.0)
    best = sorted(zip(w[:-1], names, strict=True), reverse=True)[:20]
    assert [round(v, 3) for _, v in found.features] == pytest.approx([round(v, 3) for v, _ in best], abs=2e-3)
    p = np.array([scores[r[0]].p for r in rows])
    pairs = p[y == 1][:, None] - p[y == 0][None, :]
    assert found.auc == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=1e-6) and found.auc > 0.6


def test_quantile_and_matched_sample(spark):
    values = [0.3, 0.1, 0.1, 0.9, 0.7, 0.55]
    df = spark.createDataFrame(list(enumerate(values)), "id long, p double")
    assert D.quantile(df, "p", "id", 0.75) == pytest.approx(np.quantile(values, 0.75)) and D.quantile(df.limit(0), "p", "id", 0.5) is None
    rng = np.random.default_rng(2)
    like, pool = [int(x) for x in rng.integers(5, 60, 83)], [int(x) for x in rng.integers(1, 90, 300)]
    kind = "id long, l int"
    got = D.matched_sample(spark.createDataFrame(list(enumerate(pool)), kind), spark.createDataFrame(list(enumerate(like)), kind), "id", "l").collect()
    edges = [sorted(like)[int(k / 10 * 82)] for k in range(11)]
    bin_ = lambda v: min(max(sum(v > e for e in edges) - 1, 0), 9)
    for b in range(10):
        assert sum(bin_(r.l) == b for r in got) == min(sum(bin_(v) == b for v in like), sum(bin_(v) == b for v in pool))
    assert len({r.id for r in got}) == len(got)


def test_telling_quarter_goes(spark):
    kind = "id long, text string"
    real = spark.createDataFrame([(i, f"plain report number{i % 7} about valves") for i in range(60)], kind)
    made = spark.createDataFrame([(i, f"furthermore synthetic number{i % 7} moreover tell{i % 3}") for i in range(40)], kind)
    kept, report = D.screened(real, made, "id", "text", folds=4, most=60)
    assert report["auc"] == 1.0 and report["verdict"] == "fail after drop" and 10 <= report["dropped"] <= 40 - kept.count() + 10
    assert kept.count() == 40 - report["dropped"] and report["features"][0][0] in {"furthermore", "furthermore synthetic", "moreover", "synthetic"}
    mixed = spark.createDataFrame([(i, f"plain report number{i % 7} about valves") for i in range(40)], kind)
    kept, report = D.screened(real, mixed, "id", "text", folds=4, most=60)
    assert report["verdict"] == "pass" and kept.count() == 40 and report["features"] == []


def test_long_texts_take_time_in_proportion(spark):
    """A pair of words once made all words of its text be found anew: 20,000 words took minutes."""
    import time

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(POOL, 20_000 if i < 2 else 8)), i % 2) for i in range(12)] + [(20, "É_1 É_1, x ab-cd", 0), (21, None, 1), (22, "", 0)]
    began = time.time()
    work = D.Work(spark, "test")
    data, names = D.featured(spark.createDataFrame(rows, "id long, text string, made int").repartition(3), "id", "text", "made", 300, 3, 42, work)
    got = {r["id"]: (r["at"], r["x"]) for r in data.collect()}
    assert time.time() - began < 60
    want, x = plain_features([r[1] for r in rows], 300)
    assert names == want and set(got) == {r[0] for r in rows}
    for (i, _, _), row in zip(rows, x, strict=True):
        assert got[i][0] == list(np.flatnonzero(row)) and got[i][1] == pytest.approx(list(row[row > 0]))


def test_report_on_long_texts(spark):
    """Both kinds hold texts of 15,000 words, whose pairs once took time by the square."""
    import time

    rng, kind = np.random.default_rng(6), "id long, text string"
    many = lambda own, n: [(i, " ".join([own] + list(rng.choice(POOL, 15_000 if i < 2 else 6)))) for i in range(n)]
    real, made = (spark.createDataFrame(many(own, 12), kind).repartition(2) for own in ("plain", "synthetic"))
    began = time.time()
    kept, report = D.screened(real, made, "id", "text", gate=1.1, folds=2, most=50, rounds=8)
    assert report["n_real"] == report["n_made"] == kept.count() == 12 and report["verdict"] == "pass" and time.time() - began < 60
