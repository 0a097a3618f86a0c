"""The growing bound on postings against a pass row by row."""

import numpy as np
import pytest

from reportforge.operators import ordered as O


def passed(prior, rows, n, at, most):
    """One row after another: what is kept is indexed, shingles of over `most` kept rows count no more."""

    def grams(text):
        words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
        if len(words) < n:
            return {tuple(words)} if words else set()
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    index, size, out = {}, {}, {}

    def add(key, own):
        size[key] = len(own)
        for g in own:
            index.setdefault(g, []).append(key)

    for i, t in prior:
        add(("old", i), grams(t))
    for i, t in sorted(rows):
        own, shared = grams(t), {}
        for g in own:
            if len(index.get(g, [])) <= most:
                for k in index.get(g, []):
                    shared[k] = shared.get(k, 0) + 1
        best = max([c / (len(own) + size[k] - c) for k, c in shared.items()], default=0.0)
        out[i] = (best < at, round(best, 9))
        if best < at:
            add(("new", i), own)
    return out


@pytest.mark.parametrize("most", [2, 50])
def test_bound_grows_with_what_is_kept(spark, most):
    rng = np.random.default_rng(11)
    common = "this report was filed by the desk".split()
    word = lambda k: [f"w{x}" for x in rng.integers(0, 400, k)]
    rows = []
    for _ in range(40):
        kind = rng.integers(4)
        old = rows[int(rng.integers(len(rows)))].split() if rows else word(8)
        if kind == 0:
            rows.append(" ".join(common + word(20)))
        elif kind == 1:
            rows.append(" ".join(old[: max(3, len(old) - 2)] + word(2)))
        elif kind == 2:
            rows.append(" ".join(old))
        else:
            rows.append(" ".join(common[: int(rng.integers(2, 8))]))
    # The common part stands in far more than `most` rows.
    rows += [" ".join(common + word(9)) for _ in range(70 if most == 50 else 10)] + ["", None]
    prior = [(k, " ".join(common + word(5))) for k in range(3)]
    given = list(enumerate(rows, 5))
    want = passed(prior, given, 3, 0.5, most)
    kind = "id long, t string"
    got = O.cross_file_drops(spark.createDataFrame(given, kind).repartition(5), spark.createDataFrame(prior, kind), "id", "t", 3, 0.5, most).collect()
    assert {r.id: (r.kept, round(r.jaccard, 9)) for r in got} == want
    assert 5 < sum(not k for k, _ in want.values()) < len(want) - 20
    assert all((r.keeper is None) == r.kept for r in got)


def test_empty_tables(spark):
    kind = "id long, t string"
    none = spark.createDataFrame([], kind)
    assert O.cross_file_drops(none, none, "id", "t").collect() == []
    one = spark.createDataFrame([(1, None), (2, "a b"), (3, "a b")], kind)
    assert [(r.id, r.kept, r.keeper) for r in sorted(O.cross_file_drops(one, none, "id", "t").collect())] == [(1, True, None), (2, True, None), (3, False, 2)]


def test_families_need_few_rounds(spark, monkeypatch):
    """Copies of a kept row beyond the bound go at once, not `most` a round; chains of copies end as the pass ends them."""
    rng = np.random.default_rng(3)
    text, rows = [f"w{x}" for x in rng.integers(0, 400, 40)], []
    for _ in range(60):
        near = list(text)
        near[int(rng.integers(40))] = f"x{rng.integers(400)}"
        rows.append(" ".join(near))
    chain = [f"c{x}" for x in range(60)]
    rows += [" ".join(chain[4 * k : 4 * k + 20]) for k in range(10)]
    given, kind, tables = list(enumerate(rows)), "id long, t string", []
    write = O.Work.write
    monkeypatch.setattr(O.Work, "write", lambda self, df: tables.append(df.columns) or write(self, df))
    got = O.cross_file_drops(spark.createDataFrame(given, kind).repartition(4), spark.createDataFrame([], kind), "id", "t", 3, 0.5, 2).collect()
    assert {r.id: (r.kept, round(r.jaccard, 9)) for r in got} == passed([], given, 3, 0.5, 2)
    assert sum("kept" in t for t in tables) <= 16


def test_shared_runs_against_sets(spark):
    from reportforge.operators.overlap import shared_runs
    from reportforge.operators.work import Work

    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 4, int(k))) for k in rng.integers(0, 14, 60)] + [None, "", "É é", "A-b,c\nD", "a b C d", "İx a b c d", "a"]
    given = [(int(i), t) for i, t in zip([*range(len(texts) - 2), 3, 3], texts, strict=True)]
    sets = {}
    for i, t in given:
        low = "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").replace("İ", "i̇").lower()).split()
        sets.setdefault(i, set()).update(tuple(low[k : k + 3]) for k in range(max(1, len(low) - 2)) if low)
    holders = {}
    for i, own in sets.items():
        for g in own:
            holders.setdefault(g, set()).add(i)
    want = {}
    for h in holders.values():
        if len(h) > 1:
            want[tuple(sorted(h))] = want.get(tuple(sorted(h)), 0) + 1
    posts, size = shared_runs(spark.createDataFrame([*given, (None, "a b c")], "id long, t string").repartition(3), "id", "t", 3, Work(spark, "test"))
    found = {}
    for r in posts.collect():
        ids, _ = found.setdefault(r["class"], ([], (r.w, r.df)))
        ids.append(r.id)
    got = {}
    for ids, (w, df) in found.values():
        assert df == len(ids)
        got[tuple(sorted(ids))] = got.get(tuple(sorted(ids)), 0) + w
    assert got == want
    assert {r.id: r.size for r in size.collect()} == {i: len(s) for i, s in sets.items()}
