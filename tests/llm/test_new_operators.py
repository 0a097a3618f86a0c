"""Source divergence, vector codes and sharding against plain Python, and their edge cases."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportforge.llm import divergence, sharding, vector_codes

# Source divergence


def plain_divergence(docs, min_docs, k):
    docs = [tuple(x or "" for x in d) for d in docs]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(low)))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in found}:
        own = [(s, c) for at, s, c in found if at == lang]
        df = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        whole = Counter()
        by = {s: Counter() for s, _ in own}
        for s, c in own:
            for t in kept:
                by[s][t] += c[t]
                whole[t] += c[t]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in by if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if by[s][t] and p[s][t] > q[t])[:k]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(rows, 1)]
    return sorted(out)


def audited(spark, docs, **how):
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    return sorted(tuple(r) for r in divergence.source_divergence(df, **how).collect())


def test_divergence_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    monkeypatch.setattr(divergence, "SHARD", 7)
    monkeypatch.setattr(divergence, "SIDE", 3)
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in ("Wort", "é", "ZÉ", "q") for b in "abcdefghij"]
    docs = []
    for n in range(160):
        weights = rng.dirichlet(np.full(len(vocabulary), 0.3))
        text = "".join(w + " ,.;1\n"[int(rng.integers(6))] for w in rng.choice(vocabulary, int(rng.integers(0, 60)), p=weights))
        docs.append((text if n % 11 else None, ["en", "de", None][n % 3], f"s{n % 7}" if n % 5 else None))
    docs += docs[:20] + [("lonely", "xx", "only"), (None, "xx", "other"), (None, None, "silent")]
    want = plain_divergence(docs, 12, 6)
    assert audited(spark, docs, min_docs=12, k=6) == want
    assert any(r[2] == "term" for r in want) and any(r[4] == 0 for r in want)


def test_divergence_of_ties_and_nothing(spark):
    assert audited(spark, []) == []
    docs = [("a b c d", "en", "s"), ("a b x y", "en", "t"), ("", "de", "s")]
    assert audited(spark, docs, min_docs=1, k=2) == plain_divergence(docs, 1, 2)
    assert [r for r in audited(spark, [(None, None, None)], min_docs=1)] == []


def test_long_text_by_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = "Alpha beta, ".encode() * 50 + b"x" * 35
    assert divergence.terms_of(text) == {b"alpha": 50, b"beta": 50, b"x" * 35: 1}


def test_shares_are_exact(spark):
    n, total, kept = 9_007_199_254_740_993, 2**61, 10**6 + 1
    got = spark.createDataFrame([(n, total, kept)], "n long, t long, v long").select(divergence.share("n", "t", "v")).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


# Vector codes


def plain_codes(rows, entries, rounds):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, p: min((far(x, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(4):
            own = [best(c[p], p)[1] for c in cut]
            for k in range(len(book[p])):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                if mine:
                    book[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    h = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    found = [[best(c[p], p) for p in range(4)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    of = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        of[label] += e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, of[label], h) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=repr)


def coded(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).repartition(parts)
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **how).collect()), key=repr)


def test_codes_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 17)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.1, 8))], int(rng.integers(3)) if i % 4 else None) for i in rng.permutation(140)]
    rows += [(500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] * 8, 2), (503, [float("inf")] + [0.0] * 7, 2)]
    rows += [rows[0], rows[0], (None, [0.5] * 8, 1)]
    assert coded(spark, rows, entries=9) == plain_codes(rows, 9, 4)
    assert coded(spark, rows, entries=9, rounds=1) == plain_codes(rows, 9, 1)


def test_codes_of_few_many_and_none(spark):
    few = [(i, [float(i), 0.0, -1.0, 2.0 * i], 0) for i in range(5)]
    assert coded(spark, few) == plain_codes(few, 256, 4)
    assert coded(spark, []) == [] and coded(spark, [(1, None, None)]) == []
    assert len(coded(spark, few + [(9, [1.0], 0)])) == 5  # of another length
    assert [r[1] for r in coded(spark, [(1, [], 0), (2, [], 0)])] == ["00000000"] * 2
    assert len(coded(spark, [(i, [float(i)] * 5, 0) for i in range(3)])) == 3  # filled up with zeros
    with pytest.raises(Exception, match="64 bits"):
        coded(spark, [(1, [1e9] * 4, 0), (2, [-1e9] * 4, 0)])


def test_rounds_exchange_only_what_changed(spark):
    rows = spark.createDataFrame([(i, [float(i % 7)] * 4, 0) for i in range(100)], "vec_id long, embedding array<double>, label int")
    packed = vector_codes.blocks_of(rows, 4, 1024)
    tables = vector_codes.Bucketed(spark, 4)
    blocks = tables.write(packed.repartition(4, "block"), "blocks")
    book = np.arange(12).reshape(4, 3, 1) * 512
    first = tables.write(vector_codes.assigned(blocks, None, book, 4), "first")
    again = vector_codes.assigned(blocks, first.filter("codes is not null"), book, 4)
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan
    assert again.filter("part is not null").count() == 0  # nothing changed
    tables.delete("blocks")
    tables.delete("first")


# Sharding


def exact_draw(n, k, m, u):
    chance = lambda x: Fraction(math.comb(k, x) * math.comb(n - k, m - x), math.comb(n, m)) if max(0, m + k - n) <= x <= min(m, k) else Fraction(0)
    mode = max(0, m + k - n, min(m, k, (m + 1) * (k + 1) // (n + 2)))
    run = chance(mode)
    if u < run:
        return mode
    for i in range(1, n + 1):
        for x in (mode + i, mode - i):
            run += chance(x)
            if u < run:
                return x
    raise AssertionError


def test_draws_invert_the_exact_law(spark):
    rng = np.random.default_rng(1)
    rows = [(n, int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1)), float(rng.random())) for n in map(int, rng.integers(1, 90, 300))]
    of = [F.col(c) for c in "nkmu"]
    got = spark.createDataFrame(rows, "n long, k long, m long, u double").select(*of, sharding.hypergeometric(*of).alias("x")).collect()
    assert all(r.x == exact_draw(r.n, r.k, r.m, r.u) for r in got)
    far = spark.createDataFrame([(3 * 10**10, 10**10, 10**9, u) for u in (0.0, 0.5, 0.999)], "n long, k long, m long, u double").select(sharding.hypergeometric(*of).alias("x")).collect()
    assert all(abs(r.x - 10**9 / 3) < 200_000 for r in far)


def test_matrix_has_its_margins_and_law(spark):
    sizes = [5, 0, 7, 1, 30]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "pid long, n long")
    need = F.array(*[F.lit(x).cast("long") for x in (20, 20, 3)])
    total = Counter()
    for seed in range(24):
        rows = {r.pid: r.sends for r in sharding.communication_matrix(counts, need, 4, seed).collect()}
        assert {p: sum(x) for p, x in rows.items()} == {i: n for i, n in enumerate(sizes) if n}
        assert [sum(x[c] for x in rows.values()) for c in range(3)] == [20, 20, 3]
        total[tuple(rows[3])] += 1
    # The partition of one row goes to each cell in proportion to its size.
    assert sum(total.values()) == 24 and 4 <= total[(1, 0, 0)] <= 19 and total[(0, 0, 1)] <= 7


def test_every_place_is_as_likely(spark):
    counts = np.zeros((6, 6), int)
    df = spark.range(6, numPartitions=3)
    for seed in range(24):
        for r in sharding.shuffled(df, 2, seed, cell=2).collect():
            counts[r.id, 3 * r.shard + r.slot] += 1
    # Each of 36 cells expects 4 of 24; 25 degrees of freedom, 0.1 % beyond 52.6.
    assert ((counts - 4) ** 2 / 4).sum() * 5 / 6 < 52.6, counts


def checked(df, shards, n):
    rows = df.collect()
    of = {}
    for r in rows:
        of.setdefault(r.shard, []).append(r.slot)
    sizes = [len(of.get(s, [])) for s in range(shards)]
    assert len(rows) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in of.values()) and set(of) <= set(range(shards))
    return rows


def test_sharding_of_any_rows(spark):
    docs = spark.createDataFrame([(i % 40 if i % 9 else None, "same" if i % 3 else None, i % 2) for i in range(500)], "doc_id long, text string, SHARD int").repartition(7)
    rows = checked(sharding.shuffled(docs, 16, cell=10), 16, 500)  # cells of a shard
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect())))
    assert docs.columns == ["doc_id", "text", "SHARD"] and sharding.shuffled(docs, 16).columns == ["doc_id", "text", "shard", "slot"]
    checked(sharding.shuffled(docs.limit(3), 16), 16, 3)
    checked(sharding.shuffled(docs.limit(0), 16), 16, 0)
    again = [sorted(map(repr, sharding.shuffled(spark.range(200, numPartitions=5), 4).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_sharding_query(spark, tmp_path):
    import zlib

    texts = [None, "", "é", "x" * 300_000, *["copy"] * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("slot", F.lit("clash")).write.parquet(str(tmp_path / "documents.parquet"))
    df = sharding.op13_sharding(spark, str(tmp_path))
    rows = checked(df, 16, len(texts))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
