"""Pairs and thresholds, even second labels, canonical payloads, JSON lines that name their places."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportforge.functions import scalars as S
from reportforge.operators import mining as G
from reportforge.operators import thresholds as P
from reportforge.sources import readers


def test_pairs(spark):
    rows = spark.createDataFrame([(3, "a", "s", "x"), (1, "a", "s", "x"), (2, "b", "s", "y"), (5, None, "t", "x"), (6, None, "t", None), (4, "a", None, "z"), (9, "c", "u", "x"), (8, "d", "u", "y"), (7, "e", "u", "x")], "id long, text string, g string, k string")
    assert sorted(tuple(r) for r in P.duplicate_pairs(rows, "id", "text").collect()) == [(1, 3), (1, 4)]
    assert sorted(tuple(r) for r in P.template_pairs(rows, "id", "g", "k").collect()) == [(1, 2), (7, 8)]
    many = spark.range(101).select("id", (F.col("id") % 3).cast("string").alias("text"))
    pairs = P.random_pairs(many, "id", "text").collect()
    assert 20 < len(pairs) <= 50 and len({x for p in pairs for x in p}) == 2 * len(pairs) and all(a % 3 != b % 3 for a, b in pairs)


def test_cosines_of_given_pairs(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0])], "id long, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 99)], "a long, b long")
    got = {(r.a, r.b): r.cosine for r in P.pair_cosines(pairs, vectors, "id", "v").collect()}
    assert got == {(1, 2): pytest.approx(0.5**0.5), (1, 3): 0.0}


@pytest.mark.parametrize("doubles", [[0, 0, 0], [90, 3, 0], [40, 40, 41], [7, 0, 0, 100], [1000, 10, 10, 10, 10], [5], [10, 9, 8, 7]])
def test_second_loads_are_as_even_as_can_be(doubles):
    x = G.second_loads(doubles)
    k = len(doubles)
    assert all(x[f][f] == 0 for f in range(k)) and (k == 1 or [sum(r) for r in x] == doubles)
    loads = [sum(x[f][s] for f in range(k)) for s in range(k)]
    # No item could go to a labeler with two fewer.
    assert not any(x[f][s] and loads[s] - loads[t] > 1 for f in range(k) for s in range(k) for t in range(k) if t not in (f, s))


def test_second_labels_of_uneven_firsts(spark):
    names = ["a", "b", "c"]
    rows = spark.createDataFrame([(i, "a" if i % 10 < 5 else "b" if i % 10 < 8 else "c", i % 2 == 0) for i in range(400)], "id long, labeler string, twice boolean")
    got = G.assigned(rows, "id", F.col("twice"), names, 3, first="labeler").collect()
    assert len(got) == 400 and all((r.second_labeler is not None) == r.twice and r.second_labeler != r.labeler for r in got)
    loads = Counter(r.second_labeler for r in got if r.twice)
    assert max(loads.values()) - min(loads.values()) <= 1
    assert {r.id: r.labeler for r in got} == {r.id: r.labeler for r in rows.collect()}


def test_canonical_json_is_pythons(spark):
    said = [{"b": [1, {"z": None, "a": "é\n"}], "a": {"y": 1.5, "x": [[], {}]}}, [3, {"k": True}], "text", 7, {}, {"ключ": {"b": 1, "a": 2}}]
    texts = [json.dumps(x, ensure_ascii=False, indent=1) for x in said] + ["{bad", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(S.canonical_json(F.col("t"))).collect()]
    assert got == [json.dumps(x, sort_keys=True, separators=(",", ":")) for x in said] + [None, None]
    a, b = spark.createDataFrame([('{"x":1,"y":[{"b":2,"a":1}]}',), ('{"y": [{"a":1, "b":2}], "x": 1}',)], "t string").select(S.payload_hash(F.col("t"))).collect()
    assert a[0] == b[0]


def test_bad_lines_are_named(spark, tmp_path):
    lines = [json.dumps({"id": i, "text": "x" * (i % 50)}) if i % 7 else "" for i in range(3000)]
    bad = [0, 1234, 2999]
    for k in bad:
        lines[k] = "{bad" + str(k)
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": "no number"}\n')
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        at = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
        rows = readers.read_jsonl_lines(spark, at, "id long, text string")
        assert rows.rdd.getNumPartitions() > 8 or spark.read.text(at).rdd.getNumPartitions() > 8
        got = rows.collect()
        named = sorted((r._file.rsplit("/", 1)[1], r._line, r._bad) for r in got if r._bad)
        assert named == [*[("a.jsonl", k + 1, "{bad" + str(k)) for k in bad], ("b.jsonl", 3, '{"id": "no number"}')]
        assert all(r.id == r._line - 1 for r in got if not r._bad and "a.jsonl" in r._file)
        with pytest.raises(Exception, match=r"b\.jsonl:3: bad JSONL row"):
            readers.read_jsonl_strict(spark, at[1], "id long, text string").collect()
        (tmp_path / "c.jsonl").write_text('{"id": 4, "text": "t"}\n\n')
        assert [tuple(r) for r in readers.read_jsonl_strict(spark, str(tmp_path / "c.jsonl"), "id long, text string").collect()] == [(4, "t")]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
