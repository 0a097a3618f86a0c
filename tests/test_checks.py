"""Keys, training texts, reworded explanations, texts seen before, queue filters."""

import pytest
from pyspark.sql import functions as F

from reportforge.operators import analytics as A
from reportforge.operators import checks as K


def test_key_differences(spark):
    said = ['{"id": 1, "text": null}', '{"id": 1, "extra": 2, "more": {}}', "[1]", "{bad", None]
    got = spark.createDataFrame([(t,) for t in said], "t string").coalesce(1).select(K.key_difference(F.col("t"), ["text", "id"]).alias("d")).collect()
    assert [(r.d.missing, r.d.unknown) for r in got] == [([], []), (["text"], ["extra", "more"]), *[(["id", "text"], [])] * 3]


def test_training_texts(spark):
    rows = spark.createDataFrame([(1, "a", "A"), (2, "b", None), (3, None, "C"), (4, "", "D"), (5, None, None)], "id int, text string, masked_text string")
    of = lambda r: {x.id: x.input for x in r.collect()}
    got, told = K.training_text(rows, masked=False)
    assert of(got) == {1: "a", 2: "b", 3: "C", 4: "D", 5: ""} and tuple(told.first()) == (5, 2)
    got, told = K.training_text(rows, masked=True, fallback=True)
    assert of(got) == {1: "A", 2: "b", 3: "C", 4: "D", 5: ""} and tuple(told.first()) == (5, 2)
    with pytest.raises(Exception, match="no masked text"):
        K.training_text(rows, masked=True)[0].collect()


def test_reworded_explanations(spark):
    text = "The crane dropped a load on 22.05.2025 near the deck"
    rows = [
        ("Scored 0.83. It says “dropped a load”.", ["crane"], "0.83", []), ("Scored 10.83", [], "0.83", ["score"]), ("Scored 0.833", None, "0.83", ["score"]),
        ("Let me rewrite: 0.83", [], "0.83", ["meta"]), ("0.83 " + "x" * 300 + " let me", [], "0.83", []), ("0.83", ["crane", ""], "0.83", ["spans"]), ("0.83", ["hoist"], "0.83", ["spans"]),
        ('0.83 on "22.05.2:2025"', ["deck"], "0.83", ["quotes"]), (None, [], "0.83", ["score"]),
    ]
    df = spark.createDataFrame([(e, s, text, n) for e, s, n, _ in rows], "e string, s array<string>, t string, n string").coalesce(1)
    got = df.select(K.reworded_problems(F.col("e"), F.col("s"), F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == [w for *_, w in rows]


def test_unseen_texts(spark):
    kind = "id long, text string"
    rows = spark.createDataFrame([(3, "a  b"), (1, "a b "), (2, "c"), (4, "old"), (5, " old"), (6, None), (7, "")], kind)
    kept, told = K.unseen_texts(rows, spark.createDataFrame([(9, "old ")], kind), "id", "text")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 6] and tuple(told.first()) == (7, 3, 1)
    kept, told = K.unseen_texts(rows.limit(0), None, "id", "text")
    assert kept.collect() == [] and tuple(told.first()) == (0, 0, 0)


def test_queue_filters(spark):
    rows = spark.createDataFrame([(1, {"driving": 0.5}, "2024-01-05"), (2, {"driving": 0.49}, "2024-01-06"), (3, {"hot_work": 0.9}, "2024-01-07"), (4, None, None)], "id int, rules map<string,double>, date string")
    ids = lambda **how: sorted(r.id for r in A.queue(rows, ["date"], **how).collect())
    assert ids(rule="driving") == [1] and ids(rule="driving", least=0.4) == [1, 2] and ids(first="2024-01-06") == [2, 3] and ids(last="2024-01-05", rule="driving") == [1] and ids() == [1, 2, 3, 4]
    for bad in ({"first": "2024-1-05"}, {"last": "2024-02-30"}, {"first": "20240105"}, {"first": "2024-01-06", "last": "2024-01-05"}):
        with pytest.raises(ValueError):
            ids(**bad)
