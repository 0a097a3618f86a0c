"""Readers, publishing once, and ingest as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from reportforge.sources import publish, readers
from reportforge.streaming import ingest as S


def put(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    good = put(tmp_path / "a.csv", 'Narrative,Location,Task\n"one, two",S1,\n\nthree, ,dig\n')
    rows = readers.map_columns(readers.read_csv_strict(spark, good)).collect()
    assert [(r["text"], r["site"], r["activity"], r["date"]) for r in rows] == [("one, two", "S1", None, None), ("three", None, "dig", None)]
    for name, text in (("b.csv", "a,,c\n1,2,3\n"), ("c.csv", "a,A\n1,2\n"), ("d.csv", "")):
        with pytest.raises(ValueError):
            readers.read_csv_strict(spark, put(tmp_path / name, text))
    with pytest.raises(Exception):
        readers.read_csv_strict(spark, put(tmp_path / "e.csv", "a,b\n1,2,3\n")).collect()


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "x.jsonl", '{"id": "1", "text": "a"}\n{bad\n\n{"id": "1", "text": "b"}\n')
    rows = readers.read_jsonl(spark, path, "id string, text string", keep_bad=True).collect()
    assert sum(r["_corrupt_record"] is not None for r in rows) == 1
    with pytest.raises(Exception):
        readers.read_jsonl(spark, path, "id string, text string").collect()
    ids = readers.excluded_ids(spark, put(tmp_path / "ids", '# note\nq1 # why\n{"provenance": {"id": "q2"}}\n\n')).collect()
    assert sorted(r[0] for r in ids) == ["q1", "q2"]


def test_embedded_blocks(spark):
    texts = spark.createDataFrame([('x <<SCORES {"a": 1}>> y <<SCORES {bad}>> <<SCORES {"a": 3}>>',), (None,)], "t string")
    assert sorted(r["a"] for r in readers.embedded_blocks(texts, "t", "a int").collect()) == [1, 3]


def test_publish_is_all_or_nothing(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, version long, v string")
    assert store.table("t", "id long, version long, v string").count() == 0
    assert store.publish("b1", {"t": rows}, cancelled=lambda: True) == "cancelled"
    assert store.table("t", "id long, version long, v string").count() == 0
    assert store.publish("b1", {"t": rows}) == "committed" and store.publish("b1", {"t": rows}) == "replayed"
    store.publish("b2", {"t": rows.limit(1).withColumns({"version": F.lit(2).cast("long"), "v": F.lit("c")})})
    assert {r["id"]: r["v"] for r in store.current("t", "id long, version long, v string", ["id"], "version").collect()} == {1: "c", 2: "b"}


def test_stream(spark, tmp_path):
    inbox, store = tmp_path / "in", publish.Store(spark, str(tmp_path / "store"))
    inbox.mkdir()
    put(inbox / "1.json", "\n".join(json.dumps(x) for x in [{"narrative": "no harness was worn on the derrick"}, {"narrative": "no harness  was worn on the derrick"}, {"narrative": " "}]))
    schema = "narrative string, date string"
    run = lambda: S.start(spark, spark.readStream.schema(schema).json(str(inbox)), store, str(tmp_path / "ck"))
    run().awaitTermination()
    put(inbox / "2.json", "\n".join(json.dumps(x) for x in [{"narrative": "no harness was worn on the derrick"}, {"narrative": "crane load dropped", "date": "2024-13-01"}, {"narrative": "crane load dropped on deck"}]))
    query = run()
    query.awaitTermination()
    assert S.progress(query)["status"] == "done"
    got = store.table("reports", S.REPORTS).collect()
    assert sorted(" ".join(r["text"].split()) for r in got) == ["crane load dropped on deck", "no harness was worn on the derrick"]
    assert all(len(r["gates"]) == 18 and r["band"] for r in got)
    assert store.table("rejected", S.REJECTED).count() == 2


def test_overrides_and_records(spark):
    rows = spark.createDataFrame([("a text", "\tS9\n", "x")], "Narrative string, place string, other string")
    assert readers.map_columns(rows, {"site": "place", "text": "absent"}).select("text", "site").first() == ("a text", "S9")
    made = readers.report_rows(spark, [{"text": "one"}, {"site": 4}], csv="never read")
    assert [tuple(r) for r in made.collect()] == [("one", None), (None, "4")]
    with pytest.raises(ValueError):
        readers.report_rows(spark)


def test_near_duplicates_are_badged(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "store"))
    say = lambda *texts: spark.createDataFrame([(t,) for t in texts], "narrative string")
    assert S.ingest(say("the crane dropped a load of pipes on the empty deck at noon"), store, "b1") == "committed"
    assert S.ingest(say("the crane dropped a load of pipes on the empty deck at noon!", "a gas leak was found near the well head"), store, "b2") == "committed"
    got = {r["text"]: {g["name"]: g for g in r["gates"]} for r in store.table("reports", S.REPORTS).collect()}
    near = {t: g["near_dup"]["triggered"] for t, g in got.items()}
    assert near == {t: t.endswith("!") for t in got}
    assert got["the crane dropped a load of pipes on the empty deck at noon"]["near_dup"]["detail"] == "index empty"
    assert {r["n_variants"] for r in store.table("reports", S.REPORTS).collect()} <= {1, 2, 3, 4}
