"""Job states as a stream, and runs of jobs that are cancelled, fail, or come again."""

import json
import os

from pyspark.sql import functions as F

from reportforge.sources.publish import Store
from reportforge.streaming import ingest as S
from reportforge.streaming import jobs as J


def test_states_of_a_stream(spark, tmp_path):
    inbox = tmp_path / "events"
    inbox.mkdir()

    def put(n, *events):
        (inbox / f"{n:03d}.json").write_text("\n".join(json.dumps(dict(zip(("job", "kind", "rows", "detail", "at"), e, strict=True))) for e in events))
        os.utime(inbox / f"{n:03d}.json", (1_700_000_000 + 10 * n,) * 2)  # files are taken by their times

    at = lambda m: f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00Z"
    put(0, ("a", "submitted", 64, None, at(0)), ("b", "submitted", 10, None, at(0)), ("c", "submitted", 5, None, at(0)), ("z", "progress", 1, None, at(0)))
    put(1, ("a", "started", 0, None, at(1)), ("a", "progress", 32, None, at(2)), ("b", "cancel", 0, "user", at(1)), ("c", "started", 0, None, at(1)), ("c", "failed", 0, "disk", at(2)))
    put(2, ("a", "progress", 32, None, at(3)), ("a", "finished", 0, "committed", at(4)), ("b", "started", 0, None, at(4)))
    put(3, ("a", "cancel", 0, None, at(10)))  # too late
    put(4, ("d", "submitted", 1, None, at(90)))  # time goes on: a, b and c end and are forgotten
    put(5, ("d", "started", 0, None, at(91)))
    put(6, ("a", "cancel", 0, None, at(92)))
    J.rocks(spark)
    try:
        events = spark.readStream.schema(J.EVENTS).option("maxFilesPerTrigger", 1).json(str(inbox))
        query = J.statuses(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    of = lambda job: [(r.status, r.done, r.accepted) for r in sorted(rows, key=lambda r: r.at) if r.job == job]
    assert of("a")[:6] == [("queued", 0, True), ("running", 0, True), ("running", 32, True), ("running", 64, True), ("done", 64, True), ("done", 64, False)]
    assert ("expired", 64, True) in of("a") and of("a")[-1] == ("unknown", 0, False)
    assert of("b")[:3] == [("queued", 0, True), ("cancelled", 0, True), ("cancelled", 0, False)] and of("b")[-1][0] == "expired"
    assert of("c")[2] == ("error", 0, True) and [r.detail for r in rows if r.status == "error"] == ["disk"]
    assert of("z") == [("unknown", 0, False)] and of("d") == [("queued", 0, True), ("running", 0, True)]


def said(store):
    path = store.root + "/events"
    return [(r.kind, r.rows) for r in sorted(store.spark.read.schema(J.EVENTS).json(path).collect(), key=lambda r: (r.at, J.ORDER[r.kind]))]


def test_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"the crane number {i} dropped its load near the deck",) for i in range(5)] + [("the crane number 0 dropped its load near the deck",), (" ",)], "narrative string")
    assert S.run_job(rows, store, "one", part=4) == "committed"
    reports = store.table("reports", S.REPORTS)
    assert reports.count() == 5 and store.table("rejected", S.REJECTED).count() == 1
    told = said(store)
    assert told[0] == ("submitted", 7) and told[1][0] == "started" and told[-1][0] == "finished" and sum(n for k, n in told if k == "progress") == 7
    # The same rows, in another order and under another name, are a replay.
    assert S.run_job(rows.orderBy("narrative"), store, "two", part=2) == "replayed" and reports.count() == 5
    store2 = Store(spark, str(tmp_path / "s2"))
    runner = J.Runner(store2)
    asked = []

    def made(own, before):
        asked.append(before.count())
        if len(asked) == 2:
            runner.cancel("three")  # while its second part is made
        return {"hashes": own.select(F.sha2("narrative", 256).alias("content_hash"))}

    assert runner.run("three", rows, made, 3) == "cancelled"
    assert len(asked) == 2 and asked[0] == 0 < asked[1] and store2.batches() == [] and store2.table("hashes", S.HASHES).count() == 0
    assert said(store2)[-1][0] == "cancelled"
    assert runner.run("four", rows, lambda own, before: 1 / 0) == "error" and store2.batches() == []


def test_queue(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    many = spark.range(5).selectExpr("concat('valve ', id, ' was found open on the deck') as narrative")
    assert S.submitted(many.limit(2), store, "small", at_once=3) == "committed"
    assert S.submitted(many, store, "large", at_once=3) == "queued" and store.table("reports", S.REPORTS).count() == 2
    assert S.submitted(many, store, "stopped", at_once=3) == "queued"
    J.Runner(store).cancel("stopped")
    assert S.work_off(store, part=10) == {"large": "committed", "stopped": "cancelled"} and S.work_off(store) == {}
    assert store.table("reports", S.REPORTS).count() == 5
