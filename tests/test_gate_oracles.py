"""The gates' SQL on texts that trigger them: no comparison of nothing with nothing; and their plans."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reportforge import constants as C
from reportforge.operators import gates as G
from reportforge.plans import bindings

from .test_gates import FIRES, SILENT

MORE = [
    "no injuries were reported at the rig after the event", "could have been fatal but luckily no one was near it", "an explosion in the yard threw debris over the road",
    "well control drill and fire drill were held on the rig", "LOTO", "short", "word " * 130, "गैस परीक्षण नहीं किया गया था और काम शुरू हुआ", "blowout preventer closed after a kick at the wellhead",
    "The crew commenced lifting before anyone confirmed the anchor point above", "NITROGEN PURGE IN PROGRESS near the open vessel", "purging was not in progress and the sweep was complete", "The spotter left and nobody stood by",
    "The standby man was not there, no gas detector, no permit to work, LOTO missing", "He was killed and the casualty was not hurt", "unmonitored: monitoring was skipped in the silo after the purge", "", "x",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("gates")
    texts = [t for t, _ in FIRES] + SILENT + MORE
    docs = [(i, t, ["en", "de", ""][i % 3], f"src{i % 2}", len(t)) for i, t in enumerate(texts * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(at / "documents.parquet"))
    # Scores of 0.9, 0.5 and 0.1 for the same texts.
    spark.createDataFrame([(i, int(i % 5 != 1), int(i % 7 == 3 and i % 2)) for i in range(len(docs))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(at / "labels.parquet"))
    return str(at)


def rows(frame):
    return sorted(tuple(repr(r[c]) for c in sorted(frame.columns)) for r in frame.to_dict("records"))


@pytest.mark.parametrize("name, least", [("gate_trigger_counts", 14), ("pattern_barriers", 8), ("routed_reports", 20), ("min_length_gate", 20), ("drill_gate", 20)])
def test_against_sql(spark, tables, name, least):
    got = entry.queries()[name](spark, tables).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    assert len(got) >= least and rows(got) == rows(want)


def test_every_gate_is_triggered_once(spark, tables):
    scored = bindings.scored(spark, tables).withColumns({"cos": F.lit(0.95), "row": F.lit("r"), "stable": F.lit(0.5), "many": F.lit(4)})
    out = G.with_gates(scored, similarity="cos", nearest="row", stability="stable", variants="many")
    on = {r[0] for r in out.select(F.explode_outer("gates").alias("g")).filter("g.triggered").select("g.name").distinct().collect()}
    assert on == set(C.GATES)


def test_barrier_gates_alone_are_the_same(spark, tables):
    scored = bindings.scored(spark, tables)
    whole = {r.report_id: [g for g in r.gates if g.name in C.BARRIERS] for r in G.with_gates(scored).collect()}
    alone = {r.report_id: r.gates for r in G.with_gates(scored, only=C.BARRIERS).collect()}
    assert whole == alone and sum(g.triggered for gates in alone.values() for g in gates) > 20


def test_texts_hold_what_a_match_needs(spark):
    """Of each control and direct sign: what its pattern matches holds one of the pieces that are looked for first."""
    said = [t for t, _ in FIRES] + SILENT + MORE + ["lock-out/tag-out", "tag out", "test dead", "proved dead", "zero-voltage", "deenergised", "oxygen tests", "tested for gas", "tie off", "tie-off", "tied-off", "fall-arrest devices", "hole watches", "stand by", "bottle watch", "firewatchers", "N2 sweeping underway"]
    for name in C.BARRIERS:
        for pattern in (C.CONTROLS[name], C.DIRECT.get(name)):
            for text in said:
                for m in re.finditer(pattern, text, re.I) if pattern else ():
                    assert any(x in m[0].lower() for x in C.NEEDED[name]), (name, m[0])


@pytest.mark.parametrize("name", ["pattern_barriers", "gate_trigger_counts", "routed_reports"])
def test_gates_stand_once_in_the_plan(spark, tables, name):
    plan = entry.queries()[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("atmosphere_unmonitored, ") <= 1 or plan.count(C.CONTROLS["fire_watch_absent"]) == 1
    assert plan.count(C.CONTROLS["fire_watch_absent"]) == 1
