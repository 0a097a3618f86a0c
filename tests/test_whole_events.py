"""Queries over events read every user."""

import datetime as dt
import os
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def log(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type", "ts").collect()


@pytest.mark.parametrize("name, start", [("trend_week", lambda d: d - dt.timedelta(d.weekday())), ("trend_month", lambda d: d.replace(day=1))])
def test_trend(spark, log, name, start):
    n, flagged = Counter(), Counter()
    for r in log:
        bucket = start(r["ts"].date())
        n[bucket] += 1
        flagged[bucket] += r["event_id"] * 37 % 101 / 100 >= 0.5647
    got = {r["bucket"]: (r["n"], r["flagged"]) for r in entry.queries()[name](spark, SF).collect() if r["n"]}
    assert got == {b: (n[b], flagged[b]) for b in n}


def test_override_lineage(spark, log):
    rows = defaultdict(list)
    for r in sorted(log, key=lambda r: r["event_id"]):
        rows[r["user_id"]].append((r["event_id"], r["event_type"]))
    want = {}
    for user, ((winner, decision), *rest) in rows.items():
        old = []
        for event, kind in rest:
            if kind == decision:
                old.append(event)
            else:
                old, winner, decision = [winner, *old], event, kind
        want[user] = (winner, decision, ",".join(map(str, old)))
    got = {r["user_id"]: (r["winner"], r["decision"], r["supersedes"]) for r in entry.queries()["override_lineage"](spark, SF).collect()}
    assert got == want
