"""Gates on sentences, in their order, and on texts that are null or empty."""

import pytest
from pyspark.sql import functions as F

from reportforge import constants as C
from reportforge.operators import gates as G

FIRES = [
    ("LOTO was not applied before the pump was opened", {"energy_isolation_absent"}),
    ("The isolation was never verified by the crew on site", {"energy_isolation_absent"}),
    ("Entry was made without a gas test at the vessel", {"gas_test_absent"}),
    ("Gas testing was skipped on the night shift entirely", {"gas_test_absent"}),
    ("Work went ahead with no permit to work in place", {"permit_absent"}),
    ("The crew started welding before the permit to work was signed", {"permit_absent"}),
    ("He climbed the derrick with no harness on at all", {"fall_protection_absent"}),
    ("The fire watch left the area while grinding went on", {"fire_watch_absent"}),
    ("Nobody was posted as attendant at the manhole", {"standby_absent"}),
    ("Nitrogen purge in progress while the crew stood inside", {"atmosphere_unmonitored"}),
]
SILENT = ["LOTO applied and verified by the supervisor", "Gas test conducted, readings normal at the tank", "Purge completed before entry to the vessel", "Permit to work was signed and displayed", "Harness inspected and worn by the climber"]


@pytest.fixture(scope="module")
def gated(spark):
    rows = [(i, t, 0.1) for i, (t, _) in enumerate(FIRES)] + [(100 + i, t, 0.1) for i, t in enumerate(SILENT)] + [(200, None, None), (201, "", 0.5)]
    rows += [(202, "no injuries were reported at the rig after the event", 0.1), (203, "could have been fatal but luckily no one was near it", 0.1), (204, "an explosion in the yard threw debris over the road", 0.1)]
    rows += [(205, "well control drill and fire drill were held on the rig", 0.1), (206, "LOTO", 0.5), (207, "short", 0.9), (208, "word " * 130, 0.1), (209, "गैस परीक्षण नहीं किया गया था और काम शुरू हुआ", 0.1), (210, "blowout preventer closed after a kick at the wellhead", 0.2)]
    out = G.with_gates(spark.createDataFrame(rows, "id long, text string, score double"))
    return {r["id"]: {g["name"]: g for g in r["gates"]} for r in out.collect()}


def on(states):
    return {n for n, g in states.items() if g["triggered"]}


def test_barriers(gated):
    for i, (text, want) in enumerate(FIRES):
        assert on(gated[i]) & set(C.BARRIERS) == want, text
    for i, text in enumerate(SILENT):
        assert not on(gated[100 + i]) & set(C.BARRIERS), text


def test_other_gates(gated):
    assert on(gated[200]) == on(gated[201]) - {"confidence"} == {"min_length", "language"}
    assert "negation" in on(gated[202]) and "severity_watch" not in on(gated[202])
    assert "negation" not in on(gated[203]) and "severity_watch" in on(gated[203])
    assert "severity_watch" in on(gated[204])
    assert gated[205]["drill"]["detail"] == "drill badge: fire drill, well control drill"
    assert on(gated[206]) == {"confidence"} and on(gated[207]) == {"min_length"}
    assert {"long_input", "chunked_low_score"} <= on(gated[208])
    assert "language" in on(gated[209]) and "well_control_watch" in on(gated[210])


def test_order_and_routing(spark, gated):
    assert all(list(s) == C.GATES for s in gated.values())
    rows = spark.createDataFrame([(1, "long enough text without any sign", 0.9), (2, "no one was hurt in the blast at all", 0.1)], "id long, text string, score double")
    out = {r["id"]: r["r"] for r in G.with_gates(rows).select("id", G.routed(F.col("gates")).alias("r")).collect()}
    assert out == {1: False, 2: True}
    kept = G.with_gates(rows).select("id", G.backfilled(F.slice("gates", 3, 2), F.col("gates")).alias("g")).first()["g"]
    assert [g["name"] for g in kept] == [C.GATES[2], C.GATES[3], *[n for n in C.GATES if n not in C.GATES[2:4]]]


def test_details_and_actions(spark, gated):
    said = lambda i, name: (gated[i][name]["action"], gated[i][name]["detail"])
    review = " — routed to human review, never auto-cleared"
    assert said(207, "min_length") == ("gray", "len=5 < 20 and no short code")
    assert said(206, "min_length") == ("badge", "short report accepted via codes path: LOTO") and said(208, "min_length") == ("badge", "")
    assert said(202, "negation") == ("gray", "negated outcome language (cue~outcome within 5 tokens): 'no'~'injuries'")
    assert said(0, "energy_isolation_absent") == ("gray", "barrier failure: absence or direct violation signal for energy isolation control ('not'~'loto')" + review)
    assert said(5, "permit_absent")[1].startswith("barrier failure: absence or direct violation signal for permit control ('started'~'started welding before the permit to work was signed')")
    assert said(8, "standby_absent")[1].endswith("control ('as'~'attendant')" + review)  # a cue of several words ends where its last does
    assert said(201, "language") == ("gray", "empty text") and said(209, "language")[1].startswith("language badge [devanagari]: non_ascii_ratio=0.8")
    assert said(206, "confidence") == ("gray", "score 0.500 in gray band [0.4, 0.6]")
    assert said(208, "long_input") == ("badge", "chunked: 130 words > 120; sliding-window max-pool applies (length-OOD)")
    assert said(204, "severity_watch")[1].startswith("severity watch: unnegated outcome/high-energy language ('explosion') but triage score 0.100 < flag threshold 0.565 — ")
    assert said(204, "near_dup") == ("badge", "index empty")
    rows = [(1, "a report of the usual kind on the rig", 0.3, 0.95, "r7", 0.5, 4), (2, "another one", 0.3, 0.4, "r8", 1.0, 4), (3, "a third", None, None, None, None, None)]
    out = G.with_gates(spark.createDataFrame(rows, "id long, text string, score double, cos double, row string, stable double, many int"), similarity="cos", nearest="row", stability="stable", variants="many")
    more = {r["id"]: {g["name"]: g for g in r["gates"]} for r in out.collect()}
    assert more[1]["near_dup"]["detail"] == "near-dup banner: cosine=0.950 with index row r7 (>= 0.91)" and more[2]["near_dup"]["detail"] == "max cosine=0.400"
    assert more[1]["verdict_stability"]["detail"] == "verdict flips on rephrasing: 2 of 4 variants disagree (stability 0.50) — routed to human review"
    assert on(more[2]) == on(more[3]) == {"min_length"}
