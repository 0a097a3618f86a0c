"""Register, mining and evidence operators on small rows with nulls, ties and repeats."""

import pytest
from pyspark.sql import functions as F

from reportforge.functions import evidence as V
from reportforge.operators import mining as G
from reportforge.operators import ordered as O
from reportforge.operators import register as R


def test_stored_rows_keep_zeros_and_get_defaults(spark):
    rows = spark.createDataFrame([(1, None, None, None, None), (2, 0.0, 4, 0.0, "[0, 0.2, 0.6, 1]")], "id int, spread double, n_variants int, stability double, variant_scores string")
    got = {r["id"]: (r["spread"], r["n_variants"], r["stability"], r["variant_scores"]) for r in R.decoded(rows).collect()}
    assert got == {1: (0.0, 1, 1.0, []), 2: (0.0, 4, 0.0, [0.0, 0.2, 0.6, 1.0])}


def test_options_and_orders(spark):
    rows = spark.createDataFrame([(1, " (unspecified) ", None), (2, None, 0.5), (3, "B", 0.5), (4, "A", 0.9), (5, "B", None)], "id int, site string, score double")
    assert [r["option"] for r in R.options(rows, "site").collect()] == ["A", "B"]
    assert [r["id"] for r in R.ordered(rows, "score-desc", "score", "id").collect()] == [4, 2, 3, 1, 5]
    assert [r["id"] for r in R.ordered(rows, "score-asc", "score", "id").collect()] == [1, 5, 2, 3, 4]
    with pytest.raises(ValueError):
        R.ordered(rows, "name", "score", "id")
    listed = R.shortlist(rows.filter("score is not null"), [F.desc("score"), F.asc("id")], 1, 1).collect()
    assert [(r["id"], r["place"], r["listed"]) for r in listed] == [(4, 1, "shortlist"), (2, 2, "bench")]


def test_rewrites_keep_rows_with_errors(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "failed"), (3, "C", None)], "id int, v string, error string")
    got = {r["id"]: (r["v"], r["changed"]) for r in R.rewritten(rows, "v", F.upper("v"), F.col("error")).collect()}
    assert got == {1: ("A", True), 2: ("b", False), 3: ("C", False)}


def test_plain_details(spark):
    said = ["near-dup banner: cosine=0.953 with index row 7 (>= 0.91)", "max cosine=0.4", "drill badge: fire drill"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "d string").select(R.plain_detail(F.col("d"))).collect()]
    assert got == ["near-dup banner", "max", "drill badge: fire drill"]


def test_pattern_family(spark):
    rows = [(i, "S" if i < 4 else "T", "A" if i < 4 else "B", "b1" if i % 2 else "none", ["line_of_fire"] if i else None, int(i in (0, 1, 2, 4))) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, site string, activity string, barrier string, rules array<string>, y int")
    cells = {(r["site"], r["activity"]): r for r in G.pattern_family(df, ["site", "activity"], "y", "rules", "id", 1).collect()}
    first = cells["S", "A"]
    assert (first["n"], first["sif_rate"], first["lift"], first["ci_low"], first["ci_high"], first["rule"]) == (4, 0.75, 1.875, 0.3006, 0.9544, "line_of_fire")
    assert [r["barrier"] for r in G.barrier_modes(df, "barrier", "y", "rules", "id").collect()] == ["b1"]
    assert G.pattern_family(df.limit(0), ["site"], "y", "rules", "id", 1).count() == 0


def test_assignment_is_even_and_never_doubles_a_labeler(spark):
    items = spark.range(300).select(F.col("id"), (F.col("id") % 4 == 0).alias("is_double"))
    got = G.assigned(items, "id", "is_double", ["a", "b", "c"], 1).collect()
    assert len(got) == 300 and all(r["labeler"] != r["second_labeler"] for r in got) and sum(r["second_labeler"] is not None for r in got) == 75
    from collections import Counter

    first = Counter(r["labeler"] for r in got)
    assert max(first.values()) - min(first.values()) <= 1


def test_enrichment_swaps_no_more_than_needed(spark):
    rows = spark.range(100).select("id", (F.col("id") % 20 == 0).cast("int").alias("y"))
    spare = spark.range(1000, 1030).select("id", F.lit(1).alias("y"))
    assert G.gold_enriched(rows, spare, "id", "y", 0.2, 1).agg(F.count("*"), F.sum("y")).first() == (100, 20)
    assert G.gold_enriched(rows, spare, "id", "y", 0.9, 1).agg(F.count("*"), F.sum("y")).first() == (100, 35)
    assert G.gold_enriched(rows, spare, "id", "y", 0.01, 1).agg(F.sum("y")).first()[0] == 5


def test_numbers_and_days(spark):
    got = [r["i"] for r in G.numbered(spark.range(50).repartition(3), [-F.col("id")], "i").orderBy(F.desc("id")).collect()]
    assert got == list(range(50))
    days = spark.range(1).select(G.working_days("2024-01-01", "2024-01-14", 1)).first()[0]
    assert len(days) == 12 and all(d.weekday() < 6 for d in days)
    assert G.mix_sizes(100, 0.15, {"p": 0.55, "q": 0.15}, {"p": 300}) == {"p": 300, "q": 100}


def test_evidence(spark):
    text = "Start here. The crew, near the crane, lifted a load over people; nobody was hurt. End"
    at = text.index("crane")
    row = spark.createDataFrame([(text, [(0.9, at - 1, at + 6), (0.5, 0, 2), (0.4, at - 5, at)])], "t string, s array<struct<score:double,start:int,end:int>>")
    spans, phrase = row.select(V.usable_spans(F.col("t"), F.col("s")), V.context_phrase(F.col("t"), F.lit(at), F.lit(at + 5))).first()
    assert [(s["start"], s["end"]) for s in spans] == [(at, at + 6)] or [text[s["start"] : s["end"]] for s in spans] == ["crane,"]
    assert phrase == "The crew, near the crane, lifted a load over people;"
    long = "word " * 60 + "MATCH " + "tail " * 60
    start = long.index("MATCH")
    cut = spark.createDataFrame([(long,)], "t string").select(V.context_phrase(F.col("t"), F.lit(start), F.lit(start + 5))).first()[0]
    assert "MATCH" in cut and len(cut) <= 185 and cut.startswith("word") and cut.endswith("tail")
    segments = spark.createDataFrame([("abcdef", [(1, 3)])], "t string, s array<struct<start:int,end:int>>").select(V.span_segments(F.col("t"), F.col("s"))).first()[0]
    assert [(s["said"], s["marked"]) for s in segments] == [("a", False), ("bc", True), ("def", False)]


def test_variants(spark):
    said = ["Without testing the air, staff entered the tank.", "Staff entered the tank, without testing the air.", "one; two, three. Four five", "short"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "t string").select(V.surface_variants(F.col("t"))).collect()]
    assert got[0][1] == "staff entered the tank without testing the air." and got[1][2] == "Without testing the air, staff entered the tank."
    assert got[2][3] == "three. two one Four five" and got[3] == ["short"] * 4
    stats = spark.range(1).select(V.variant_stats(F.array(F.lit(0.0), F.lit(0.2), F.lit(0.6), F.lit(1.0)), 0.5)).first()[0]
    assert abs(stats["mean"] - 0.45) < 1e-12 and stats["stability"] == 0.5


def test_explanations(spark):
    gate = lambda name, on, action="gray": (name, on, "", action)
    kind = "array<struct<name:string,triggered:boolean,detail:string,action:string>>"
    rows = [([gate("gas_test_absent", True)], True, 0.9, "no gas test"), ([gate("drill", True)], False, 0.1, None), ([gate("near_dup", True, "badge")], False, 0.1, None), ([], False, 0.5, None), ([], None, 0.9, "")]
    got = [r[0] for r in spark.createDataFrame(rows, f"g {kind}, w boolean, s double, p string").select(V.explanation(F.col("g"), F.col("w"), F.col("s"), F.col("p"))).collect()]
    assert got == [
        "Missing: a gas test before entry. Report text: “no gas test”\nSent to a reviewer.\nWell-control equipment is involved.", "The report needs a review before it is closed.",
        "No clear high-energy exposure or missing safeguard was identified.", "The report is unclear; a person should check it.", "This report describes a serious event; a person should review it.",
    ]


def test_later_files_drop_what_overlaps_earlier_ones(spark):
    words = [f"w{i}" for i in range(40)]
    say = lambda *ws: " ".join(ws)
    prior = spark.createDataFrame([(1, say(*words))], "id long, text string")
    rows = spark.createDataFrame([(0, say(*words[:38], "x", "y")), (1, say(*[f"v{i}" for i in range(40)])), (2, say(*[f"v{i}" for i in range(38)])), (3, None), (4, "a b c")], "id long, text string")
    got = {r["id"]: (r["kept"], r["keeper"]) for r in O.cross_file_drops(rows, prior, "id", "text").collect()}
    assert {k: v[0] for k, v in got.items()} == {0: False, 1: True, 2: False, 3: True, 4: True} and got[2][1] == 1


def test_code_rules_and_taggers(spark):
    from reportforge.functions import text as X

    rows = spark.createDataFrame([("6212", "v1"), ("6212", "v2"), (" 41", "v2"), (None, "v1"), ("9", "v2")], "c string, e string")
    assert [r[0] for r in rows.select(X.code_rule(F.col("c"), F.col("e"))).collect()] == ["line_of_fire", None, "working_at_height", None, None]
    kind = "array<struct<start:int,end:int>>"
    one = spark.createDataFrame([([(0, 0), (0, 3), (4, 7), (8, 12), (13, 15)], [(4, 12)]), ([(0, 3)], [(50, 60)]), ([], [])], f"o {kind}, a {kind}")
    got = [r[0] for r in one.select(X.bio_labels(F.col("o"), F.col("a"))).collect()]
    assert [(g["labels"], g["aligned"]) for g in got] == [(["O", "O", "B", "I", "O"], True), (["O"], False), ([], False)]


def test_kappa_resamples(spark):
    from reportforge.operators import evaluate as E

    rows = [(i, r, "a" if (i + (r == 2 and i % 5 == 0)) % 2 else "b") for i in range(60) for r in range(3)]
    got = E.bootstrap_kappa(spark.createDataFrame(rows, "item int, rater int, label string"), "item", "label", 50).first()
    assert got["draws"] == 50 and 0.6 < got["low"] <= got["mean"] <= got["high"] <= 1 and 0 < got["error"] < 0.1
