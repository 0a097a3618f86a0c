"""More queries over the provided tables, and their SQL: the register, corpus mining, labels of several raters, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import evidence as V
from ..functions import scalars as S
from ..operators import mining as G
from ..operators import ordered as O
from ..operators import register as R
from ..operators import similarity as M
from .bindings import EV, SCORED, TRIGGERED, WHITE_SQL, events, facet_, keyworded, list_, predictions, query, quoted_, r_, read, reports, scored, wilson_

TEXTS = "SELECT doc_id, text FROM documents"


@query(f"WITH {SCORED} SELECT report_id, score, CASE WHEN score >= 0.3 THEN 'HIGH' WHEN score >= 0.2 THEN 'MODERATE' ELSE 'LOW' END AS band, (score >= 0.3)::INTEGER AS flagged FROM scored")
def rebanded(spark, sf):
    return R.rebanded(scored(spark, sf), "score", 0.3, 0.2).select("report_id", "score", "band", "flagged")


@query("SELECT report_id, score, 0.0::DOUBLE AS spread, 1 AS n_variants, 1.0::DOUBLE AS stability FROM (SELECT doc_id AS report_id, (CASE WHEN toxic = 1 THEN 0.9 WHEN quality = 0 THEN 0.5 ELSE 0.1 END)::DOUBLE AS score FROM labels)")
def decoded_predictions(spark, sf):
    old = predictions(spark, sf).withColumns({"spread": F.lit(None).cast("double"), "n_variants": F.lit(None).cast("int"), "stability": F.lit(None).cast("double"), "variant_scores": F.lit(None).cast("string")})
    return R.decoded(old).select("report_id", "score", "spread", "n_variants", "stability")


@query("SELECT doc_id AS report_id, source FROM documents WHERE doc_id = 7")
def report_by_id(spark, sf):
    return read(spark, sf, "documents").filter(F.col("doc_id") == 7).select(F.col("doc_id").alias("report_id"), "source")


@query(f"SELECT DISTINCT source AS option FROM documents WHERE trim(source) NOT IN ('', {list_(C.MISSING_WORDS)})")
def site_options(spark, sf):
    return R.options(read(spark, sf, "documents"), "source")


SORTED = "WITH rep AS (SELECT doc_id AS report_id FROM documents), pred AS (SELECT doc_id AS report_id, (CASE WHEN toxic = 1 THEN 0.9 WHEN quality = 0 THEN 0.5 ELSE 0.1 END)::DOUBLE AS score FROM labels) SELECT report_id, score FROM rep LEFT JOIN pred USING (report_id)"


@query(f"{SORTED} ORDER BY coalesce(score, -1) DESC, report_id LIMIT 120")
def queue_sorted(spark, sf):
    rows = reports(spark, sf).join(predictions(spark, sf), "report_id", "left").select("report_id", "score")
    return R.ordered(rows, "score-desc", "score", "report_id").limit(120)


@query(f"SELECT *, row_number() OVER (ORDER BY score DESC, report_id)::INTEGER AS place, CASE WHEN row_number() OVER (ORDER BY score DESC, report_id) <= 20 THEN 'shortlist' ELSE 'bench' END AS listed FROM ({SORTED}) WHERE score IS NOT NULL ORDER BY score DESC, report_id LIMIT 30")
def shortlist(spark, sf):
    rows = predictions(spark, sf).join(reports(spark, sf).select("report_id"), "report_id").select("report_id", "score")
    return R.shortlist(rows, [F.desc("score"), F.asc("report_id")], 20)


@query("SELECT (SELECT count(*) FROM documents) AS reports, (SELECT count(*) FROM labels) AS predictions, (SELECT count(*) FROM orders) AS actions")
def health_counts(spark, sf):
    return R.health(read(spark, sf, "documents"), read(spark, sf, "labels"), read(spark, sf, "orders"))


@query("WITH g AS (SELECT text, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 HAVING count(*) >= 2) SELECT coalesce(sum(n - 1), 0)::BIGINT AS hidden, count(*) AS groups FROM g")
def queue_compression(spark, sf):
    docs = read(spark, sf, "documents")
    groups = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.collect_list("doc_id").alias("members")).filter(F.size("members") >= 2)
    return R.compressed(groups, "members", docs.filter("doc_id % 2 = 0"), "doc_id")  # the even ones are the visible rows


@query(f"WITH {SCORED} SELECT sum((score >= 0.5647)::INTEGER)::BIGINT AS client, sum((score > 0.4)::INTEGER)::BIGINT AS server, sum((score >= 0.5647)::INTEGER) <> sum((score > 0.4)::INTEGER) AS drift FROM scored")
def threshold_drift(spark, sf):
    return R.drifted(scored(spark, sf), "score", F.col("score") > 0.4, C.FLAG)


@query(f"""WITH {SCORED} SELECT report_id, CASE WHEN score >= 0.5647 THEN 3 WHEN score >= 0.4 THEN 2 ELSE 1 END AS severity, CASE WHEN score >= 0.5647 THEN 'HIGH' WHEN score >= 0.4 THEN 'MODERATE' WHEN report_id % 3 = 0 THEN 'REVIEW' ELSE 'LOW' END AS word,
  CASE WHEN report_id % 7 = 0 THEN 'fir' ELSE 'iir' END AS track, CASE WHEN report_id % 7 = 0 THEN DATE '2024-03-02' ELSE DATE '2024-03-31' END AS due FROM scored""")
def review_clock(spark, sf):
    rows = scored(spark, sf).withColumn("band", S.band(F.col("score")))
    track = R.track(F.col("report_id") % 7 == 0)
    word = R.effective_word(F.col("band"), F.when(F.col("report_id") % 3 == 0, 0.2).otherwise(0.1))
    return rows.select("report_id", R.severity_rank(F.col("band")).alias("severity"), word.alias("word"), track.alias("track"), R.default_due(track, F.lit("2024-03-01").cast("date")).alias("due"))


@query("""WITH x AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'click' THEN 'not_sif_potential' ELSE 'sif_potential' END AS v FROM events WHERE event_type <> 'view')
  SELECT user_id, CASE WHEN arg_max(v, (ts, event_id)) = 'not_sif_potential' THEN 'reject' ELSE 'confirm' END AS decision FROM x GROUP BY 1""")
def latest_decision(spark, sf):
    log = read(spark, sf, "events").filter("event_type <> 'view'").withColumns({"field": F.lit("sif_label"), "new_value": F.when(F.col("event_type") == "click", "not_sif_potential").otherwise("sif_potential")})
    return R.latest_decision(log, "user_id", "ts", "event_id")


@query("SELECT o_orderkey, o_custkey, c_mktsegment, c_acctbal, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3) ON n_nationkey = c_nationkey")
def decision_rows(spark, sf):
    reports_ = read(spark, sf, "customer").select(F.col("c_custkey").alias("report_id"), "c_mktsegment", "c_acctbal", F.col("c_nationkey").alias("override_id"))
    actions = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_regionkey < 3").select(F.col("n_nationkey").alias("override_id"), "r_name")
    log = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("report_id"))
    return R.decisions(log, reports_, actions).select("o_orderkey", F.col("report_id").alias("o_custkey"), "c_mktsegment", "c_acctbal", "r_name")


FAMILY = f"""WITH e AS (SELECT event_id, user_id::VARCHAR AS site, event_type AS activity, (floor(event_id * 7 / 3)::BIGINT % 2)::INTEGER AS y, CASE WHEN event_id % 3 = 0 THEN 'hot_work' ELSE 'driving' END AS rule FROM events),
  b AS (SELECT avg(y)::DOUBLE AS b FROM e), n AS (SELECT site, activity, count(*) AS n, sum(y)::BIGINT AS k FROM e GROUP BY 1, 2 HAVING count(*) >= 5),
  r AS (SELECT site, activity, rule, row_number() OVER (PARTITION BY site, activity ORDER BY count(*) DESC, min(event_id)) AS o FROM e GROUP BY 1, 2, 3)
  SELECT n.site, n.activity, rule, n, k AS n_sif, {r_('k::DOUBLE / n')} AS sif_rate, CASE WHEN b > 0 THEN {r_('k::DOUBLE / n / b', 3)} ELSE 0 END AS lift, {r_(wilson_('(k::DOUBLE / n)', 'n', 'low'))} AS ci_low, {r_(wilson_('(k::DOUBLE / n)', 'n', 'high'))} AS ci_high
  FROM n JOIN r ON n.site = r.site AND n.activity = r.activity AND o = 1, b"""


@query(FAMILY)
def pattern_family(spark, sf):
    rows = events(spark, sf).select("event_id", F.col("user_id").cast("string").alias("site"), F.col("event_type").alias("activity"), "y", F.array(F.when(F.col("event_id") % 3 == 0, "hot_work").otherwise("driving")).alias("rules"))
    return G.pattern_family(rows, ["site", "activity"], "y", "rules", "event_id", 5)


@query(f"WITH {SCORED} SELECT site, activity, count(*) AS n_reports, sum((toxic = 1)::INTEGER)::BIGINT AS n_flagged, {r_('avg((toxic = 1)::INTEGER)')} AS sif_rate FROM scored GROUP BY 1, 2")
def density_seed(spark, sf):
    return G.density_seed(scored(spark, sf), "site", "activity", "toxic")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1")
def top_title(spark, sf):
    return G.top_value(read(spark, sf, "events"), ["user_id"], "event_type")


@query(f"SELECT lang, source, count(*) AS n, {r_('count(*)::DOUBLE / (SELECT count(*) FROM documents)')} AS share FROM documents GROUP BY 1, 2")
def corpus_composition(spark, sf):
    return G.composition(read(spark, sf, "documents"), ["lang", "source"])


@query(f"""WITH {SCORED}, c AS (SELECT activity AS split, site AS source, count(*) AS n, sum((toxic = 1)::INTEGER)::BIGINT AS positives FROM scored GROUP BY GROUPING SETS ((activity, site), (activity)))
  SELECT split, source, n, positives, {r_('positives::DOUBLE / n')} AS prevalence FROM c""")
def split_audit(spark, sf):
    return G.split_audit(scored(spark, sf).select(F.col("activity").alias("split"), F.col("site").alias("source"), "toxic"), "split", "source", "toxic")


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS raters, string_agg(event_type || '=' || printf('%.3f', v), ';' ORDER BY event_type) AS labels FROM l GROUP BY 1""")
def latest_labels(spark, sf):
    maps = G.latest_labels(read(spark, sf, "events"), "user_id", "event_type", ["event_id"], ["value"])
    said = F.transform(F.array_sort(F.map_keys("labels")), lambda k: F.concat(k, F.lit("="), F.format_string("%.3f", F.col("labels")[k]["value"])))
    return maps.select("user_id", F.size("labels").cast("long").alias("raters"), F.array_join(said, ";").alias("labels"))


@query(f"""WITH v AS (SELECT user_id, event_type, arg_max((event_id % 2)::INTEGER, event_id) AS v FROM events GROUP BY 1, 2)
  SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, sum((a.v = b.v)::INTEGER)::BIGINT AS agree, {r_('avg((a.v = b.v)::INTEGER)')} AS share FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""")
def rater_pairs(spark, sf):
    votes = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by(F.col("event_id") % 2, "event_id").alias("v"))
    return G.rater_pairs(votes, "user_id", "event_type", "v")


@query("""WITH f AS (SELECT user_id, min(event_id) AS a FROM events GROUP BY 1), g AS (SELECT f.user_id, f.a, e.event_type AS k FROM f JOIN events e ON e.event_id = f.a)
  SELECT g.user_id, g.a, min(e.event_id) AS b FROM g JOIN events e ON e.user_id = g.user_id AND e.event_type <> g.k GROUP BY 1, 2""")
def first_pairs(spark, sf):
    return G.first_pairs(read(spark, sf, "events"), "user_id", "event_type", "event_id")


@query(f"""WITH {EV}, t AS (SELECT unnest(range(5, 96)) AS s), c AS (SELECT s, sum(CASE WHEN floor(score * 100 + 1e-9) >= s AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN floor(score * 100 + 1e-9) >= s AND y = 0 THEN 1 ELSE 0 END) AS fp, sum(y) AS p FROM ev, t GROUP BY 1),
  f AS (SELECT s, 2.0::DOUBLE * tp / (tp + fp + p) AS f1 FROM c) SELECT s / 100.0::DOUBLE AS threshold, {r_('f1', 6)} AS f1 FROM f ORDER BY f.f1 DESC, s LIMIT 1""")
def f1_grid(spark, sf):
    return G.f1_grid(events(spark, sf), "y", "score")




@query()
def assigned(spark, sf):
    items = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 5 == 0).alias("is_double"))
    out = G.assigned(items, "doc_id", "is_double", ["a", "b", "c"], 7)
    return out.groupBy("labeler", "second_labeler").agg(F.count("*").alias("n"))


@query()
def gold_enriched(spark, sf):
    rows = read(spark, sf, "labels").select("doc_id", "toxic")
    out = G.gold_enriched(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), "doc_id", "toxic", 0.2, 3)
    return out.agg(F.count("*").alias("n"), F.sum("toxic").alias("positives"))


@query("SELECT bucket, target::BIGINT AS target, least(coalesce(n, 0), target)::BIGINT AS taken, greatest(target - coalesce(n, 0), 0)::BIGINT AS shortfall FROM (VALUES ('en', 300), ('de', 20), ('xx', 5)) t(bucket, target) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) ON lang = bucket")
def bucket_shortfall(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("bucket"))
    return G.sliced(rows, "bucket", {"en": 300, "de": 20, "xx": 5}, [F.asc("doc_id")])[1]


@query("SELECT lang AS bucket, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE (lang = 'en' AND r <= 300) OR (lang = 'de' AND r <= 20)")
def bucket_slice(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("bucket"))
    return G.sliced(rows, "bucket", {"en": 300, "de": 20, "xx": 5}, [F.asc("doc_id")])[0]


@query(f"SELECT doc_id, regexp_matches(lower(text), {quoted_('(?:^|[^a-z0-9_])(?:' + '|'.join(C.MACHINE_PHRASES) + ')(?:[^a-z0-9_]|$)')}) AS machine FROM documents")
def machine_phrases(spark, sf):
    return read(spark, sf, "documents").select("doc_id", G.machine_phrase(F.col("text")).alias("machine"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Conflict' WHEN doc_id % 4 = 1 THEN 'Ground Excursion' END AS dropped FROM documents")
def anomaly_screen(spark, sf):
    anomaly = F.when(F.col("doc_id") % 4 == 0, "Deviation; Conflict NMAC ; Ground Excursion Taxiway").when(F.col("doc_id") % 4 == 1, "ATC Issue;Ground Excursion").when(F.col("doc_id") % 4 == 2, "No Conflict")
    return read(spark, sf, "documents").select("doc_id", G.anomaly_dropped(anomaly).alias("dropped"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'id ''x1'' missing syn- prefix' WHEN doc_id % 5 = 1 THEN 'sif_potential 2 not in {0,1}' WHEN doc_id % 5 = 2 THEN 'unknown rules [''a'', ''b'']' WHEN doc_id % 5 = 3 THEN 'missing field ''register''' END AS reason FROM documents""")
def schema_errors(spark, sf):
    k = F.col("doc_id") % 5
    row = {
        "id": F.when(k == 0, "x1").otherwise("syn-1"), "text": F.lit("some text"), "sif_potential": F.when(k == 1, 2).otherwise(1), "source": F.lit("synthetic"),
        "rules": F.when(k == 2, F.array(F.lit("b"), F.lit("driving"), F.lit("a"))).otherwise(F.array(F.lit("driving"))), "register": F.when(k != 3, "drill"),
    }
    return read(spark, sf, "documents").select("doc_id", G.schema_error(row).alias("reason"))


@query("SELECT DISTINCT trim(a.text) AS text FROM documents a WHERE doc_id % 2 = 0 AND trim(a.text) IN (SELECT trim(text) FROM documents WHERE doc_id % 2 = 1 UNION SELECT trim(text) FROM benchmark)")
def text_collisions(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return G.same_texts(docs.filter("doc_id % 2 = 0"), [docs.filter("doc_id % 2 = 1"), read(spark, sf, "benchmark")], "text")  # two halves as two corpora


def cues_sql(rule: str) -> str:
    return f"regexp_matches(lower(text), {quoted_('|'.join(C.EVIDENCE[rule]))})"


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {cues_sql(r)} THEN '{r}' END" for r in C.EVIDENCE) + ") AS cues FROM documents")
def rule_cues(spark, sf):
    cues = V.rule_cues(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.filter(F.array(*map(F.lit, C.EVIDENCE)), lambda k: cues[k]), ",").alias("cues"))


@query("""WITH v AS (SELECT event_id, [value, value / 2, abs(value - 30)] AS s FROM events), m AS (SELECT *, list_sum(s) / 3 AS m FROM v)
  SELECT event_id, floor(m * 1e4 + 0.5) / 1e4 AS mean, floor(sqrt(list_sum(list_transform(s, lambda x: (x - m) * (x - m))) / 3) * 1e4 + 0.5) / 1e4 AS spread, floor(len(list_filter(s, lambda x: (x >= 40) = (m >= 40)))::DOUBLE / 3 * 1e4 + 0.5) / 1e4 AS stability FROM m""")
def variant_stats(spark, sf):
    x = V.variant_stats(F.array(F.col("value"), F.col("value") / 2, F.abs(F.col("value") - 30)), 40.0)
    return read(spark, sf, "events").select("event_id", x.alias("x")).select("event_id", *[S.rounded(F.col(f"x.{n}")).alias(n) for n in ("mean", "spread", "stability")])


@query("SELECT doc_id, 'explain:' || sha256(text || chr(0) || 'm1' || chr(0) || '0.5647' || chr(0) || 'v3') AS key FROM documents")
def explanation_keys(spark, sf):
    return read(spark, sf, "documents").select("doc_id", V.explanation_key(F.col("text"), "m1", 0.5647, "v3").alias("key"))


MEANINGS = ", ".join(f"({quoted_(g)}, {quoted_(m)}, {C.GATES.index(g)})" for g, m in C.BARRIER_MEANING.items())
WELLS = f"regexp_matches(t, {quoted_('(?i)(?:' + '|'.join(C.WELL_CONTROL) + ')')})"


@query(f"""WITH {TRIGGERED}, b AS (SELECT report_id, string_agg(meaning, ', ' ORDER BY place) AS missing FROM trig JOIN (VALUES {MEANINGS}) m(gate, meaning, place) USING (gate) GROUP BY 1)
  SELECT d.report_id, CASE WHEN missing IS NOT NULL THEN 'Missing: ' || missing || '.' || chr(10) || 'Sent to a reviewer.' || CASE WHEN {WELLS} THEN chr(10) || 'Well-control equipment is involved.' ELSE '' END
    WHEN {WELLS} THEN 'The report involves well-control equipment; a person should review it.' WHEN score >= 0.5647 THEN 'This report describes a serious event; a person should review it.'
    WHEN score >= 0.4 THEN 'The report is unclear; a person should check it.' WHEN d.report_id IN (SELECT report_id FROM trig WHERE gate NOT IN ('near_dup', 'long_input')) THEN 'The report needs a review before it is closed.'
    ELSE 'No clear high-energy exposure or missing safeguard was identified.' END AS explanation FROM doc d LEFT JOIN b USING (report_id)""")
def explanations(spark, sf):
    from ..functions.text import well_control
    from ..operators import gates

    rows = gates.with_gates(scored(spark, sf))
    return rows.select("report_id", V.explanation(F.col("gates"), well_control(F.col("text")), F.col("score"), F.lit(None).cast("string")).alias("explanation"))


@query()
def surface_variants(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.transform(V.surface_variants(F.col("text")), lambda t: F.sha2(t, 256)).alias("variants"))


@query("WITH e AS (SELECT event_id, value FROM events) SELECT event_id, array_to_string(list_transform(list_sort(list_filter([(-value, 'a'), (-value / 2, 'b'), (-(value + 1), 'c')], lambda x: -x[1] >= 20)), lambda x: x[2]), ',') AS rules FROM e")
def implicated_rules(spark, sf):
    p = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") / 2, F.lit("c"), F.col("value") + 1)
    return read(spark, sf, "events").select("event_id", F.array_join(F.transform(V.implicated_rules(p, {"a": 20, "b": 20, "c": 20}), lambda x: x["rule"]), ",").alias("rules"))


@query("SELECT doc_id, 'near-dup banner:' AS detail FROM documents")
def plain_details(spark, sf):
    said = F.concat(F.lit("near-dup banner: cosine=0.95 with index row "), F.col("doc_id").cast("string"), F.lit(" (>= 0.91) ( )"))
    return read(spark, sf, "documents").select("doc_id", F.concat(R.plain_detail(said), F.lit(":")).alias("detail"))


@query(f"WITH {SCORED} SELECT {facet_('site')} AS facet, count(*) AS n FROM scored WHERE site NOT IN ('', {list_(C.MISSING_WORDS)}) GROUP BY 1")
def known_sites(spark, sf):
    return scored(spark, sf).filter(R.has_facet(F.col("site"))).groupBy(S.facet(F.col("site")).alias("facet")).agg(F.count("*").alias("n"))


TIERS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, CASE WHEN x.vec_id % 2 = 0 THEN 0 ELSE 1 END AS tier, floor(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) / (q.n * x.n) * 1e6 + 0.5) / 1e6 AS cosine FROM v q JOIN v x ON q.vec_id % 25 = 0 AND q.vec_id <> x.vec_id)
  SELECT query_id, rank, id, cosine, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, tier, id)::INTEGER AS rank FROM s) WHERE rank <= 3"""


@query(TIERS)
def two_tier_top(spark, sf):
    rows = read(spark, sf, "embeddings")
    queries = rows.filter("vec_id % 25 = 0")
    base, session = (M.cosine_top(queries, rows.filter(f"vec_id % 2 = {k}"), 3, "vec_id", "embedding") for k in (0, 1))
    return G.two_tier_top(base, session, 3)


CODES = ", ".join(f"('{e}', '{k}', '{v}')" for e, rules in C.CODE_RULES.items() for k, v in rules.items())


@query(f"WITH m(era, prefix, rule) AS (VALUES {CODES}) SELECT o_orderkey, rule FROM (SELECT o_orderkey, CASE WHEN o_orderdate::DATE < DATE '1995-01-01' THEN 'v1' ELSE 'v2' END AS era, substr((10 + o_custkey % 90)::VARCHAR || '7', 1, 2) AS prefix FROM orders) LEFT JOIN m USING (era, prefix)")
def code_rules(spark, sf):
    from ..functions.text import code_rule

    era = F.when(F.to_date("o_orderdate") < F.lit("1995-01-01").cast("date"), "v1").otherwise("v2")
    code = F.concat((10 + F.col("o_custkey") % 90).cast("string"), F.lit("7"))
    return read(spark, sf, "orders").select("o_orderkey", code_rule(code, era).alias("rule"))


@query(f"""WITH {SCORED}, b AS (SELECT *, CASE WHEN score >= 0.5647 THEN 'HIGH' WHEN score >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS band FROM scored),
  v AS (SELECT activity, band, row_number() OVER (PARTITION BY activity ORDER BY count(*) DESC, band) AS r FROM b GROUP BY 1, 2)
  SELECT b.activity, count(*) AS n, {r_('avg((score >= 0.5647)::INTEGER)')} AS flag_recall, {r_('avg((score >= 0.4)::INTEGER)')} AS routed_recall, {r_('avg(score)')} AS mean, {r_('stddev_pop(score)')} AS sd, count(DISTINCT b.band) AS distinct_verdicts, any_value(v.band) AS majority_verdict
  FROM b JOIN v ON v.activity = b.activity AND r = 1 GROUP BY 1""")
def probe_summary(spark, sf):
    rows = scored(spark, sf).withColumns({"flagged": F.col("score") >= C.FLAG, "routed": F.col("score") >= C.GRAY_LOW, "band": S.band(F.col("score"))})
    return G.probe_summary(rows, ["activity"])


@query(f"""WITH {SCORED} SELECT activity, count(*) AS n, sum((toxic = 1)::INTEGER)::BIGINT AS positives, {r_(f"avg(len(list_filter(string_split_regex(text, '{WHITE_SQL}+'), lambda x: x <> '')))")} AS mean_words,
  {", ".join(f"sum({keyworded(r)}::INTEGER)::BIGINT AS {r}" if r in C.KEYWORDS else f"0::BIGINT AS {r}" for r in C.RULES)} FROM scored GROUP BY 1""")
def corpus_profile(spark, sf):
    from ..functions.text import keyword_rules

    rows = scored(spark, sf).withColumn("rules", keyword_rules(F.col("text")))
    return G.corpus_profile(rows, "activity", "toxic", "rules", "text")


@query()
def cross_file_drops(spark, sf):
    prior = read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return O.cross_file_drops(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), prior, "id", "text")
