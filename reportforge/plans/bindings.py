"""Queries over the provided tables, by name, and the SQL that gives the same rows.

documents stand for reports (source as site, lang as activity), labels for the partial predictions, events for dated
registers and logs, embeddings for vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions import text as X
from ..operators import analytics as A
from ..operators import corpus as K
from ..operators import evaluate as E
from ..operators import gates as G
from ..operators import review as R
from ..operators import similarity as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), "text", F.col("source").alias("site"), F.col("lang").alias("activity"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(F.col("toxic") == 1, 0.9).when(F.col("quality") == 0, 0.5).otherwise(0.1)
    return read(spark, sf, "labels").select(F.col("doc_id").alias("report_id"), score.alias("score"), "toxic", "quality")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return reports(spark, sf).join(predictions(spark, sf), "report_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a score in 0..1 in hundredths and a truth in 0/1."""
    score = F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double") / 100.0
    return read(spark, sf, "events").withColumns({"score": score, "y": F.pmod(F.floor(F.col("event_id") * 7 / 3).cast("long"), F.lit(2)).cast("int"), "day": F.to_date("ts")})


# SQL pieces that many queries share.
REP = "rep AS (SELECT doc_id AS report_id, text, source AS site, lang AS activity FROM documents)"
PRED = "pred AS (SELECT doc_id AS report_id, (CASE WHEN toxic = 1 THEN 0.9 WHEN quality = 0 THEN 0.5 ELSE 0.1 END)::DOUBLE AS score, toxic, quality FROM labels)"
SCORED = f"{REP}, {PRED}, scored AS (SELECT * FROM rep JOIN pred USING (report_id))"
EV = "ev AS (SELECT *, ((event_id * 37) % 101)::DOUBLE / 100 AS score, (floor(event_id * 7 / 3)::BIGINT % 2)::INTEGER AS y, ts::DATE AS day FROM events)"


def r_(x: str, n: int = 4) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def facet_(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '(unspecified)')"


def wilson_(p: str, n: str, side: str) -> str:
    centre, half = f"({p} + 3.8416 / (2 * ({n})))", f"1.96 * sqrt({p} * (1 - {p}) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))"
    value = f"greatest(({centre} - {half}) / (1 + 3.8416 / ({n})), 0)" if side == "low" else f"least(({centre} + {half}) / (1 + 3.8416 / ({n})), 1)"
    return value


@query(f"""WITH {REP}, {PRED} SELECT {facet_('site')} AS facet, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged,
  {r_('avg(coalesce(score, 0))')} AS mean_score, {r_('sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::DOUBLE / count(*)')} AS rate
  FROM rep LEFT JOIN pred USING (report_id) GROUP BY 1""")
def facet_density(spark, sf):
    return A.facet_density(reports(spark, sf), predictions(spark, sf), "report_id", "site")


CELLS = f"""WITH {SCORED}, base AS (SELECT avg(CASE WHEN score >= 0.5647 THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM scored),
  cell AS (SELECT {facet_('site')} AS first, {facet_('activity')} AS second, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM scored GROUP BY 1, 2),
  s AS (SELECT *, flagged::DOUBLE / n AS p FROM cell, base WHERE n >= 2)
  SELECT first, second, n, flagged, {r_('p')} AS rate, CASE WHEN b > 0 THEN {r_('p / b', 3)} ELSE 0 END AS lift, {r_(wilson_('p', 'n', 'low'))} AS ci_low, {r_(wilson_('p', 'n', 'high'))} AS ci_high FROM s"""


# What the gates find, in SQL: patterns' matches as spans of token numbers, and which report triggers which gate. Signs
# outside ASCII become "_" where they are letters or numbers and blanks elsewhere, as this dialect's word bounds are ASCII.
WHITE_SQL = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PLAIN_SQL = r"regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{M}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def quoted_(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def list_(xs: list[str]) -> str:
    return ", ".join(map(quoted_, xs))


SHORT_SQL = rf"""(length(regexp_replace(text, '^{WHITE_SQL}+|{WHITE_SQL}+$', '', 'g')) < 20 AND NOT regexp_matches(upper({PLAIN_SQL}), {quoted_(G.phrases(C.SHORT_CODES))})
  AND coalesce(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: length(x) >= 2 AND x = upper(x) AND regexp_matches(x, '[A-Z]')))::DOUBLE / nullif(len(regexp_extract_all(text, '[A-Za-z0-9]+')), 0), 0) < 0.4)"""
LANGUAGE_SQL = r"(length(text) = 0 OR length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))::DOUBLE / length(text) > 0.15 OR regexp_matches(text, '[\x{0900}-\x{097F}]'))"
DRILLS_SQL = f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({PLAIN_SQL}, {quoted_('(?i)' + C.DRILL)}), lambda x: lower(x)))), ', ')"
PATTERNS = {"cue": G.CUES, "counter": G.COUNTER, "absence": C.ABSENCE, "over": C.PURGE_OVER} | {f"control {k}": v for k, v in C.CONTROLS.items()} | {f"direct {k}": v for k, v in C.DIRECT.items()}
TRIGGERED = rf"""{SCORED}, doc AS (SELECT report_id, activity, score, text, {PLAIN_SQL} AS t, len(list_filter(string_split_regex(text, '{WHITE_SQL}+'), lambda x: x <> '')) AS words FROM scored),
  pat(kind, p) AS (VALUES {", ".join(f"({quoted_(k)}, {quoted_('(?i)' + v)})" for k, v in PATTERNS.items())}),
  cut AS (SELECT report_id, kind, string_split(regexp_replace(t, p, chr(1) || '\0' || chr(1), 'g'), chr(1)) AS s FROM doc, pat),
  piece AS (SELECT report_id, kind, generate_subscripts(s, 1) AS i, unnest(list_transform(s, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9]+')))) AS k FROM cut WHERE len(s) > 1),
  placed AS (SELECT *, sum(k) OVER (PARTITION BY report_id, kind ORDER BY i) AS upto FROM piece),
  span AS (SELECT report_id, kind, upto - k AS first, upto - 1 AS last FROM placed WHERE i % 2 = 0),
  token AS (SELECT report_id, generate_subscripts(w, 1) - 1 AS first, unnest(w) AS w FROM (SELECT report_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM doc)),
  anchor AS (SELECT report_id, first, regexp_matches(w, '^(?:{"|".join(C.OUTCOME_STEMS)})') OR w IN ({list_(C.SEVER_TOKENS)}) AS plain, w IN ({list_(C.MECHANISM_TOKENS)}) AS mechanism FROM token),
  outcome AS (SELECT * FROM anchor WHERE plain OR mechanism),
  pair AS (SELECT c.report_id, a.first, a.plain FROM span c JOIN outcome a ON c.report_id = a.report_id AND c.kind = 'cue' AND abs(c.first - a.first) <= 5
    WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.kind = 'counter' AND s.report_id = c.report_id AND s.first BETWEEN least(c.first, a.first) - 5 AND greatest(c.first, a.first) + 5)),
  sign AS (SELECT * FROM span s WHERE s.kind LIKE 'direct %' AND (s.kind <> 'direct atmosphere_unmonitored' OR
    NOT EXISTS (SELECT 1 FROM span o WHERE o.report_id = s.report_id AND o.kind = 'over' AND o.first <= s.last + 3 AND o.last >= s.first - 3)
    AND NOT EXISTS (SELECT 1 FROM span o WHERE o.report_id = s.report_id AND o.kind = 'absence' AND o.last BETWEEN s.first - 2 AND s.first - 1))),
  trig AS (SELECT report_id, 'negation' AS gate FROM pair WHERE plain
    UNION SELECT o.report_id, 'severity_watch' FROM outcome o JOIN doc d ON d.report_id = o.report_id AND d.score < 0.5647 WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.report_id = o.report_id AND p.first = o.first)
    UNION SELECT report_id, substr(kind, 8) FROM sign
    UNION SELECT s.report_id, substr(s.kind, 9) FROM span s JOIN span a ON a.report_id = s.report_id AND a.kind = 'absence' AND s.kind LIKE 'control %' AND s.first <= a.last + 3 AND s.last >= a.last - 3
    UNION SELECT report_id, 'min_length' FROM doc WHERE {SHORT_SQL}
    UNION SELECT report_id, 'language' FROM doc WHERE {LANGUAGE_SQL}
    UNION SELECT report_id, 'confidence' FROM doc WHERE score BETWEEN 0.4 AND 0.6
    UNION SELECT report_id, 'drill' FROM doc WHERE {DRILLS_SQL} <> ''
    UNION SELECT report_id, 'long_input' FROM doc WHERE length(text) > 10000 OR words > 120
    UNION SELECT report_id, 'chunked_low_score' FROM doc WHERE words > 120 AND score < 0.4
    UNION SELECT report_id, 'well_control_watch' FROM doc WHERE score < 0.5647 AND regexp_matches(t, {quoted_("(?i)" + "|".join(C.WELL_CONTROL))}))"""


@query(CELLS)
def pattern_cells(spark, sf):
    return A.pattern_cells(scored(spark, sf), "site", "activity")


@query(f"{CELLS} ORDER BY lift DESC, n DESC, first, second LIMIT 20")
def pattern_top(spark, sf):
    cells = A.pattern_cells(scored(spark, sf), "site", "activity")
    return cells.orderBy(F.desc("lift"), F.desc("n"), "first", "second").limit(20)


@query(f"""WITH {TRIGGERED}, base AS (SELECT avg(CASE WHEN score >= 0.5647 THEN 1.0 ELSE 0.0 END)::DOUBLE AS b FROM scored),
  cell AS (SELECT {facet_('activity')} AS first, gate AS second, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM trig JOIN doc USING (report_id) WHERE gate IN ({list_(C.BARRIERS)}) GROUP BY 1, 2),
  s AS (SELECT *, flagged::DOUBLE / n AS p FROM cell, base)
  SELECT first, second, n, flagged, {r_('p')} AS rate, CASE WHEN b > 0 THEN {r_('p / b', 3)} ELSE 0 END AS lift, {r_(wilson_('p', 'n', 'low'))} AS ci_low, {r_(wilson_('p', 'n', 'high'))} AS ci_high FROM s""")
def pattern_barriers(spark, sf):
    rows = G.with_gates(scored(spark, sf), only=C.BARRIERS)
    return A.barrier_cells(rows, "report_id", "activity", min_n=1)


@query(f"""WITH {REP}, {PRED} SELECT count(*) AS reports, count(score) AS scored, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged,
  {r_('sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::DOUBLE / count(score)')} AS flag_rate, {r_('avg(score)')} AS mean_score FROM rep LEFT JOIN pred USING (report_id)""")
def summary_metrics(spark, sf):
    return A.summary(reports(spark, sf), predictions(spark, sf), "report_id")


@query(f"WITH {TRIGGERED} SELECT gate, count(*) AS n FROM trig GROUP BY 1")
def gate_trigger_counts(spark, sf):
    return A.trigger_counts(G.with_gates(scored(spark, sf)))


@query(r"""SELECT doc_id, length(text) = 0 OR length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))::DOUBLE / length(text) > 0.15 AS triggered FROM documents""")
def language_gate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", G.language(F.col("text")).alias("triggered"))


@query(f"SELECT doc_id, {SHORT_SQL} AS triggered FROM documents")
def min_length_gate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", G.min_length(F.col("text")).alias("triggered"))


@query(f"SELECT doc_id, {DRILLS_SQL} AS drills FROM documents")
def drill_gate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(G.drill_hits(F.col("text")), ", ").alias("drills"))


@query(f"WITH {TRIGGERED} SELECT report_id, report_id IN (SELECT report_id FROM trig WHERE gate NOT IN ('near_dup', 'long_input')) AS routed FROM doc")
def routed_reports(spark, sf):
    return G.with_gates(scored(spark, sf)).select("report_id", G.routed(F.col("gates")).alias("routed"))


@query(f"WITH {SCORED} SELECT report_id, site, score, CASE WHEN score >= 0.5647 THEN 'HIGH' WHEN score >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS band FROM scored ORDER BY report_id DESC LIMIT 50 OFFSET 10")
def report_page(spark, sf):
    rows = scored(spark, sf).select("report_id", "site", "score", S.band(F.col("score")).alias("band"))
    return A.page(rows, "report_id", 50, 10)


@query(f"""WITH {SCORED} SELECT report_id, site, score FROM scored WHERE contains(lower(concat_ws(' ', site, activity, text)), 'src1') AND score >= 0.4 AND score < 0.5647 AND activity = 'en'""")
def queue_filter(spark, sf):
    rows = scored(spark, sf).withColumn("band", S.band(F.col("score")))
    return A.queue(rows, ["site", "activity", "text"], "SRC1", "MODERATE", {"activity": "en"}).select("report_id", "site", "score")


@query(f"""WITH {SCORED}, c AS (SELECT {facet_('site')} AS key, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM scored GROUP BY 1),
  s AS (SELECT *, {r_(wilson_('(flagged::DOUBLE / n)', 'n', 'low'))} AS lower, n < 15 AS quarantined FROM c)
  SELECT key, n, flagged, lower, quarantined, row_number() OVER (PARTITION BY quarantined ORDER BY CASE WHEN quarantined THEN 0 ELSE -lower END, n DESC, key)::INTEGER AS rank FROM s""")
def rank_wilson(spark, sf):
    cells = scored(spark, sf).groupBy(S.facet(F.col("site")).alias("key")).agg(F.count("*").alias("n"), F.sum(S.flagged(F.col("score"))).alias("flagged"))
    return A.ranking(cells, 15)


TREND = f"""WITH {EV}, c AS (SELECT date_trunc('UNIT', day)::DATE AS bucket, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM ev GROUP BY 1),
  spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c)::TIMESTAMP, (SELECT max(bucket) FROM c)::TIMESTAMP, INTERVAL STEP))::DATE AS bucket),
  f AS (SELECT bucket, coalesce(n, 0) AS n, coalesce(flagged, 0) AS flagged, CASE WHEN n > 0 THEN flagged::DOUBLE / n END AS p FROM spine LEFT JOIN c USING (bucket))
  SELECT bucket, n, flagged, {r_('100 * p', 2)} AS rate, {r_('100 * ' + wilson_('p', 'n', 'low'), 2)} AS ci_low, {r_('100 * ' + wilson_('p', 'n', 'high'), 2)} AS ci_high FROM f"""


@query(TREND.replace("UNIT", "week").replace("STEP", "'7 days'"))
def trend_week(spark, sf):
    return A.trend(events(spark, sf), F.col("day"), "week")


@query(TREND.replace("UNIT", "month").replace("STEP", "'1 month'"))
def trend_month(spark, sf):
    return A.trend(events(spark, sf), F.col("day"), "month")


@query(f"""WITH {EV}, c AS (SELECT date_trunc('week', day)::DATE AS bucket, count(*) AS n, sum(CASE WHEN score >= 0.5647 THEN 1 ELSE 0 END)::BIGINT AS f FROM ev GROUP BY 1),
  spine AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c)::TIMESTAMP, (SELECT max(bucket) FROM c)::TIMESTAMP, INTERVAL '7 days'))::DATE AS bucket),
  b AS (SELECT coalesce(n, 0) AS n, coalesce(f, 0) AS f, row_number() OVER (ORDER BY bucket DESC) AS r FROM spine LEFT JOIN c USING (bucket)),
  s AS (SELECT coalesce(sum(n) FILTER (WHERE r <= 2), 0)::BIGINT AS n_now, coalesce(sum(f) FILTER (WHERE r <= 2), 0)::DOUBLE AS f_now, coalesce(sum(n) FILTER (WHERE r IN (3, 4)), 0)::BIGINT AS n_before, coalesce(sum(f) FILTER (WHERE r IN (3, 4)), 0)::DOUBLE AS f_before FROM b),
  p AS (SELECT *, CASE WHEN n_now > 0 THEN 100 * f_now / n_now ELSE 0 END AS x, CASE WHEN n_before > 0 THEN 100 * f_before / n_before ELSE 0 END AS y FROM s)
  SELECT n_now, n_before, {r_('x', 2)} AS rate_now, {r_('y', 2)} AS rate_before, {r_('x - y', 2)} AS delta FROM p""")
def trend_delta(spark, sf):
    return A.trend_delta(A.trend(events(spark, sf), F.col("day"), "week"), 2)


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
def override_latest(spark, sf):
    log = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return R.latest(log, ["user_id", "event_type"], ["event_id"])


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id, event_type) AS last FROM events) WHERE event_id <> last""")
def override_superseded(spark, sf):
    return R.superseded(read(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("""WITH RECURSIVE log AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  f AS (SELECT user_id, r, event_id AS winner, event_type AS sig, []::BIGINT[] AS old FROM log WHERE r = 1
    UNION ALL SELECT l.user_id, l.r, CASE WHEN l.event_type = f.sig THEN f.winner ELSE l.event_id END, l.event_type,
      CASE WHEN l.event_type = f.sig THEN list_append(f.old, l.event_id) ELSE list_prepend(f.winner, f.old) END FROM f JOIN log l ON l.user_id = f.user_id AND l.r = f.r + 1)
  SELECT user_id, winner, sig AS decision, array_to_string(old, ',') AS supersedes FROM (SELECT *, max(r) OVER (PARTITION BY user_id) AS m FROM f) WHERE r = m""")
def override_lineage(spark, sf):
    log = read(spark, sf, "events")
    out = R.overrides(log, ["user_id"], "event_id", ["event_type"])
    return out.select("user_id", "winner", F.col("decision.event_type").alias("decision"), F.array_join(F.transform("supersedes", lambda x: x.cast("string")), ",").alias("supersedes"))


@query("""SELECT o_orderpriority AS owner, count(*) FILTER (WHERE o_orderstatus = 'O') AS "open", count(*) FILTER (WHERE o_orderstatus = 'P') AS in_progress, count(*) FILTER (WHERE o_orderstatus = 'F') AS closed,
  count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderdate::DATE < DATE '1998-01-01') AS overdue FROM orders GROUP BY 1""")
def workload(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("closed")
    actions = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("owner"), F.to_date("o_orderdate").alias("due"), status.alias("status"))
    return R.workload(actions, F.lit("1998-01-01").cast("date"))


@query(r"""SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def content_hash_dedup(spark, sf):
    rows = read(spark, sf, "documents").select(S.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return K.keep_first(rows, ["content_hash"], ["doc_id"])


@query(r"""WITH h AS (SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h, doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS f FROM documents)
  SELECT k.lang AS kept, d.lang AS dropped, count(*) AS n FROM h d JOIN documents k ON k.doc_id = d.f WHERE d.doc_id > d.f GROUP BY 1, 2""")
def duplicate_excess(spark, sf):
    return K.duplicate_excess(read(spark, sf, "documents").withColumn("order_key", F.col("doc_id")), "text", F.col("lang"))


@query("""SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) = 1 THEN 'c-' || o_custkey
  ELSE 'c-' || o_custkey || '-' || chr((96 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER) END AS uid FROM orders""")
def occurrence_uid(spark, sf):
    rows = read(spark, sf, "orders")
    return rows.select("o_orderkey", K.occurrence_uid(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "c").alias("uid"))


@query("""SELECT CASE WHEN o_orderdate::DATE < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders WHERE o_orderdate::DATE <= DATE '1997-06-30' GROUP BY 1""")
def temporal_split(spark, sf):
    rows = K.temporal_split(read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate").cast("string")), "d", "1996-01-01", "1997-06-30")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query()
def group_val_split(spark, sf):
    return K.group_split(read(spark, sf, "orders"), "o_custkey", 0.1, 42).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query("""WITH tr AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate::DATE < DATE '1993-01-01'), te AS (SELECT o_custkey, o_custkey IN (SELECT o_custkey FROM tr) AS hit FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-01')
  SELECT count(DISTINCT CASE WHEN hit THEN o_custkey END) AS groups, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, floor(avg(hit::INTEGER) * 1e4 + 0.5) / 1e4 AS share FROM te""")
def employer_leakage(spark, sf):
    rows = read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate").cast("string"))
    return K.leakage(rows.filter("d < '1993-01-01'"), rows.filter("d >= '1998-01-01'"), "o_custkey")


@query("""WITH q(source, quota) AS (VALUES ('src0', 40), ('src1', 80), ('none', 10)), c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1)
  SELECT q.source, coalesce(n, 0) AS n, quota::BIGINT AS quota, floor(100.0 * greatest(0, quota - coalesce(n, 0))::DOUBLE / quota * 100 + 0.5) / 100 AS shortfall FROM q LEFT JOIN c USING (source)""")
def mix_ratio(spark, sf):
    return K.mix_ratio(read(spark, sf, "documents"), "source", {"src0": 40, "src1": 80, "none": 10})


@query("""SELECT drop_stage, count(*) AS n FROM (SELECT CASE WHEN length(text) < 200 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN contains(text, '***') THEN 'symbols' END AS drop_stage FROM documents) GROUP BY 1""")
def drop_accounting(spark, sf):
    t = F.col("text")
    rows = K.staged_drops(read(spark, sf, "documents"), [("short", F.length(t) < 200), ("language", ~F.col("lang").isin("en", "de")), ("symbols", t.contains("***"))])
    return rows.groupBy("drop_stage").agg(F.count("*").alias("n"))


@query(r"""SELECT term, count(*) FILTER (WHERE contains(lower(text), term)) AS n, count(*) FILTER (WHERE contains(lower(text), term)) >= 50 AS enough FROM documents, (VALUES ('the'), ('license'), ('und'), ('que'), ('crane')) t(term) GROUP BY term""")
def vocab_coverage(spark, sf):
    return K.coverage(read(spark, sf, "documents"), "text", ["the", "license", "und", "que", "crane"], 50)


# Words of other scripts do not touch the outcome words, so ASCII word bounds do on the texts as they are.
MASKED = quoted_("(?i)(?:" + "|".join(C.OUTCOMES) + ")")


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, {MASKED})) AS outcomes,
  sha256(regexp_replace(regexp_replace(text, {MASKED}, '[OUTCOME]', 'g'), '\[OUTCOME\](?:\s+\[OUTCOME\])+', '[OUTCOME]', 'g')) AS masked_sha256 FROM documents""")
def mask_counts(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", X.mask_count(t).alias("outcomes"), F.sha2(X.mask_text(t), 256).alias("masked_sha256"))


def keyworded(rule: str) -> str:
    return f"regexp_matches({PLAIN_SQL}, {quoted_('(?i)(?:' + '|'.join(C.KEYWORDS[rule]) + ')')})"


@query(f"""SELECT doc_id, concat_ws(',', {", ".join(f"CASE WHEN {keyworded(r)} THEN '{r}' END" for r in C.RULES if r in C.KEYWORDS)}) AS rules,
  coalesce({", ".join(f"CASE WHEN {keyworded(r)} THEN '{r}' END" for r in C.TIE_ORDER if r in C.KEYWORDS)}) AS primary_rule, regexp_matches({PLAIN_SQL}, {quoted_("(?i)(?:" + "|".join(C.WELL_CONTROL) + ")")}) AS well_control FROM documents""")
def keyword_rules(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", F.array_join(X.keyword_rules(t), ",").alias("rules"), X.primary_rule(t).alias("primary_rule"), X.well_control(t).alias("well_control"))


@query("""WITH w AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
  SELECT user_id, event_type AS dominant, n AS support FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM w) WHERE r = 1""")
def dominant_rule(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", F.array("event_type").alias("rules"))
    return A.dominant(rows, ["user_id"], "rules", "event_id")


SPACED = f"list_filter(string_split_regex(lower(text), '{WHITE_SQL}+'), lambda x: x <> '')"
JAC = f"WITH t AS (SELECT doc_id AS id, doc_id % 10 = 0 AS test, {SPACED} AS w FROM documents)," + r"""
  s AS (SELECT id, test, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM t WHERE len(w) >= 8),
  p AS (SELECT id, test, len(s) AS size, unnest(s) AS g FROM s), df AS (SELECT g FROM p WHERE NOT test GROUP BY g HAVING count(*) <= 256),
  c AS (SELECT a.id, a.size AS x, b.id AS other, b.size AS y, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.test AND NOT b.test WHERE b.g IN (SELECT g FROM df) GROUP BY ALL),
  m AS (SELECT id, max(c::DOUBLE / (x + y - c)) AS j FROM c GROUP BY id)
  SELECT t.id, floor(coalesce(j, 0) * 1e6 + 0.5) / 1e6 AS max_jaccard FROM t LEFT JOIN m USING (id) WHERE test"""


@query(JAC)
def ngram_jaccard_screen(spark, sf):
    rows = read(spark, sf, "documents")
    return M.jaccard_screen(rows.filter("doc_id % 10 = 0"), rows.filter("doc_id % 10 <> 0"), "doc_id", "text")


@query(JAC.replace(" FROM documents),", f" FROM documents UNION ALL SELECT item_id, false, {SPACED} FROM benchmark),", 1).replace("doc_id % 10 = 0 AS test", "true AS test"))
def benchmark_screen(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.jaccard_screen(docs, read(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), "id", "text")


@query()
def within_file_dup(spark, sf):
    return M.within_file_duplicates(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


COS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
  s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, floor(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) / (q.n * x.n) * 1e6 + 0.5) / 1e6 AS cosine FROM v q JOIN v x ON q.vec_id % 25 = 0 AND q.vec_id <> x.vec_id)
  SELECT query_id, rank, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)::INTEGER AS rank FROM s) WHERE rank <= K"""


@query(COS.replace("<= K", "<= 1"))
def cosine_top1(spark, sf):
    rows = read(spark, sf, "embeddings")
    return M.cosine_top(rows.filter("vec_id % 25 = 0"), rows, 1, "vec_id", "embedding")


@query(COS.replace("<= K", "<= 5"))
def cosine_topk(spark, sf):
    rows = read(spark, sf, "embeddings")
    return M.cosine_top(rows.filter("vec_id % 25 = 0"), rows, 5, "vec_id", "embedding")


@query()
def star_clusters(spark, sf):
    out = M.star_clusters(read(spark, sf, "embeddings"), 0.5, "vec_id", "embedding")
    return out.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), ","))


def four(y: str, hit: str) -> str:
    return f"count(*) FILTER (WHERE {hit} AND {y} = 1) AS tp, count(*) FILTER (WHERE {hit} AND {y} = 0) AS fp, count(*) FILTER (WHERE NOT {hit} AND {y} = 1) AS fn, count(*) FILTER (WHERE NOT {hit} AND {y} = 0) AS tn"


RATES = f"""tp, fp, fn, tn, {r_('(tp + fn)::DOUBLE / (tp + fp + fn + tn)')} AS prevalence, {r_('tp::DOUBLE / (tp + fp)')} AS precision, {r_('tp::DOUBLE / (tp + fn)')} AS recall, {r_('2.0 * tp / (2 * tp + fp + fn)')} AS f1,
  {r_('(tp + fp)::DOUBLE / (tp + fp + fn + tn)')} AS flag_rate, {r_(wilson_('(tp::DOUBLE / (tp + fp))', '(tp + fp)', 'low'))} AS precision_low, {r_(wilson_('(tp::DOUBLE / (tp + fp))', '(tp + fp)', 'high'))} AS precision_high,
  {r_(wilson_('(tp::DOUBLE / (tp + fn))', '(tp + fn)', 'low'))} AS recall_low, {r_(wilson_('(tp::DOUBLE / (tp + fn))', '(tp + fn)', 'high'))} AS recall_high"""


@query(f"WITH {EV}, c AS (SELECT {four('y', 'score >= 0.5647')} FROM ev) SELECT {RATES} FROM c")
def confusion(spark, sf):
    return E.confusion(events(spark, sf), "y", "score", 0.5647)


@query(f"""WITH {EV}, p AS (SELECT unnest(CASE WHEN event_type IN ('click', 'view') THEN [event_type, 'real_pooled'] ELSE [event_type] END) AS stratum, y, score FROM ev),
  c AS (SELECT stratum, {four('y', 'score >= 0.5647')} FROM p GROUP BY 1) SELECT stratum, {RATES} FROM c""")
def stratum_pooled(spark, sf):
    rows = E.pooled(events(spark, sf).withColumn("stratum", F.col("event_type")), "stratum", ["click", "view"])
    return E.confusion(rows, "y", "score", 0.5647, ["stratum"])


PR = f"""WITH {EV}, s AS (SELECT score AS threshold, sum(y) AS p, sum(1 - y) AS q FROM ev GROUP BY 1),
  w AS (SELECT threshold, (sum(p) OVER (ORDER BY threshold DESC))::BIGINT AS tp, (sum(q) OVER (ORDER BY threshold DESC))::BIGINT AS fp, sum(p) OVER () AS a FROM s),
  c AS (SELECT threshold, tp, fp, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / a::DOUBLE AS recall FROM w)"""


@query(f"{PR} SELECT * FROM c")
def pr_curve(spark, sf):
    return E.pr_curve(events(spark, sf), "y", "score")


@query(f"{PR} SELECT {r_('sum((recall - before) * precision)', 6)} AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS before FROM c)")
def avg_precision(spark, sf):
    return E.average_precision(E.pr_curve(events(spark, sf), "y", "score"))


@query(f"""WITH {EV}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ev), t AS (SELECT sum(r) FILTER (WHERE y = 1) AS r, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM r)
  SELECT {r_('(r - p * (p + 1) / 2) / (p * n)', 6)} AS auc FROM t""")
def auc_rank(spark, sf):
    return E.auc(events(spark, sf), "y", "score")


@query(f"""{PR}, b AS (SELECT * FROM c WHERE precision >= 0.45 ORDER BY recall DESC, precision DESC, threshold DESC LIMIT 1) SELECT threshold, {r_('precision')} AS precision, {r_('recall')} AS recall, true AS reachable FROM b""")
def operating_point(spark, sf):
    return E.operating_point(E.pr_curve(events(spark, sf), "y", "score"), 0.45)


@query(f"""WITH {EV}, t AS (SELECT least(floor(score * 15), 14) AS b, count(*) AS n, avg(score) AS c, avg(y::DOUBLE) AS a FROM ev GROUP BY 1)
  SELECT {r_('sum(n * abs(c - a)) / sum(n)', 6)} AS ece, {r_('(SELECT avg((score - y) * (score - y)) FROM ev)', 6)} AS brier FROM t""")
def ece_brier(spark, sf):
    return E.ece_brier(events(spark, sf), "y", "score")


@query(f"""WITH {EV}, g(threshold) AS (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)), c AS (SELECT threshold, {four('y', 'score >= threshold')} FROM ev, g GROUP BY 1)
  SELECT threshold, {r_('tp::DOUBLE / (tp + fn)')} AS recall, {r_('fp::DOUBLE / (fp + tn)')} AS fpr, {r_('2.0 * tp / (2 * tp + fp + fn)')} AS f1 FROM c""")
def threshold_grid(spark, sf):
    return E.threshold_grid(events(spark, sf), "y", "score", [0.1, 0.3, 0.5, 0.7, 0.9])


@query(f"""SELECT count(value) AS n, {r_('avg(value)', 6)} AS mean, {r_('quantile_cont(value, 0.05)', 6)} AS p5, {r_('quantile_cont(value, 0.5)', 6)} AS p50, {r_('quantile_cont(value, 0.95)', 6)} AS p95, {r_('quantile_cont(value, 0.99)', 6)} AS p99, {r_('min(value)', 6)} AS min, {r_('max(value)', 6)} AS max FROM events""")
def dist_stats(spark, sf):
    return E.distribution(read(spark, sf, "events"), "value")


VOTES = "v AS (SELECT event_id // 3 AS item, CASE WHEN event_id % 7 = 0 THEN 'unsure' WHEN (event_id // 3) % 2 = 0 OR event_id % 5 = 0 THEN 'yes' ELSE 'no' END AS label FROM events)"


def votes(spark, sf):
    item = F.floor(F.col("event_id") / 3).cast("long")
    label = F.when(F.col("event_id") % 7 == 0, "unsure").when((item % 2 == 0) | (F.col("event_id") % 5 == 0), "yes").otherwise("no")
    return read(spark, sf, "events").select(item.alias("item"), label.alias("label"))


@query(f"""WITH {VOTES}, k AS (SELECT item, count(*) AS raters, count(DISTINCT label) AS k, min(label) AS l FROM v GROUP BY 1)
  SELECT item, raters, CASE WHEN k = 1 AND l <> 'unsure' THEN l END AS consensus, CASE WHEN k > 1 THEN 'disagree' WHEN l = 'unsure' THEN 'unsure' END AS reason FROM k""")
def consensus(spark, sf):
    return E.consensus(votes(spark, sf), "item", "label")


@query(f"""WITH {VOTES}, c AS (SELECT item, label, count(*) AS c FROM v GROUP BY 1, 2), s AS (SELECT *, sum(c) OVER (PARTITION BY item) AS n FROM c), k AS (SELECT * FROM s WHERE n >= 2),
  i AS (SELECT n, item, sum(c * (c - 1)) AS a FROM k GROUP BY 1, 2), o AS (SELECT n, count(*) AS items, sum(a)::DOUBLE / (count(*) * n * (n - 1)) AS po FROM i GROUP BY n),
  p AS (SELECT n, label, sum(c)::DOUBLE AS c FROM k GROUP BY 1, 2), e AS (SELECT n, sum(q * q) AS pe FROM (SELECT n, c / sum(c) OVER (PARTITION BY n) AS q FROM p) GROUP BY n)
  SELECT n::BIGINT AS raters, items, {r_('(po - pe) / (1 - pe)', 6)} AS kappa FROM o JOIN e USING (n)""")
def fleiss_kappa(spark, sf):
    return E.fleiss_kappa(votes(spark, sf), "item", "label")


@query(f"""WITH {VOTES}, c AS (SELECT item, label, count(*) AS c FROM v GROUP BY 1, 2), m AS (SELECT *, max(c) OVER (PARTITION BY item) AS m FROM c)
  SELECT item, sum(c)::BIGINT AS votes, CASE WHEN count(*) FILTER (WHERE c = m) > 1 THEN 'tie' ELSE min(label) FILTER (WHERE c = m) END AS majority FROM m GROUP BY 1""")
def panel_majority(spark, sf):
    return E.majority(votes(spark, sf), "item", "label")


@query(f"WITH {VOTES}, k AS (SELECT item, count(DISTINCT label) AS k FROM v GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS items, {r_('avg((k = 1)::INTEGER)')} AS agreement FROM k")
def raw_agreement(spark, sf):
    return E.raw_agreement(votes(spark, sf), "item", "label")


@query(f"""WITH {EV}, d AS (SELECT count(*) FILTER (WHERE (score >= 0.5)::INTEGER = y AND (value >= 50)::INTEGER <> y) AS b, count(*) FILTER (WHERE (score >= 0.5)::INTEGER <> y AND (value >= 50)::INTEGER = y) AS c FROM ev)
  SELECT b, c, {r_('pow(abs(b - c) - 1, 2) / (b + c)', 6)} AS chi2 FROM d""")
def mcnemar_counts(spark, sf):
    rows = events(spark, sf).withColumns({"p1": (F.col("score") >= 0.5).cast("int"), "p2": (F.col("value") >= 50).cast("int")})
    return E.mcnemar(rows, "y", "p1", "p2")


@query("""WITH t AS (SELECT event_type AS test, floor(avg(value) * 10) / 100000 AS p FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM t)
  SELECT test, p, max(least(1, p * (m - r + 1))) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS adjusted FROM r""")
def holm(spark, sf):
    tests = read(spark, sf, "events").groupBy(F.col("event_type").alias("test")).agg((F.floor(F.avg("value") * 10) / 100000.0).alias("p"))
    return E.holm(tests)


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 4 AS hand FROM orders""")
def round_robin(spark, sf):
    return K.round_robin(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 4).select("o_orderkey", F.col("hand").cast("long").alias("hand"))


DECILES = ", ".join(f"quantile_cont(n_chars, {k / 10})" for k in range(1, 10))


@query(f"""WITH q AS (SELECT [{DECILES}] AS e FROM documents WHERE lang = 'en')
  SELECT doc_id, len(list_filter(q.e, lambda x: n_chars >= x))::INTEGER AS bin FROM documents, q WHERE lang = 'de'""")
def length_bins(spark, sf):
    rows = read(spark, sf, "documents")
    return K.length_bins(rows.filter("lang = 'de'").select("doc_id", "n_chars"), "n_chars", rows.filter("lang = 'en'")).select("doc_id", "bin")


@query(f"""WITH n AS (SELECT doc_id, len(list_filter(string_split_regex(text, '{WHITE_SQL}+'), lambda x: x <> '')) AS n FROM documents),
  a AS (SELECT doc_id, n, CASE WHEN n <= 126 THEN [0] ELSE range(0, n, 64) END AS s FROM n WHERE n > 0)
  SELECT doc_id, n::INTEGER AS n, w::INTEGER AS start, least(w + 126, n)::INTEGER AS "end" FROM (SELECT doc_id, n, unnest(s) AS w FROM a)""")
def sliding_windows(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", G.word_count(F.col("text")).alias("n"))
    return rows.select("doc_id", "n", F.explode(X.sliding_windows(F.col("n"))).alias("w")).select("doc_id", "n", "w.start", "w.end")


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1996-02-29'""")
def date_range(spark, sf):
    rows = A.ranged(read(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate").cast("string")), "d", "1995-03-01", "1996-02-29")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query(f"""SELECT n_name AS facet, count(*) AS n, sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::BIGINT AS flagged, {r_('sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END)::DOUBLE / count(*)')} AS rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def star_schema_density(spark, sf):
    li, o, c, n = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.select("l_orderkey", "l_discount").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(S.flagged(F.col("l_discount"), 0.05)).alias("flagged"))
    named = counts.join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("facet"), "n", "flagged", S.rounded(S.rate(F.col("flagged"), F.col("n"))).alias("rate"))


@query("""SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1""")
def latest_turn(spark, sf):
    return R.latest(read(spark, sf, "conversations"), ["conv_id"], ["turn"])


@query(f"""WITH k AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT event_type AS axis, count(k) AS n, {r_('avg(k)')} AS mean FROM k GROUP BY 1""")
def axis_means(spark, sf):
    rows = read(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy(F.col("event_type").alias("axis")).agg(F.count("k").alias("n"), S.rounded(F.avg("k")).alias("mean"))


@query("""WITH g AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
  SELECT user_id, count(*) AS events, quantile_cont(CASE WHEN gap <= 600 THEN gap END, 0.5)::DOUBLE AS median_gap, count(*) FILTER (WHERE gap > 600) + 1 AS sessions FROM g GROUP BY 1""")
def session_gaps(spark, sf):
    return E.session_gaps(read(spark, sf, "events"), "user_id", "ts")


@query("""WITH f AS (SELECT event_type AS key, count(*) AS n, floor(avg(value) * 1e4 + 0.5) / 1e4 AS rate FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1), g AS (SELECT event_type AS key, count(*) AS n, floor(avg(value) * 1e4 + 0.5) / 1e4 AS rate FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
  a AS (SELECT *, row_number() OVER (ORDER BY rate DESC, n DESC, key) AS rank FROM f), b AS (SELECT key, row_number() OVER (ORDER BY rate DESC, n DESC, key) AS previous FROM g)
  SELECT key, n, rate, rank::INTEGER AS rank, coalesce(previous, rank)::INTEGER AS previous, (coalesce(previous, rank) - rank)::INTEGER AS change FROM a LEFT JOIN b USING (key)""")
def rank_change(spark, sf):
    half = lambda late: read(spark, sf, "events").filter((F.col("ts") >= F.lit("2024-01-16").cast("timestamp")) == late).groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"), S.rounded(F.avg("value")).alias("rate"))
    return A.rank_change(half(True), half(False))


@query(f"""WITH {EV} SELECT event_id, {r_('1 / (1 + exp(-ln(p / (1 - p)) / 1.7))', 6)} AS tempered FROM (SELECT event_id, least(greatest(score, 0.01), 0.99) AS p FROM ev)""")
def tempered_scores(spark, sf):
    p = F.least(F.greatest("score", F.lit(0.01)), F.lit(0.99))
    return events(spark, sf).select("event_id", S.rounded(S.tempered(p, 1.7), 6).alias("tempered"))


@query()
def exact_sample(spark, sf):
    return K.exact_sample(read(spark, sf, "orders"), 100, "o_orderkey", 42)


@query("""SELECT user_id, event_id, nth::INTEGER AS nth, standing FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth, lead(1) OVER (PARTITION BY user_id, event_type ORDER BY event_id) IS NULL AS standing FROM events)""")
def audit_trail(spark, sf):
    return R.audit(read(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_id", "nth", "standing")
