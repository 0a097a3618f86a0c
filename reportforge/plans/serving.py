"""Queries of what serves reports: masked texts with their sources, scores by windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import checks as K
from ..operators import detector as D
from ..operators import evaluate as E
from ..operators import mining as G
from ..operators import scoring as Z
from ..operators import thresholds as P
from .bindings import WHITE_SQL, query, r_, read

# Parts of invented words stand for outcome words, which no table holds.
STAND_INS = ["[a-z]*ing[a-z]*", "[a-z]*tion[a-z]*"]


@query(rf"""WITH m AS (
    SELECT doc_id, text, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)({"|".join(STAND_INS)})', chr(1) || '\1' || chr(2), 'g'), chr(2) || '(\s+)' || chr(1), '\1', 'g'), chr(1)) AS pieces FROM documents
  ), p AS (SELECT doc_id, text, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM m),
  q AS (SELECT doc_id, text, k, CASE WHEN k > 1 THEN split_part(piece, chr(2), 1) ELSE '' END AS run, CASE WHEN k > 1 THEN split_part(piece, chr(2), 2) ELSE piece END AS rest FROM p),
  r AS (
    SELECT *, coalesce(sum(length(run) + length(rest)) OVER w, 0) AS src, coalesce(sum((k > 1)::INTEGER * 9 + length(rest)) OVER w, 0) AS place, regexp_extract(rest, '^ [a-z]+') AS tail
    FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  )
  SELECT doc_id, place::INTEGER AS masked_start, src::INTEGER AS start, (src + length(run) + length(tail))::INTEGER AS "end", substr(text, (src + 1)::BIGINT, (length(run) + length(tail))::BIGINT) AS said FROM r WHERE k > 1 AND tail <> ''""")
def masked_source_spans(spark, sf):
    masked = read(spark, sf, "documents").select("doc_id", "text", X.mask_with_source(F.col("text"), STAND_INS).alias("m"))
    found = masked.select("doc_id", "text", "m", F.explode(X.find_spans(F.col("m.masked"), r"\[OUTCOME\] [a-z]+")).alias("s"))
    placed = found.select("doc_id", "text", F.col("s.start").alias("masked_start"), X.to_source(F.col("m.source"), F.col("s.start"), F.col("s.end")).alias("at"))
    return placed.select("doc_id", "masked_start", "at.start", "at.end", F.substring("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")).alias("said"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  c AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 126 THEN [0] ELSE range(0, len(w), 64) END) AS i FROM w),
  h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 126], ' ')) AS h FROM c)
  SELECT doc_id, count(*)::INTEGER AS windows, count(*) > 1 AS chunked, {r_("max(('0x' || substr(h, 1, 7))::BIGINT / 268435456.0::DOUBLE)")} AS score,
    {r_("max(('0x' || substr(h, 9, 2))::BIGINT / 255.0::DOUBLE)")} AS line_of_fire FROM h GROUP BY doc_id""")
def score_windows(spark, sf):
    rows = Z.classified(read(spark, sf, "documents").select("doc_id", "text"), Z.Scorer(variants=1))
    p = F.col("prediction")
    return rows.select("doc_id", p["windows"].alias("windows"), p["chunked"].alias("chunked"), p["score"].alias("score"), p["rules"]["line_of_fire"].alias("line_of_fire"))


@query()
def ensemble_scores(spark, sf):
    """Four rephrasings a text, with evidence in the source text; held to plain Python in tests."""
    rows = Z.classified(read(spark, sf, "documents").select("doc_id", "text"), patterns=STAND_INS)
    said = F.col("prediction")
    cited = F.array_join(F.transform(said["spans"], lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")
    return rows.select("doc_id", *[said[c].alias(c) for c in ("score", "spread", "stability", "n_variants", "band", "windows", "chunked")], cited.alias("spans"))


def two_pools(spark, sf):
    """Documents that labels call good stand for real texts, the others for generated ones."""
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality")
    return docs.filter("quality = 1"), docs.filter("quality = 0")


@query()
def detector_scores(spark, sf):
    """Each labelled document's score by the model of nine folds that did not see it; held to a plain fit in tests."""
    real, made = two_pools(spark, sf)
    rows = real.unionByName(made).withColumn("made", 1 - F.col("quality"))
    return D.detect(rows, "doc_id", "text", "made").scores.select(F.col("id").alias("doc_id"), "y", "fold", F.round("p", 6).alias("p"))


@query()
def detector_report(spark, sf):
    """How far a detector tells generated documents apart, before and after the most telling quarter is dropped."""
    kept, told = D.screened(*two_pools(spark, sf), "doc_id", "text")
    row = [told[c] for c in ("n_real", "n_made", "auc", "dropped", "auc_after", "verdict")] + [kept.count(), [f"{t} ({v:+.3f})" for t, v in told["features"]]]
    return spark.createDataFrame([row], "n_real long, n_made long, auc double, dropped long, auc_after double, verdict string, kept long, features array<string>")


PAIRS = """d AS (SELECT doc_id AS id, text, source, lang FROM documents JOIN (SELECT vec_id FROM embeddings) ON vec_id = doc_id),
  f AS (SELECT text, min(id) AS a FROM d WHERE text IS NOT NULL GROUP BY text),
  g AS (SELECT source, lang, min(id) AS id FROM d WHERE source <> '' AND lang IS NOT NULL GROUP BY ALL),
  l AS (SELECT source, min((id, lang)) AS x FROM g GROUP BY source),
  n AS (SELECT id, text, (row_number() OVER (ORDER BY md5('42:' || id), id) - 1) // 2 AS pair FROM d),
  pairs AS (
    SELECT 'duplicate' AS kind, a, id AS b FROM d JOIN f USING (text) WHERE a < id
    UNION ALL SELECT 'template', least(any_value(x[1]), min(id)), greatest(any_value(x[1]), min(id)) FROM g JOIN l USING (source) WHERE lang <> x[2] GROUP BY source
    UNION ALL SELECT 'random', min(id), max(id) FROM n GROUP BY pair HAVING count(*) = 2 AND min(text) <> max(text)
  ), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
  cosines AS (SELECT kind, a, b, list_dot_product(p.v, q.v) / (sqrt(list_dot_product(p.v, p.v)) * sqrt(list_dot_product(q.v, q.v))) AS cosine FROM pairs JOIN v p ON p.vec_id = a JOIN v q ON q.vec_id = b)"""


def kinds_of_pairs(spark, sf):
    vectors = read(spark, sf, "embeddings")
    rows = read(spark, sf, "documents").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id")
    kinds = {"duplicate": P.duplicate_pairs(rows, "doc_id", "text"), "template": P.template_pairs(rows, "doc_id", "source", "lang"), "random": P.random_pairs(rows, "doc_id", "text")}
    return {k: P.pair_cosines(p, vectors, "vec_id", "embedding").withColumn("kind", F.lit(k)) for k, p in kinds.items()}


@query(f"WITH {PAIRS} SELECT kind, a, b, {r_('cosine', 6)} AS cosine FROM cosines")
def pair_cosines(spark, sf):
    k = kinds_of_pairs(spark, sf)
    return k["duplicate"].unionByName(k["template"]).unionByName(k["random"]).select("kind", "a", "b", S.rounded(F.col("cosine"), 6).alias("cosine"))


@query(f"""WITH {PAIRS}, grid AS (SELECT (k / 100.0)::DOUBLE AS threshold FROM range(0, 100, 5) t(k)),
  c AS (SELECT threshold, sum((kind = 'template' AND cosine >= threshold)::INTEGER) AS tp, sum((kind = 'random' AND cosine >= threshold)::INTEGER) AS fp,
    sum((kind = 'template' AND cosine < threshold)::INTEGER) AS fn, sum((kind = 'random' AND cosine < threshold)::INTEGER) AS tn FROM cosines, grid WHERE kind <> 'duplicate' GROUP BY threshold)
  SELECT threshold, {r_('tp::DOUBLE / (tp + fn)')} AS recall, {r_('fp::DOUBLE / (fp + tn)')} AS fpr, {r_('2.0 * tp / (2 * tp + fp + fn)')} AS f1 FROM c""")
def pair_thresholds(spark, sf):
    """Pairs of one source stand for the duplicates here: copies of a text have vectors of their own in these tables."""
    k = kinds_of_pairs(spark, sf)
    return P.measured(k["template"], k["random"], [k / 100 for k in range(0, 100, 5)])


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"meta":{"lang":"' || lang || '","n_chars":' || n_chars || '},"source":"' || source || '"}') AS payload FROM documents""")
def payload_hashes(spark, sf):
    named = lambda *cs: F.struct(*[F.col(c).alias(c) for c in cs])
    meta = read(spark, sf, "documents").select("doc_id", "source", named("n_chars", "lang").alias("meta"))
    return meta.select("doc_id", S.payload_hash(F.to_json(named("source", "meta", "doc_id"))).alias("payload"))


@query()
def second_labels(spark, sf):
    """Second labelers of documents whose first ones (by language) are uneven; how even they come out is tested."""
    rows = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("labeler"))
    return G.assigned(rows, "doc_id", F.xxhash64("doc_id") % 4 == 0, ["en", "de", "fr", "es"], 7, first="labeler")


LABELLED = "l AS (SELECT vec_id AS id, (list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + 8) / 16 AS score, (quality = 0)::INTEGER AS y FROM embeddings JOIN labels ON doc_id = vec_id)"


def labelled(spark, sf):
    """A score from a document's vector against whether labels call it poor."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    scores = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), ((total + 8) / 16).alias("score"))
    return E.paired(read(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).cast("int").alias("y")), scores, "id", "y", "score")


@query(f"""WITH {LABELLED}, t AS (SELECT DISTINCT score AS threshold FROM l),
  c AS (SELECT threshold, sum((score >= threshold AND y = 1)::INTEGER) AS tp, sum((score >= threshold AND y = 0)::INTEGER) AS fp, sum(y) AS p FROM l, t GROUP BY threshold),
  n AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall, row_number() OVER (ORDER BY threshold) - 1 AS i, greatest(1, count(*) OVER () // 20) AS stride FROM c),
  f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM n WHERE i % stride = 0)
  SELECT {r_('threshold', 6)} AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, {r_('precision')} AS precision, {r_('recall')} AS recall, {r_('f1')} AS f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def strided_f1(spark, sf):
    best = E.strided_f1(E.pr_curve(labelled(spark, sf), "y", "score"), 20)
    return best.withColumn("threshold", S.rounded(F.col("threshold"), 6))


@query("""WITH t(held_by, id) AS (SELECT 'items', doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels UNION ALL SELECT 'scores', vec_id FROM embeddings),
  names AS (SELECT DISTINCT held_by FROM t), d AS (SELECT DISTINCT held_by, id FROM t)
  SELECT a.held_by, b.held_by AS missing_in, count(d.id) AS n, coalesce(min(d.id)::VARCHAR, '') AS first FROM names a JOIN names b ON a.held_by <> b.held_by
  LEFT JOIN d ON d.held_by = a.held_by AND NOT EXISTS (SELECT 1 FROM d x WHERE x.held_by = b.held_by AND x.id = d.id) GROUP BY ALL""")
def gold_orphans(spark, sf):
    ids = lambda t, c: read(spark, sf, t).select(F.col(c).alias("id"))
    return E.orphans({"items": ids("documents", "doc_id"), "labels": ids("labels", "doc_id"), "scores": ids("embeddings", "vec_id")}, "id").withColumn("first", F.coalesce(F.col("first").cast("string"), F.lit("")))


@query(f"""WITH t AS (SELECT doc_id, source, lang, trim(regexp_replace(text, '{WHITE_SQL}+', ' ', 'g'), ' ') AS t FROM documents)
  SELECT min(doc_id) AS doc_id FROM t WHERE source <> 'src0' GROUP BY t HAVING t NOT IN (SELECT t FROM t WHERE source = 'src0')""")
def unseen_texts(spark, sf):
    docs = read(spark, sf, "documents")
    return K.unseen_texts(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'"), "doc_id", "text")[0].select("doc_id")
