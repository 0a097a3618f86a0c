"""Masks with their sources and scores by windows, against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportforge import constants as C
from reportforge.functions import evidence as V
from reportforge.functions import text as X
from reportforge.operators import scoring as Z
from reportforge.streaming.ingest import enrich

TEXTS = [
    "", None, "nothing here", "Worker died.", "He was killed,  injured and fractured  \n hospitalized today", "injured", "died died died", "😀 severe  injuries é fatal",
    "Before noon on site, the crew was hospitalized; two died, badly.", "x " * 300 + "killed by a crane" + " y" * 40, "tail died ",
]


def plain_mask(text, most=None):
    """Masked text, and for each of its characters the source span it stands for."""
    out, sources, at = "", [], 0
    runs = []
    for m in re.finditer(X.ANY_OUTCOME.replace("(?iU)", "(?i)"), text):
        if runs and m.start() > runs[-1][1] and text[runs[-1][1] : m.start()].isspace():
            runs[-1][1] = m.end()
        else:
            runs.append([m.start(), m.end()])
    for a, b in [*runs, [len(text), len(text)]]:
        out += text[at:a]
        sources += [(i, i + 1) for i in range(at, a)]
        if b > a:
            out += C.MASK_TOKEN
            sources += [(a, b)] * len(C.MASK_TOKEN)
        at = b
    return out[:most], sources[:most]


@pytest.mark.parametrize("most", [None, 20])
def test_masks_lead_back_to_their_source(spark, most):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").withColumn("m", X.mask_with_source(F.col("t"), most=most))
    spots = rows.withColumn("i", F.explode_outer(F.sequence(F.lit(0), F.length("m.masked")))).withColumn("j", F.explode_outer(F.array(F.col("i") + 1, F.col("i") + 4, F.length("m.masked"))))
    for r in spots.select("id", "t", "m", "i", "j", X.to_source(F.col("m.source"), F.col("i"), F.col("j")).alias("s")).collect():
        masked, sources = plain_mask(r.t or "", most)
        assert r.m.masked == masked
        if r.i < r.j <= len(masked):
            assert tuple(r.s) == (sources[r.i][0], sources[r.j - 1][1])
        elif r.i >= len(masked):
            assert r.s is None


def test_mask_agrees_with_the_plain_one(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    assert all(a == b for a, b in rows.select(X.mask_text(F.col("t")), X.mask_with_source(F.col("t"))["masked"]).collect())


def test_cue_spans(spark):
    said = "Lockout was missing; the crane hoist burst. A blowout near the crane after a flash of sparks, loto, torch"
    want = sorted(m.span() for ps in C.SPAN_CUES.values() for p in ps for m in re.finditer("(?i)" + p, said))[:5]
    row = spark.createDataFrame([(said,), ("none",), (None,)], "t string").select(X.cue_spans(F.col("t")).alias("s")).collect()
    assert [(s.start, s.end) for s in row[0].s] == want and all(said[s.start : s.end] == s.text for s in row[0].s)
    assert row[1].s == [] and row[2].s == []


def plain_prediction(variants, text, sources, scorer):
    """The ensemble, token by token."""
    best, chunked = [], 0
    for k, v in enumerate(variants):
        spans = [m.span() for m in re.finditer(scorer.token, v)]
        starts = [0] if len(spans) <= scorer.width else list(range(0, len(spans), scorer.stride))
        cuts = [spans[i : i + scorer.width] for i in starts]
        chunked = max(chunked, len(cuts))
        heads = [Z.hash_heads([[v[a:b] for a, b in c]]) for c in cuts]
        best.append(max(float(h[0][0]) for h in heads))
        if k == 0:
            rules = np.max([h[1][0] for h in heads], 0)
            found = []
            for c, h in zip(cuts, heads, strict=True):
                run = []
                for j, p in enumerate(h[2][0]):
                    if p <= scorer.evidence:
                        continue
                    if run and (j == run[-1] + 1 or (c[j][0] - c[run[-1]][1] <= 3 and not re.search("[A-Za-z]", v[c[run[-1]][1] : c[j][0]]))):
                        run.append(j)
                    else:
                        found, run = found + ([(run, c, h[2][0])] if run else []), [j]
                found += [(run, c, h[2][0])] if run else []
            placed = []
            for run, c, p in found:
                a, b, score = c[run[0]][0], c[run[-1]][1], float(np.mean(p[run[0] : run[-1] + 1]))
                said = v[a:b].strip()
                words = re.findall("[a-z]+", said.lower())
                if len(said) >= 3 and re.search("[A-Za-z]", said) and not (words and all(w in C.SPAN_STOPWORDS for w in words)):
                    placed.append((-score, sources[a][0], sources[b - 1][1]))
            kept = []
            for _, a, b in sorted(placed):
                if len(kept) < 3 and not any(a >= x and b <= y for x, y in kept):
                    kept.append((a, b))
    mean = np.mean(best)
    return float(mean), float(np.std(best)), np.mean([(s >= scorer.flag) == (mean >= scorer.flag) for s in best]), chunked, rules, kept


def test_ensemble_against_plain_python(spark):
    rng = np.random.default_rng(3)
    pool = ["alpha", "Bravo,", "the", "of", "x", "died", "killed", "crane", "12", "é", "off-shore;", "end.", "and"]
    texts = [" ".join(rng.choice(pool, int(n))) for n in [1, 3, 8, 20, 60, 11, 12, 200]] + ["Before noon on site, the crew was hospitalized; two died, badly."]
    scorer = Z.Scorer(width=11, stride=5, batch=7)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("prediction", F.lit("clash"))
    rows = Z.classified(rows, scorer).withColumn("variants", V.surface_variants(X.mask_with_source(F.col("text"))["masked"]))
    for r in rows.collect():
        p = r.prediction
        masked, sources = plain_mask(texts[r.id])
        assert r.variants[0] == masked
        mean, spread, stable, chunked, rules, spans = plain_prediction(r.variants, texts[r.id], sources, scorer)
        assert (p.score, p.spread, p.stability) == pytest.approx((mean, spread, stable), abs=6e-5)
        assert p.windows == chunked and p.chunked == (chunked > 1) and p.n_variants == 4
        assert [p.rules[k] for k in C.RULE_HEADS] == pytest.approx(list(rules), abs=6e-5)
        assert all(texts[r.id][s.start : s.end] == s.text for s in p.spans)
        if spans:
            assert [(s.start, s.end) for s in p.spans] == spans


def test_texts_without_tokens_and_cues(spark):
    def silent(windows):
        return np.full(len(windows), 0.7), np.zeros((len(windows), 7)), [np.zeros(len(w)) for w in windows]

    rows = spark.createDataFrame([(None,), ("",), ("A blowout while the crane lifts",)], "text string")
    got = [r.prediction for r in Z.classified(rows, Z.Scorer(heads=silent)).collect()]
    assert [(p.score, p.windows, p.band, len(p.spans)) for p in got] == [(0.7, 1, "HIGH", 0), (0.7, 1, "HIGH", 0), (0.7, 1, "HIGH", 1)]
    assert got[2].spans[0].text == "crane" and got[2].well_control


def test_ingest_takes_the_windows(spark):
    low = lambda windows: (np.full(len(windows), 0.1), np.zeros((len(windows), 7)), [np.zeros(len(w)) for w in windows])
    rows = spark.createDataFrame([("a", "word " * 125), ("b", "word " * 127)], "content_hash string, text string")
    got = {r.content_hash: r for r in enrich(rows, Z.Scorer(heads=low)).collect()}
    chunk = {k: next(g.triggered for g in r.gates if g.name == "chunked_low_score") for k, r in got.items()}
    assert chunk == {"a": False, "b": True} and got["b"].windows == 2 and got["a"].n_variants == 4


def test_places_are_looked_up_for_the_first_variant_only():
    """Each variant's tokens are found once; places in the text serve evidence, which is the first one's."""
    import re

    class Token:
        groups, pattern, asked = 0, re.compile(Z.Scorer().token), 0

        def findall(self, text):
            return self.pattern.findall(text)

        def finditer(self, text):
            self.asked += 1
            return self.pattern.finditer(text)

    token, row = Token(), [" ".join(f"{s}{k}" for k in range(200)) for s in "abcd"]
    got = Z.pooled([row, ["b1 - b2", "b1 - b2"]], Z.Scorer(), token)
    assert token.asked == 2 and got[0]["windows"] == [4] * 4 and len(got[0]["scores"]) == 4
    heads = Z.hash_heads([row[0].split()[:126]])
    assert heads[0].shape == (1,) and heads[1].shape == (1, len(Z.C.RULE_HEADS)) and heads[2][0].shape == (126,)
    hot = Z.hot_runs("aa b - cc dd", [(0, 2), (3, 4), (5, 6), (7, 9), (10, 12)], np.array([0.9, 0.1, 0.8, 0.7, 0.2]), 0.5)
    assert hot == [(0.9, 0, 2), (0.75, 5, 9)]
