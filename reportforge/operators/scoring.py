"""Scores of texts by windows: an ensemble of rephrasings, each cut into windows, put together again with evidence.

A scorer is a function of windows of tokens; everything around it is columns. All windows of the texts of a batch go
through it together, each distinct text once, windows of like lengths side by side.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.evidence import surface_variants, usable_spans, variant_stats
from ..functions.scalars import band, let, rounded
from ..functions.text import cue_spans, mask_with_source, to_source, valid_spans, well_control

#: Of windows of tokens: a score each, a probability of each rule, and each token's probability of being evidence.
Heads = Callable[[list[list[str]]], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]

#: Characters of the texts whose windows go through a scorer together.
TOGETHER = 1 << 20
LETTER = re.compile("[A-Za-z]")


def share(d: bytes) -> float:
    """The first 28 bits of a digest as a part of one."""
    return (int.from_bytes(d[:4], "big") >> 4) / 16**7


@functools.lru_cache(100_000)
def token_share(said: str) -> float:
    return share(hashlib.md5(said.encode()).digest())


def hash_heads(windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A stand-in for a model: numbers of 0..1 that depend on a window's tokens alone."""
    of = [hashlib.md5(" ".join(w).encode()).digest() for w in windows]
    rules = np.frombuffer(b"".join(d[4 : 4 + len(C.RULE_HEADS)] for d in of), np.uint8).reshape(len(of), -1) / 255
    return np.array([share(d) for d in of]), rules, [np.fromiter(map(token_share, w), np.float64, len(w)) for w in windows]


@dataclass(frozen=True)
class Scorer:
    """A scorer, how its windows are cut, and where its verdicts lie."""

    heads: Heads = hash_heads
    rules: tuple[str, ...] = tuple(C.RULE_HEADS)
    token: str = r"[^\x20\x09-\x0D]+"
    width: int = 126
    stride: int = 64
    batch: int = 256
    variants: int = 4
    evidence: float = 0.5
    flag: float = C.FLAG
    gray_low: float = C.GRAY_LOW


def windows(n: int, width: int, stride: int) -> list[tuple[int, int]]:
    """(start, end) of windows over n tokens: one if they fit, else one from every stride on."""
    return [(0, n)] if n <= width else [(i, min(i + width, n)) for i in range(0, n, stride)]


def hot_runs(text: str, offsets: list[tuple[int, int]], p: np.ndarray, over: float) -> list[tuple[float, int, int]]:
    """(mean, start, end) of runs of tokens over a probability; gaps of up to three signs without a letter are bridged."""
    runs: list[list[int]] = []
    for j in np.flatnonzero(p > over).tolist():
        begin, end = offsets[j]
        if begin >= end:
            continue
        if runs:
            last = runs[-1][1]
            if last == j - 1 or begin - offsets[last][1] <= 3 and not LETTER.search(text, offsets[last][1], begin):
                runs[-1][1] = j
                continue
        runs.append([j, j])
    told = p.tolist()
    # Two numbers have one sum, whichever way they are added.
    mean = lambda i, j: sum(told[i : j + 1]) / (j + 1 - i) if j - i < 2 else float(p[i : j + 1].mean())
    return [(mean(i, j), offsets[i][0], offsets[j][1]) for i, j in runs]


def pooled(rows: list[list[str]], scorer: Scorer, token: re.Pattern) -> list[dict]:
    """Per row: each variant's greatest score and number of windows; rules and evidence of the first variant."""
    texts = list(dict.fromkeys(v for row in rows for v in row))
    place, first = {t: k for k, t in enumerate(texts)}, {row[0] for row in rows if row}
    tokens = [[m.group() for m in token.finditer(t)] if token.groups else token.findall(t) for t in texts]
    offsets = {k: [m.span() for m in token.finditer(t)] for k, t in enumerate(texts) if t in first}  # evidence is the first variant's
    cut = sorted(((k, a, b) for k, o in enumerate(tokens) for a, b in windows(len(o), scorer.width, scorer.stride)), key=lambda x: x[2] - x[1])
    best, many = np.full(len(texts), -np.inf), np.bincount([k for k, _, _ in cut], minlength=len(texts))
    rules, spans = np.zeros((len(texts), len(scorer.rules))), [[] for _ in texts]
    for at in range(0, len(cut), scorer.batch):
        some = cut[at : at + scorer.batch]
        score, rule, hot = scorer.heads([tokens[k][a:b] for k, a, b in some])
        of = [k for k, _, _ in some]
        np.maximum.at(best, of, score)
        np.maximum.at(rules, of, rule)
        for (k, a, b), p in zip(some, hot, strict=True):
            if k in offsets:
                spans[k] += [(s, i, j, a) for s, i, j in hot_runs(texts[k], offsets[k][a:b], p, scorer.evidence)]
    own = lambda k: [{"score": s, "start": i, "end": j} for s, i, j, _ in sorted(spans[k], key=lambda x: (x[3], x[1]))]
    return [{"scores": [float(best[place[v]]) for v in row], "windows": [int(many[place[v]]) for v in row], "rules": rules[place[row[0]]].tolist(), "spans": own(place[row[0]])} for row in rows]


def window_scores(variants: Column, scorer: Scorer) -> Column:
    """(scores, windows, rules, spans) of an array of texts, none null and at least one; spans in the first text's places."""
    token = re.compile(scorer.token)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held, size = [], [], 0
            for row in batch:
                held.append(list(row))
                size += sum(map(len, row))
                if size >= TOGETHER:
                    out, held, size = out + pooled(held, scorer, token), [], 0
            yield pd.DataFrame(out + pooled(held, scorer, token), columns=["scores", "windows", "rules", "spans"])

    kind = "scores array<double>, windows array<int>, rules array<double>, spans array<struct<score:double,start:int,end:int>>"
    # Marked so that the optimiser leaves it in a projection of its own: it can be moved into a lambda otherwise, where no Python runs.
    return F.pandas_udf(score, kind).asNondeterministic()(variants)


def evidence_spans(text: Column, masked: Column, spans: Column, most: int = 3) -> Column:
    """(start, end, text) of what speaks for a verdict, in the source text: the best usable spans of a masked text, else cues.

    Spans are taken by falling score, then start; one within another that was taken is passed over. Once `most` are found
    no more are looked at.
    """
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s["score"]).alias("m"), s["start"].alias("start"), s["end"].alias("end"))))
    kind = "array<struct<start:int,end:int>>"

    def step(kept: Column, s: Column) -> Column:
        usable = usable_spans(masked["masked"], F.array(F.struct((-s["m"]).alias("score"), s["start"].alias("start"), s["end"].alias("end"))))
        within = lambda at: F.exists(kept, lambda k: (at["start"] >= k["start"]) & (at["end"] <= k["end"]))
        taken = lambda at: F.when(at.isNull() | within(at), kept).otherwise(F.concat(kept, F.array(at)))
        found = let(usable, lambda u: F.when(F.size(u) == 0, kept).otherwise(let(F.get(u, 0), lambda x: let(to_source(masked["source"], x["start"], x["end"]), taken))))
        return F.when(F.size(kept) >= most, kept).otherwise(found)

    said = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"))
    best = F.aggregate(ranked, F.array().cast(kind), step)
    return let(best, lambda found: F.when(F.size(found) == 0, F.slice(cue_spans(text), 1, most)).otherwise(valid_spans(text, F.transform(found, said))))


def classified(rows: DataFrame, scorer: Scorer | None = None, text: str = "text", most: int | None = None, name: str = "prediction", patterns: list[str] | None = None) -> DataFrame:
    """`rows` with a struct `name`: score, spread, stability, n_variants, variant_scores, band, windows, chunked, rules,
    well_control, spans, flag, gray_low.

    Outcome words are masked (or what `patterns` match), and the masked text cut to `most` characters if that is given.
    The masked text and its fixed rephrasings are scored by windows, each by its greatest one; a rephrasing that changes
    nothing counts again. score is their mean, spread their deviation, stability the share that agrees with the mean's
    verdict; windows is the most that one took. Rules and spans are those of the masked text itself; spans lie in the
    source text. A null or empty text is one empty window.
    """
    scorer, said = scorer or Scorer(), F.coalesce(F.col(text), F.lit(""))
    out = rows.withColumn("__m", mask_with_source(said, patterns, most))
    out = out.withColumn("__h", window_scores(surface_variants(F.col("__m.masked"), scorer.variants), scorer))
    four = lambda c: rounded(c)

    def told(h: Column, v: Column) -> Column:
        score = four(v["mean"])
        return F.struct(
            score.alias("score"), four(v["spread"]).alias("spread"), four(v["stability"]).alias("stability"), F.size(h["scores"]).alias("n_variants"), F.transform(h["scores"], four).alias("variant_scores"),
            band(score, scorer.flag, scorer.gray_low).alias("band"), F.array_max(h["windows"]).alias("windows"), (F.array_max(h["windows"]) > 1).alias("chunked"),
            F.map_from_arrays(F.array(*map(F.lit, scorer.rules)), F.transform(h["rules"], four)).alias("rules"), well_control(said).alias("well_control"),
            evidence_spans(said, F.col("__m"), h["spans"]).alias("spans"), F.lit(scorer.flag).alias("flag"), F.lit(scorer.gray_low).alias("gray_low"),
        )

    return out.withColumn(name, let(F.col("__h"), lambda h: let(variant_stats(h["scores"], scorer.flag), lambda v: told(h, v)))).drop("__m", "__h")
