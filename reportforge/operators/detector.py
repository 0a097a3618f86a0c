"""A detector of generated text: how well a linear model tells two kinds of texts apart, by scores of rows it was not fitted on.

Words and pairs of words are weighed by TF-IDF; a logistic model is fitted for every fold, and one for all rows, side by
side: one pass over the rows gives the gradients of all of them. Only sums of gradients leave a pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import auc
from .mining import numbered
from .work import Work

#: Numbers of a gradient that are summed over tasks together.
CHUNK = 512
#: Bytes of words that are counted at a time.
SLICE = 1 << 22
WORD = r"(?U)\b\w\w+\b"


def said(text: Column) -> Column:
    """Lower-cased words of two signs or more, with a space between."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), " ")


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE bytes of a column of strings."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def counted(words: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, row, term, tf) of words, then of pairs of neighbours: how often a row of said() holds each of the terms."""
    split = pc.split_pattern(words, " ")
    flat, row = split.flatten().dictionary_encode(), pc.list_parent_indices(split).to_numpy()
    names, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    some = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code]  # an empty row is split into one empty word
    row, code = row[some], code[some]
    wide = max(1, len(names))
    beside = row[1:] == row[:-1]
    for key, at in ((code, row), ((code[:-1] * wide + code[1:])[beside], row[1:][beside])):
        kinds, term = np.unique(key, return_inverse=True)
        held, tf = np.unique(at * max(1, len(kinds)) + term, return_counts=True)
        one = key is code
        terms = names.take(pa.array(kinds)) if one else pc.binary_join_element_wise(names.take(pa.array(kinds // wide)), names.take(pa.array(kinds % wide)), " ")
        yield terms, held // max(1, len(kinds)), held % max(1, len(kinds)), tf


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, all, df): how often the rows of a batch hold each term, and how many of them do."""
    for batch in slices(batches, "words"):
        for terms, _, term, tf in counted(batch.column("words")):
            sums = [np.bincount(term, w, len(terms)).astype(np.int64) for w in (tf, None)]
            yield pa.RecordBatch.from_arrays([terms, *map(pa.array, sums)], ["term", "all", "df"])


def featured(rows: DataFrame, id_: str, text: str, label: str, most: int, folds: int, seed: int, work: Work) -> tuple[DataFrame, list[str]]:
    """(id, y, fold, at, x): each row's weights as a sparse unit vector; and the vocabulary.

    The vocabulary is the `most` commonest terms over all rows, ties by name; a weight is count * (1 + ln((1 + n) / (1 + df))).
    Folds are dealt within each label by a hash, so that they differ by one row at most. Texts are split once; what is
    shuffled are a batch's distinct terms and their numbers.
    """
    base = numbered(rows.select(F.col(id_).alias("id"), said(F.col(text)).alias("words"), F.col(label).cast("int").alias("y")), [F.col("y"), F.xxhash64(F.lit(seed), "id"), F.col("id")], "nth")
    base = work.write(base.select("id", "y", F.pmod("nth", F.lit(folds)).cast("int").alias("fold"), "words"))
    n = base.count()
    terms = base.select("words").mapInArrow(told, "term string, all long, df long").groupBy("term").agg(F.sum("all").alias("all"), F.sum("df").alias("df")).orderBy(F.desc("all"), "term").limit(most)
    kept = sorted((r["term"], r["idf"]) for r in terms.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect())
    names, idf = [t for t, _ in kept], np.array([x for _, x in kept])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            row, at, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for terms, r, term, tf in counted(batch.column("words")):
                place = pc.fill_null(pc.index_in(terms, pa.array(names, pa.string())), -1).to_numpy()[term]
                r, tf, place = r[place >= 0], tf[place >= 0], place[place >= 0]
                row, at, x = np.concatenate([row, r]), np.concatenate([at, place]), np.concatenate([x, tf * idf[place]])
            order = np.lexsort((at, row))
            row, at, x = row[order], at[order], x[order]
            x = x / np.sqrt(np.bincount(row, x * x, batch.num_rows))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "y", "fold")], *lists], ["id", "y", "fold", "at", "x"])

    kind = f"id {base.schema['id'].dataType.simpleString()}, y int, fold int, at array<int>, x array<double>"
    return work.write(base.mapInArrow(weighed, kind)), names


def margins(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, models) products of a batch with every model; and each stored weight's row, place and value."""
    at, x = batch.column("at"), batch.column("x")
    many = np.diff(at.offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), many)
    place, value = at.flatten().to_numpy(), x.flatten().to_numpy()
    z = np.tile(w[:, -1], (batch.num_rows, 1))
    for k in range(len(w)):
        z[:, k] += np.bincount(row, w[k, place] * value, batch.num_rows)
    return z, row, place, value


def gradients(data: DataFrame, w: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each model's summed loss and gradient over all rows but those of the fold that it must not see."""
    models, width = w.shape

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((models, width + 1))
        for batch in batches:
            z, row, place, value = margins(batch, w)
            y, fold = (batch.column(c).to_numpy() for c in ("y", "fold"))
            sees = unseen[None, :] != fold[:, None]
            out[:, width] += (sees * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
            off = sees * (1 / (1 + np.exp(-z)) - y[:, None])
            out[:, width - 1] += off.sum(0)
            for k in range(models):
                out[k, : width - 1] += np.bincount(place, off[row, k] * value, width - 1)
        flat = out.ravel()
        cut = range(0, len(flat), CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([flat[i : i + CHUNK].tobytes() for i in cut], pa.binary())], ["chunk", "part"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": parts["chunk"].iloc[:1], "part": [np.sum([np.frombuffer(p) for p in parts["part"]], 0).tobytes()]})

    kind = "chunk int, part binary"
    sums = data.select("y", "fold", "at", "x").mapInArrow(one, kind).groupBy("chunk").applyInPandas(added, kind).collect()  # models * (width + 1) numbers
    flat = np.concatenate([np.frombuffer(r["part"]) for r in sorted(sums, key=lambda r: r["chunk"])])
    told = flat.reshape(models, width + 1)
    return told[:, width], told[:, :width]


class Descent:
    """One model's way down by L-BFGS with halved steps; its values come from outside."""

    def __init__(self, width: int, kept: int = 10) -> None:
        self.w, self.f, self.g, self.past, self.step, self.way = np.zeros(width), np.inf, None, deque(maxlen=kept), 1.0, np.zeros(width)

    def trial(self) -> np.ndarray:
        return self.w + self.step * self.way

    def told(self, f: float, g: np.ndarray) -> None:
        if self.g is not None and f > self.f + 1e-4 * self.step * (self.g @ self.way):
            self.step /= 2
            return
        if self.g is not None:
            s, y = self.trial() - self.w, g - self.g
            if s @ y > 1e-12:
                self.past.append((s, y))
        self.w, self.f, self.g = self.trial(), f, g
        q, held = -g, []
        for s, y in reversed(self.past):
            held.append((s @ q) / (s @ y))
            q = q - held[-1] * y
        if self.past:
            s, y = self.past[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.past, reversed(held), strict=True):
            q = q + (a - (y @ q) / (s @ y)) * s
        self.way, self.step = q, 1.0 if self.past else min(1.0, 1 / max(np.abs(g).max(), 1e-12))

    def there(self, near: float) -> bool:
        return self.g is not None and np.abs(self.g).max() < near or self.step < 1e-10


def fitted(data: DataFrame, width: int, folds: int, c: float, rounds: int, near: float) -> np.ndarray:
    """(folds + 1, width + 1) weights, the intercept last: least c * loss + half the squared weights (not the intercept)."""
    ways = [Descent(width + 1) for _ in range(folds + 1)]
    for _ in range(rounds):
        on = [k for k, x in enumerate(ways) if not x.there(near)]  # the last model's number is no fold
        if not on:
            break
        w = np.array([ways[k].trial() for k in on])
        loss, grad = gradients(data, w, np.array(on))
        flat = np.hstack([w[:, :-1], np.zeros((len(w), 1))])
        for k, f, g, own in zip(on, loss, grad, flat, strict=True):
            ways[k].told(c * f + own @ own / 2, c * g + own)
    return np.array([x.w for x in ways])


@dataclass
class Detection:
    """scores: (id, y, fold, p), p by the model that did not see the row; auc of them; features: the strongest, best first."""

    scores: DataFrame
    auc: float | None
    features: list[tuple[str, float]]


def detect(rows: DataFrame, id_: str, text: str, label: str, folds: int = 10, most: int = 5000, c: float = 1.0, rounds: int = 200, near: float = 1e-4, top: int = 20, seed: int = 42) -> Detection:
    """Tell label 1 from label 0 by text. `label` holds 0 and 1; ids are unique.

    The vocabulary (`most` terms) and the models (folds + 1 of them) are what the driver holds, whatever the number of
    rows. Rows without a term get the intercept. Null and empty texts have none. With one label or no rows auc is None.
    """
    work = Work(rows.sparkSession, "detector")
    data, names = featured(rows, id_, text, label, most, folds, seed, work)
    w = fitted(data, len(names), folds, c, rounds, near)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = margins(batch, w)[0][np.arange(batch.num_rows), batch.column("fold").to_numpy()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("id", "y", "fold")], pa.array(1 / (1 + np.exp(-z)))], ["id", "y", "fold", "p"])

    scores = work.write(data.mapInArrow(score, f"id {data.schema['id'].dataType.simpleString()}, y int, fold int, p double"))
    both = scores.select("y").distinct().count() == 2
    area = auc(scores, "y", "p").first()["auc"] if both else None
    work.drop(keep=1)
    best = np.argsort(-w[-1, :-1], kind="stable")[:top]
    return Detection(scores, area, [(names[i], float(w[-1, i])) for i in best])


def quantile(rows: DataFrame, value: str, id_: str, q: float) -> float | None:
    """The exact quantile with linear interpolation, from rows numbered by ranges: no task holds more than a range."""
    n = rows.count()
    if not n:
        return None
    spot = (n - 1) * q
    low = int(spot)
    near = numbered(rows.select(value, id_), [F.col(value), F.col(id_)], "nth").filter(F.col("nth").isin(low, min(low + 1, n - 1))).orderBy("nth").collect()
    a, b = near[0][value], near[-1][value]
    return a + (b - a) * (spot - low)


def length_bin(length: Column, edges: list[int]) -> Column:
    """The tenth (0..9) that a length falls in, by eleven edges."""
    over = sum((F.when(length > e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.least(F.greatest(over - 1, F.lit(0)), F.lit(9))


def matched_sample(pool: DataFrame, like: DataFrame, id_: str, length: str, seed: int = 42) -> DataFrame:
    """Rows of `pool` of which each length tenth of `like` holds as many as `like` has there, or all there are; by a hash."""
    n = like.count()
    if not n:
        return pool.limit(0)
    ranked = numbered(like.select(F.col(length).alias("l")), [F.col("l")], "nth")
    want = sorted({int(k / 10 * (n - 1)) for k in range(11)})
    at = {r["nth"]: r["l"] for r in ranked.filter(F.col("nth").isin(want)).collect()}  # eleven rows
    edges = [at[int(k / 10 * (n - 1))] for k in range(11)]
    need = like.groupBy(length_bin(F.col(length), edges).alias("__bin")).agg(F.count("*").alias("__want"))
    dealt = numbered(pool.withColumn("__bin", length_bin(F.col(length), edges)), [F.col("__bin"), F.xxhash64(F.lit(seed), F.col(id_)), F.col(id_)], "__place")
    begins = dealt.groupBy("__bin").agg(F.min("__place").alias("__first"))
    bounds = F.broadcast(begins.join(need, "__bin"))  # ten rows
    return dealt.join(bounds, "__bin").filter(F.col("__place") - F.col("__first") < F.col("__want")).select(*pool.columns)


def screened(real: DataFrame, made: DataFrame, id_: str, text: str, gate: float = 0.9, **how) -> tuple[DataFrame, dict]:
    """The rows of `made` that stay, and a report. Where a detector reaches `gate`, the quarter that it finds most telling goes.

    The real rows are a length-matched sample of `real`. The rest is told from as many real rows once more.
    """
    seed = how.get("seed", 42)
    words = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    work = Work(real.sparkSession, "screened")
    slim = lambda df: work.write(df.select(F.col(id_).alias("id"), F.col(text).alias("t"), words.alias("l")))
    pool, made_ = slim(real), slim(made)
    sample = work.write(matched_sample(pool, made_, "id", "l", seed))
    both = lambda a, b: a.select("id", "t", F.lit(0).alias("y")).unionByName(b.select("id", "t", F.lit(1).alias("y"))).withColumn("id", F.concat(F.col("y").cast("string"), F.lit(":"), F.col("id").cast("string")))
    first = detect(both(sample, made_), "id", "t", "y", **how)
    report = {"n_real": sample.count(), "n_made": made_.count(), "auc": first.auc, "dropped": 0, "auc_after": None, "features": first.features if (first.auc or 0) >= gate else [], "verdict": "pass"}
    if (first.auc or 0) < gate:
        return made, report
    own = first.scores.filter("y = 1")
    cut = quantile(own, "p", "id", 0.75)
    stays = work.write(own.filter(F.col("p") < cut).select(F.expr("substring(id, 3)").alias("key")))
    left = work.write(made_.join(stays, F.col("id").cast("string") == F.col("key"), "left_semi"))
    n = left.count()
    again = numbered(sample, [F.xxhash64(F.lit(seed + 1), "id"), F.col("id")], "nth").filter(F.col("nth") < n).drop("nth")
    second = detect(both(again, left), "id", "t", "y", **how)
    report |= {"dropped": report["n_made"] - n, "auc_after": second.auc, "verdict": "pass after drop" if (second.auc or 0) < gate else "fail after drop"}
    return made.join(stays, F.col(id_).cast("string") == F.col("key"), "left_semi"), report
