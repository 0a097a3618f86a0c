"""Source divergence audit: how far the term shares of a source lie from those of other sources of its language.

Terms are counted in the tasks that read the texts, and only those counts move. Terms common enough in a language are
kept as postings: a row for each source that holds the term. Two searches run on them:

* The terms that set a source apart are found best first. A source's terms fall into buckets by their count; a bucket's
  largest count and the smallest share that its terms have in the language bound every difference in it. Buckets are
  opened by falling bounds until every bound left is strictly below the k-th difference found.
* Sources are compared pairwise by tiles of terms and sources, dense in one task, from which only sums leave.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, discard, staged, table

#: A kept term occurs in so many documents of its language at least.
MIN_DOCS = 30
#: Added to every count.
PRIOR = 5
SCALE = 1_000_000_000
#: Terms that are told apart for one source.
TOP = 50
#: Terms of a tile, and sources of each of its two sides.
SHARD, SIDE = 8192, 64
#: Counts that a task holds before it hands them on, and bytes of a text that it splits at a time.
HELD, PIECE = 400_000, 4 << 20
#: Best-first search opens buckets until they hold so many times more terms in each round.
WIDER = 8

#: Letters become small, bytes of other characters stay, all else parts terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DOC = 1 << 40


def terms_of(text: bytes) -> Counter[bytes]:
    """How often a text (UTF-8) holds each term; a long one is taken piece by piece."""
    flat, found, at = text.translate(_BYTES), Counter(), 0
    if len(flat) <= PIECE:
        return Counter(flat.split())
    while at < len(flat):
        end = flat.find(b" ", min(at + PIECE, len(flat)))
        end = len(flat) if end < 0 else end
        found.update(flat[at:end].split())
        at = end
    return found


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) for each task's share of `docs` (text, lang, source): occurrences and documents."""

    def flushed(held: dict) -> pa.RecordBatch:
        sizes = [len(x) for x in held.values()]
        both = np.fromiter((v for x in held.values() for v in x.values()), np.int64, sum(sizes))
        spread = lambda k: pa.array([key[k] for key in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        terms = pa.array([t for x in held.values() for t in x], pa.binary())
        return pa.RecordBatch.from_arrays([spread(0), spread(1), terms, pa.array(both & (_DOC - 1)), pa.array(both >> 40)], ["lang", "source", "term", "n", "d"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault((lang, source), {})
                keys -= len(own)
                for term, n in terms_of(text).items():
                    own[term] = own.get(term, 0) + n + _DOC
                keys += len(own)
                if keys >= HELD:
                    yield flushed(held)
                    held, keys = {}, 0
        if keys:
            yield flushed(held)

    bound_batches(docs.sparkSession)
    found = docs.select(*[F.col(c).cast("binary") for c in ("lang", "source", "text")]).mapInArrow(count, "lang binary, source binary, term binary, n long, d long")
    return found.withColumns({c: F.col(c).cast("string") for c in ("lang", "source", "term")})


def share(n: str, total: str, kept: str, scale: int = SCALE, prior: int = PRIOR) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * kept)) as a long, in exact decimals; 0 without kept terms."""
    whole = lambda x: f"cast({x} as decimal(19, 0))"
    return F.expr(f"if({kept} = 0, 0L, 1 + cast({scale} as decimal(10, 0)) * {whole(f'{n} + {prior}')} div {whole(f'{total} + {prior} * greatest({kept}, 1)')})")


def bucket(n: Column) -> Column:
    """The length of a count in bits and its four leading bits."""
    bits = F.length(F.bin(n))
    return bits * 16 + F.call_function("shiftright", n, F.greatest(bits - 4, F.lit(0))).cast("int")


def postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total, head): kept terms; total over the language, head on one row of each (lang, term).

    One exchange by (lang, term) carries the tasks' counts; sums by source and by language both need no other.
    """
    summed = partial_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of = W.partitionBy("lang", "term")
    marked = summed.withColumns({"total": F.sum("n").over(of), "docs": F.sum("d").over(of), "head": F.row_number().over(of.orderBy("source")) == 1})
    return marked.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "total", "head")


def grouped(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, idx, sum, kept, whole, zero): every occurring group, numbered in its language from 0.

    sum is the group's occurrences of kept terms, whole the language's, kept its terms, zero the share of a count of 0.
    """
    langs = held.groupBy("lang").agg(F.count_if("head").alias("kept"), F.sum("n").alias("whole"))
    sums = held.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    out = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["sum", "kept", "whole"])
    return out.withColumn("idx", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).withColumn("zero", share("0", "sum", "kept"))


def leading_terms(held: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's k terms of the largest share above the language's, best first."""
    key = ["lang", "source"]
    named = held.withColumn("bucket", bucket(F.col("n")))
    extremes = named.groupBy(*key, "bucket").agg(F.max("n").alias("most"), F.min("total").alias("least"), F.count("*").alias("terms"))
    ladder = extremes.join(groups, key).withColumn("bound", share("most", "sum", "kept") - share("least", "whole", "kept")).filter("bound > 0")
    falling = W.partitionBy(*key).orderBy(F.desc("bound"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    ladder = staged(ladder.select(*key, "bucket", "bound", F.coalesce(F.sum("terms").over(falling), F.lit(0)).alias("before")), "ladder", "zstd")
    best, opened, reach = None, 0, k
    while True:
        todo = ladder.filter(F.col("before") >= opened)
        if best is not None:
            kth = best.filter(F.col("rank") == k).select(*key, F.col("value").alias("kth"))
            todo = todo.join(kth, key, "left").filter("kth is null or bound >= kth").drop("kth")
            if todo.isEmpty():
                discard(ladder)
                return best
        exact = named.join(todo.filter(F.col("before") < reach).select(*key, "bucket"), [*key, "bucket"]).join(groups, key)
        exact = exact.select(*key, F.col("term").alias("item"), (share("n", "sum", "kept") - share("total", "whole", "kept")).alias("value")).filter("value > 0")
        found = exact if best is None else exact.unionByName(best.drop("rank"))
        ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= k)
        last, best = best, staged(ranked, "leading", "zstd")
        discard(*[x for x in (last,) if x is not None])
        opened, reach = reach, reach * WIDER


def pair_sums(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, i, j, more): for idx i < j, the sum over terms of their difference, less what two counts of 0 differ by.

    Each tile holds at most `SHARD` terms (about) and two sides of `SIDE` sources.
    """
    shape = groups.groupBy("lang").agg(F.greatest(F.ceil(F.max("kept") / SHARD), F.lit(1)).alias("shards"), F.ceil(F.count("*") / SIDE).alias("sides"))
    sided = groups.join(shape, "lang").withColumn("side", F.floor(F.col("idx") / SIDE))
    both = lambda df: df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).select("lang", "shard", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "idx", "term", "p")
    zeros = sided.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).withColumns({"term": F.lit(None).cast("string"), "p": F.col("zero")})
    there = held.select("lang", "source", "term", "n").join(sided, ["lang", "source"]).withColumns({"shard": F.pmod(F.xxhash64("term"), F.col("shards")), "p": share("n", "sum", "kept")})

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["a"].iloc[0], rows["b"].iloc[0]
        zero = rows[rows["term"].isna()].sort_values("idx")
        idx, floor = zero["idx"].to_numpy(), zero["p"].to_numpy(np.int64)
        seen = rows[rows["term"].notna()]
        at, terms = pd.factorize(seen["term"])
        p = np.tile(floor, (len(terms), 1))
        p[at, np.searchsorted(idx, seen["idx"].to_numpy())] = seen["p"].to_numpy(np.int64)
        out = []
        for i in np.flatnonzero(idx // SIDE == a):
            later = np.flatnonzero((idx // SIDE == b) & (idx > idx[i]))
            more = np.abs(p[:, later] - p[:, i, None]).sum(0) - len(terms) * np.abs(floor[later] - floor[i])
            out.append(pd.DataFrame({"i": idx[i], "j": idx[later], "more": more}))
        return pd.concat(out).assign(lang=rows["lang"].iloc[0])[["lang", "i", "j", "more"]]

    tiles = both(there).unionByName(both(zeros)).groupBy("lang", "shard", "a", "b")
    return tiles.applyInPandas(tile, "lang string, i long, j long, more long").groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` compares sources of a language, part `term` names leading terms.

    Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased; a language keeps those in at least
    `min_docs` of its documents. A share is 1 + floor(1e9 * (count + 5) / (N + 5 * V)), N the occurrences of kept terms
    there and V their number. `pair`: the sum over kept terms of the absolute difference of both shares, for every other
    source of the language. `term`: the k kept terms of the group whose share is furthest above the language's. Ranks
    count from 1 by falling value, then by the item's bytes.

    Null text, lang and source are ''. Groups without terms occur in pairs like others; a language without kept terms
    has pairs of value 0 and no terms. Repeated rows count as often as they come; a language with one source has no
    pairs; an empty table gives no rows. Other columns are not read.
    """
    clean = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    held = staged(postings(clean, min_docs), "postings", "zstd")
    groups = staged(grouped(clean, held), "groups", "zstd")
    terms = leading_terms(held, groups, k).withColumn("part", F.lit("term"))
    one = lambda k: groups.select("lang", F.col("source").alias(f"source_{k}"), F.col("idx").cast("long").alias(k), F.col("zero").alias(f"zero_{k}"), *(["kept"] if k == "i" else []))
    value = F.col("more") + F.col("kept") * F.abs(F.col("zero_i") - F.col("zero_j"))
    pairs = staged(pair_sums(held, groups).join(one("i"), ["lang", "i"]).join(one("j"), ["lang", "j"]).select("lang", "source_i", "source_j", value.alias("value")), "pairs", "zstd")
    way = lambda x, y: pairs.select("lang", F.col(x).alias("source"), F.col(y).alias("item"), "value")
    ranked = way("source_i", "source_j").unionByName(way("source_j", "source_i")).withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    discard(held, groups)
    return ranked.withColumn("part", F.lit("pair")).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (coalesce(s.n, 0) + 5 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 5)) // (l.whole + 5 * l.v))::BIGINT AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
