"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents link when
100 * |intersection| >= percent * |union|.

1. Equal sets are one class from here on; its member of the smallest id stands for it.
2. Shingles are ordered by how many classes hold them, the rarest first. To learn those numbers, documents are dealt to
   blocks; each block sends its distinct hashes, as packed arrays by hash range, and gets one small number back per hash.
3. Two sets of an overlap t share at least l of the first n - t + l shingles of each. A document takes l = 1 where its
   prefix is cheap, and a longer prefix with more required matches where common shingles would bring many candidates.
   Shingles that one class alone holds cannot match, so most documents leave here without a single row.
4. Star links: every document of a prefix shingle is compared with one centre, the one with the least share of shingles
   of its own. What links joins the centre's component, in rows linear in the prefixes.
5. Other candidates: pairs from different components that share enough prefix shingles and can still reach the overlap.
   One of them lies outside the centre's component. Pairs with the same centre are settled by how each set differs from
   it: |x ^ y| = |dx| + |dy| - 2 |dx & dy|. The conditions are part of the join, so a pair that fails is never a row.
6. Every candidate's sets are compared in full; components of all links give the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bound_batches, range_edges, staged, table
from .components import components

#: Shingles of a block of documents, and of a range of hashes, that a task holds at a time.
BLOCK, RANGE = 1_500_000, 3_000_000
#: Candidates per required match that a prefix may bring before it is lengthened, and the most matches asked for.
CHEAP, MATCHES = 64, 8
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash, kept while a task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words; with fewer words the whole sequence is one."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(size, n)
    x = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        x = (x ^ h[j : n - width + 1 + j]) * MIX[0]
        x ^= x >> np.uint64(29)
    x *= MIX[1]
    x ^= x >> np.uint64(32)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def set_facts(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2): the set's size and a 128-bit digest of it."""

    @F.pandas_udf("n_shingles long, f1 long, f2 long")
    def facts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for text in batch:
                s = shingles(text, size, hashes)
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), ">i8")
                rows.append((len(s), int(d[0]), int(d[1])))
            yield pd.DataFrame(rows, columns=["n_shingles", "f1", "f2"])

    return docs.select("doc_id", facts("text").alias("x")).select("doc_id", "x.*")


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte that keeps their order: exact up to 200, then by powers of two."""
    high = 200 + np.log2(np.maximum(counts, 201) / 200).astype(np.int64)
    return np.where(counts <= 200, counts, np.minimum(high, 255)).astype(np.uint8)


def required(n: int, percent: int) -> int:
    """The least overlap of a set of `n` with any set that it links to."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int, common: np.ndarray) -> tuple[int, int]:
    """(matches to ask for, prefix length) of a set whose shingles, in order, are held by `common` classes."""
    base, best = n - required(n, percent), None
    cost = np.cumsum(np.where(common > 1, common, 0), dtype=np.int64)
    for ask in range(1, min(MATCHES, required(n, percent)) + 1):
        share = int(cost[base + ask - 1]) / ask**2
        if best is None or share < best[0]:
            best = (share, ask, base + ask)
        if share <= CHEAP:
            break
    return best[1], best[2]


def active_sets(docs: DataFrame, reps: DataFrame, total: int, size: int, percent: int) -> DataFrame:
    """(doc, n, alone, ask, lead, tokens) of each class that shares a prefix shingle with another class.

    tokens: the set's hashes, the rarest first; alone: how many of them no other class holds; ask: the matches that
    its prefix of `lead` tokens asks for.
    """
    blocks, bits = max(1, math.ceil(total / BLOCK)), max(0, math.ceil(math.log2(max(1, total / RANGE))))
    block = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    dealt = docs.select(block(), "doc_id", "text")
    chosen = reps.select(block(), F.lit(-1).alias("range"), F.col("doc").cast("string").cast("binary").alias("payload"))

    def sets(left: pd.DataFrame, ids: set) -> list[tuple[int, np.ndarray]]:
        hashes = WordHashes()
        return [(d, s) for d, t in zip(left["doc_id"], left["text"], strict=True) if d in ids and len(s := shingles(t, size, hashes))]

    def wanted(right: pd.DataFrame) -> set[int]:
        return {int(x) for x in right.loc[right["range"] < 0, "payload"]}

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = sets(left, wanted(right))
        keys, counts = np.unique(np.concatenate([s for _, s in found]), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        at, short = range_edges(keys, bits), ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        out = [(int(left["block"].iloc[0]), r, short[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
        return pd.DataFrame(out, columns=["block", "range", "keys", "counts"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, "<u4") for x in group["keys"]]
        spots, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in group["counts"]]), len(spots)).astype(np.int64)
        seen = np.split(rarity(counts)[at], np.cumsum([len(k) for k in keys])[:-1])
        return pd.DataFrame({"block": group["block"], "range": group["range"], "payload": [x.tobytes() for x in seen]})

    def lead(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found, rows = sets(left, wanted(right)), []
        if found:
            keys = np.unique(np.concatenate([s for _, s in found]))
            held = np.frombuffer(b"".join(right[right["range"] >= 0].sort_values("range")["payload"]), np.uint8)
            for doc, s in found:
                common, n = held[np.searchsorted(keys, s)], len(s)
                alone = int(np.count_nonzero(common < 2))
                if alone > n - required(n, percent):  # the shortest prefix is cheapest, and all its shingles are alone
                    continue
                order = np.argsort(common, kind="stable")  # equal counts stay in the order of hashes
                common = common[order]
                matches, length = prefix(n, percent, common)
                if alone < length:
                    rows.append((doc, n, alone, matches, length, s[order].view(np.int64)))
        return pd.DataFrame(rows, columns=["doc", "n", "alone", "ask", "lead", "tokens"])

    asked = dealt.groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(ask, "block int, range int, keys binary, counts binary")
    answered = asked.groupBy("range").applyInPandas(answer, "block int, range int, payload binary")
    both = chosen.unionByName(answered)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(lead, "doc long, n int, alone int, ask int, lead int, tokens array<long>")


def verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    one = active.select(F.col("doc").alias("a"), F.col("tokens").alias("ta"))
    two = active.select(F.col("doc").alias("b"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").filter(100 * overlap >= percent * (F.size("ta") + F.size("tb") - overlap)).select("a", "b")


def similar_links(active: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes, enough of them for every component."""
    reach = lambda x, y: F.least(F.col(f"{x}.n") - F.col(f"{x}.alone"), F.col(f"{y}.n") - F.col(f"{y}.alone")) * (100 + percent) >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))
    begun = active.select("doc", "n", "alone", "ask", F.slice("tokens", 1, F.col("lead")).alias("first"))
    rows = begun.select("doc", "n", "alone", "ask", "first", F.explode(F.slice("first", F.col("alone") + 1, F.size("first"))).alias("token"))

    slim = rows.select("token", "doc", "n", "alone")
    centre = slim.groupBy("token").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), (-F.col("n")).alias("size"), "doc", "n", "alone")).alias("c"), F.count("*").alias("many"))
    centre = staged(centre.filter("many > 1").select("token", "c.doc", "c.n", "c.alone"), "centres")
    met = slim.alias("x").join(centre.alias("c"), "token").select(F.col("x.doc").alias("a"), F.col("c.doc").alias("b"), reach("x", "c").alias("can"))
    met = staged(met.groupBy("a", "b").agg(F.count("*").alias("times"), F.first("can").alias("can")), "met")
    found = staged(verified(met.filter("a <> b and can").select("a", "b"), active, percent), "stars")

    # How each set differs from the centre that it meets most often: small arrays that settle a pair of one centre. Half
    # of a hash is enough, as equal halves can only make two differences look nearer.
    home = met.groupBy("a").agg(F.min(F.struct((-F.col("times")).alias("t"), "b")).alias("h")).select("a", F.col("h.b").alias("b"))
    one, two = active.select(F.col("doc").alias("a"), F.col("tokens").alias("ta")), active.select(F.col("doc").alias("b"), F.col("tokens").alias("tb"))
    differ = F.array_distinct(F.transform(F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta")), lambda x: F.shiftright(x, 32).cast("int")))
    apart = home.join(one, "a").join(two, "b").select(F.col("a").alias("doc"), F.col("b").alias("home"), differ.alias("differ"))

    # A pair that is not linked yet has a member outside the component of the shingle's centre.
    joined = components(found).withColumnRenamed("node", "doc")
    placed = rows.drop("first").join(joined, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    main = centre.select("token", "doc").join(joined, "doc", "left").select("token", F.coalesce("component", "doc").alias("main"))
    placed = placed.join(main, "token").withColumn("outside", F.col("component") != F.col("main")).drop("main")
    mixed = placed.groupBy("token").agg(F.max("outside").alias("mixed")).filter("mixed").select("token")
    placed = staged(placed.join(mixed, "token", "left_semi").join(apart, "doc"), "placed")

    x, y = placed.filter("outside").alias("x"), placed.alias("y")
    apart2 = F.size("x.differ") + F.size("y.differ") - 2 * F.size(F.array_intersect("x.differ", "y.differ"))
    near = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
        & (~F.col("y.outside") | (F.col("x.doc") < F.col("y.doc")))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & reach("x", "y")
        & ((F.col("x.home") != F.col("y.home")) | (apart2 * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)))
    )
    # A pair has one row for each shared token, in the direction that the token's centre gives: both directions count.
    shared = x.join(y, near).groupBy(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")).agg(F.count("*").alias("matches"), F.first(F.least("x.ask", "y.ask")).alias("asked"))
    return found.unionByName(verified(shared.filter("matches >= asked").select("a", "b"), active, percent))


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach, the document itself included. A text that is null, empty or
    without words has an empty set: 0 shingles, linked with nothing, its own component. Rows with a null doc_id get
    their n_shingles and a null component_id. Rows that share a doc_id count as one document with several texts: what
    any of them links to, all of them reach. Equal texts link. No other column is read. Hashes of 64 bits stand for
    shingles, so a wrong count needs a collision within one pair of documents.
    """
    if not 1 <= percent <= 100 or size < 1:
        raise ValueError("percent lies in 1..100, size is positive")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = staged(set_facts(docs, size), "sets")
    linked = facts.filter("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"))
    reps = staged(classes, "classes")
    # All texts are dealt to blocks, copies too, so blocks are sized by all of them.
    total = facts.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    active = staged(active_sets(docs, reps.select("doc", F.col("doc").alias("doc_id")).distinct(), total, size, percent), "active")

    members = linked.join(reps, ["f1", "f2"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).filter("a <> b")
    reached = components(similar_links(active, percent).unionByName(members))
    return facts.select("doc_id", "n_shingles").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group of linked rows: that of the smallest doc_id (null last), then of a hash of id and text.

    Rows are told apart by doc_id and text: those that share an id but not a text are documents of their own, and of
    rows that share both one stays. Rows without words link with nothing.
    """
    from .common import copies_apart, free_name

    d, r, node, component = (free_name(docs, x) for x in ("d", "r", "node", "component"))
    keyed = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), r: F.xxhash64("doc_id", "text")})
    rows = copies_apart(keyed, d, r)[0].withColumn(d, F.col("doc_id").cast("long"))
    shared = staged(docs.groupBy(F.col("doc_id").cast("long").alias(d)).agg(F.count("*").alias("many")).filter(f"many > 1 and `{d}` is not null").select(d, F.lit(True).alias(component)), "shared-ids")
    own = -1 - F.pmod(F.col(r), F.lit(1 << 62))  # a number of its own for a row that its id doesn't tell
    named = rows.withColumn(node, F.coalesce(F.col(d), own))
    if not shared.isEmpty():
        named = rows.join(shared, d, "left").withColumn(node, F.when(F.col(d).isNull() | F.col(component), own).otherwise(F.col(d))).drop(component)
    classes = jaccard_classes(named.select(F.col(node).alias("doc_id"), "text"), size, percent)
    first = F.min(F.struct(F.col(d).isNull(), F.col(d), F.col(r), F.col(node).alias("stays"))).alias("first")
    linked = named.select(node, d, r).join(classes.select(F.col("doc_id").alias(node), F.col("component_id").alias(component)), node)
    stays = linked.groupBy(component).agg(first).select(F.col("first.stays").alias(node))
    return named.join(stays, node, "left_semi").select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=90)


#: The same result in DuckDB: shingles as strings, pairs that share one, links, and what they reach.
OP4_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM worded
), shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN link l ON r.b = l.a OR r.b = l.b
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY ALL
"""
