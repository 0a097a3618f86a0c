"""Similarity: shingle overlap screens, greedy dedup as fixpoints, cosine search, star clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from .overlap import shared_runs
from .work import Work, checkpointed


def shingles(text: Column, n: int = 8, short: str = "none", tokens: str = "letters") -> Column:
    """Distinct hashes of runs of n lower-cased words; a shorter text has none, or with short='whole' itself.

    Words are runs of [a-z0-9] ('letters'), or what stands between white space ('space'). Each word is hashed once; a run is
    the hash of its words' hashes.
    """
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)) if tokens == "letters" else F.array_remove(F.split(low, r"(?U)\s+"), "")

    def runs(h: Column) -> Column:
        many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))
        few = F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda s, x: F.xxhash64(s, x))) if short == "whole" else F.array().cast("array<bigint>")
        return F.when(F.size(h) >= n, many).when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(few)

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 1)


def postings(rows: DataFrame, id_: str, text: str, n: int, short: str = "none", tokens: str = "letters") -> DataFrame:
    sets = rows.select(F.col(id_).alias("id"), shingles(F.col(text), n, short, tokens).alias("s"))
    return sets.select("id", F.size("s").alias("size"), F.explode("s").alias("shingle"))


def jaccard_screen(test: DataFrame, train: DataFrame, id_: str, text: str, n: int = 8, most: int = 256) -> DataFrame:
    """Each test row's greatest Jaccard with a train row; shingles in over `most` train rows count in sizes only.

    Words stand between white space. The bound is part of the measure: an exact copy of a text of which every shingle
    stands in over `most` train rows has no rare shingle to be met by.
    """
    p, q = postings(test, id_, text, n, "none", "space"), postings(train, id_, text, n, "none", "space")
    rare = q.groupBy("shingle").agg(F.count("*").alias("df")).filter(F.col("df") <= most).select("shingle")
    q = q.join(rare, "shingle", "left_semi").select("shingle", F.col("id").alias("train_id"), F.col("size").alias("train_size"))
    shared = p.join(q, "shingle").groupBy("id", "size", "train_id", "train_size").agg(F.count("*").alias("c"))
    scored = shared.withColumn("j", F.col("c") / (F.col("size") + F.col("train_size") - F.col("c")))
    best = scored.groupBy("id").agg(F.max("j").alias("j"))
    return test.select(F.col(id_).alias("id")).join(best, "id", "left").select("id", rounded(F.coalesce("j", F.lit(0.0)), 6).alias("max_jaccard"))


def first_independent(nodes: DataFrame, edges: DataFrame, pinned: Column | None = None) -> DataFrame:
    """(id, kept, keeper): the lexicographically first independent set of a graph, as a greedy pass would keep it.

    `edges` has (a, b) with a < b. A node without an earlier neighbour that is undecided or kept is kept; one with an
    earlier kept neighbour goes, to the smallest such. Pinned nodes are kept whatever their neighbours. Each round is
    written by checkpoint(), so lost executors cost no more than a round.
    """
    pin = F.lit(False) if pinned is None else pinned
    state = checkpointed(nodes.select(F.col("id"), F.when(pin, F.lit(1)).alias("kept"), F.lit(None).cast("long").alias("keeper")))
    edges = checkpointed(edges.select("a", "b").distinct())
    while not state.filter("kept is null").isEmpty():
        seen = edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("k")), "a").groupBy(F.col("b").alias("id")).agg(
            F.min(F.when(F.col("k") == 1, F.col("a"))).alias("smallest"), F.count_if(F.col("k").isNull()).alias("waiting"))
        joined = state.join(seen, "id", "left")
        open_ = F.col("kept").isNull()
        kept = F.when(~open_, F.col("kept")).when(F.col("smallest").isNotNull(), 0).when(F.coalesce("waiting", F.lit(0)) == 0, 1)
        state = checkpointed(joined.select("id", kept.cast("int").alias("kept"), F.when(F.col("kept").isNull() | (F.col("kept") == 0), F.col("smallest")).alias("keeper")))
    return state.select("id", (F.col("kept") == 1).alias("kept"), F.when(F.col("kept") == 0, F.col("keeper")).alias("keeper"))


def within_file_duplicates(rows: DataFrame, id_: str, text: str, n: int = 8) -> DataFrame:
    """(id, kept, keeper): rows kept when each row that shares a shingle with an earlier kept row is dropped.

    The same fixpoint as first_independent, on classes of shingles with equal holders in place of pairs: a round tells each
    class's smallest kept and smallest undecided row to its undecided rows. A dropped row's keeper is the smallest that it meets.
    """
    work = Work(rows.sparkSession, "within")
    posts = work.write(shared_runs(rows, id_, text, n, work)[0].select("class", "id"))
    work.drop(keep=1)
    state = work.write(posts.select("id").distinct().withColumn("kept", F.lit(None).cast("int")))
    first = lambda told: posts.join(state, "id").groupBy("class").agg(*told)
    kept_one, open_one = F.min(F.when(F.col("kept") == 1, F.col("id"))).alias("k"), F.min(F.when(F.col("kept").isNull(), F.col("id"))).alias("u")
    while not state.filter("kept is null").isEmpty():
        waiting = posts.join(state.filter("kept is null").select("id"), "id")
        seen = waiting.join(first([kept_one, open_one]), "class").groupBy("id").agg(F.bool_or(F.coalesce(F.col("k") < F.col("id"), F.lit(False))).alias("met"), F.min("u").alias("u"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("met"), 0).when(F.col("u") == F.col("id"), 1)
        state = work.write(state.join(seen, "id", "left").select("id", now.cast("int").alias("kept")))
    gone = posts.join(state.filter("kept = 0").select("id"), "id").join(first([kept_one]), "class").filter(F.col("k") < F.col("id")).groupBy("id").agg(F.min("k").alias("keeper"))
    out = work.write(rows.select(F.col(id_).cast("long").alias("id")).join(gone, "id", "left").select("id", F.col("keeper").isNull().alias("kept"), "keeper"))
    work.drop(keep=1)
    return out


def unit(vector: np.ndarray) -> np.ndarray:
    """Rows of length one; zero vectors stay zero."""
    norm = np.linalg.norm(vector, axis=1, keepdims=True)
    return np.divide(vector, norm, out=np.zeros_like(vector), where=norm > 0)


#: Rows of a block of queries and of a block of the index: a product of two blocks is one task's work.
QUERY_BLOCK, INDEX_BLOCK = 1024, 4096


def dealt(rows: DataFrame, id_: str, vector: str, size: int, count: int) -> DataFrame:
    """(id, v, block): rows dealt to as many blocks of about `size` rows as `count` rows make."""
    return rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id_), F.lit(max(1, -(-count // size)))).cast("int").alias("block"))


def cosine_top(queries: DataFrame, index: DataFrame, k: int, id_: str, vector: str) -> DataFrame:
    """Each query's k nearest index rows by cosine: (query_id, rank, id, cosine); ties to the smaller id.

    Queries and index rows are dealt to blocks by their numbers; each pair of blocks is one matrix product, of which a
    query's k best leave, by the cosine as it is given back, and these are ranked per query.
    """
    many, all_ = queries.count(), index.count()
    left, right = dealt(queries, id_, vector, QUERY_BLOCK, many), dealt(index, id_, vector, INDEX_BLOCK, all_)
    of = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // size)) - 1)))
    q = left.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("block").alias("qb")).withColumn("ib", of(all_, INDEX_BLOCK))
    x = right.select("id", "v", F.col("block").alias("ib")).withColumn("qb", of(many, QUERY_BLOCK))

    def tile(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
        ids, own = right["id"].to_numpy(), left["qid"].to_numpy()
        sims = unit(np.stack(left["qv"]).astype(np.float64)) @ unit(np.stack(right["v"]).astype(np.float64)).T
        sims = np.floor(sims * 1e6 + 0.5) / 1e6
        sims[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(sims, max(0, sims.shape[1] - k), axis=1)[:, max(0, sims.shape[1] - k)]
        i, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))  # the k best, and what ties with the last of them
        order = np.lexsort((ids[j], -sims[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pd.DataFrame({"query_id": own[i], "id": ids[j], "cosine": sims[i, j]})

    parts = q.groupBy("qb", "ib").cogroup(x.groupBy("qb", "ib")).applyInPandas(tile, "query_id long, id long, cosine double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "cosine")


def cosine_edges(rows: DataFrame, threshold: float, id_: str, vector: str) -> DataFrame:
    """Pairs (a < b, cosine) at or over the threshold, found block by block; blocks by the number of rows."""
    count = rows.count()
    side, blocks = dealt(rows, id_, vector, INDEX_BLOCK, count), max(1, -(-count // INDEX_BLOCK))
    left = side.withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("x <= y")
    right = side.withColumnRenamed("block", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("x <= y")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        sims = unit(np.stack(a["v"]).astype(np.float64)) @ unit(np.stack(b["v"]).astype(np.float64)).T
        i, j = np.nonzero(sims >= threshold)
        p, q = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        low, high = np.minimum(p, q), np.maximum(p, q)
        return pd.DataFrame({"a": low, "b": high, "cosine": sims[i, j]})[low < high]

    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(tile, "a long, b long, cosine double")
    return found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def star_clusters(rows: DataFrame, threshold: float, id_: str, vector: str) -> DataFrame:
    """(exemplar, size, members, closest): a row opens a cluster if no earlier exemplar is near, else joins the smallest.

    `closest` is the greatest cosine of any two members; clusters of one are left out.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold lies in 0.5..1")
    edges = checkpointed(cosine_edges(rows, threshold, id_, vector))
    state = first_independent(rows.select(F.col(id_).cast("long").alias("id")), edges).select("id", F.coalesce("keeper", "id").alias("exemplar"))
    pairs = edges.join(state.withColumnRenamed("id", "a"), "a").join(state.select(F.col("id").alias("b"), F.col("exemplar").alias("other")), "b").filter("exemplar = other")
    near = pairs.groupBy("exemplar").agg(F.max("cosine").alias("closest"))
    groups = state.groupBy("exemplar").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members")).filter("size >= 2")
    return groups.join(near, "exemplar").select("exemplar", "size", "members", rounded(F.col("closest"), 6).alias("closest"))


def pseudo_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector of signed hashed words and character trigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    flat = F.array_join(words, " ")
    grams = F.concat(words, F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - 2, F.lit(1))), lambda i: F.substring(flat, i, F.lit(3))))
    h = F.transform(grams, lambda g: F.xxhash64(g))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(h, lambda x: F.pmod(x, F.lit(dims)) == d), F.lit(0.0), lambda s, x: s + F.when(F.pmod(F.shiftright(x, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.element_at(F.transform(F.array(raw), lambda v: F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)), 1)


def embed_missing(rows: DataFrame, done: DataFrame, id_: str, text: str) -> DataFrame:
    """Vectors of rows that have none yet: a resumed run embeds only what is missing."""
    return rows.join(done.select(id_), id_, "left_anti").select(id_, pseudo_embedding(F.col(text)).alias("embedding"))
