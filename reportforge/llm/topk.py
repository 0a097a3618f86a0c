"""Exact top-k search: query blocks times candidate shards, partial selection per tile, merged as a tree.

Vectors are packed into blocks of a fixed number of rows, one row of Spark a block. Every query block meets every
shard once, as a matrix product in a task of its own; of a tile only each query's k best leave. The partial lists of a
query are merged `FAN` shards at a time, so no task holds more than FAN * k rows of a query at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

#: Rows of a candidate shard and of a query block.
SHARD, BLOCK = 8192, 2048
#: Shards whose lists one merge takes together.
FAN = 16


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a long; null if a component is null or not finite, or the vector is."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def packed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row for each (dim, key): ids and numbers of the group's vectors as bytes."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        numbers = np.stack(group["v"].to_numpy()) if group["dim"].iloc[0] else np.zeros((len(group), 0), np.int64)
        return pd.DataFrame({"dim": group["dim"].iloc[:1], key: group[key].iloc[:1], f"{name}_ids": [group["vec_id"].to_numpy(np.int64).tobytes()], f"{name}s": [numbers.astype(np.int64).tobytes()]})

    return rows.groupBy("dim", key).applyInPandas(pack, f"dim int, {key} int, {name}_ids binary, {name}s binary")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where no sum can pass 2**53, else by whole numbers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if top < 2**63:
        return q @ c.T
    raise OverflowError("an inner product of these vectors may not fit 64 bits")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank (from 1), vec_id, score.

    Candidates are all rows whose id differs from the query's and whose vector has the query's dimension. Ties go to
    the smaller id; rows that repeat an id are candidates each. A query id that repeats is answered once, by the
    vector that sorts first. Vectors that are null or hold a null, NaN or infinite component, and rows with a null
    id, take no part; with fewer candidates than k all are given. Other columns are not read. A product that could
    leave 64 bits raises an error.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    totals = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("q").alias("m"))
    # A few rows: one for each dimension that occurs.
    spread = F.broadcast(totals.select("dim", F.ceil(F.col("n") / SHARD).cast("int").alias("shards"), F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int").alias("blocks")))
    rows = rows.join(spread, "dim")
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.to_json("v"), F.lit(salt)), F.col(n)).cast("int")
    shards = packed(rows.select("dim", "vec_id", "v", dealt("shards", 0).alias("shard")), "shard", "cand")
    asked = rows.filter("q").withColumn("nth", F.row_number().over(W.partitionBy("dim", "vec_id").orderBy("v"))).filter("nth = 1")
    blocks = packed(asked.select("dim", "vec_id", "v", dealt("blocks", 1).alias("block")), "block", "query")

    tiles = shards.join(spread, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("shards", "blocks").join(blocks, ["dim", "block"])

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                qi, ci = np.frombuffer(t.query_ids, np.int64), np.frombuffer(t.cand_ids, np.int64)
                q, c = (np.frombuffer(x, np.int64).reshape(-1, t.dim) if t.dim else np.zeros((n, 0), np.int64) for x, n in ((t.querys, len(qi)), (t.cands, len(ci))))
                yield best(qi, ci, products(q, c), t.shard)

    def best(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, shard: int) -> pd.DataFrame:
        out = []
        for i, row in enumerate(score):
            keep = np.flatnonzero(ci != qi[i])
            if len(keep) > k:
                # All that reach the k-th score, so that ties are settled by id.
                floor = np.partition(row[keep], len(keep) - k)[len(keep) - k]
                keep = keep[row[keep] >= floor]
                keep = keep[np.lexsort((ci[keep], -row[keep]))[:k]]
            out.append(pd.DataFrame({"query_id": np.full(len(keep), qi[i]), "vec_id": ci[keep], "score": row[keep]}))
        return pd.concat(out).assign(part=np.int64(shard))[["query_id", "vec_id", "score", "part"]] if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score", "part")})

    spread_out = tiles.repartition(F.col("dim"), F.col("block"), F.col("shard"))
    lists = staged(spread_out.mapInPandas(select, "query_id long, vec_id long, score long, part long"), "tiles")
    order = [F.desc("score"), F.asc("vec_id")]
    most = (totals.agg(F.coalesce(F.max(F.ceil(F.col("n") / SHARD)), F.lit(0))).first()[0])
    while most > 1:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN))
        lists = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
        most = -(-most // FAN)
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
