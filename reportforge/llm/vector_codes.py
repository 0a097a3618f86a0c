"""Vector code compression: product codebooks by Lloyd's rounds that are maintained from what changed.

Vectors become whole numbers and lie in blocks, bucketed once by block. A round reads the blocks beside the assignments
of the round before, which are bucketed alike, so neither moves; it writes the new assignments and, for each task, the
sums that moved: plus for the entry that a part joins, minus for the one it leaves. Those few rows alone are shuffled,
and added to running integer sums, from which the next codebook follows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, staged, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block at most, and bytes of its numbers.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Blocks of a bucket, about.
BUCKET_BLOCKS = 64


class Bucketed:
    """Tables in the shared folder, bucketed by block; each can be dropped when it has served."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.folder = spark, buckets, f"{shared_dir(spark)}/reportforge/codes-{uuid.uuid4().hex}"
        self.names: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        at = self.names[name] = f"reportforge_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "block").sortBy("block").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(at)
        return self.spark.table(at)

    def delete(self, name: str) -> None:
        self.spark.sql(f"drop table {self.names.pop(name)}")  # an external table: its files go apart
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where squared distances of such numbers may not fit 64 bits."""
    out = np.floor(scale * values.astype(np.float64))
    if 4 * values.shape[1] * float(np.abs(out).max(initial=0) + 1) ** 2 >= 2**63:
        raise OverflowError("squared distances of these vectors may not fit 64 bits")
    return out.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (the first of equal ones) and the squared distance, exactly."""
    top = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) ** 2 * 4 * max(1, x.shape[1])
    kind = np.float64 if top < 2**53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    away = (b * b).sum(1) - 2 * (a @ b.T)
    code = away.argmin(1)
    return code, (away[np.arange(len(x)), code] + (a * a).sum(1)).astype(np.int64)


def blocks_of(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(block, ids, labels, x): vectors of `dim` components as they lie in the tasks that read them, up to `BLOCK` a row."""
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))
    label = rows.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                cut = batch.slice(at, most)
                values = cut.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(cut.num_rows, dim)
                x, ends = whole_numbers(values, scale), pa.array([0, cut.num_rows], pa.int32())
                listed = [pa.ListArray.from_arrays(ends, cut.column(c)) for c in ("vec_id", "label")]
                kind = np.int32 if np.abs(x).max(initial=0) < 2**31 else np.int64
                yield pa.RecordBatch.from_arrays([pa.array([nth]), *listed, pa.array([x.astype(kind).tobytes()])], ["block", "ids", "labels", "x"])
                nth += 1

    return rows.mapInArrow(pack, f"block long, ids array<long>, labels array<{label}>, x binary")


def numbers(x: bytes, n: int, dim: int) -> np.ndarray:
    """A block's vectors (n, parts, width): the last part is filled up with zeros."""
    flat = np.frombuffer(x, np.int32 if len(x) == 4 * n * dim else np.int64).reshape(n, dim).astype(np.int64)
    width = -(-dim // PARTS)
    return np.pad(flat, ((0, 0), (0, width * PARTS - dim))).reshape(n, PARTS, width)


def assigned(blocks: DataFrame, before: DataFrame | None, book: np.ndarray, dim: int) -> DataFrame:
    """(block, codes, part, entry, n, moved): a row of codes for each block, then a task's changes, one row an entry."""
    both = blocks.select("block", F.size("ids").alias("many"), "x")
    both = both.withColumn("old", F.lit(None).cast("binary")) if before is None else both.join(before.select("block", F.col("codes").alias("old")), "block")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, moved, last = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64), None
        for batch in batches:
            for row in batch.to_pylist():
                x = numbers(row["x"], row["many"], dim)
                codes = np.stack([nearest(x[:, p], book[p])[0] for p in range(PARTS)], 1).astype(np.uint8)
                old, last = row["old"] and np.frombuffer(row["old"], np.uint8).reshape(-1, PARTS), row["block"]
                for p in range(PARTS):
                    change = np.ones(len(x), bool) if old is None else codes[:, p] != old[:, p]
                    for sign, which in ((1, codes),) if old is None else ((1, codes), (-1, old)):
                        np.add.at(n[p], which[change, p], sign)
                        np.add.at(moved[p], which[change, p], sign * x[change, p])
                yield pa.RecordBatch.from_pylist([{"block": last, "codes": codes.tobytes()}], out)
        if last is not None:
            # Parts that came and went in equal number still move sums.
            for p, e in np.argwhere((n != 0) | moved.any(2)):
                yield pa.RecordBatch.from_pylist([{"block": last, "part": p, "entry": e, "n": n[p, e], "moved": moved[p, e]}], out)

    out = pa.schema([("block", pa.int64()), ("codes", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("moved", pa.list_(pa.int64()))])
    return both.select("block", "many", "x", "old").mapInArrow(step, "block long, codes binary, part int, entry int, n long, moved array<long>")


def added(sums: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Running (part, entry, n, moved) with a round's changes: at most parts * entries rows."""
    rows = changes.filter("part is not null").select("part", "entry", "n", "moved")
    rows = rows if sums is None else rows.unionByName(sums)
    flat = rows.select("part", "entry", F.posexplode(F.concat(F.array("n"), "moved")).alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
    all_of = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
    return flat.groupBy("part", "entry").agg(all_of.alias("all")).select("part", "entry", F.get("all", F.lit(0)).alias("n"), F.slice("all", 2, F.size("all")).alias("moved"))


def trained(tables: Bucketed, blocks: DataFrame, book: np.ndarray, dim: int, rounds: int) -> np.ndarray:
    """The codebook (parts, entries, width) after so many rounds."""
    before = sums = None
    for r in range(rounds):
        now = tables.write(assigned(blocks, before, book, dim), f"round{r}")
        sums = staged(added(sums, now), "sums", "zstd")
        # parts * entries rows at most.
        book = book.copy()
        for row in sums.filter("n > 0").collect():
            book[row["part"], row["entry"]] = np.array(row["moved"], np.int64) // row["n"]
        if r:
            tables.delete(f"round{r - 1}")
        before = now.filter("codes is not null")
    return book


def vector_codes(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that can be coded.

    Components become floor(scale * x); vectors are cut into four equal consecutive parts (the last is filled up with
    zeros where the length is no multiple of four). Each part position has a codebook, at first that part of the
    `entries` (256 at most) smallest ids; equal ids are taken in the order of their vectors, null ids come last.

    Vectors that are null or hold null, NaN or infinite components take no part; nor do vectors of another length than
    that of the smallest id. Equal rows are coded each. label_error sums the errors of all rows with an equal label,
    nulls together; NaN equals NaN there. An empty table gives no rows. Fewer vectors than `entries` make a smaller
    codebook. Numbers whose squared distances may leave 64 bits raise an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    order = [F.asc_nulls_last("vec_id"), F.asc("embedding")]
    first = rows.select("vec_id", "embedding").orderBy(*order).limit(1).collect()
    dim = len(first[0]["embedding"]) if first else 0
    rows = rows.filter(F.size("embedding") == dim)
    # At most `entries` vectors reach the driver.
    begin = [r["embedding"] for r in rows.select("vec_id", "embedding").orderBy(*order).limit(min(entries, 256)).collect()]
    out = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    if not begin:
        return spark.createDataFrame([], f"{out}, label_error long, codebooks_sha256 string").drop("label")
    start = whole_numbers(np.array(begin, np.float64).reshape(len(begin), dim), scale)
    book = np.ascontiguousarray(numbers(start.tobytes(), len(start), dim).transpose(1, 0, 2))

    packed = staged(blocks_of(rows, dim, scale), "blocks", "zstd")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-packed.count() // BUCKET_BLOCKS), 50_000))
    tables = Bucketed(spark, buckets)
    blocks = tables.write(packed.repartition(buckets, "block"), "blocks")
    book = trained(tables, blocks, book, dim, rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = (batch.column(c)[k].values for c in ("ids", "labels"))
                x = numbers(batch.column("x")[k].as_py(), len(ids), dim)
                found = [nearest(x[:, p], book[p]) for p in range(PARTS)]
                names = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
                codes = [names[i : i + 2 * PARTS] for i in range(0, len(names), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string()), pa.array(sum(e for _, e in found))], ["vec_id", "label", "code", "error"])

    coded = staged(blocks.select("ids", "labels", "x").mapInArrow(code, out), "coded", "zstd")
    for name in list(tables.names):
        tables.delete(name)
    discard(packed)
    # One row a label, read from a written table: Spark broadcasts it only below its own size limit, and splits hot labels beyond it.
    totals = staged(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "totals", "zstd")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int) -> str:
    """Every round as tables: c0 the first entries; a{r} the parts with their nearest entries of c{r}; c{r + 1} the next."""

    def nearest_of(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT id, part, v, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
    SELECT p.id, p.part, p.v, c.e, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
    FROM parts p JOIN c{r} c ON p.part = c.part
  ) GROUP BY id, part, v
)"""

    def next_of(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT part, e, list(floor(s::HUGEINT / n)::BIGINT ORDER BY i) AS v FROM (
      SELECT part, e, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 1 + (SELECT max(len(v)) FROM parts)) t(i) GROUP BY part, e, i
    ) GROUP BY part, e
  ) m ON m.part = c.part AND m.e = c.e
)"""

    steps = ",\n".join(f"{nearest_of(r)},\n{next_of(r)}" for r in range(rounds))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT id, part, v[1 + part * (len(v) // 4) : (part + 1) * (len(v) // 4)] AS v FROM kept, range(4) t(part)
), c0 AS (SELECT part, id - 1 AS e, v FROM parts WHERE id <= 256),
{steps},
{nearest_of(rounds)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM c{rounds}),
coded AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (id), book
"""


OP12_SQL = _sql(ROUNDS)
