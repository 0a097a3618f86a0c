"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, as a Java/Python regular expression class.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    A session without one gets a temporary folder where everything runs on this machine (local tests); on a cluster
    that is an error, as executors cannot see the driver's folders.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Where each staged table lies.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends here.

    Once the table is whole, the shuffle files that it was made from have served and are removed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reportforge/{name}-{uuid.uuid4().hex}"
    schema, before = df.schema, spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", codec).option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more. A table that a returned frame reads must stay."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def before(counts: DataFrame, key: str, many: str, name: str, each: int = 4096) -> DataFrame:
    """(key, name): the sum of `many` over all smaller keys (longs). A task sees the keys of `each` neighbours, or one row for each."""
    run = counts.withColumn("__run", F.floor(F.col(key) / each))
    sums = run.groupBy("__run").agg(F.sum(many).alias("__sum"))
    earlier = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("__run", earlier("__sum", W.orderBy("__run")).alias("__base"))
    return run.join(bases, "__run").select(key, (F.col("__base") + earlier(many, W.partitionBy("__run").orderBy(key))).alias(name))


def bound_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Keep Arrow batches under `size` bytes, so that long texts cannot fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().getConf(
            spark._jvm.org.apache.spark.sql.internal.SQLConf.ARROW_EXECUTION_MAX_BYTES_PER_BATCH())) > size:
        spark.conf.set(key, str(size))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not hold yet, whatever its case."""
    held = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in held:
        name += "_"
    return name


def copies_apart(docs: DataFrame, d: str, r: str) -> tuple[DataFrame, DataFrame | None]:
    """`docs` with one row of each (d, r), the first by a hash of its other columns; and the rows that repeat one, if any do.

    Which rows repeat is told by counts of hashes. Equal rows come together as one row and a number before they move.
    """
    twice = staged(docs.groupBy(d, r).agg(F.count("*").alias("many")).filter("many > 1").select(d, r), "repeated", "zstd")
    if twice.isEmpty():
        return docs, None
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row, hashed, nth, first = (free_name(docs, x) for x in ("row", "hash", "nth", "first"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(twice, [d, r]).groupBy(d, r, F.xxhash64(*plain).alias(hashed)).agg(F.first(whole).alias(row), F.count("*").alias(nth))
    again = staged(again, "copies", "zstd")
    firsts = again.groupBy(d, r).agg(F.min(hashed).alias(first))
    told = again.join(firsts, [d, r]).withColumn(nth, F.explode(F.sequence(F.when(F.col(hashed) == F.col(first), 0).otherwise(1), F.col(nth) - F.when(F.col(hashed) == F.col(first), 1).otherwise(0))))
    flat = told.select(nth, f"{row}.*")
    alone = docs.join(twice, [d, r], "left_anti")
    return alone.unionByName(flat.filter(F.col(nth) == 0).drop(nth)), flat.filter(F.col(nth) > 0).drop(nth)


def range_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2**bits ranges of 64-bit hashes starts among sorted `keys`, and the end."""
    inner = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])
