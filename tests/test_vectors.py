"""Half-precision vectors: round trip, reads by rows, resumed writes, pairs that do not match."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportforge.sources import vectors as V


def made(spark, n, dim=6):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim)).astype(np.float16)
    return x, spark.createDataFrame([(i, f"r{i}é", [float(v) for v in x[i]]) for i in range(n)], "row long, id string, embedding array<float>").repartition(4)


def test_round_trip(spark, tmp_path):
    x, rows = made(spark, 50)
    at = str(tmp_path / "v")
    assert V.read_vectors(spark, at).count() == 0
    assert V.write_vectors(rows, at, 50, stride=16) == 0
    assert V.blocks(at) == [0, 1, 2, 3] and V.next_row(at, 16) == 64 and not list((tmp_path / "v").glob("_temporary*"))
    got = V.read_vectors(spark, at, size=5)
    assert got.rdd.getNumPartitions() == 3 * 4 + 1
    got = sorted(got.collect())
    assert [r.row for r in got] == list(range(50)) and [r.id for r in got] == [f"r{i}é" for i in range(50)]
    assert np.array_equal(np.array([r.embedding for r in got], np.float16), x)
    # Any reader of NumPy files sees the same.
    assert np.array_equal(np.load(tmp_path / "v" / "block-0000000001.npy"), x[16:32])
    assert V.write_vectors(rows, at, 50, stride=16) == 64  # all there: nothing is written


def test_many_batches_of_a_block(spark, tmp_path):
    at = str(tmp_path / "v")
    rows = spark.range(5000).select(F.col("id").alias("row"), F.col("id").cast("string").alias("id"), F.array((F.col("id") % 7).cast("float")).alias("embedding"))
    V.write_vectors(rows, at, 5000)
    got = V.read_vectors(spark, at, size=4999)
    assert got.filter("cast(row as string) <> id or embedding[0] <> row % 7").count() == 0 and got.select("row").distinct().count() == 5000


def test_resume_at_the_first_row_that_is_not_there(spark, tmp_path):
    x, rows = made(spark, 50)
    at = str(tmp_path / "v")
    V.write_vectors(rows, at, 50, stride=16)
    (tmp_path / "v" / "block-0000000002.jsonl").unlink()  # as if the move of the ids had been cut off
    before = (tmp_path / "v" / "block-0000000000.npy").stat().st_mtime_ns
    spoiled = rows.withColumn("embedding", F.when(F.col("row") < 32, F.array(F.lit(9.0).cast("float"))).otherwise(F.col("embedding")))
    assert V.next_row(at, 16) == 32 and V.write_vectors(spoiled, at, 50, stride=16) == 32
    assert (tmp_path / "v" / "block-0000000000.npy").stat().st_mtime_ns == before
    assert np.array_equal(np.array([r.embedding for r in sorted(V.read_vectors(spark, at).collect())], np.float16), x)


def test_failed_writes_leave_nothing(spark, tmp_path):
    _, rows = made(spark, 40)
    at = str(tmp_path / "v")
    for bad in (rows.filter("row <> 20"), rows.withColumn("embedding", F.when(F.col("row") != 33, F.col("embedding"))), rows.unionByName(rows.filter("row = 3"))):
        with pytest.raises(Exception):  # noqa: B017
            V.write_vectors(bad, at, 40, stride=16)
        assert V.blocks(at) == []
    V.write_vectors(rows, at, 40, stride=16)
    assert V.read_vectors(spark, at).count() == 40


@pytest.mark.parametrize("lines", [9, 11])
def test_pair_that_does_not_match(spark, tmp_path, lines):
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "block-0000000000.npy", np.ones((10, 3), np.float16))
    (tmp_path / "v" / "block-0000000000.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(lines)))
    with pytest.raises(Exception, match="matching pair"):
        V.read_vectors(spark, str(tmp_path / "v"), size=4).collect()
    np.save(tmp_path / "v" / "block-0000000000.npy", np.ones((10, 3), np.float32))
    with pytest.raises(Exception, match="float16"):
        V.read_vectors(spark, str(tmp_path / "v")).collect()
