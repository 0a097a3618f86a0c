"""Token-id output in training order: a keyed permutation gives every sequence a slot, slots make fixed-stride shards.

The permutation is a balanced Feistel network on the smallest even number of bits that holds all sequences, with
cycle-walking: a value outside 0..n-1 goes through again. It needs no table and no sort: any slot's sequence, and any
sequence's slot, follow from (key, n). Sequences of a range of slots go to one partition, which writes them in order as
one file. Sequence i of a shard starts at byte i * stride, so a reader starts or resumes at any slot by seeking.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import before, bound_batches, discard, shared_dir, staged, table
from .wordbpe import slices, words_of

WORD_FILE = "word_bpe_49k.json"
#: Tokens of a sequence, sequences of a shard, and the permutation's key.
LENGTH, SLOTS, KEY = 2048, 2048, 20_240_607
ROUNDS = 4
#: Neighbouring ids whose documents are cut in a row; the last sequence of a group is filled up.
GROUP, NAMELESS = 2048, 256
#: Shards are written in so many rounds; more rounds keep less of the ids on their way at a time, but read them again.
WAVES = 2
#: Groups whose numbers are broadcast at most.
BROADCAST_ROWS = 500_000


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The slot of each index in 0..n-1, or with `back` the index of each slot."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(index).astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> shift, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            turn = mixed(left if back else right, key * ROUNDS + r) & mask
            left, right = (right ^ turn, left) if back else (right, left ^ turn)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def encoded(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """(grp, doc_id, h, ids): ids of each document and `end`, little-endian unsigned 16-bit; where they are made, in the scan."""
    bound_batches(docs.sparkSession, 4 << 20)
    last = end.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            for first, many, ids, bounds in words.runs(batch.column("text"), last):
                if ids.max() > 65535:
                    raise ValueError("ids over 65535 need a wider stride")
                columns = [batch.column(x).slice(first, many) for x in ("grp", "doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*columns, slices(ids.astype("<u2"), bounds)], names=["grp", "doc_id", "h", "ids"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows without an id: a few groups by text.
    group = F.coalesce(F.floor(F.col("doc_id") / GROUP), F.pmod(F.xxhash64("text"), F.lit(NAMELESS)) - (1 << 60))
    return named.select(group.alias("grp"), "doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(encode, "grp long, doc_id long, h long, ids binary")


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = 2) -> DataFrame:
    """Documents' ids, each followed by `end`, in a row and cut every `length` ids: grp, nth, doc_ids, n_tokens, ids.

    ids: little-endian unsigned 16-bit numbers, the last sequence of a group filled up with zeros; n_tokens: how many
    are real. A null text is empty; a null doc_id is listed as null, and such rows are groups of their own.
    """
    size = 2 * length

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, nth, held, owners, rows = None, 0, bytearray(), [], []

        def row(data: bytes, n: int) -> None:
            rows.append((group, nth, list(owners), n, data))

        for batch in batches:
            for own, doc_id, ids in zip(batch["grp"].array, batch["doc_id"].array, batch["ids"].array, strict=True):
                if own != group:
                    if held:
                        row(bytes(held).ljust(size, b"\0"), len(held) // 2)
                    group, nth, held, owners = own, 0, bytearray(), []
                held += ids
                owners.append(None if pd.isna(doc_id) else int(doc_id))
                while len(held) >= size:
                    row(bytes(held[:size]), length)
                    del held[:size]
                    nth += 1
                    owners = owners[-1:] if held else []
                if len(rows) * size > 2 << 20:
                    yield frame(rows)
                    rows = []
        if held:
            row(bytes(held).ljust(size, b"\0"), len(held) // 2)
        yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["grp", "nth", "doc_ids", "n_tokens", "ids"])

    ordered = encoded(docs, path, end).repartition("grp").sortWithinPartitions("grp", "doc_id", "h")
    return ordered.mapInPandas(cut, "grp long, nth long, doc_ids array<long>, n_tokens int, ids binary")


def slotted(made: DataFrame, key: int, slots: int) -> tuple[DataFrame, int]:
    """Sequences with index (0.., dense), slot, shard and place; and how many there are."""
    counts = made.groupBy("grp").agg(F.count("*").alias("many"))
    bases = before(counts, "grp", "many", "base")
    n, groups = counts.agg(F.coalesce(F.sum("many"), F.lit(0)), F.count("*")).first()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n, key))

    # Else a filter on what follows from the slot has Spark ask for it twice, of two Python workers a task at once.
    slot = slot.asNondeterministic()
    # A number for each group: broadcast while few.
    indexed = made.join(F.broadcast(bases) if groups <= BROADCAST_ROWS else bases, "grp").withColumn("index", F.col("base") + F.col("nth")).drop("base", "grp", "nth")
    placed = indexed.withColumn("slot", slot("index"))
    return placed.withColumns({"shard": F.floor(F.col("slot") / slots), "place": F.col("slot") % slots}), n


def write_shards(placed: DataFrame, n: int, folder: str, slots: int) -> DataFrame:
    """One file a shard under `folder` (a path or URI that every executor reaches); (shard, n, crc32) of the files.

    A file appears under its name only when it is whole, so a repeated task puts the same bytes in place again.
    """
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = fs.FileSystem.from_uri(uri)
        out = temporary = shard = None
        count = crc = 0
        for batch in batches:
            for k, ids in zip(batch["shard"], batch["ids"], strict=True):
                if shard is None:
                    shard, temporary = int(k), f"{at}/.{int(k):08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                out.write(ids)
                count, crc = count + 1, zlib.crc32(ids, crc)
        if out is not None:
            out.close()
            store.move(temporary, f"{at}/shard-{shard:08d}.bin")
            yield pd.DataFrame({"shard": [shard], "n": [count], "crc32": [crc]})

    store, at = fs.FileSystem.from_uri(uri)
    store.create_dir(at, recursive=True)
    shards = -(-n // slots)
    wave, done = -(-shards // WAVES), []
    for first in range(0, shards, wave):
        own = placed.filter((F.col("shard") >= first) & (F.col("shard") < first + wave)).select("shard", "slot", "ids")
        one = own.repartitionById(min(wave, shards - first), (F.col("shard") - first).cast("int")).sortWithinPartitions("slot")
        done.append(staged(one.mapInPandas(write, "shard long, n long, crc32 long"), "shards-written"))
    return functools.reduce(DataFrame.unionByName, done)


def read_shards(spark: SparkSession, folder: str, slots: int, length: int = LENGTH, first: int = 0) -> DataFrame:
    """(slot, ids) of the shards in `folder` from slot `first` on; shards before it are not opened."""
    names = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder).filter(names >= first // slots)
    bound_batches(spark, 4 << 20)
    step = 2 * length

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, data in zip(batch["start"], batch["content"], strict=True):
                yield pd.DataFrame({"slot": range(start, start + len(data) // step), "ids": [data[i : i + step] for i in range(0, len(data), step)]})

    whole = files.filter(F.col("length") > 0).select((names * slots).alias("start"), "content")
    return whole.mapInPandas(cut, "slot long, ids binary").filter(F.col("slot") >= first)


def materialise(docs: DataFrame, path: str, folder: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> DataFrame:
    """Write `docs` (doc_id, text) as shards under `folder`; (slot, shard, place, index, doc_ids, n_tokens) of each.

    Every token is written once. An empty table writes no shard; repeated rows are written as often as they come;
    other columns are not read. The order depends on `key` and on the rows, not on files or partitions.
    """
    made = staged(sequences(docs, path, length), "sequences", "zstd")
    placed, n = slotted(made, key, slots)
    if n:
        written = write_shards(placed, n, folder, slots).agg(F.sum("n")).first()[0]
        if written != n:
            raise RuntimeError(f"{written} of {n} sequences were written")
    index = staged(placed.drop("ids"), "shard-index")
    discard(made)
    return index


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = os.path.join(shared_dir(spark), "reportforge", f"shards-{uuid.uuid4().hex}")
    index = materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE), folder)
    if index.isEmpty():
        return index.withColumn("ids_crc32", F.lit(None).cast("long"))
    digests = read_shards(spark, folder, SLOTS).select("slot", F.crc32("ids").alias("ids_crc32"))
    return index.join(digests, "slot")
