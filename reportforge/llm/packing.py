"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths.

Each piece is a sequence of its own, so no sequence crosses documents and none needs padding; sequences of one
length are numbered in a row (the longest first), so a reader takes buckets of equal lengths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, staged, table
from .wordbpe import slices, words_of

WORD_FILE = "word_bpe_49k.json"
#: Rows of (task, length) numbers, 24 bytes each, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Bytes of ids, about, that a batch of pieces holds.
BATCH = 4 << 20
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, nth long"


def binary_lengths(n: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of `n` tokens: as many of `most` as fit, then n's binary digits, falling."""
    start = 0
    for _ in range(n // most):
        yield start, most
        start += most
    size = most >> 1
    while size:
        if n & size:
            yield start, size
            start += size
        size >>= 1


def pack(docs: DataFrame, path: str, most: int = 4096, end: int = 2) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    `docs` needs doc_id and text; other columns are not read. A null text is empty and gives one piece that holds
    the end id; a null doc_id stays null; repeated rows are packed as often as they come; an empty table gives no
    rows. `most` is a power of two. `ids` holds unsigned little-endian 32-bit numbers.

    Tokens are made once: pieces go to a table in the shared folder with their number within (task, length).
    What is counted over all tasks is one row a task and length, and a running sum of those numbers sequences.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")
    bound_batches(docs.sparkSession, 4 << 20)
    last, names = end.to_bytes(4, "little"), [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, nth = words_of(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, _, ids, bounds in words.runs(batch.column("text"), last):
                rows = []
                for owner, n in enumerate(np.diff(bounds).tolist(), first):
                    for start, length in binary_lengths(n, most):
                        rows += (owner, start, length, n, nth[length])
                        nth[length] += 1
                owner, start, length, n, number = np.array(rows, np.int64).reshape(-1, 5).T
                ends = np.concatenate([[0], np.cumsum(length)])
                # Pieces follow each other in `ids`.
                at = np.unique([*np.searchsorted(ends, np.arange(0, ends[-1], BATCH // 4)), len(owner)])
                for a, b in zip(at[:-1], at[1:], strict=True):
                    columns = [doc_ids.take(pa.array(owner[a:b])), *map(pa.array, (start[a:b], length[a:b], n[a:b])), slices(ids, ends[a : b + 1])]
                    columns += [pa.array(np.full(b - a, part, np.int32)), pa.array(number[a:b])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)
    pieces = staged(pieces, "pieces", "zstd")
    counted = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = W.orderBy(F.desc("length"), "part").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row a task and length: sent to every task while that is known to be small, else joined by a shuffle.
    bases = F.broadcast(bases) if counted.count() <= BROADCAST_ROWS else bases
    return pieces.join(bases, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("base") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def packed_digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_FILE))
