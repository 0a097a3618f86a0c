"""Which rows share runs of words: classes of runs with the same holders, from packed arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work

U = np.uint64
#: Bytes of text that are cut into words at a time; runs of a block that is dealt out; rows of a block at most.
SLICE, BLOCK, ROWS = 1 << 22, 1 << 20, 1 << 16
#: Ranges of hashes for each shuffle partition, and runs of a range that are compared at a time.
RANGES, TOGETHER = 3, 1 << 21
IN_WORD = np.isin(np.arange(256), [*b"abcdefghijklmnopqrstuvwxyz0123456789"])
ODD = U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


SIGNS = mixed(np.arange(1, 257, dtype=U) * ODD)


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word [a-z0-9]+ of lower-cased texts, in order; and how many words each text has."""
    at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    said = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    held = IN_WORD[said]
    first, last = held.copy(), held.copy()
    first[1:] &= ~held[:-1]
    last[:-1] &= ~held[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(said))]  # words end where their text ends
    first[edges], last[edges - 1] = held[edges], held[edges - 1]
    begin = np.flatnonzero(first)
    long = np.flatnonzero(last) - begin + 1
    h, live, k = np.zeros(len(begin), U), np.arange(len(begin)), 0
    while len(live):
        h[live] = (h[live] ^ SIGNS[said[begin[live] + k]]) * ODD
        k += 1
        live = live[long[live] > k]
    return mixed(h), np.diff(np.searchsorted(begin, at))


def runs(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each text's distinct runs of n words; a shorter text is one run, a text without words has none."""
    h, many = words(text)
    first = np.cumsum(many) - many
    row = np.repeat(np.arange(len(many)), many)
    whole = max(0, len(h) - n + 1)
    x = np.zeros(whole, U)
    for k in range(n):
        x = (x + h[k : k + whole]) * ODD
        x ^= x >> U(29)
    inside = row[:whole] == row[n - 1 : n - 1 + whole] if whole else np.zeros(0, bool)
    short = np.flatnonzero((many > 0) & (many < n))
    y = many[short].astype(U)
    for k in range(n - 1):
        more = many[short] > k
        y[more] = (y[more] + h[first[short[more]] + k]) * ODD
        y ^= y >> U(29)
    x, row = np.concatenate([mixed(x[inside]), mixed(~y)]), np.concatenate([row[:whole][inside], short])
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], row[new]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by SLICE bytes of text or so."""
    at = np.frombuffer(batch.column("t").buffers()[1], np.int32)[batch.column("t").offset :][: batch.num_rows + 1].astype(np.int64)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, min(low + ROWS, int(np.searchsorted(at, at[low] + SLICE, "right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def packed(h: np.ndarray) -> bytes:
    """Sorted numbers by planes of bytes: the high ones are runs, which the shuffle's compression takes away."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def shared_runs(rows: DataFrame, id_: str, text: str, n: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """(class, id, w, df) and (id, size): the runs of n lower-cased words [a-z0-9]+ that more than one id holds.

    A text of fewer words is one run, a text without words (or null) has none; equal ids hold their texts together. Runs
    with the same holders are one class: `w` is their number, `df` that of their holders, `size` an id's number of distinct
    runs, shared or not. Ids are longs that are not null.

    Rows are numbered as they are read. A task sends its runs by ranges of hashes, as sorted arrays of 64-bit hashes and
    of places of rows (two bytes); a range's task finds the runs that several rows hold, and names a class by
    the sums of two hashes of its holders. So no run is a row, and a class is one for each range that holds some of it.
    """
    ranges = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, ids = [], 0, []

        def block() -> Iterator[pa.RecordBatch]:
            base = ids[0][0][0]
            h, row = np.concatenate([x for x, _ in held]), np.concatenate([r for _, r in held])
            size = np.bincount(row, minlength=sum(len(i) for i, _ in ids))
            order = np.argsort(h)
            h, row = h[order], row[order].astype("<u2")
            at = np.searchsorted(((h >> U(32)) * U(ranges)) >> U(32), np.arange(ranges + 1))
            full = [r for r in range(ranges) if at[r + 1] > at[r]]
            told = np.stack([np.concatenate([i for i, _ in ids]), np.concatenate([k for _, k in ids]), size])
            keys = [*full, -1 - int(base % ranges)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int32()), pa.array([base] * len(keys), pa.int64()),
                pa.array([*[packed(h[at[r] : at[r + 1]]) for r in full], told.astype("<i8").tobytes()], pa.binary()),
                pa.array([*[row[at[r] : at[r + 1]].tobytes() for r in full], b""], pa.binary()),
            ], ["range", "base", "runs", "places"])

        for batch in batches:
            for part in slices(batch):
                number = part.column("number").to_numpy()
                many = sum(len(i) for i, _ in ids)
                if ids and (some >= BLOCK or many + len(number) > ROWS or number[0] != ids[0][0][0] + many):
                    yield from block()
                    held, some, ids, many = [], 0, [], 0
                x, row = runs(part.column("t"), n)
                held.append((x, row + many))
                ids.append((number, part.column("id").to_numpy()))
                some += len(x)
        if ids:
            yield from block()

    def met(group: pa.Table) -> pa.Table:
        """Of a range: (a, b, w, holders) of each class; of rows: (number, id, size, null)."""
        key, base = group.column("range")[0].as_py(), group.column("base").to_pylist()
        load = group.column("runs").to_pylist()
        if key < 0:
            told = np.concatenate([np.frombuffer(b, "<i8").reshape(3, -1) for b in load], axis=1)
            return pa.table({"a": told[0], "b": told[1], "w": told[2], "holders": pa.nulls(told.shape[1], pa.list_(pa.int64()))})
        parts = [unpacked(b) for b in load]
        places = [np.frombuffer(b, "<u2") for b in group.column("places").to_pylist()]
        del load
        low, high = -(-(key << 64) // ranges), -(-((key + 1) << 64) // ranges)
        cuts = max(1, -(-sum(map(len, parts)) // TOGETHER))
        edges = [low + (high - low) * k // cuts for k in range(cuts)]
        spots = [np.array([*np.searchsorted(p, np.array(edges, U)), len(p)]) for p in parts]
        spots = [np.concatenate([[0], s[1:]]) for s in spots]
        out = [classes(np.concatenate([p[s[k] : s[k + 1]] for p, s in zip(parts, spots, strict=True)]), np.concatenate([x[s[k] : s[k + 1]].astype(np.int64) + b for x, b, s in zip(places, base, spots, strict=True)])) for k in range(cuts)]
        return pa.concat_tables(out)

    own = rows.filter(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.monotonically_increasing_id().alias("number"))
    sent = own.mapInArrow(dealt, "range int, base long, runs binary, places binary")
    found = work.write(sent.groupBy("range").applyInArrow(met, "a long, b long, w long, holders array<long>"))
    one = found.filter("holders is not null").groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("holders").alias("holders"))
    one = work.write(one.select(F.monotonically_increasing_id().alias("class"), "w", "holders"))
    named = found.filter("holders is null").select(F.col("a").alias("number"), F.col("b").alias("id"), F.col("w").alias("size"))
    posts = one.select("class", "w", F.explode("holders").alias("number")).join(named, "number").select("class", "w", "number", "id")
    return sized(posts, named, work)


def sized(posts: DataFrame, named: DataFrame, work: Work) -> tuple[DataFrame, DataFrame]:
    """Classes by ids in place of rows: rows of one id hold a class once, and a class of one id is that id's alone."""
    per_row = posts.groupBy("number").agg(F.sum("w").alias("shared"))
    alone = named.join(per_row, "number", "left").groupBy("id").agg(F.sum(F.col("size") - F.coalesce("shared", F.lit(0))).alias("alone"))
    ids = posts.groupBy("class", "id").agg(F.max("w").alias("w"))
    df = ids.groupBy("class").agg(F.count("*").alias("df"))
    ids = work.write(ids.join(df, "class"))
    size = work.write(alone.join(ids.groupBy("id").agg(F.sum("w").alias("shared")), "id", "left").select("id", (F.col("alone") + F.coalesce("shared", F.lit(0))).alias("size")))
    return ids.filter("df > 1"), size


def classes(h: np.ndarray, number: np.ndarray) -> pa.Table:
    """(a, b, w, holders) of the runs that several rows hold: one for all runs of the same holders."""
    order = np.argsort(h, kind="stable")
    h, number = h[order], number[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(h)))
    begin, many = begin[many > 1], many[many > 1]
    if not len(begin):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "holders": pa.array([], pa.list_(pa.int64()))})
    ends = np.cumsum(many)
    spot = np.repeat(begin - (ends - many), many) + np.arange(ends[-1])
    one = mixed(number[spot].astype(U) * ODD + U(1))
    a, b = np.add.reduceat(one, ends - many), np.add.reduceat(mixed(one ^ U(0x5851F42D4C957F2D)), ends - many)
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    first = order[new]
    w = np.diff(np.append(np.flatnonzero(new), len(order)))
    stop = np.cumsum(many[first])
    spot = np.repeat(begin[first] - (stop - many[first]), many[first]) + np.arange(stop[-1])
    holders = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(number[spot], pa.int64()))
    return pa.table({"a": a[first].view(np.int64), "b": b[first].view(np.int64), "w": w.astype(np.int64), "holders": holders})
