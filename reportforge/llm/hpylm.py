"""Language-model scoring by a hierarchical Pitman-Yor model of two levels.

Every previous word (or the start of a text) is a context restaurant; all of them share one parent, the root, whose
base is uniform over the training vocabulary and one unknown word. Customers of a context's dish are its bigram's
occurrences; its tables are customers of the root. Gibbs sweeps draw each (context, word) cell's tables from their exact
law given the tables of everything else (seating.py), contexts first, then the root; cells of one sweep are drawn side by
side, given all others after the sweep before. Predictive probabilities are averaged over the last sweeps. Discounts come
from the corpus: n1 / (n1 + 2 * n2), of cells held once and twice, between 0.2 and 0.95.

How it is dealt out: each scan task cuts its documents into blocks, once, as numbers of the block's own words; texts are
neither shuffled nor read again. A block sends its distinct words, then its distinct bigrams, as packed arrays by hash
range; each range adds the blocks' training counts and sends numbers back in the order asked. A block never sends more
messages than it has distinct keys, so they stay linear in the text. One block owns each cell of two or more customers
and seats it; a cell of one customer has one table. As predictive probabilities are linear in a cell's tables, blocks that
score a cell are sent the sum of its tables over the samples. Seating draws a random number from a hash of (cell, sweep),
so a lost task gives the same tables again. Only totals over the corpus reach the driver. Tables that are no
longer read are deleted on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, range_edges, staged, table
from .seating import MIX, mixed, seat

#: Bytes of text of a block, and bytes of corpus for each hash range of words and of bigrams.
BLOCK, WORDS, BIGRAMS = 12 << 20, 128 << 20, 64 << 20
#: Strength of contexts and of the root.
CONTEXT, ROOT = 2.0, 1.0
#: Sweeps in all, and how many of the last are averaged.
SWEEPS, SAMPLES = 5, 3
END, START = xxhash.xxh64_intdigest(b"\nend"), xxhash.xxh64_intdigest(b"\nstart")  # no word holds a line feed


def bigram_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(contexts * MIX[0] + np.uint64(1)) + words)


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative integers, byte plane by byte plane, compressed."""
    a = np.ascontiguousarray(numbers).astype("<u8")
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.int64)


def root_probability(customers: np.ndarray, tables: np.ndarray, total: tuple[int, int], kinds: int, discount: float) -> np.ndarray:
    return (customers - discount * tables + (ROOT + discount * total[1]) / (kinds + 1)) / (ROOT + total[0])


def discount_of(once: int, twice: int) -> float:
    """Of what is held once and twice; a half where nothing tells."""
    return min(0.95, max(0.2, once / (once + 2 * twice))) if once else 0.5


BLOCKS = "block long, size long, ids binary, nulls binary, held binary, lengths binary, hashes binary, counts binary, tokens binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row a block of documents (doc_id, text, held): their tokens as numbers of the block's words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0

        def block() -> pd.DataFrame:
            lengths = np.array([len(d) for d in docs], np.int64)
            flat, mask = np.concatenate(docs), np.array(held, bool)
            counts = np.bincount(flat[np.repeat(~mask, lengths)], minlength=len(hashes))
            counts[1] = int((~mask).sum())
            ids = [0 if pd.isna(d) else int(d) for d in names]
            return pd.DataFrame([(
                (part << 24) + nth, size, np.array(ids, "<i8").tobytes(), np.array([pd.isna(d) for d in names], np.uint8).tobytes(), mask.astype(np.uint8).tobytes(),
                packed(lengths), np.array(hashes, "<u8").tobytes(), packed(counts), packed(flat),
            )], columns=["block", "size", "ids", "nulls", "held", "lengths", "hashes", "counts", "tokens"])

        docs: list[np.ndarray] = []
        for batch in batches:
            for doc_id, text, out in zip(batch["doc_id"].array, batch["text"].array, batch["held"].array, strict=True):
                if not docs:
                    hashes, names, held, size = [END, START], [], [], 0

                    class Numbers(dict):
                        def __missing__(self, word: bytes) -> int:
                            hashes.append(xxhash.xxh64_intdigest(word))  # noqa: B023
                            self[word] = n = len(hashes) - 1  # noqa: B023
                            return n

                    get = Numbers().__getitem__
                data = ("" if text is None else text).encode()
                words = data.lower().split()
                docs.append(np.fromiter((*map(get, words), 0), np.int32, len(words) + 1))
                names.append(doc_id)
                held.append(out)
                size += len(data) + 16
                if size >= BLOCK:
                    yield block()
                    docs, nth = [], nth + 1
        if docs:
            yield block()

    return docs.mapInPandas(cut, BLOCKS)


class Block:
    """A block: places in the order of its words' hashes, and its tokens and their contexts as such places."""

    def __init__(self, row: pd.Series) -> None:
        self.number = int(row["block"])
        hashes = np.frombuffer(row["hashes"], "<u8")
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.hashes, self.counts = hashes[order], unpacked(row["counts"])[order]
        self.words = place[unpacked(row["tokens"])]
        self.lengths = unpacked(row["lengths"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.contexts = np.empty_like(self.words)
        self.contexts[1:] = self.words[:-1]
        self.contexts[self.starts] = place[1]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.ids = pd.array(np.frombuffer(row["ids"], "<i8").copy(), "Int64")
        self.ids[np.frombuffer(row["nulls"], np.uint8).astype(bool)] = pd.NA

    def bigrams(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct bigrams of known words: keys (sorted), contexts, words; and each token's bigram, -1 for none."""
        could = np.flatnonzero(known[self.contexts] & known[self.words])
        keys = bigram_keys(self.hashes[self.contexts[could]], self.hashes[self.words[could]])
        order = np.argsort(keys)
        keys, could = keys[order], could[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        of = np.full(len(self.words), -1, np.int64)
        of[could] = np.cumsum(new) - 1
        first = could[new]
        return keys[new], self.contexts[first], self.words[first], of


SENT = "kind string, block long, range int, a binary, b binary, c binary, n long, m long, once long, twice long"
CELLS = "block long, words long, edges binary, by_word binary, by_context binary, seeds binary, contexts binary, dishes binary, counts binary, ranges binary, spread binary"


def sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "range", "a", "b", "c", "n", "m", "once", "twice"])


def message(kind: str, block: int, number: int, *parts: np.ndarray) -> tuple:
    return (kind, block, number, *map(packed, parts), *[b""] * (3 - len(parts)), 0, 0, 0, 0)


def totals_row(number: int, *sums: int) -> tuple:
    return ("total", -1, number, b"", b"", b"", *map(int, sums), *[0] * (4 - len(sums)))


def asked(block: int, keys: np.ndarray, bits: int, counts: np.ndarray) -> pd.DataFrame:
    """A block's sorted keys and their training counts by hash range. Of a key, the 48 bits behind the range's are sent."""
    edges, short = range_edges(keys, bits), (keys << np.uint64(bits)) >> np.uint64(16)
    rows = []
    for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            rows.append(message("ask", block, r, np.diff(short[a:b], prepend=np.uint64(0)), counts[a:b]))
    return sent(rows)


def gathered(rows: pd.DataFrame, kind: str, column: str = "a") -> np.ndarray:
    """A block's numbers of one kind, in the order of their ranges."""
    own = rows[rows["kind"] == kind].sort_values("range")
    return np.concatenate([np.empty(0, np.int64), *map(unpacked, own[column])])


def merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All different keys of a range in order, where each asked key is among them, and where each block's keys end."""
    keys = [np.cumsum(unpacked(x)) for x in group["a"]]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, at, np.cumsum([len(k) for k in keys])[:-1]


def bits_for(total: int, each: int) -> int:
    return max(0, math.ceil(math.log2(max(1.0, total / each))))


def summed(found: DataFrame) -> tuple[int, int, int, int]:
    """Totals over all ranges."""
    return tuple(found.filter("kind = 'total'").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "m", "once", "twice")]).first())


def lm_scores(docs: DataFrame, fold: int = 1, folds: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs` (doc_id, text).

    Held out are rows whose crc32(doc_id as text) mod `folds` is `fold`; all others are learnt from. A null doc_id is
    learnt from. A null or empty text is its end alone, one token. Repeated rows count as often as they come, and each
    is scored. Without any training row base_score and score take every token as unknown. No other column is read.
    base_score is exact; score is log10 of the model's averaged predictive probabilities. The model sums to one over
    the training vocabulary and one unknown word.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    blocks = staged(blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))), "lm-blocks")
    size = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits, bits2 = bits_for(size, WORDS), bits_for(size, BIGRAMS)
    grouped = lambda frame: frame.groupBy("block")

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, hashes, counts in zip(batch["block"], batch["hashes"], batch["counts"], strict=True):
                hashes = np.frombuffer(hashes, "<u8")
                order = np.argsort(hashes)
                yield asked(number, hashes[order], bits, unpacked(counts)[order])

    asks = staged(blocks.select("block", "hashes", "counts").mapInPandas(ask_words, SENT), "lm-words")
    start = int((np.uint64((START << bits) % (1 << 64)) >> np.uint64(16)))

    def count_words(group: pd.DataFrame) -> pd.DataFrame:
        distinct, at, ends = merged(group)
        number = int(group["range"].iloc[0])
        counts = np.bincount(at, np.concatenate([unpacked(x) for x in group["b"]]), len(distinct)).astype(np.int64)
        own = counts[(distinct != start) | (number != (START >> (64 - bits) if bits else 0))]
        rows = [message("word", b, number, p) for b, p in zip(group["block"], np.split(counts[at], ends), strict=True)]
        return sent([*rows, totals_row(number, own.sum(), (own > 0).sum())])

    vocabulary = staged(asks.groupBy("range").applyInPandas(count_words, SENT), "lm-vocabulary")
    tokens, kinds, _, _ = summed(vocabulary)
    words = vocabulary.filter("kind = 'word'")

    def ask_bigrams(frame: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return sent([])
        block = Block(frame.iloc[0])
        keys, _, _, of = block.bigrams(gathered(rows, "word") > 0)
        learnt = of[block.train]
        return asked(block.number, keys, bits2, np.bincount(learnt[learnt >= 0], minlength=len(keys)))

    def count_bigrams(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        distinct, at, ends = merged(group)
        own = np.concatenate([unpacked(x) for x in group["b"]])
        counts = np.bincount(at, own, len(distinct)).astype(np.int64)
        first = np.full(len(distinct), len(at), np.int64)
        learnt = np.flatnonzero(own)[::-1]
        first[at[learnt]] = learnt  # the last written is the first that learnt it
        told, ranks = (np.split(x, ends) for x in (counts[at] * 2 + (first[at] == np.arange(len(at))), at))
        number = int(group["range"].iloc[0])
        rows = [message("pair", b, number, x, np.diff(y, prepend=0)) for b, x, y in zip(group["block"], told, ranks, strict=True)]
        return sent([*rows, totals_row(number, 0, 0, (counts == 1).sum(), (counts == 2).sum())])

    counted = grouped(blocks).cogroup(grouped(words)).applyInPandas(ask_bigrams, SENT).groupBy("range").applyInPandas(count_bigrams, SENT)
    counted = staged(counted, "lm-pairs")
    pairs, discount = counted.filter("kind = 'pair'"), discount_of(*summed(counted)[2:])

    def own_cells(frame: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """The cells that a block owns: those of several customers in the order of their keys, and sums of those of one."""
        if not len(frame):
            return pd.DataFrame(columns=[c.split()[0] for c in CELLS.split(", ")])
        block = Block(frame.iloc[0])
        keys, contexts, dishes, _ = block.bigrams(gathered(rows, "word") > 0)
        own = rows[rows["kind"] == "pair"].sort_values("range")
        told, n = [unpacked(x) for x in own["a"]], len(block.hashes)
        pair = np.concatenate([np.empty(0, np.int64), *told])
        one, more = (pair & 1 > 0) & (pair >> 1 == 1), np.flatnonzero(owned(pair))
        return pd.DataFrame([(
            block.number, n, packed(range_edges(block.hashes, bits)), packed(np.bincount(dishes[one], minlength=n)), packed(np.bincount(contexts[one], minlength=n)),
            (keys[more] >> np.uint64(32)).astype("<u4").tobytes(), packed(contexts[more]), packed(dishes[more]), packed(pair[more] >> 1),
            packed(own["range"].to_numpy()), packed(np.array([owned(x).sum() for x in told], np.int64)),
        )], columns=[c.split()[0] for c in CELLS.split(", ")])

    cells = staged(grouped(blocks).cogroup(grouped(words.unionByName(pairs))).applyInPandas(own_cells, CELLS), "lm-cells")

    def sums(own: pd.Series, tables: np.ndarray | None, chosen: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
        """Tables of a block's own cells by word and by context, in the order that it asked in."""
        edges, n = unpacked(own["edges"]), int(own["words"])
        add = lambda one, at: unpacked(own[one]) + np.bincount(at, tables, n).astype(np.int64)
        by_word, by_context = add("by_word", chosen[1]), add("by_context", chosen[0])
        return sent([message("sum", own["block"], r, by_word[a:b], by_context[a:b]) for r, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a])

    def chosen(own: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        return unpacked(own["contexts"]), unpacked(own["dishes"])

    def first_sums(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.iloc[0]
        return sums(own, None, chosen(own))

    def root(sweep: int, all_tables: int, root_discount: float):
        def seat_root(ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(ask):
                return sent([])
            ask, rows = ask.sort_values("block"), rows.sort_values("block")
            distinct, at, ends = merged(ask)
            number = int(ask["range"].iloc[0])
            add = lambda c: np.bincount(at, np.concatenate([unpacked(x) for x in rows[c]]), len(distinct)).astype(np.int64)
            customers, context_tables = add("a"), add("b")
            tables = (customers > 0).astype(np.int64)
            if sweep:
                rate = np.full(len(distinct), (ROOT + root_discount * all_tables) / (kinds + 1))
                tables = seat(customers, rate, root_discount, root_keys(distinct, number, bits), sweep)
            parts = zip(ask["block"], *(np.split(x[at], ends) for x in (customers, tables, context_tables)), strict=True)
            rows = [message(f"s{sweep}", b, number, *x) for b, *x in parts]
            return sent([*rows, totals_row(number, customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum())])

        return seat_root

    totals, replies, root_discount = [], [], 0.5

    def rates(rows: pd.DataFrame, sweep: int, total: tuple[int, int], of_root: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a block: its probability at the root, and strength + discount * tables as a context."""
        customers, tables, context_tables = (gathered(rows, f"s{sweep}", c) for c in "abc")
        return root_probability(customers, tables, total, kinds, of_root), CONTEXT + discount * context_tables

    def sweep_cells(sweep: int, total: tuple[int, int], of_root: float):
        def seat_cells(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return sent([])
            own = own.iloc[0]
            contexts, dishes = chosen(own)
            chance, mass = rates(rows, sweep - 1, total, of_root)
            tables = seat(unpacked(own["counts"]), mass[contexts] * chance[dishes], discount, np.frombuffer(own["seeds"], "<u4"), sweep)
            out = sums(own, tables, (contexts, dishes))
            if sweep <= SWEEPS - SAMPLES:
                return out
            parts = np.split(tables, np.cumsum(unpacked(own["spread"]))[:-1])
            return pd.concat([out, sent([message("tables", own["block"], r, x) for r, x in zip(unpacked(own["ranges"]), parts, strict=True) if len(x)])])

        return seat_cells

    seated = [staged(grouped(cells).applyInPandas(first_sums, SENT), "lm-seated0")]
    for sweep in range(SWEEPS + 1):
        made = seated[sweep].filter("kind = 'sum'").groupBy("range")
        found = asks.groupBy("range").cogroup(made).applyInPandas(root(sweep, totals[-1][1] if totals else 0, root_discount), SENT)
        found = staged(found, f"lm-sweep{sweep}")
        *total, once, twice = summed(found)
        root_discount = root_discount if sweep else discount_of(once, twice)
        totals.append(tuple(total))
        replies.append(found)
        if sweep <= SWEEPS - SAMPLES:
            discard(seated[sweep], *replies[max(0, sweep - 1) : sweep])
        if sweep < SWEEPS:
            state = found.filter("kind <> 'total'")
            new = grouped(cells).cogroup(grouped(state)).applyInPandas(sweep_cells(sweep + 1, totals[-1], root_discount), SENT)
            seated.append(staged(new, f"lm-seated{sweep + 1}"))

    def sum_tables(group: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Of each block's keys of several customers: the cell's tables over all samples, from the block that owns it."""
        told = {b: unpacked(x) for b, x in zip(group["block"], group["a"], strict=True)}
        ranks = {b: np.cumsum(unpacked(x)) for b, x in zip(group["block"], group["b"], strict=True)}
        of = np.zeros(1 + max((int(x.max(initial=0)) for x in ranks.values()), default=0), np.int64)
        for b, x in zip(rows["block"], rows["a"], strict=True):
            of[ranks[b][owned(told[b])]] += unpacked(x)
        return sent([message("tables", b, int(group["range"].iloc[0]), of[ranks[b][told[b] >> 1 > 1]]) for b in told])

    tables = seated[SWEEPS - SAMPLES + 1].filter("kind = 'tables'")
    for more in seated[SWEEPS - SAMPLES + 2 :]:
        tables = tables.unionByName(more.filter("kind = 'tables'"))
    tables = staged(pairs.groupBy("range").cogroup(tables.groupBy("range")).applyInPandas(sum_tables, SENT), "lm-tables")
    discard(asks, cells, replies[SWEEPS - SAMPLES], *seated[SWEEPS - SAMPLES + 1 :])

    samples = range(SWEEPS - SAMPLES + 1, SWEEPS + 1)

    def score(frame: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
        block = Block(frame.iloc[0])
        count = gathered(rows, "word")
        _, _, _, of = block.bigrams(count > 0)
        customers = gathered(rows, "pair") >> 1
        below = np.minimum(customers, 1) * len(samples)
        below[customers > 1] = gathered(rows, "tables")
        could, seen = of >= 0, count[block.contexts] > 0
        chance_of = np.zeros(len(block.words))
        for sweep in samples:
            chance, mass = rates(rows, sweep, totals[sweep], root_discount)
            of_word = np.where(count > 0, chance, root_probability(np.int64(0), np.int64(0), totals[sweep], kinds, root_discount))[block.words]
            chance_of += np.where(seen, mass[block.contexts] * of_word / (CONTEXT + count[block.contexts]), of_word)
        chance_of[could] += ((customers * len(samples) - discount * below)[of[could]]) / (CONTEXT + count[block.contexts[could]])
        logs = np.log10(chance_of / len(samples))
        base = np.log10((count + 0.5) / (tokens + 0.5 * (kinds + 1)))[block.words]
        return pd.DataFrame({
            "doc_id": block.ids, "held_out": block.held, "n_tokens": block.lengths,
            "n_known": np.add.reduceat((count > 0)[block.words].astype(np.int64), block.starts), "train_tokens": tokens,
            "base_score": np.add.reduceat(base, block.starts), "score": np.add.reduceat(logs, block.starts),
        })

    told = words.unionByName(pairs).unionByName(tables)
    for reply in replies[SWEEPS - SAMPLES + 1 :]:
        told = told.unionByName(reply.filter("kind <> 'total'"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return grouped(blocks).cogroup(grouped(told)).applyInPandas(score, out)


def owned(pair: np.ndarray) -> np.ndarray:
    """Which of a block's keys are cells of several customers that it owns."""
    return (pair & 1 > 0) & (pair >> 1 > 1)


def root_keys(short: np.ndarray, number: int, bits: int) -> np.ndarray:
    """Random seeds of words: what is sent of their hashes, and the range."""
    return short.astype(np.uint64) + (np.uint64(number << (64 - bits) if bits else 0))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
