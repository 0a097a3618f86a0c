"""Token counts: texts are encoded batch by batch in an Arrow function that returns lengths only.

Batches are balanced by bytes, and long texts are split at safe boundaries, where no token crosses. In a word-level file
every white space is one, so there the library encodes a batch's distinct words, and a text's count is their sum.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table
from .wordbpe import balanced, is_word_level, safe_parts

WORD_FILE = "word_bpe_49k.json"
#: Bytes of text that one batch holds, and lengths of words that a worker keeps in each of two generations.
BATCH_BYTES, KEEP = 1 << 20, 400_000


class Lengths:
    """Lists of words -> their token counts; the library encodes the words that are not kept, a batch at a time."""

    def __init__(self, encode: Callable[[list[str]], list[int]]) -> None:
        self.encode, self.known, self.old = encode, {}, {}

    def __call__(self, parts: list[bytes]) -> list[int]:
        words = [part.split() for part in parts]
        fresh = {w for own in words for w in own}.difference(self.known)
        again = {w: self.old[w] for w in fresh if w in self.old}
        new = [w for w in fresh if w not in again]
        if len(self.known) + len(fresh) > KEEP:
            self.old, self.known = self.known, {}
            again |= {w: self.old[w] for own in words for w in own if w in self.old}
        self.known |= again
        for run in balanced([len(w) for w in new], BATCH_BYTES):
            self.known |= dict(zip(new[run], self.encode([w.decode() for w in new[run]]), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, own)) for own in words]


def spaced_parts(before: str) -> Callable[[bytes], Iterator[bytes]]:
    """Cuts a long text where one blank stands between two ASCII letters; the blank goes with `before` or is dropped."""
    spot = regex.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")

    def parts(data: bytes) -> Iterator[bytes]:
        start = 0
        while len(data) - start > BATCH_BYTES:
            found = spot.search(data, start + BATCH_BYTES)
            if not found:
                break
            yield data[start : found.start()]
            start = found.end() - len(before)
        yield data[start:]

    return parts


#: Texts that tell whether a file's tokens cross a single blank between two letters.
PROBES = [("The lake", "is deep"), ("a", "b"), ("x. And then", "we don't"), ("12 cats", "sat down"), ("na\u00efve caf\u00e9 in", "two  parts\n\nhere"), ("it", "it")]
_counters: dict = {}


def counter(path: str) -> tuple[Callable[[bytes], Iterator[bytes]], Callable[[list[bytes]], list[int]]]:
    """(parts of a text, token counts of parts), by the library that reads `path` (.json or .model)."""
    if path in _counters:
        return _counters[path]
    if path.endswith(".model"):
        import sentencepiece

        model, before = sentencepiece.SentencePieceProcessor(model_file=path), ""
        encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    else:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer, before = Tokenizer.from_file(path), " "
        tokenizer.no_truncation()
        tokenizer.no_padding()
        encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".json") and is_word_level(json.load(open(path))):
        _counters[path] = (lambda data: safe_parts(data, BATCH_BYTES)), Lengths(encode)
    else:
        whole, apart = encode([f"{a} {b}" for a, b in PROBES]), zip(encode([a for a, _ in PROBES]), encode([before + b for _, b in PROBES]), strict=True)
        safe = whole == [x + y for x, y in apart]
        _counters[path] = (spaced_parts(before) if safe else lambda data: iter([data])), lambda parts: encode([x.decode() for x in parts])
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Every row gives one row. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay repeated; no other
    column is read, and a column of `docs` with the name of a result is replaced. No shuffle: the scan's partitions
    are encoded where they lie, in runs balanced by bytes. Long texts are cut at white space in a word-level file, and
    elsewhere at a blank between letters where probes show that no token crosses it; else they stay whole.
    """
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut, measure = counter(path)
        for batch in batches:
            owners, parts, totals = [], [], [0] * len(batch)
            for i, x in enumerate(batch.array):
                if not pd.isna(x):
                    for part in cut(x.encode()):
                        owners.append(i)
                        parts.append(part)
            for run in balanced([len(x) for x in parts], BATCH_BYTES):
                for i, n in zip(owners[run], measure(parts[run]), strict=True):
                    totals[i] += n
            yield pd.Series(totals, dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumns({"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": count(F.col(text))})
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(WORD_FILE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
