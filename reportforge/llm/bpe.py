"""Byte-level BPE by recursive SQL: DuckDB contracts token positions inside each Spark partition.

A partition's texts are cut by the published pattern. Its distinct pieces go to DuckDB as rows (word, position, token);
a recursive query joins neighbours to the merge table and contracts each word's leftmost pair of the lowest rank until
no pair is left. Pieces are encoded once a worker, and ordered aggregation decodes their ids; a text's are its pieces' in a row.

A long piece without a break (a run of letters, say) would take as many steps as it has letters, each over all of it. It is
cut first, where that changes nothing: overlapping chunks are encoded, and where two neighbours hold the same token at the
same place, the piece is cut before that token. A row of tokens of which all neighbours are as the encoding of some text has
them is the encoding of its own text, so the parts' ids in a row are the piece's.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Pieces that a worker keeps, bytes of pieces that one recursion takes, and occurrences that one aggregation takes.
KEEP, ROUND, SPAN = 1_200_000, 600_000, 500_000
#: Bytes of a piece that is cut before it is encoded, and of half a chunk.
LONG, HOP = 256, 64
#: Contractions of a word in one recursive query; longer words go through several, so its rows stay bounded.
STEPS = 48
#: Positions in a word are below this number.
WIDE = 1 << 32

CONTRACT = f"""
WITH RECURSIVE r AS (
  SELECT word, 0 AS step, pos, tok FROM parts
  UNION ALL
  (WITH pair AS (
    SELECT n.word, m.tok::BIGINT * {WIDE} + n.pos AS score, n.follows
    FROM (SELECT word, pos, tok, lead(tok) OVER w AS after, lead(pos) OVER w AS follows FROM r WINDOW w AS (PARTITION BY word ORDER BY pos)) n
    JOIN merges m ON m.a = n.tok AND m.b = n.after
  ), best AS (SELECT word, min(score) AS score, arg_min(follows, score) AS gone FROM pair GROUP BY word)
  SELECT r.word, r.step + 1, r.pos, CASE WHEN r.pos = b.score % {WIDE} THEN (b.score // {WIDE})::INTEGER ELSE r.tok END
  FROM r JOIN best b ON b.word = r.word WHERE r.pos <> b.gone AND r.step < {STEPS})
)
SELECT word, step, pos, tok FROM r JOIN (SELECT word, max(step) AS last FROM r GROUP BY word) l USING (word) WHERE step = last
"""

DECODED = "SELECT word, count(*) AS n, string_agg(hex, '' ORDER BY pos) AS hex FROM tokens t JOIN spelling s ON s.tok = t.tok GROUP BY word ORDER BY word"


class Codec:
    """The ranks of a .tiktoken file in DuckDB, and the pieces that this worker has encoded."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        # White space as the standard defines it, as the library's own engine does.
        self.cut = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = {t: r for t, r in ranks.items() if len(t) > 1}
        self.con = con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        a, b, tok = (np.array(x, np.int32) for x in zip(*merges, strict=True))
        frame = pd.DataFrame({"a": a, "b": b, "tok": tok})  # noqa: F841
        con.execute("CREATE TABLE merges AS SELECT * FROM frame")
        spelled = pd.DataFrame({"tok": list(ranks.values()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        con.execute("CREATE TABLE spelling AS SELECT tok::INTEGER AS tok, hex FROM spelled")
        self.reset()

    def reset(self) -> None:
        self.words: dict[str | bytes, int] = {}
        self.chunks: dict[bytes, list[tuple[int, int]]] = {}
        self.ids: list[str] = []
        self.sizes, self.decoded = array("i"), []

    def contracted(self, words: list[tuple[int, bytes]]) -> pd.DataFrame:
        """(word, pos, tok) of the words' tokens, in order."""
        sizes = np.array([len(b) for _, b in words], np.int64)
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts = pd.DataFrame({
            "word": np.repeat(np.array([w for w, _ in words], np.int32), sizes), "pos": np.arange(int(sizes.sum()), dtype=np.int64) - starts,
            "tok": self.bytes[np.frombuffer(b"".join(b for _, b in words), np.uint8)],
        })
        done = [parts.iloc[:0]]
        while len(parts):
            self.con.register("parts", parts)
            found = self.con.execute(CONTRACT).df()
            open_words = found["step"] == STEPS
            done.append(found.loc[~open_words, ["word", "pos", "tok"]])
            parts = found.loc[open_words, ["word", "pos", "tok"]]
        return pd.concat(done).astype({"word": "int32", "pos": "int64", "tok": "int32"}).sort_values(["word", "pos"], ignore_index=True)

    def encode(self, words: list[tuple[int, bytes]]) -> None:
        whole = pd.DataFrame([(w, 0, self.whole[b]) for w, b in words if b in self.whole], columns=["word", "pos", "tok"])
        tokens = pd.concat([whole.astype({"word": "int32", "pos": "int64", "tok": "int32"}), self.contracted([(w, b) for w, b in words if b not in self.whole])])
        self.con.register("tokens", tokens)
        found = self.con.execute(DECODED).fetchnumpy()
        self.sizes.extend(found["n"].tolist())
        self.decoded += map(bytes.fromhex, found["hex"])
        tokens = tokens.sort_values(["word", "pos"], ignore_index=True)
        starts = np.flatnonzero(tokens["word"].diff().ne(0))
        spelled = list(map(str, tokens["tok"]))
        self.ids += [" ".join(spelled[a:b]) for a, b in zip(starts, [*starts[1:], len(spelled)], strict=True)]

    def spans(self, chunks: list[bytes]) -> list[list[tuple[int, int]]]:
        """(start, end) of every chunk's tokens. Chunks of late are kept, as runs repeat them."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        if len(self.chunks) + len(new) > 4096:
            self.chunks = {c: self.chunks[c] for c in chunks if c in self.chunks}
        for i in range(0, len(new), ROUND // (4 * HOP)):
            some = new[i : i + ROUND // (4 * HOP)]
            tokens = self.contracted(list(enumerate(some)))
            for (_, own), c in zip(tokens.groupby("word"), some, strict=True):
                starts = own["pos"].tolist()
                self.chunks[c] = list(zip(starts, [*starts[1:], len(c)], strict=True))
        return [self.chunks[c] for c in chunks]

    def parts(self, data: bytes) -> list[bytes]:
        """A long piece in parts whose encodings in a row are its own."""
        starts = list(range(0, len(data) - HOP, HOP))
        cuts, at = [0], 0
        for i in range(0, len(starts), 2048):
            some = starts[i : i + 2048]
            for start, own in zip(some, self.spans([data[s : s + 2 * HOP] for s in some]), strict=True):
                if start:
                    held = [(a + at, b + at) for a, b in now if a + at >= start]
                    same = [a for a, b in held if (a - start, b - start) in set(own)]
                    if same:
                        cuts.append(same[len(same) // 2])
                    else:  # a chunk that begins with a token that is held already
                        for a, b in held:
                            own = self.spans([data[a : a + 2 * HOP]])[0]
                            if own[0] == (0, b - a):
                                cuts.append(a)
                                start = a
                                break
                        else:
                            return [data]
                at, now = start, own
        return [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of what they decode to) of every text."""
        sums = [[0, hashlib.sha256(), hashlib.sha256(), False] for _ in texts]
        docs, found, fresh = [], [], []

        def flush() -> None:
            todo, held = [], 0
            for p in fresh:
                todo.append((self.words[p], p if isinstance(p, bytes) else p.encode()))
                held += len(todo[-1][1])
                if held > ROUND:
                    self.encode(todo)
                    todo, held = [], 0
            self.encode(todo)
            sizes = np.array(self.sizes, np.int64)
            for doc, part in zip(docs, found, strict=True):
                s, words = sums[doc], part.tolist()
                if not words:
                    continue
                ids = " ".join(map(self.ids.__getitem__, words))
                s[0] += int(sizes[part].sum())
                s[1].update((" " + ids if s[3] else ids).encode())
                s[2].update(b"".join(map(self.decoded.__getitem__, words)))
                s[3] = True
            for x in (docs, found, fresh):
                x.clear()

        for doc, text in enumerate(texts):
            pieces = self.cut(text or "")
            for i in range(0, len(pieces), SPAN):
                part = pieces[i : i + SPAN]
                if max(map(len, part)) > LONG:
                    part = [x for p in part for x in (self.parts(p.encode()) if len(p) > LONG else (p,))]
                new = [p for p in dict.fromkeys(part) if p not in self.words]
                if len(self.words) + len(new) > KEEP:
                    flush()
                    self.reset()
                    new = list(dict.fromkeys(part))
                self.words |= {p: len(self.words) + k for k, p in enumerate(new)}
                fresh += new
                docs.append(doc)
                found.append(np.fromiter(map(self.words.__getitem__, part), np.int32, len(part)))
                if sum(map(len, found)) >= SPAN:
                    flush()
        flush()
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b, _ in sums]


_codecs: dict[str, Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path, pattern)
    return _codecs[path]


def bpe_digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, ids_sha256 (of the decimal ids, one space between) and decoded_sha256 (of decoded bytes).

    Every row gives one row. A null or empty text has no tokens; its digests are those of nothing. No special tokens
    are read or added. Repeated rows stay repeated; other columns are carried along, those that bear a result's name
    are replaced. No shuffle; a worker holds at most KEEP distinct pieces and SPAN occurrences at a time; a piece of
    over LONG letters is cut into parts first, so its time grows with its length.
    """
    bound_batches(docs.sparkSession, 4 << 20)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path, pattern)
        for batch in batches:
            yield pd.DataFrame(codec.digests(batch.tolist()), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = [c for c in docs.columns if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    held = "__digest"
    while held in names:
        held += "_"
    return docs.select(*[F.col(f"`{c}`") for c in names], digest(F.col(text)).alias(held)).select(*[F.col(f"`{c}`") for c in names], f"{held}.*")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
