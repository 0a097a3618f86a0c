"""Ids of a word-level BPE file (white space dropped, word ends marked), by distinct words.

For a file of this kind no token crosses white space, so a text's ids are its words' ids in a row. Arrow splits a
batch of texts and numbers its distinct words; their ids are kept, or asked of the tokenizers library many pieces at a
time, and laid out by the words' numbers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

#: Words of these characters are unchanged by NFC and lower-case alike in every library.
PLAIN = "!-~À-ÖØ-öø-ÿ"
#: White space.
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
#: Words and pieces kept at a time in a worker (two generations of this size, about 150 bytes an entry), pieces that the
#: library gets at once, and bytes of texts that are laid out at a time; a longer text is cut into parts.
KEEP, PIECES, RUN = 200_000, 4096, 1 << 20


def is_word_level(spec: dict) -> bool:
    """True where every token lies between white space: the file's own settings say so."""
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])[:2]
    model = spec.get("model", {})
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and spec["normalizer"]["normalizers"][1].get("pattern") == {"Regex": "\\s+"}
        and split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"
        and r"[^\s" in split["pattern"]["Regex"]
        and level.get("type") == "ByteLevel" and not level.get("add_prefix_space") and not level.get("use_regex", True)
        and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")
        and spec.get("truncation") is None and spec.get("padding") is None and spec.get("post_processor") is None
    )


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.array(ids, "<u4").tobytes()


def laid_out(data: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`data` holds units of `sizes` in a row; here they are in another `order`, any number of times, and the end of each."""
    many = sizes[order]
    ends = np.cumsum(many)
    at = np.repeat((np.cumsum(sizes) - sizes)[order] - ends + many, many)
    at += np.arange(len(at))
    return data[at], ends


class Words:
    """Ids of texts, a batch of them at a time.

    Arrow numbers a batch's distinct words, and the distinct parts of those that are letters with signs or nothing
    behind them. `known` holds parts and other words of late with their ids as little-endian unsigned 32-bit numbers;
    when it is full it becomes `old`, and what was old before is let go.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        if not is_word_level(spec):
            raise ValueError(f"{path} is not a word-level BPE file")
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # A word that may hold an added token's string goes to the library whole.
        marks = "".join({x["content"][0] for x in spec["added_tokens"] if x["content"]})
        self.plain = re.compile(rf"(?:(?![{re.escape(marks)}])[{PLAIN}])*" if marks else rf"[{PLAIN}]*").fullmatch
        free = [x for x in re.findall(f"[{PLAIN}]", "".join(map(chr, range(256)))) if x.lower() not in marks.lower()]
        self.alphabet = "".join(x for x in free if x.isalpha())
        signs = "".join(x for x in free if not x.isalnum())
        # Letters, then signs: a piece each, as the file's pattern has no other piece that a sign begins and no letter follows.
        self.simple = rf"\A[{self.alphabet}]+[{re.escape(signs)}]*\z" if self.alphabet and signs else r"\A\z"
        self.signs = signs
        self.letters = {b: x for b, x in byte_letters().items() if b != 32}
        # The same model on pieces that are ready, with blanks between them.
        self.ready = Tokenizer(self.tokenizer.model)
        self.ready.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary, suffix = self.tokenizer.get_vocab(with_added_tokens=False), spec["model"]["end_of_word_suffix"]
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of `pieces`, all plain; a piece's last token, and no other, has the end's mark."""
        text = " ".join(pieces)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.ready.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(pieces):  # a file without tokens for some bytes
            return [packed([t.id for t in self.ready.model.tokenize(x)]) for x in text.split(" ")]
        data = ids.tobytes()
        return [data[start:end] for start, end in zip([0, *ends[:-1]], ends, strict=True)]

    def stems(self, new: list[str]) -> dict[str, bytes]:
        """The ids of plain pieces, many of them at a time; those of ASCII stand as they are in the file. No piece, no ids."""
        made = {"": b""}
        for as_it_is in (True, False):
            own = [x for x in new if x and x.isascii() is as_it_is]
            for i in range(0, len(own), PIECES):
                made |= zip(own[i : i + PIECES], self.piece_ids(own[i : i + PIECES]), strict=True)
        return made

    def others(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words of any kind."""
        made = {}
        for word in new:
            if self.plain(word):
                made[word] = b"".join([self.known.get(x) or self.of([x], self.stems)[0] for x in self.cut(word.lower())])
            else:
                made[word] = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return made

    def of(self, words: list[str], make: Callable[[list[str]], dict[str, bytes]]) -> list[bytes]:
        """The ids of each of `words`, which are distinct; `make` gives those of words that are not kept."""
        found = list(map(self.known.get, words))
        absent = [word for word, ids in zip(words, found, strict=True) if ids is None]
        if not absent:
            return found
        if len(self.known) + len(absent) > KEEP:
            self.old, self.known = self.known, {}
        made = {x: self.old[x] for x in absent if x in self.old}
        made |= make([x for x in absent if x not in made])
        self.known |= made
        return [made[word] if ids is None else ids for word, ids in zip(words, found, strict=True)]

    def batch(self, texts: pa.Array, last: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's with `last` behind them, and where each text starts; at last, the end."""
        split = pc.ascii_split_whitespace(texts)
        coded, stops = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:]
        words = coded.dictionary
        simple = pc.match_substring_regex(words, self.simple)
        low = pc.utf8_lower(words.filter(simple))
        stem = pc.utf8_rtrim(low, self.signs).dictionary_encode()
        tail = pc.utf8_ltrim(low, self.alphabet).dictionary_encode()
        # A word is a stem and a tail, or another word and nothing.
        made = self.of(listed(stem.dictionary), self.stems) + self.of(listed(tail.dictionary), self.stems)
        n, is_simple = len(made), simple.to_numpy(zero_copy_only=False)
        made += [*self.of(listed(words.filter(pc.invert(simple))), self.others), b""]
        pairs = np.full((len(words), 2), len(made) - 1)
        pairs[is_simple, 0], pairs[is_simple, 1] = stem.indices.to_numpy(), len(stem.dictionary) + tail.indices.to_numpy()
        pairs[~is_simple, 0] = np.arange(n, len(made) - 1)
        data, ends = laid_out(np.frombuffer(b"".join(made), "<u4"), np.fromiter(map(len, made), np.int64, len(made)) // 4, pairs.ravel())
        sizes = np.diff(ends[1::2], prepend=0)
        # Words in their order, and the end behind each text.
        order = np.insert(coded.indices.to_numpy(), stops, len(words))
        ids, ends = laid_out(np.concatenate([data, np.frombuffer(last, "<u4")]), np.append(sizes, len(last) // 4), order)
        return ids, np.concatenate([[0], ends[stops + np.arange(len(stops))]])

    def runs(self, texts: pa.Array, last: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows as (first, number of rows, ids, starts and end); null is an empty text. A text of over `RUN` bytes is a run of its own."""
        texts = texts.cast(pa.string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy().tolist()
        for run in balanced(sizes, RUN):
            first, many = run.start, run.stop - run.start
            if sizes[first] <= RUN:
                yield first, many, *self.batch(texts.slice(first, many), last)
            else:
                parts = [self.batch(pa.array([part.decode()]), b"")[0] for part in safe_parts(texts[first].as_py().encode(), RUN)]
                ids = np.concatenate([*parts, np.frombuffer(last, "<u4")])
                yield first, many, ids, np.array([0, len(ids)])


def listed(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def slices(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the numbers of `data` from each of `bounds` up to the next."""
    offsets = ((bounds - bounds[0]) * data.itemsize).astype(np.int32)
    values = np.ascontiguousarray(data[bounds[0] : bounds[-1]])
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def balanced(sizes: list[int], most: int) -> Iterator[slice]:
    """Runs of neighbouring texts of about `most` bytes each; a longer text is a run of its own."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def safe_parts(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut at ASCII white space; a longer word stays whole."""
    start, end = 0, len(data)
    while end - start > size:
        cut = max(data.rfind(sign, start + 1, start + size) for sign in SPACES)
        if cut < 0:
            cut = min((x for x in (data.find(sign, start + size) for sign in SPACES) if x >= 0), default=-1)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data


_held: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The one table of a worker process."""
    if path not in _held:
        _held[path] = Words(path)
    return _held[path]
