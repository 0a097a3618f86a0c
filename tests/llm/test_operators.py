"""Each operator against plain Python, and its defined results for nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from reportforge.llm import bpe, hpylm, jaccard, licences, line_dedup, packing, quality, shards, token_counts, topk
from reportforge.llm.components import components

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rng, n, kinds=400):
    return " ".join(f"w{int(rng.random() ** 2 * kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    out = [text_of(rng, rng.randint(1, 120)) for _ in range(40)]
    out += [out[0], out[1] + " tail", "", None, "  \n\t ", "a\na\n\nb", "É é ß 中文 😀 don't <|endoftext|> x", "same " * 300]
    out += ["\n".join(text_of(rng, 12) for _ in range(5)) for _ in range(6)]
    line = [f"k{i}" for i in range(20)]
    for i in range(12):
        w = list(line)
        if i % 3:
            w[i] = f"z{i % 5}"
        out.append("Head of it\n" + " ".join(w if i % 4 else [*w[:5], "more", *w[5:]]))
    out.append(text_of(rng, 30_000, 3000))
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)


def clashing(df):
    names = ["n_tokens", "n_bytes", "kept", "n_lines", "component", "__r", "__d", "start", "length", "score", "bucket", "shard", "__weights", "llr"]
    return df.withColumns({n: F.lit("x") for n in names})


def test_token_counts_and_packing(spark, docs):
    from tokenizers import Tokenizer

    path, t = P.path("word_bpe_49k.json"), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    df = clashing(frame(spark, [*docs, docs[3], (None, "no id")]))
    got = token_counts.token_counts(df, path).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in docs} | {None: t.encode("no id").ids}
    size = {d: len((x or "").encode()) for d, x in docs} | {None: 5}
    assert Counter(map(tuple, got)) == Counter((d, size[d], len(ids[d]), len(ids[d]) > 2048) for d in [*range(len(docs)), 3, None])
    rows = packing.pack(df, path).collect()
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in rows), reverse=True)
    want = Counter()
    for d in [*range(len(docs)), 3, None]:
        whole = np.array([*ids[d], 2], "<u4").tobytes()
        want.update((d, s, n, len(whole) // 4, whole[4 * s : 4 * (s + n)], 0) for s, n in brute.pieces(len(whole) // 4))
    assert Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], bytes(r["ids"]), r["offset"]) for r in rows) == want
    assert packing.pack(frame(spark, []), path).count() == token_counts.token_counts(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("keep, pieces, run", [(200_000, 4096, 1 << 20), (40, 3, 50)])
def test_words_of_a_batch_ask_the_library_once(monkeypatch, keep, pieces, run):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from reportforge.llm import wordbpe

    for name, value in (("KEEP", keep), ("PIECES", pieces), ("RUN", run)):
        monkeypatch.setattr(wordbpe, name, value)
    words, t, asked, rng = wordbpe.Words(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json")), [], random.Random(5)
    signs = [*"abcABCéÉßÿÀ×÷ªµºİıKſ\u0331\u0301'.,;:!?-_()[]|>/\\\"#$%&*@^`{}~12٣½日ﬁΣς \t\n\x0b\x0c\r\x1c\x85\xa0", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "'", "</w>", " "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(50))) if rng.random() < 0.95 else None for _ in range(400)]
    texts += ["don't foo' foo's foo,'s foo!!! (foo) FOO,'", "", " ", "x" * 200 + " y " * 90]
    for some in (texts[:7], texts, texts[7:]):
        got = []
        for first, many, ids, bounds in words.runs(pa.array(some, pa.string()), b"\2\0\0\0"):
            assert first == len(got) and len(bounds) == many + 1 and bounds[-1] == len(ids)
            got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in some]
    words, make = wordbpe.Words(P.path("word_bpe_49k.json")), wordbpe.Words.piece_ids
    monkeypatch.setattr(words, "piece_ids", lambda own: asked.append(own) or make(words, own))
    for _ in range(2):
        words.batch(pa.array(["Word word, WORD!!! other", "", "word. Other,"]), b"")
    assert sorted(x for own in asked for x in own) == ["!!!", ",", ".", "other", "word"] and len(asked) == 2


def test_a_worker_lays_out_few_texts_at_a_time():
    import pyarrow as pa

    from reportforge.llm import wordbpe

    texts = ["word " * 20_000] * 30 + ["x" * (wordbpe.RUN + 1), "y z " * wordbpe.RUN, "", None]
    words, sizes = wordbpe.Words(P.path("word_bpe_49k.json")), [len(x or "") for x in texts]
    runs = [(first, many, len(ids)) for first, many, ids, _ in words.runs(pa.array(texts), b"\2\0\0\0")]
    assert [first for first, _, _ in runs] == [0, 10, 20, 30, 31, 32] and sum(many for _, many, _ in runs) == len(texts)
    assert all(many == 1 or sum(sizes[first : first + many]) <= wordbpe.RUN for first, many, _ in runs)
    assert [n for _, _, n in runs][:3] == [200_010] * 3 and runs[4][2] == 2 * wordbpe.RUN + 1 and runs[5][2] == 2


def test_token_counts_by_other_libraries(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    some = docs[38:50]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    s = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for name, count in (("byte_bpe_50k.json", lambda x: len(t.encode(x, add_special_tokens=False).ids)), ("piece_bpe_32k.model", lambda x: len(s.encode(x)))):
        got = token_counts.token_counts(frame(spark, some), P.path(name)).select("doc_id", "n_tokens").collect()
        assert {r[0]: r[1] for r in got} == {d: count(x or "") for d, x in some}


def test_byte_bpe(spark, docs):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(900, "x" * 200 + " " * 70), (901, "a\x1cb  ​ c\r\n\x85d"), (902, "<|endoftext|>")]
    got = bpe.bpe_digests(clashing(frame(spark, [*docs, *odd, docs[2]])), path, P.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()

    def want(d, x):
        ids = enc.encode_ordinary(x or "")
        return d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()

    assert Counter(map(tuple, got)) == Counter(want(d, x) for d, x in [*docs, *odd, docs[2]])
    assert bpe.bpe_digests(frame(spark, []), path, P.PATTERN).count() == 0


def test_quality_rules(spark, docs):
    rng = random.Random(3)
    rows = [*docs, *[(100 + i, text_of(rng, 80)) for i in range(6)], *[(200 + i, " ".join(f"q{rng.randint(0, 900)}%%%" for _ in range(80))) for i in range(4)]]
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(5)] + [(200, 0, 0), (7, 1, 1), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(clashing(frame(spark, rows)), labels, buckets=512).collect()}
    for (d, t), (llr, kept) in zip(rows, brute.verdicts(rows, set(range(100, 105)), 512, quality.THRESHOLD), strict=True):
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.facts(t), d
        assert (r["llr"] is None and llr is None) or math.isclose(r["llr"], llr, abs_tol=1e-9), d
        assert r["kept"] == kept, d
    assert got[201]["llr"] < 0 < got[105]["llr"] and got[105]["kept"]
    none = quality.quality_rules(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert all(r["llr"] == 0 for r in none) and quality.quality_rules(frame(spark, []), labels).count() == 0


def test_long_pieces_are_cut_where_nothing_changes():
    import base64

    import tiktoken

    path, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(3)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library, codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(path, P.PATTERN)
    runs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8000)), "".join(rng.choices("aeiounrst", k=3000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(900))]
    runs += [p * 700 for p in ("a", "ab", "aaaab", "the", "=", "=-", "\u00e9", "0", "\n", "ation")] + ["x " + "=" * 1701 + "z"]
    for text, (n, ids, decoded) in zip(runs, codec.digests(runs), strict=True):
        want = library.encode_ordinary(text)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()) and decoded == hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(spark, docs):
    short = ["a b c d e", "a b x d e", "b c d e f", "a b c d e f", "a c d e", "q a b c d e", "a b c d", "m n o p q r s", "m n o p q r s t", "m n o p q r s t u"]
    rows = [*docs, (None, docs[-3][1]), (None, docs[-3][1]), docs[3], docs[3], (3, docs[4][1]), *[(1000 + i, t) for i, t in enumerate(short)], (None, None), (None, None)]
    got = line_dedup.dedup_lines(clashing(frame(spark, rows))).select("doc_id", "text", "n_lines", "n_exact", "n_near").collect()
    assert Counter(map(tuple, got)) == Counter((d, *x) for (d, _), x in zip(rows, brute.dedup(rows, line_dedup.LEAST), strict=True))
    assert sum(r["n_near"] for r in got) > 5
    twice = line_dedup.dedup_lines(frame(spark, [(1, "p q\np q"), (1, "p q\np q"), (2, " p \t q")])).select("doc_id", "text").collect()
    assert Counter(map(tuple, twice)) == Counter([(1, "p q"), (1, ""), (2, "")])
    same = line_dedup.dedup_lines(spark.createDataFrame([(1, "x y\n", "b"), (1, "x y\n", "a"), (1, "x y\n", "a"), (None, "x y", "a")], "doc_id long, text string, other string"))
    assert sorted((r["text"], r["n_exact"]) for r in same.collect()) == [("", 1)] * 3 + [("x y", 0)] and sorted(r["other"] for r in same.collect()) == ["a", "a", "a", "b"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_jaccard_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 1500)
    monkeypatch.setattr(jaccard, "RANGE", 2500)
    rng, rows = random.Random(4), list(docs)
    for family in range(3):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(70)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(70)] = f"x{rng.randint(0, 12 if family else 5000)}"
            rows.append((1000 + len(rows), " ".join(w)))
    for size, percent in ((3, 90), (5, 80)):
        got = jaccard.jaccard_classes(clashing(frame(spark, rows)), size, percent).collect()
        want = brute.components(rows, size, percent)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    odd = jaccard.jaccard_classes(frame(spark, [(None, "a b"), (5, "a b"), (5, "c"), (9, "c"), (3, None), (4, "")]), 3, 90).collect()
    assert Counter(map(tuple, odd)) == Counter([(None, 1, None), (5, 1, 5), (5, 1, 5), (9, 1, 5), (3, 0, 3), (4, 0, 4)])
    assert jaccard.jaccard_classes(frame(spark, []), 3, 90).count() == 0
    kept = jaccard.one_of_each(clashing(frame(spark, rows)), 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    seven = "one two three four five six seven"
    odd = [(1, "quite another text of its own here"), (1, seven), (1, seven), (0, seven + " eight"), (None, seven), (None, "alone"), (None, "alone"), (None, None), (7, ""), (8, "")]
    assert Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(clashing(frame(spark, odd)), 3, 80).collect()) == Counter([odd[0], odd[3], odd[5], *odd[7:]])


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([*links, (None, 4), (9, 9)], "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
            root.setdefault(a, a)
            root.setdefault(b, b)
    assert got == {n: find(n) for n in root if any(n in x and x[0] != x[1] for x in links)}


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "FAN", 3)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(3)], 0) for i in range(150)]
    odd = [(500, None, 0), (550, [1.0, None, 0.0], 0), (600, [float("nan"), 0.0, 0.0], 0), (650, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (700, [0.5, 0.5], 0), (750, [0.5, 0.25], 0), (3, [0.7, 0.7, 0.7], 0)]
    got = topk.top_k(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int").withColumn("rank", F.lit("x")), F.col("vec_id") % 50 == 0).collect()
    whole = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    ok = [(i, whole(v)) for i, v, _ in [*rows, *odd[5:]]]
    want = []
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == Counter(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [1e12] * 4), (1, [1e12] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(big, F.lit(True)).collect()


def test_lm_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(hpylm, "BLOCK", 60_000)
    monkeypatch.setattr(hpylm, "WORDS", 100_000)
    monkeypatch.setattr(hpylm, "BIGRAMS", 80_000)
    rows = [*docs, docs[2], (None, "w1 w2")]
    got = hpylm.lm_scores(clashing(frame(spark, rows))).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    by = {d: t for d, t in rows}
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    for r in got:
        w = tokens(by[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert hpylm.lm_scores(frame(spark, [])).count() == 0


def test_seating_is_the_restaurants_distribution():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(7919)
    c, rate, d = np.full(20_000, 6), np.full(20_000, 0.7), 0.5
    got = hpylm.seat(c, rate, d, keys, 1)
    # Weights of the seatings of six customers at t tables, one customer given all others: S(6, t) * rate**t.
    weight = {1: 1.0}
    for n in range(1, 6):
        nxt = Counter()
        for t, w in weight.items():
            nxt[t + 1] += w
            nxt[t] += w * (n - d * t)
        weight = nxt
    total = sum(w * 0.7**t for t, w in weight.items())
    share = {t: w * 0.7**t / total for t, w in weight.items()}
    for t, p in share.items():
        assert abs((got == t).mean() - p) < 0.015
    assert (hpylm.seat(np.array([0, 1, 100_000]), np.array([1.0, 1.0, 2.0]), d, keys[:3], 2)[:2] == [0, 1]).all()
    assert (hpylm.seat(c, rate, d, keys, 1) == got).all()


def test_token_shards(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "GROUP", 7)
    path = P.path("word_bpe_49k.json")
    for n in (1, 2, 3, 17, 64, 1000):
        slots = shards.permuted(np.arange(n), n, 5)
        assert sorted(slots) == list(range(n)) and (shards.permuted(slots, n, 5, back=True) == np.arange(n)).all()
    rows = [*docs, (None, "no id"), docs[1]]
    index = shards.materialise(clashing(frame(spark, rows)), path, str(tmp_path / "s"), length=64, slots=32).collect()
    read = {r["slot"]: bytes(r["ids"]) for r in shards.read_shards(spark, str(tmp_path / "s"), 32, 64).collect()}
    n = len(index)
    assert sorted(r["slot"] for r in index) == sorted(read) == list(range(n))
    assert [r["slot"] for r in sorted(index, key=lambda r: r["index"])] == shards.permuted(np.arange(n), n, shards.KEY).tolist()
    assert [(list(r["doc_ids"]), r["n_tokens"], read[r["slot"]]) for r in sorted(index, key=lambda r: r["index"])] == brute.sequences(rows, path, 64)
    again = shards.materialise(frame(spark, rows[::-1]).repartition(5), path, str(tmp_path / "again"), length=64, slots=32)
    by_slot = lambda r: r["slot"]
    assert sorted(again.collect(), key=by_slot) == sorted(index, key=by_slot)
    words = token_counts.token_counts(frame(spark, rows), path).agg(F.sum("n_tokens"), F.count("*")).first()
    assert sum(r["n_tokens"] for r in index) == sum(words)
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "s").glob("shard-*.bin")))
    assert len(raw) == n * 128 and all(raw[128 * s : 128 * (s + 1)] == x for s, x in read.items())
    later = shards.read_shards(spark, str(tmp_path / "s"), 32, 64, first=40).collect()
    assert sorted(r["slot"] for r in later) == list(range(40, n))
    assert shards.materialise(frame(spark, []), path, str(tmp_path / "none")).count() == 0


def test_a_wave_of_shards_needs_one_python_worker_a_task(spark):
    made = spark.createDataFrame([(g, i, [g], 4, b"12345678") for g in (0, 5) for i in range(10)], "grp long, nth long, doc_ids array<long>, n_tokens int, ids binary")
    placed, n = shards.slotted(made, 5, 8)
    wave = placed.filter((F.col("shard") >= 1) & (F.col("shard") < 2)).select("shard", "slot", "ids")
    assert wave._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert n == 20 and sorted(r["slot"] for r in wave.collect()) == list(range(8, 16))


def test_licences(spark):
    files = [
        ("p/LICENSE", "x\nReleased under the MIT License."), ("p/a/one.txt", "nothing here"), ("p/a/b/two.txt", "Licensed under the Apache License, Version 2.0.\nmore"),
        ("p/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("p/a/b/three.txt", None), ("q/four.txt", ""), ("/p/five", "the license of nothing at all in many other words"),
        ("p/a/one.txt", "nothing again"), (None, "Released under the MIT License."), ("top.txt", "word " * 50_000 + "\nReleased under the MIT License."),
    ]
    got = {r["path"]: (r["licence"], r["how"], r["licence_from"]) for r in licences.licence_scan(clashing(spark.createDataFrame(files, "path string, text string"))).collect()}
    assert got == {
        "p/LICENSE": ("MIT", "own", "p/LICENSE"), "p/a/one.txt": ("MIT", "inherited", "p"), "p/a/b/two.txt": ("Apache-2.0", "own", "p/a/b/two.txt"),
        "p/a/b/COPYING": ("GPL-3.0", "own", "p/a/b/COPYING"), "p/a/b/three.txt": ("GPL-3.0", "inherited", "p/a/b"), "q/four.txt": (None, "none", None), "/p/five": ("MIT", "inherited", "p"),
        "top.txt": ("MIT", "own", "top.txt"),
    }
    said = {
        "a/x.txt": "Copyright 2024 Jane Doe. Released under the MIT License.", "a/y.c": "// Copyright (c) 2023 Acme Corp. Licensed under the Apache License, Version 2.0.\nint main;",
        "b/wrapped.txt": "/*\n * Redistribution and use in source and binary forms,\n * with or without modification, are permitted\n * provided that the following conditions are met:\n */",
        "b/embedded.md": "Released under the MIT License. This is the home page of a tool that does something else entirely, and well.", "c/LICENSE": licences.TEMPLATES[21][1].replace(". ", ".\n\n").replace(", ", ",\n"),
        "d/gpl": "SPDX-License-Identifier: GPL-2.0-only", "d/mpl": "# SPDX-License-Identifier: MPL-2.0", "d/title": "MIT License", "d/prose": "The crew of the general store took the public road to work with software and a file of forms. It may be that any person can use it.",
    }
    rows = [*said.items(), *[(f"t/{k}", t) for k, (_, t) in enumerate(licences.TEMPLATES)], ("a/x.txt", "quite another text"), ("n", None)]
    best = {r["path"]: (r["licence"], r["score"]) for r in licences.statements(spark.createDataFrame(rows, "path string, text string"), licences.NEAR).collect()}
    want = brute.licences(rows, licences)
    assert {k: v[0] for k, v in best.items()} == {k: v[0] for k, v in want.items()} and all(abs(best[k][1] - want[k][1]) < 1e-8 for k in want)
    assert [best[p][0] for p in said if p != "d/prose"] == ["MIT", "Apache-2.0", "BSD-3-Clause", "MIT", "MIT", "GPL-2.0", "MPL-2.0", "MIT"] and not {"d/prose", "n"} & best.keys()
    assert all(best[f"t/{k}"] == (name, 1.0) or best[f"t/{k}"][1] > 0.99 for k, (name, _) in enumerate(licences.TEMPLATES))
    assert licences.licence_scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_licence_windows_stay_in_their_rows(spark):
    files = spark.createDataFrame([("a/LICENSE", "License. " * 300 + "Released under the MIT License."), ("b", "İ Kelvin K.\x0bReleased under the MIT License.\fv. 2"), (None, "MIT License")], "path string, text string")
    best = licences.statements(files, licences.NEAR)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("hashpartitioning") == 1  # terms of windows are no rows, so none are shuffled
    want = brute.licences([(r["path"] or "", r["text"]) for r in files.collect()], licences)
    assert {r["path"] or "": (r["licence"], r["score"]) for r in best.collect()} == want


def test_pieces_are_decoded_once():
    codec = bpe.Codec(P.path(bpe.RANK_FILE), P.PATTERN)
    texts = ["same word " * 500, "", None, "same 中文 😀 word", "x" * 700]
    for (n, ids, decoded), t in zip(codec.digests(texts), texts, strict=True):
        assert decoded == hashlib.sha256((t or "").encode()).hexdigest() and (n > 0) == bool(t)
    assert len(codec.decoded) == len(codec.words) == len(codec.sizes) < 30  # not one row for each occurrence


def test_texts_without_shared_prefix_are_not_ordered(spark, monkeypatch):
    def prefix(n, percent, common):
        assert (common[: n - jaccard.required(n, percent) + 1] > 1).any() and (np.diff(common.astype(int)) >= 0).all()
        return 1, n - jaccard.required(n, percent) + 1

    monkeypatch.setattr(jaccard, "prefix", prefix)  # goes to the workers by value, with `lead`
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(5)] + [(9, " ".join(f"w1x{j}" for j in range(39)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    active = jaccard.active_sets(docs, docs.select("doc_id", F.col("doc_id").alias("doc")), 300, 3, 90)
    assert {r["doc"] for r in active.collect()} <= {1, 9}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs, 3, 90).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 1}


def test_map_of_lines_is_read_as_numbers(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h1"))
    bits = line_dedup.marked(hashes)
    got = line_dedup.maybe_marked(spark.range(200_000).select(F.xxhash64("id").alias("h1")), bits)
    spot = lambda h: h % line_dedup.BITS
    own = {spot(r["h1"]) for r in hashes.collect()}
    want = [r["h1"] for r in spark.range(200_000).select(F.xxhash64("id").alias("h1")).collect() if spot(r["h1"]) in own]
    assert sorted(r["h1"] for r in got.collect()) == sorted(want)
    assert "conv(" not in [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x or "Filter" in x][0]
