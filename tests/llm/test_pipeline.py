"""The whole pipeline against plain Python on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from reportforge.llm import line_dedup, quality

from . import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"w{int(rng.random() ** 2 * 300)}"
    texts = ["\n".join(" ".join(word() for _ in range(20)) for _ in range(5)) for _ in range(30)]
    texts += [texts[0], texts[1].replace("w1 ", "v1 "), "\n".join([*texts[2].split("\n")[:4], "quite another last line of it here"]), " ".join(f"{word()}%%%" for _ in range(90)), "short", None, "same " * 80]
    near = " ".join(word() for _ in range(100)).split()
    texts += [" ".join(near), " ".join([*near[:50], "x1", *near[51:70], "x2", *near[71:]])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [(d, t) for d, t, *_ in rows]
    docs = [x for x, (_, kept) in zip(docs, brute.verdicts(docs, set(range(20)), quality.BUCKETS, quality.THRESHOLD), strict=True) if kept]
    left = zip(docs, brute.dedup(docs, line_dedup.LEAST), strict=True)
    docs = [(d, t) for (d, _), (t, n, exact, nears) in left if not n or exact + nears < n]
    docs = [(d, t) for d, t in docs if brute.components(docs, 5, 80)[d][1] == d]
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
        want.update((d, s, n, ids[4 * s : 4 * (s + n)]) for s, n in brute.pieces(len(ids) // 4))
    assert Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    kept = {d for d, _ in docs}
    assert not {30, 33, 34, 35, 36} & kept and len({37, 38} & kept) <= 1 and {0, 5} <= kept
