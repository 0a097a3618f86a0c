"""Scores of the hierarchical model against a plain one, and sums to one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from reportforge.llm import hpylm, seating

END, START = "\nend", "\nstart"


def hashed(word):
    return np.uint64(xxhash.xxh64_intdigest(word.encode()))


def tables_by_law(customers, rates, d, keys, sweep):
    """Tables by the law of a Gibbs move, S(n, t) * rate**t, each picked by the operator's random number; by plain recurrence."""
    out, known = [], {1: [0.0, 1.0]}
    for n, rate, u in zip(customers.tolist(), rates.tolist(), seating.uniforms(keys, sweep).tolist(), strict=True):
        for m in range(max(known), n):  # scaled rows of S(m + 1, t)
            row = known[m] + [0.0]
            new = [0.0] + [row[t - 1] + (m - d * t) * row[t] for t in range(1, m + 2)]
            known[m + 1] = [x / max(new) for x in new]
        weights = [known[n][t] * rate**t for t in range(n + 1)]
        goal, run, t = u * sum(weights), 0.0, 0
        while t < n and run <= goal:
            t += 1
            run += weights[t]
        out.append(t)
    return np.array(out)


class Plain:
    """The model on dictionaries: all cells in one place, drawn sweep by sweep."""

    def __init__(self, texts, bits):
        self.words, self.cells, self.of = Counter(), Counter(), Counter()
        for text in texts:
            before = START
            for w in [*text.split(), END]:
                self.words[w] += 1
                self.cells[before, w] += 1
                self.of[before] += 1
                before = w
        once, twice = (sum(c == k for c in self.cells.values()) for k in (1, 2))
        self.d = hpylm.discount_of(once, twice)
        pairs, names = list(self.cells), list(self.words)
        hashes = np.array([hashed(w) for w in names], np.uint64)
        seeds = hpylm.root_keys((hashes << np.uint64(bits)) >> np.uint64(16), 0, bits) if not bits else np.array(
            [hpylm.root_keys(np.array([(h << np.uint64(bits)) >> np.uint64(16)]), int(h >> np.uint64(64 - bits)), bits)[0] for h in hashes], np.uint64)
        keys = hpylm.bigram_keys(np.array([hashed(c) for c, _ in pairs], np.uint64), np.array([hashed(w) for _, w in pairs], np.uint64)) >> np.uint64(32)
        counts = np.array([self.cells[x] for x in pairs])
        tables, self.samples = np.ones(len(pairs), np.int64), []
        for sweep in range(hpylm.SWEEPS + 1):
            if sweep:
                rate = np.array([(hpylm.CONTEXT + self.d * tables_of[c]) * self.root(state, w) for c, w in pairs])
                tables = tables_by_law(counts, rate, self.d, keys, sweep)
            customers, tables_of = Counter(), Counter()
            for (c, w), t in zip(pairs, tables.tolist(), strict=True):
                customers[w] += t
                tables_of[c] += t
            own = np.array([customers[w] for w in names])
            if not sweep:
                self.d0 = hpylm.discount_of(sum(own == 1), sum(own == 2))
                below = np.ones(len(names), np.int64)
            else:
                below = tables_by_law(own, np.full(len(own), (hpylm.ROOT + self.d0 * state[3]) / (len(names) + 1)), self.d0, seeds, sweep)
            state = (customers, dict(zip(names, below.tolist(), strict=True)), sum(customers.values()), int(below.sum()))
            if sweep > hpylm.SWEEPS - hpylm.SAMPLES:
                self.samples.append((state, dict(zip(pairs, tables.tolist(), strict=True)), tables_of))

    def root(self, state, w):
        customers, below, n, t = state
        return (customers[w] - self.d0 * below.get(w, 0) + (hpylm.ROOT + self.d0 * t) / (len(self.words) + 1)) / (hpylm.ROOT + n)

    def chance(self, c, w):
        p = 0.0
        for state, tables, tables_of in self.samples:
            q = self.root(state, w)
            if self.of[c]:
                q = (self.cells[c, w] - self.d * tables.get((c, w), 0) + (hpylm.CONTEXT + self.d * tables_of[c]) * q) / (hpylm.CONTEXT + self.of[c])
            p += q / len(self.samples)
        return p

    def score(self, text):
        before, total = START, 0.0
        for w in [*text.split(), END]:
            total += math.log10(self.chance(before, w))
            before = w
        return total


@pytest.mark.parametrize("spread", [False, True])
def test_scores_are_the_plain_models(spark, monkeypatch, spread):
    if spread:  # many blocks and ranges
        for name, size in (("BLOCK", 700), ("WORDS", 4000), ("BIGRAMS", 2500)):
            monkeypatch.setattr(hpylm, name, size)
    draw = random.Random(5)
    pool = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(draw.choices(pool, [1 / (k + 1) for k in range(60)], k=draw.choice([0, 3, 40, 90])))) for i in range(60)]
    rows += [(1000 + i, "w0 w1 w2 " * 12) for i in range(9)] + [(2000 + i, f"new{i} w1 w59 novel") for i in range(30)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    size = sum(len(t) + 16 for _, t in rows)
    plain = Plain([t for d, t in rows if not held(d)], hpylm.bits_for(size, hpylm.WORDS))
    got = {r["doc_id"]: r["score"] for r in hpylm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for d, t in rows:
        assert math.isclose(got[d], plain.score(t), rel_tol=1e-9), d
    # The model that these scores equal sums to one over the known words and one unknown, after every context.
    for c in [START, "w0", "w59", "never seen"]:
        assert math.isclose(sum(plain.chance(c, w) for w in plain.words) + plain.chance(c, "never seen either"), 1, rel_tol=1e-9)
    assert defaultdict(int, plain.of)[START] == sum(not held(d) for d, _ in rows)
