"""Plain Python versions of the operators, for small inputs."""

import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").encode().lower().decode()


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, as a signed number."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def facts(text):
    text = text or ""
    words = WORD.findall(text)
    runs = list(zip(words, words[1:], words[2:], strict=False))
    many, spots = Counter(runs), set()
    for i, run in enumerate(runs):
        if many[run] > 1:
            spots |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(spots), n < 50 or 100 * len(spots) > 50 * n


def grams(text, buckets):
    tokens = re.findall(r"\w+|[^\w\x20\x09-\x0D]+", text or "")
    h = [spark_hash(t) for t in tokens]
    pairs = [spark_hash(a, b) for a, b in zip(h, [*h, None][1:], strict=True)]
    return [x % buckets for x in [*h, *pairs]]


def verdicts(docs, good, buckets, threshold):
    """docs: (doc_id, text); good: trusted ids. List of (llr, kept)."""
    raw, target = Counter(), Counter()
    for d, t in docs:
        g = grams(t, buckets)
        raw.update(g)
        if d in good:
            target.update(g)
    r, t_ = sum(raw.values()), sum(target.values())
    weight = lambda b: 0.0 if not t_ else math.log((target[b] + 1) / (t_ + buckets)) - math.log((raw[b] + 1) / (r + buckets))
    out = []
    for _, t in docs:
        g = grams(t, buckets)
        llr = sum(map(weight, g)) / len(g) if g else None
        out.append((llr, not facts(t)[5] and llr is not None and llr >= threshold))
    return out


def within_one(a, b):
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dedup(docs, least):
    """docs: (doc_id, text). List of (text, n_lines, n_exact, n_near); of equal rows the first one listed stays."""
    key = lambda d, t: (-(1 << 63) if d is None else d, spark_hash(d, t))
    firsts = {}
    for i, (d, t) in enumerate(docs):
        firsts.setdefault(key(d, t), i)
    lines = [(key(d, t), k, x) for i, (d, t) in enumerate(docs) if firsts[key(d, t)] == i for k, x in enumerate((t or "").split("\n"))]
    lines = sorted((d, k, WORD.findall(x)) for d, k, x in lines)
    lines = [x for x in lines if x[2]]
    gone = {}
    for i, (d, k, w) in enumerate(lines):
        for _, _, v in lines[:i]:
            if v == w:
                gone[d, k] = "exact"
                break
        else:
            if any(len(v) >= least and len(w) >= least and within_one(v, w) for _, _, v in lines[:i]):
                gone[d, k] = "near"
    # Copies of a line that is near to an earlier one are exact copies where their own first stands earlier.
    out = []
    for i, (d, t) in enumerate(docs):
        split = (t or "").split("\n")
        again = firsts[key(d, t)] != i
        kinds = [("exact" if WORD.search(x) else None) if again else gone.get((key(d, t), k)) for k, x in enumerate(split)]
        text = t if t is None or not any(kinds) else "\n".join(x for x, kind in zip(split, kinds, strict=True) if not kind)
        out.append((text, sum(bool(WORD.search(x)) for x in split), kinds.count("exact"), kinds.count("near")))
    return out


def components(docs, size, percent):
    """docs: (doc_id, text). doc_id -> (n_shingles, component)."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


def pieces(n, most=4096):
    out, start = [], 0
    while n - start >= most:
        out.append((start, most))
        start += most
    for k in reversed(range(most.bit_length() - 1)):
        if (n - start) >> k & 1:
            out.append((start, 1 << k))
            start += 1 << k
    return out


def sequences(docs, path, length, end=2):
    """docs: (doc_id, text). (doc_ids, n_tokens, bytes) of every sequence in training order, by the library on whole texts."""
    from tokenizers import Tokenizer

    from reportforge.llm import shards

    tokenizer, groups = Tokenizer.from_file(path), {}
    for d, t in docs:
        h = spark_hash(t)
        group = d // shards.GROUP if d is not None else h % shards.NAMELESS - (1 << 60)
        groups.setdefault(group, []).append(((d is not None, d or 0, h), d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]))
    out = []
    for group in sorted(groups):
        flat = [(x, d, k) for k, (_, d, ids) in enumerate(sorted(groups[group], key=lambda g: g[0])) for x in ids]
        for i in range(0, len(flat), length):
            part = flat[i : i + length]
            owners = [d for d, k in dict.fromkeys((d, k) for _, d, k in part)]
            out.append((owners, len(part), b"".join(x.to_bytes(2, "little") for x, _, _ in part).ljust(2 * length, b"\0")))
    return out


def licences(rows, module):
    """rows: (path, text). path -> (licence, score) of the best of all windows of segments, none left out beforehand."""
    weights, unknown = module.template_weights()
    of, idf = {}, {}
    for k, name, term, weight, value in weights:
        of.setdefault((k, name), {})[term] = weight
        idf[term] = value
    best = {}
    for path, text in rows:
        segments = [s for s in re.split(module.SEGMENT, (text or "").lower()) if re.search("[a-z0-9]", s)]
        n = len(segments)
        spans = {(a, k) for a in range(n) for k in range(1, min(module.WINDOW, n - a) + 1)}
        if re.search(module.LICENCE_FILE, path):
            spans.add((0, n))
        for a, k in spans:
            tf = module.terms(" ".join(segments[a : a + k]))
            norm = math.sqrt(sum((c * idf.get(t, unknown)) ** 2 * (1 if t in idf else module.OUTSIDE) for t, c in tf.items()))
            for (_, name), own in of.items():
                score = round(sum(c * idf[t] * own[t] for t, c in tf.items() if t in own) / norm, 9) if norm else 0
                if score >= module.NEAR:
                    best[path] = min(best.get(path, (0, "~")), (-score, name))
    return {path: (name, -s) for path, (s, name) in best.items()}
