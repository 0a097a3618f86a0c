"""Text functions: masking, keyword labels, spans, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .scalars import let

OPEN, CLOSE = "\x01", "\x02"


def alternatives(patterns: list[str]) -> str:
    """Any of the patterns; a word bound that all begin with is looked for once at a place."""
    bound = r"\b"
    if all(p.startswith(bound) for p in patterns):
        return bound + "(?:" + "|".join(p[len(bound) :] for p in patterns) + ")"
    return "(?:" + "|".join(patterns) + ")"


ANY_OUTCOME = "(?iU)" + alternatives(C.OUTCOMES)


def mask_text(text: Column) -> Column:
    """Outcome words as one neutral token; runs of it collapse."""
    token = r"\[OUTCOME\]"
    return F.regexp_replace(F.regexp_replace(text, ANY_OUTCOME, token), rf"{token}(?:\s+{token})+", token)


def mask_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_OUTCOME)), F.lit(0)).cast("long")


def any_of(patterns: list[str]) -> str:
    return "(?iU)" + alternatives(patterns)


def rule_hits(text: Column, order: list[str]) -> Column:
    """Rules with a keyword in the text, in the order given."""
    hits = [F.when(text.rlike(any_of(C.KEYWORDS[r])), F.lit(r)) for r in order if r in C.KEYWORDS]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def code_rule(code: Column, era: Column) -> Column:
    """The rule of an event code's first two digits in its era ('v1' or 'v2'); null for none."""
    maps = {e: F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]) for e, rules in C.CODE_RULES.items()}
    prefix = F.substring(F.trim(code.cast("string")), 1, 2)
    return F.when(era == "v1", F.try_element_at(maps["v1"], prefix)).when(era == "v2", F.try_element_at(maps["v2"], prefix))


def keyword_rules(text: Column) -> Column:
    return rule_hits(text, C.RULES)


def primary_rule(text: Column, code_rule: Column | None = None) -> Column:
    """The first keyword rule in tie order, else the code's rule."""
    first = F.get(rule_hits(text, C.TIE_ORDER), 0)
    return first if code_rule is None else F.coalesce(first, code_rule)


def rules_with_code(text: Column, code_rule: Column) -> Column:
    """Keyword rules and the code's rule, in display order."""
    found = F.concat(keyword_rules(text), F.filter(F.array(code_rule), lambda x: x.isNotNull()))
    return let(found, lambda f: F.filter(F.array(*map(F.lit, C.RULES)), lambda r: F.array_contains(f, r)))


def primary_of(rules: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, C.TIE_ORDER)), lambda r: F.array_contains(rules, r)), 0)


def well_control(text: Column) -> Column:
    return F.coalesce(text.rlike(any_of(C.WELL_CONTROL)), F.lit(False))


def find_spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern without groups: array of (start, end, text), in code points, end exclusive."""
    clean = F.translate(text, OPEN + CLOSE, "  ")
    pieces = F.split(F.regexp_replace(clean, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN)
    span = "struct<start:int,end:int,text:string>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def step(s: Column, piece: Column) -> Column:
        hit = F.instr(piece, CLOSE) > 0
        found = F.substring_index(piece, CLOSE, 1)
        end = s["at"] + F.length(found)
        return F.when(hit, F.struct((s["at"] + F.length(piece) - 1).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end"), found.alias("text")).cast(span))).alias("spans"))).otherwise(
            F.struct((s["at"] + F.length(piece)).alias("at"), s["spans"].alias("spans")))

    return F.aggregate(pieces, begin, step, lambda s: s["spans"])


def mask_with_source(text: Column, patterns: list[str] | None = None, most: int | None = None) -> Column:
    """(masked, source): a text with what `patterns` match as one token, and where each piece of it comes from.

    `source` holds (at, width) of a piece in the masked text, (start, size) in the source, and whether it is a token, in
    order and without gaps. Matches with nothing but white space between them share a token, whose source is all of them.
    `most` cuts the masked text, not the source: masking may lengthen a text. Counts are in code points.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, "  ")
    marked = F.regexp_replace(clean, f"({ANY_OUTCOME if patterns is None else any_of(patterns)})", f"{OPEN}$1{CLOSE}")
    pieces = F.split(F.regexp_replace(marked, rf"(?U){CLOSE}(\s+){OPEN}", "$1"), OPEN)
    kind = "array<struct<at:int,width:int,start:int,size:int,token:boolean>>"
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.array().cast(kind).alias("out"))
    wide = len(C.MASK_TOKEN)

    def step(s: Column, piece: Column) -> Column:
        hit = F.instr(piece, CLOSE) > 0
        size = F.when(hit, F.length(F.substring_index(piece, CLOSE, 1))).otherwise(0)
        rest, token = F.length(piece) - size - hit.cast("int"), F.when(hit, wide).otherwise(0)
        both = F.array(
            F.struct(s["at"].alias("at"), token.alias("width"), s["start"].alias("start"), size.alias("size"), F.lit(True).alias("token")),
            F.struct((s["at"] + token).alias("at"), rest.alias("width"), (s["start"] + size).alias("start"), rest.alias("size"), F.lit(False).alias("token")),
        )
        return F.struct((s["at"] + token + rest).alias("at"), (s["start"] + size + rest).alias("start"), F.concat(s["out"], F.filter(both, lambda p: p["width"] > 0)).alias("out"))

    def cut(p: Column) -> Column:
        width = p["width"] if most is None else F.least(p["width"], F.lit(most) - p["at"])
        return F.struct(p["at"].alias("at"), width.alias("width"), p["start"].alias("start"), F.when(p["token"], p["size"]).otherwise(width).alias("size"), p["token"].alias("token"))

    def whole(all_of: Column) -> Column:
        held = all_of if most is None else F.transform(F.filter(all_of, lambda p: p["at"] < most), cut)
        said = lambda p: F.when(p["token"], F.substring(F.lit(C.MASK_TOKEN), F.lit(1), p["width"])).otherwise(F.substring(text, p["start"] + 1, p["size"]))
        return F.struct(F.array_join(F.transform(held, said), "").alias("masked"), held.alias("source"))

    return let(F.aggregate(pieces, begin, step, lambda s: s["out"]), whole)


def to_source(source: Column, start: Column, end: Column) -> Column:
    """(start, end) in the source of a masked text's span: all of every token that it meets. Null outside the text."""
    at = lambda place: F.get(F.filter(source, lambda p: (p["at"] <= place) & (place < p["at"] + p["width"])), 0)
    low = let(at(start), lambda p: F.when(p["token"], p["start"]).otherwise(p["start"] + start - p["at"]))
    high = let(at(end - 1), lambda p: F.when(p["token"], p["start"] + p["size"]).otherwise(p["start"] + end - p["at"]))
    return F.when(low < high, F.struct(low.cast("int").alias("start"), high.cast("int").alias("end")))


def cue_spans(text: Column, most: int = 5) -> Column:
    """The first `most` (start, end, text) matches of any span cue, by start and end; overlapping ones all count."""
    every = [p for patterns in C.SPAN_CUES.values() for p in patterns]
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    found = F.flatten(F.array(*[F.when(text.rlike("(?iU)" + p), find_spans(text, "(?iU)" + p)).otherwise(none) for p in every]))
    return F.when(text.rlike(any_of(every)), F.slice(F.array_sort(found), 1, most)).otherwise(none)


def valid_spans(text: Column, spans: Column) -> Column:
    """Spans whose text stands where they say."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(text)) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) == s["text"]))


def merged_spans(spans: Column, touching: bool = False) -> Column:
    """Overlapping (start, end) spans joined; with `touching` also those that only meet."""
    kind = "struct<start:int,end:int>"
    slim = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (s["start"] <= last["end"]) if touching else (s["start"] < last["end"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(done) > 0) & joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(s)))

    return F.when(F.size(slim) == 0, F.array().cast(f"array<{kind}>")).otherwise(
        F.aggregate(F.slice(slim, F.lit(2), F.greatest(F.size(slim) - 1, F.lit(0))), F.slice(slim, 1, 1), step))


def top_spans(spans: Column, most: int = 3) -> Column:
    """The `most` best spans (with start, end, score) by score, then start; a span within a better one is passed over."""
    best = F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))

    def step(kept: Column, s: Column) -> Column:
        nested = F.exists(kept, lambda k: (s["start"] >= k["start"]) & (s["end"] <= k["end"]))
        return F.when((F.size(kept) >= most) | nested, kept).otherwise(F.concat(kept, F.array(s)))

    return F.aggregate(best, F.slice(best, F.lit(1), F.lit(0)), step)


def sliding_windows(n: Column, width: int = 126, stride: int = 64) -> Column:
    """(start, end) of windows over n tokens: one if they fit, else one from every stride on; the last ones end at n."""
    starts = F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)))
    return F.when(n <= 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(
        F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), F.least(i + width, n).cast("int").alias("end"))))


def site(text: Column) -> Column:
    """A report's place: a labelled start, else the first phrase after at, near, inside or within that holds a place
    word, else a first clause of 2 to 80 signs that does; else null."""
    edges = F.lit(" \t:;,–—-")
    bare = lambda c: F.nullif(F.trim(c, edges), F.lit(""))
    word, label = "(?iU)" + C.PLACE_WORD, "(?iU)" + C.PLACE_LABEL
    phrases = F.regexp_extract_all(text, F.lit("(?iU)" + C.PLACE_PHRASE), F.lit(1))
    phrase = F.get(F.filter(F.transform(phrases, lambda p: F.trim(p, edges)), lambda p: p.rlike(word)), 0)
    clause = F.trim(F.get(F.split(text, r"[.\n]"), 0))
    short = F.when(F.length(clause).between(2, 80) & clause.rlike(word), bare(clause))
    return F.when(text.rlike(label), bare(F.regexp_extract(text, label, 1))).otherwise(F.coalesce(phrase, short))


def prefilter_score(text: Column, rewards: list[str], penalties: list[str]) -> Column:
    """0.75 a rewarding match, 6 at most, less 1 a penalised one."""
    count = lambda words: F.regexp_count(F.lower(text), F.lit("(?:" + "|".join(words) + ")"))
    return F.least(F.lit(6.0), F.lit(0.75) * count(rewards)) - count(penalties).cast("double")


def bio_labels(offsets: Column, anchors: Column, least: float = 0.5) -> Column:
    """(labels, aligned) of tokens for a tagger: B and I where a token's signs meet an anchor's, else O.

    `offsets` and `anchors` hold (start, end); a token without signs is O. Not aligned: tokens cover less than `least` of
    the anchors' signs, or there are none.
    """
    meets = lambda o, a: F.greatest(F.least(o["end"], a["end"]) - F.greatest(o["start"], a["start"]), F.lit(0))
    inside = F.transform(offsets, lambda o: (o["end"] > o["start"]) & F.exists(anchors, lambda a: meets(o, a) > 0))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x.cast("int"))
    signs = total(F.transform(anchors, lambda a: a["end"] - a["start"]))
    covered = total(F.transform(offsets, lambda o: F.when(o["end"] > o["start"], total(F.transform(anchors, lambda a: meets(o, a)))).otherwise(0)))
    named = lambda flags: F.transform(flags, lambda f, i: F.when(~f, "O").when((i > 0) & F.coalesce(F.get(flags, i - 1), F.lit(False)), "I").otherwise("B"))
    return F.struct(let(inside, named).alias("labels"), ((signs > 0) & (F.try_divide(covered, signs) >= least)).alias("aligned"))
