"""Line dedup by deletion neighbourhoods: of lines within an edit bound of each other, the earliest stays.

Lines are compared by their words; white space does not count, case does. The bound is one edit, of a word: put in,
left out or replaced. It holds for lines of `least` words or more, by default five: there one edit leaves at least 0.8
of a line as it is. Of shorter lines only equal ones are copies.

1. Equal lines are grouped by hash; a group is one line from here on, at its earliest place.
2. Two lines within the bound agree in their first or their last words, up to half of a line. Lines that share no such
   end with another line are left out of what follows. This is exact.
3. The others are numbered in the order of their places and emit each variant with one word deleted as a hashed key: the
   exclusive or of hashes of (word, place), so a line's keys cost one pass. Equal keys with equal places are
   replacements; a key equal to a whole line's hash is an insertion.
4. Of each key only its earliest line is a partner, so rows stay linear in the variants whatever a group's size: two
   lines with a key and a place in common differ in that one word, so who has any earlier partner has the earliest.
5. Each pair's words are compared; hashes alone never drop a line.

Rows that one line, key or end has very many of are summed up before they are shuffled, or joined to a written table, where
the planner splits such a key's rows over several tasks. Everything is DataFrame expressions; no Python runs on the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, copies_apart, discard, free_name, staged, table
from .quality import BLANK, let

#: Words that a line needs for the edit bound of one word.
LEAST = 5
#: Elements of a running list that are copied when one is added.
RUN = 128


def words_of_line(line: Column) -> Column:
    return F.split(normal(line), " ")


def normal(line: Column) -> Column:
    """A line's words with one blank between. Only lines that need it go through the pattern."""
    odd = F.contains(line, F.lit("  "))
    for sign in BLANK[1:]:
        odd = odd | F.contains(line, F.lit(sign))
    return F.trim(F.when(odd, F.regexp_replace(line, WHITE, " ")).otherwise(line))


def xor_all(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))


def placed(words: Column, shift: int = 0) -> Column:
    """Hash of every (word, place); `shift` moves places, as a deletion before them does."""
    return F.transform(words, lambda w, i: F.xxhash64(w, i + shift))


def running_xor(hashes: Column) -> Column:
    """0, then the exclusive or of the first 1, 2, ... hashes. Lists grow in runs, so long lines stay cheap."""
    longs = "array<bigint>"
    start = F.struct(F.array().cast(f"array<{longs}>").alias("done"), F.array(F.lit(0).cast("long")).alias("now"), F.lit(0).cast("long").alias("x"))

    def add(s: Column, h: Column) -> Column:
        x = s["x"].bitwiseXOR(h)
        full = F.size(s["now"]) >= RUN
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.array(x)).otherwise(F.concat(s["now"], F.array(x))).alias("now"),
            x.alias("x"),
        )

    return F.aggregate(hashes, start, add, lambda s: F.concat(F.flatten(s["done"]), s["now"]))


def variant_keys(words: Column) -> Column:
    """The key of a line without its 1st, 2nd, ... word: what stands before, and what stands after moved up by one."""
    before, after = running_xor(placed(words)), running_xor(placed(words, -1))
    body = lambda b: lambda a: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.get(b, i).bitwiseXOR(F.get(a, i + 1)).bitwiseXOR(F.get(a, F.size(a) - 1)))
    return let(before, lambda b: let(after, body(b)))


def some_words(norm: Column, k: Column) -> Column:
    """The first k words of a line, or the last -k."""
    return F.call_function("substring_index", norm, F.lit(" "), k)


def end_keys(norm: Column, n: Column) -> Column:
    """Keys of which two lines within one edit share at least one: their first or their last L words.

    L is 4 * (n // 8), and half of n for fewer than 8 words, but 2 at most; so one edit leaves one end alone. It is the
    same for n and n - 1 words but where n is a multiple of 8 or below 5; there a line also gives the keys of the other L.
    """
    size = F.when(n >= 8, 4 * F.floor(n / 8).cast("int")).otherwise(F.least(F.floor(n / 2).cast("int"), F.lit(2)))
    less = F.when(n > 8, size - 4).when(n == 8, 2).otherwise(F.floor((n - 1) / 2).cast("int"))
    ends = lambda k: [F.xxhash64(F.lit(0), k, some_words(norm, k)), F.xxhash64(F.lit(1), k, some_words(norm, -k))]
    return F.when((n % 8 == 0) | (n < 5), F.array(*ends(size), *ends(less))).otherwise(F.array(*ends(size)))


def exploded(docs: DataFrame) -> DataFrame:
    """(at, norm, n, h1, h2) of every line with a word; docs has d, r, text."""
    line = docs.select("d", "r", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    norm = line.select(F.struct("d", "r", "line_no").alias("at"), normal(F.col("line")).alias("norm")).filter("norm <> ''")
    words = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    return norm.select("at", "norm", words.alias("n"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(7), "norm").alias("h2"))


#: Bits of the map that keeps lines without a partner out of the second pass: a fixed 2 MB, whatever the input.
BITS = 1 << 24


def marked(hashes: DataFrame) -> DataFrame:
    """The bit map of a table of hashes: (bucket, bits), at most BITS / 32768 rows of 4 KB."""
    spot = F.pmod("h1", F.lit(BITS)) + 1
    return hashes.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))


def maybe_marked(lines: DataFrame, bits: DataFrame) -> DataFrame:
    """Lines whose hash's bit is set: all that were marked, and a few others."""
    spot = F.pmod("h1", F.lit(BITS)) + 1
    place = F.bitmap_bit_position(spot).cast("int")
    # As numbers of 32 bits, made once a row of the map: a line then reads one number and no text.
    word = lambda i: F.conv(F.hex(F.substring("bits", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    held = bits.select("bucket", F.transform(F.sequence(F.lit(0), F.floor(F.octet_length("bits") / 4).cast("int") - 1), word).alias("held"))
    joined = lines.withColumn("bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(held), "bucket")
    own = F.get("held", F.shiftright(place, 5))
    return joined.filter(F.getbit(own, (3 - F.shiftright(place, 3) % 4) * 8 + place % 8) == 1).drop("bucket", "held")


def near_lines(docs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """(h1, h2, to): lines with an earlier line within one edit, and where the earliest such line stands."""
    ends = lines.filter(F.col("n") >= least).select("h1", "h2", F.explode("ends").alias("end"))
    shared = staged(ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("end"), "shared", "zstd")
    wanted = staged(ends.join(shared, "end").select("h1", "h2").distinct(), "wanted", "zstd")
    # Copies of a line come together before its text moves; the map keeps most other texts from moving at all.
    near = maybe_marked(exploded(docs).drop("n"), marked(wanted)).groupBy("h1", "h2").agg(F.min("at").alias("at"), F.first("norm").alias("norm"))
    near = near.join(wanted, ["h1", "h2"]).orderBy("at").select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "at", "norm")
    found = staged(near, "candidates", "zstd")  # in the order of places, so ids rise with them
    discard(shared, wanted)

    split = found.select("id", F.split("norm", " ").alias("w"))
    cut = split.select("id", F.size("w").alias("n"), F.posexplode(variant_keys(F.col("w"))).alias("place", "key"))
    variants = staged(cut.select("id", "n", F.col("place").cast("int").alias("place"), "key"), "variants", "zstd")
    key = F.xxhash64("key", "n", "place").alias("k")
    earliest = staged(variants.groupBy(key).agg(F.min("id").alias("other"), F.max("id").alias("last")).filter("other < last").select("k", "other"), "earliest", "zstd")
    replaced = variants.select("id", "place", key).join(earliest, "k").filter("other < id")
    replaced = staged(replaced.groupBy("id", "other").agg(F.min("place").alias("place")).select("id", "other", "place", F.lit(0).alias("kind")), "replaced", "zstd")
    whole = split.select(F.xxhash64(xor_all(placed(F.col("w"))), F.size("w") + 1).alias("k"), F.col("id").alias("other"))
    inserted = variants.select("id", "place", F.xxhash64("key", "n").alias("k")).join(whole, "k").filter("id <> other")
    inserted = inserted.groupBy("id", "other").agg(F.min("place").alias("place"))
    longer = inserted.filter("other < id").withColumn("kind", F.lit(1))
    shorter = inserted.filter("id < other").select(F.col("other").alias("id"), F.col("id").alias("other"), "place", F.lit(2).alias("kind"))
    pairs = staged(replaced.unionByName(longer.unionByName(shorter)), "pairs", "zstd")
    discard(variants, earliest, replaced)

    sides = pairs.join(found.select("id", F.col("norm").alias("a_norm")), "id").join(found.select(F.col("id").alias("other"), F.col("norm").alias("b_norm")), "other")

    def without(norm: str) -> Column:
        """A line without the word at `place`."""
        rest = F.size(F.split(norm, " ")) - F.col("place") - 1
        return F.concat_ws(" ", F.when(F.col("place") > 0, some_words(F.col(norm), F.col("place"))), F.when(rest > 0, some_words(F.col(norm), -rest)))

    a = F.when(F.col("kind") == 2, F.col("a_norm")).otherwise(without("a_norm"))
    b = F.when(F.col("kind") == 1, F.col("b_norm")).otherwise(without("b_norm"))
    first = sides.filter(a == b).groupBy("id").agg(F.min("other").alias("other"))
    to = found.select(F.col("id").alias("other"), F.col("at").alias("to"))
    out = staged(first.join(to, "other").join(found.select("id", "h1", "h2"), "id").select("h1", "h2", "to"), "near", "zstd")
    discard(found, pairs)
    return out


def line_decisions(docs: DataFrame, least: int) -> DataFrame:
    """(d, r, line_no, kind) of every line that goes: 'exact' or 'near'."""
    ends = F.when(F.col("n") >= least, end_keys(F.col("norm"), F.col("n")))
    lines = staged(exploded(docs).select("at", "n", "h1", "h2", ends.alias("ends")), "lines", "zstd")
    near = near_lines(docs, lines, least)
    groups = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # Groups of one place without an earlier near line have nothing to drop.
    dropped = staged(groups.join(near, ["h1", "h2"], "left").filter("first < last or to is not null").select("h1", "h2", "first", "to"), "dropped", "zstd")
    discard(near)
    gone = lines.select("at", "h1", "h2").join(dropped, ["h1", "h2"]).filter("first < at or to is not null")
    return gone.select("at.d", "at.r", "at.line_no", F.when(F.col("first") < F.col("at"), "exact").otherwise("near").alias("kind"))


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """`docs` with the text that is left, and n_lines, n_exact, n_near (long): lines with a word, and those that went.

    A line goes where an equal line, or one within the edit bound, stands earlier in the corpus; whether that line
    stays itself does not matter, so the result depends on no order of work. Earlier: by doc_id (null first), then,
    for rows of one id, by a hash of id and text, then by line. Lines without a word always stay. Of rows with equal id and
    equal text one is the first, and the others lose all lines with a word. A null text has no lines and stays null. Other
    columns are carried along; columns that bear a result's name are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_exact", "n_near")]
    d, r, nos = (free_name(docs, x) for x in ("d", "r", "gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    base = docs.select(*[F.col(f"`{c}`") for c in names], place.alias(d), F.xxhash64("doc_id", "text").alias(r))
    base, copies = copies_apart(base, d, r)
    slim = docs.select(place.alias("d"), F.xxhash64("doc_id", "text").alias("r"), text.alias("text"))
    gone = line_decisions(slim if copies is None else slim.distinct(), least).groupBy(F.col("d").alias(d), F.col("r").alias(r)).agg(F.collect_set(F.struct("line_no", "kind")).alias(nos))

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(nos, lambda x: x["line_no"]))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    worded = lambda x: F.trim(x, F.lit(BLANK)) != ""
    count = lambda kind: F.coalesce(F.size(F.filter(nos, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
    n_lines = F.size(F.filter(F.split(text, "\n"), worded)).cast("long").alias("n_lines")
    new = F.when(F.col(nos).isNull(), F.col("text")).otherwise(let(F.split(text, "\n"), left)).alias("text")
    shown = lambda new, *counts: [*[new if c.lower() == "text" else F.col(f"`{c}`") for c in names], n_lines, *counts]
    out = base.join(gone, [d, r], "left").select(*shown(new, count("exact").alias("n_exact"), count("near").alias("n_near")))
    if copies is None:
        return out
    bare = F.when(F.col("text").isNotNull(), F.array_join(F.filter(F.split(text, "\n"), lambda x: ~worded(x)), "\n")).alias("text")
    return out.unionByName(copies.select(*shown(bare, n_lines.alias("n_exact"), F.lit(0).cast("long").alias("n_near"))))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("text"), 256).alias("text_sha256"))


#: The same result in DuckDB: lines, their words, variants as word lists, and pairs joined on equal variants.
OP2_SQL = r"""
WITH line AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line, list_filter(string_split_regex(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), worded AS (SELECT *, doc_id * 10000000 + line_no AS pos FROM line WHERE len(w) > 0),
grouped AS (SELECT w, min(pos) AS first FROM worded GROUP BY w),
variant AS (SELECT w, first, p, list_concat(w[:p - 1], w[p + 1:]) AS v FROM (SELECT w, first, unnest(range(1, len(w) + 1)) AS p FROM grouped WHERE len(w) >= 5)),
near AS (
  SELECT a.w FROM variant a JOIN variant b ON a.v = b.v AND a.p = b.p WHERE b.first < a.first
  UNION SELECT a.w FROM variant a JOIN grouped b ON a.v = b.w WHERE b.first < a.first AND len(b.w) >= 5
  UNION SELECT b.w FROM variant a JOIN grouped b ON a.v = b.w WHERE a.first < b.first AND len(b.w) >= 5
), judged AS (
  SELECT x.doc_id, x.line_no, x.pos > g.first AS exact, x.pos = g.first AND n.w IS NOT NULL AS near
  FROM worded x JOIN grouped g ON x.w = g.w LEFT JOIN near n ON n.w = x.w
), summed AS (
  SELECT l.doc_id, count(j.line_no)::BIGINT AS n_lines, count(*) FILTER (WHERE j.exact)::BIGINT AS n_exact, count(*) FILTER (WHERE j.near)::BIGINT AS n_near,
    string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE NOT coalesce(j.exact OR j.near, false)) AS text
  FROM line l LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.line_no = j.line_no GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_exact, n_near, sha256(coalesce(text, '')) AS text_sha256 FROM summed
"""
