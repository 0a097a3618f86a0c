"""Quality rules: counted facts of every text, then a hashed n-gram log-likelihood ratio against trusted text.

Two multinomials over hashed n-grams are compared: that of documents labelled good (the target) and that of the
whole corpus. A document's verdict is its mean log-ratio per n-gram against a fixed threshold. Everything is a
DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, table

#: Hash buckets of n-grams: the model's fixed size.
BUCKETS = 1 << 14
#: At most so many trusted documents are fitted, the first in the order of their id's hash.
TRUSTED = 20_000
#: Least mean log-ratio (nats an n-gram) of a document that is kept.
THRESHOLD = -0.4
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once a row, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more."""

    def covered(runs: Column) -> Column:
        same = lambda x, k: F.get(runs, k)["h"] == x["h"]
        twice = F.filter(runs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        spots = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(spots))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    def repeats(runs: Column) -> Column:
        numbered = F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(runs)) == F.size(runs), 0).otherwise(let(F.sort_array(numbered), covered))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < 3, 0).otherwise(let(windows(h), repeats)))
    return counted.cast("long")


def facts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    counted = let(word_list(whole), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    name = "__counted"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, counted).withColumns({
        "n_words": F.col(name)["n"],
        "word_chars": F.length(F.regexp_replace(whole, WHITE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col(name)["r"],
    })
    return out.drop(name).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ngrams(text: Column, buckets: int) -> Column:
    """Buckets of a text's one- and two-token n-grams; tokens are runs of letters and digits or of other signs."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"), F.lit(0))
    pair = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
    # The last token's pair has no second half, so it is the token at the end of a text.
    grams = let(F.transform(tokens, lambda x: F.xxhash64(x)), lambda h: F.concat(h, pair(h)))
    return F.transform(grams, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def trusted_ids(labels: DataFrame, bound: int) -> DataFrame:
    """At most `bound` ids of documents labelled good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("id"))
    return good.filter(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(bound)


def ratio_table(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = TRUSTED) -> DataFrame:
    """One row: `weights`, an array with each bucket's log(target share / corpus share), both with 1 added.

    The corpus counts cover every document; target counts cover the (bounded) trusted ones.
    """
    trusted = F.broadcast(trusted_ids(labels, bound).withColumn("good", F.lit(1)))
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(trusted, "id", "left")
    grams = marked.select(F.explode(ngrams(F.col("text"), buckets)).alias("bucket"), F.coalesce("good", F.lit(0)).alias("good"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    spine = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    row = spine.join(counts, "bucket", "left").agg(
        F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("rows"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("raws"), F.coalesce(F.sum("target"), F.lit(0)).alias("targets"),
    )
    share = lambda n, of: F.log((n + 1) / (F.col(of) + buckets))
    weight = lambda x: F.when(F.col("targets") == 0, 0.0).otherwise(share(x["target"], "targets") - share(x["raw"], "raws"))
    return row.select(F.transform("rows", weight).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, bound: int = TRUSTED) -> DataFrame:
    """`docs` with the facts, llr (mean log-ratio an n-gram; null without n-grams), base_failed and kept.

    `docs` needs doc_id and text; `labels` needs doc_id, quality and toxic. A null or empty text has no words, so it
    fails the base rules and is not kept. Null ids are never trusted. Without any trusted row every ratio is 0 and the
    base rules alone decide. Repeated rows are judged one by one and count as often as they come. Columns of `docs`
    that bear a result's name are replaced. Each row is judged where it lies: no text is shuffled; the model is one
    row of `buckets` numbers, so its broadcast has a fixed size.
    """
    model = ratio_table(docs, labels, buckets, bound)
    name = "__weights"
    while name in docs.columns:
        name += "_"
    grams = ngrams(F.col("text"), buckets)
    mean = let(grams, lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(F.col(name), b)) / F.size(g)))
    judged = facts(docs).crossJoin(F.broadcast(model.withColumnRenamed("weights", name))).withColumn("llr", mean).drop(name)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
