"""A training corpus from `documents`: quality rules, line dedup, near-duplicate groups, packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportforge.llm.common import discard, staged, table
from reportforge.llm.jaccard import one_of_each
from reportforge.llm.line_dedup import dedup_lines
from reportforge.llm.packing import WORD_FILE, pack
from reportforge.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-ratio threshold, as they are."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; a document that loses every line goes."""
    out = dedup_lines(docs).filter("n_lines = 0 or n_exact + n_near < n_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 80 % of its five-word shingles, link by link."""
    return one_of_each(docs, size=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, each a power of two long and from one document, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(WORD_FILE))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: The first stage's hash and the last one's tokenizer have no counterpart in DuckDB; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row; what a stage kept is written, and deleted when the next stage's output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(docs)
        docs = made
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing writes its pieces itself
    discard(docs)
    return out
