"""Readers: CSV and JSON records with mapped columns, kept or refused bad lines, embedded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headers that stand for each column, the first that is present wins.
ALIASES = {
    "text": ["text", "narrative", "description", "report", "incident_description", "details", "observation", "body"],
    "date": ["date", "report_date", "incident_date", "event_date"],
    "site": ["site", "location", "field", "installation", "plant"],
    "activity": ["activity", "task", "operation", "work_activity"],
    "contractor": ["contractor", "company", "employer", "vendor"],
}


def checked_header(names: list[str]) -> list[str]:
    bare = [n.strip() for n in names]
    if not any(bare):
        raise ValueError("a header is required")
    if not all(bare):
        raise ValueError("a header is blank")
    if len({n.casefold() for n in bare}) != len(bare):
        raise ValueError("two headers are equal but for case")
    return bare


def read_csv_strict(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a bad header or a ragged row is an error when it is met; empty lines are skipped."""
    import csv

    first = spark.read.option("lineSep", "\n").text(path).filter(F.trim("value") != "").first()
    names = checked_header(next(csv.reader([first["value"].rstrip("\r")])) if first else [])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).option("multiLine", True).schema(schema).csv(path)


def report_rows(spark: SparkSession, records: list[dict] | None = None, csv: str | None = None) -> DataFrame:
    """Raw rows from records at hand, or else from a CSV file; records win, and one of the two has to be given."""
    if records is not None:
        names = list(dict.fromkeys(k for r in records for k in r))
        told = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in records]
        return spark.createDataFrame(told, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    if csv is None:
        raise ValueError("one of 'records' or 'csv' must be provided")
    return read_csv_strict(spark, csv)


def map_columns(rows: DataFrame, override: dict[str, str] | None = None) -> DataFrame:
    """The five columns of a report from any headers; names are settled from the schema, blank strings are null.

    An override that names a column at hand wins; one that names none leaves the choice to the usual names.
    """
    by_name = {c.strip().lower(): c for c in rows.columns}

    def pick(target: str) -> Column:
        own = (override or {}).get(target)
        found = own if own in rows.columns else next((by_name[a.lower()] for a in ALIASES[target] if a.lower() in by_name), None)
        bare = F.regexp_replace(F.col(f"`{found}`").cast("string"), r"(?U)^\s+|\s+$", "")
        return F.lit(None).cast("string") if found is None else F.nullif(bare, F.lit(""))

    return rows.select(*[pick(t).alias(t) for t in ALIASES])


def with_errors(rows: DataFrame) -> DataFrame:
    """Mapped rows with `errors`: why a row cannot be a report; empty where it can."""
    from ..functions.scalars import iso_date

    day = F.col("date").isNotNull() & iso_date(F.col("date")).isNull()
    found = [F.when(F.col("text").isNull(), "text is required"), F.when(F.length("text") > 100_000, "text is too long"), F.when(day, "date is not YYYY-MM-DD")]
    return rows.withColumn("errors", F.filter(F.array(*found), lambda e: e.isNotNull()))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """JSON lines of a schema. A malformed line is an error, or with `keep_bad` a row whose `_corrupt_record` holds it."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not keep_bad:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_jsonl_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines of a schema with `_file` and `_line` (from 1); `_bad` holds a line that does not parse, null else. Blank lines are left out.

    A file's splits are counted side by side: a line's number is its place in its split and the lines of the splits before.
    """
    full = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("_file", "__at").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("_file").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_file", "__at", "__first", before.alias("__before"))  # a row a split
    told = lines.filter(F.trim("value") != "").join(starts, ["_file", "__at"]).withColumn("_line", F.col("__before") + F.col("__id") - F.col("__first") + 1)
    parsed = told.withColumn("__x", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.when(F.col("__x.__bad").isNotNull() | F.col("__x").isNull(), F.col("value"))
    return parsed.select(*[F.col(f"__x.{f.name}").alias(f.name) for f in full.fields[:-1]], "_file", "_line", bad.alias("_bad"))


def read_jsonl_strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines of a schema; a line that does not parse is an error that names its file and line when it is read."""
    rows = read_jsonl_lines(spark, path, schema)
    said = F.concat(F.col("_file"), F.lit(":"), F.col("_line").cast("string"), F.lit(": bad JSONL row: "), F.substring("_bad", 1, 200))
    checked = rows.filter(F.when(F.col("_bad").isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True)))
    return checked.drop("_file", "_line", "_bad")


def read_many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several JSONL files as one: of rows with equal id, or without an id equal text, the first by path stays."""
    rows = spark.read.schema(schema).json(paths).withColumn("__path", F.input_file_name()).withColumn("__key", F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("t"), "text")))
    rest = [c for c in rows.columns if not c.startswith("__")]
    picked = rows.groupBy("__key").agg(F.min(F.struct("__path", F.struct(*rest).alias("row"))).alias("x"))
    return picked.select("x.row.*")


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A JSON array, or an object with `records`; the text is the first of the named fields that is there."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("records").alias("r")).select("r.*") if "records" in raw.columns else raw
    return rows.select(F.coalesce(*[F.col(n) for n in names if n in rows.columns]).alias("text"))


def embedded_blocks(texts: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON objects in `<<SCORES {..}>>` blocks of a text; a block that does not parse is left out."""
    blocks = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?s)<<SCORES\s*(\{.*?\})\s*>>"), F.lit(1))).alias("b"))
    good = blocks.filter(F.try_parse_json("b").isNotNull())
    return good.select(F.from_json("b", schema).alias("x")).select("x.*")


def excluded_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a list: JSON lines with id or provenance.id, or plain lines with # comments."""
    line = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("line"), F.col("value").startswith("{").alias("json"), "value")
    id_ = F.when(F.col("json"), F.coalesce(F.get_json_object("value", "$.id"), F.get_json_object("value", "$.provenance.id"))).otherwise(F.col("line"))
    return line.select(id_.alias("id")).filter("id is not null and id <> ''").distinct()
