"""Bulk ingest as a stream: each micro-batch is mapped, checked, deduplicated, gated and published once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions.evidence import variant_stats
from ..functions.scalars import band
from ..operators.corpus import new_rows
from ..operators.gates import with_gates
from ..operators.scoring import Scorer, classified
from ..operators.similarity import cosine_top, pseudo_embedding
from ..sources.publish import Store
from ..sources.readers import map_columns, with_errors
from .jobs import AT_ONCE, PART, Runner, name

REPORT_COLUMNS = [
    "content_hash string", "text string", "date string", "site string", "activity string", "contractor string", "score double", "spread double", "stability double",
    "n_variants int", "windows int", "rules map<string,double>", "spans array<struct<start:int,end:int,text:string>>", "band string", "gates array<struct<name:string,triggered:boolean,detail:string,action:string>>",
]
REPORTS, HASHES, VECTORS = ", ".join(REPORT_COLUMNS), "content_hash string", "content_hash string, embedding array<double>"
REJECTED = "text string, date string, errors array<string>"


def nearest_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """`rows` (content_hash, embedding) with `similarity` and `nearest`: the best cosine among `known` (row, embedding).

    Rows without any known vector have null in both. Vectors meet block by block.
    """
    numbered = rows.select(F.col("content_hash"), "embedding").withColumn("id", F.xxhash64("content_hash"))
    index = known.select("row", "embedding").withColumn("id", F.xxhash64(F.lit("known"), "row"))
    best = cosine_top(numbered, index, 1, "id", "embedding").select(F.col("query_id").alias("id"), F.col("cosine").alias("similarity"), F.col("id").alias("at"))
    named = best.join(index.select(F.col("id").alias("at"), F.col("row").alias("nearest")), "at")
    return rows.join(numbered.join(named, "id").select("content_hash", "similarity", "nearest"), "content_hash", "left")


def enrich(rows: DataFrame, scorer: Callable | Scorer | None = None, known: DataFrame | None = None) -> DataFrame:
    """Accepted rows with vector, score, spread, stability, windows, rules, evidence, band and gates.

    `scorer` is a Scorer of windows, or a function from the text column to a score or an array of scores, one a rephrasing;
    such a function tells no windows, rules or evidence. Without one a stand-in scores windows by their hashes. `known`
    (row, embedding) is what near duplicates are looked for in; without it the index is empty.
    """
    text, out = F.col("text"), rows.withColumn("embedding", pseudo_embedding(F.col("text")))
    if scorer is None or isinstance(scorer, Scorer):
        held = ["score", "spread", "stability", "n_variants", "windows", "rules", "spans", "band"]
        out = classified(out, scorer, "text", C.LONG_CHARS, "__p").withColumns({c: F.col(f"__p.{c}") for c in held}).drop("__p")
    else:
        out = out.withColumn("__s", scorer(text))
        if not dict(out.dtypes)["__s"].startswith("array"):
            out = out.withColumn("__s", F.array("__s"))
        none = {"windows": F.lit(None).cast("int"), "rules": F.lit(None).cast("map<string,double>"), "spans": F.lit(None).cast("array<struct<start:int,end:int,text:string>>")}
        out = out.withColumn("__v", variant_stats(F.col("__s"), C.FLAG)).withColumns({
            "score": F.col("__v.mean"), "spread": F.col("__v.spread"), "stability": F.col("__v.stability"), "n_variants": F.size("__s"), **none,
        }).withColumn("band", band(F.col("score"), C.FLAG, C.GRAY_LOW)).drop("__s", "__v")
    told = {"stability": "stability", "variants": "n_variants", "windows": "windows" if scorer is None or isinstance(scorer, Scorer) else None}
    if known is not None:
        return with_gates(nearest_known(out, known), similarity="similarity", nearest="nearest", **told).drop("similarity", "nearest")
    return with_gates(out, **told)


def ingested(rows: DataFrame, store: Store, scorer: Callable | Scorer | None = None, base: DataFrame | None = None, before: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that raw rows become: reports, hashes, vectors, rejected.

    Rows are compared with what was committed and with `before` (content_hash), and with earlier ones of their own by
    content. Near duplicates are looked for in `base` (row, embedding), if there is one, and among the rows committed so far.
    """
    checked = with_errors(map_columns(rows))
    good = checked.filter(F.size("errors") == 0).drop("errors")
    seen = store.table("hashes", HASHES)
    fresh = new_rows(good, seen if before is None else seen.unionByName(before), "text", ["date", "site"])
    known = store.table("vectors", VECTORS).select(F.col("content_hash").alias("row"), "embedding")
    known = known if base is None else base.select(F.col("row").cast("string").alias("row"), "embedding").unionByName(known)
    reports = enrich(fresh, scorer, known).select(*[c.split(" ")[0] for c in REPORT_COLUMNS])
    bad = checked.filter(F.size("errors") > 0).select("text", "date", "errors")
    return {"reports": reports, "hashes": fresh.select("content_hash"), "vectors": fresh.select("content_hash", pseudo_embedding(F.col("text")).alias("embedding")), "rejected": bad}


def ingest(rows: DataFrame, store: Store, batch: str, scorer: Callable | Scorer | None = None, base: DataFrame | None = None, cancelled: Callable[[], bool] = lambda: False) -> str:
    """One batch of raw rows into the store; a batch that is already there is replayed, one that is cancelled in time is not there."""
    return store.publish(batch, ingested(rows, store, scorer, base), cancelled)


def run_job(rows: DataFrame, store: Store, job: str, scorer: Callable | Scorer | None = None, base: DataFrame | None = None, part: int = PART) -> str:
    """ingest() as a job: part by part, with its events told, and cancelled where its cancel was asked for in time."""
    return Runner(store).run(job, rows, lambda own, before: ingested(own, store, scorer, base, before), part)


def submitted(rows: DataFrame, store: Store, job: str, at_once: int = AT_ONCE, **how) -> str:
    """Few rows are taken in at once; more are laid down for work_off(), and 'queued' comes back."""
    if rows.limit(at_once + 1).count() <= at_once:
        return run_job(rows, store, job, **how)
    store.put_once(f"queue/{name(job)}/rows", rows)
    store.put_once(f"queue/{name(job)}/job", store.spark.createDataFrame([(job,)], "job string"))
    return "queued"


def work_off(store: Store, **how) -> dict[str, str]:
    """Run the jobs that were laid down and have not ended; what became of each."""
    out = {}
    for at in sorted(set(store.names("queue")) - set(store.names("ended"))):
        job = store.spark.read.parquet(f"{store.root}/queue/{at}/job").first()["job"]
        out[job] = run_job(store.spark.read.parquet(f"{store.root}/queue/{at}/rows"), store, job, **how)
        store.mark(f"ended/{at}")
    return out


def start(spark: SparkSession, source: DataFrame, store: Store, checkpoint: str, job: str = "ingest") -> StreamingQuery:
    """Run `source` (a stream) through ingest() until what is there is read; a repeated micro-batch is a replay.

    After a cancel of `job` no further micro-batch is committed.
    """
    stop = Runner(store)
    return (
        source.writeStream.foreachBatch(lambda frame, n: ingest(frame, store, f"{job}-{n:012d}", cancelled=lambda: stop.cancelled(job)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progress(query: StreamingQuery) -> dict:
    """A job's state as its poller sees it."""
    last = query.lastProgress or {}
    failed = query.exception()
    return {"status": "error" if failed else "running" if query.isActive else "done", "rows": last.get("numInputRows", 0), "batch": last.get("batchId", -1)}
