"""Ingest jobs: what becomes of each, told by a stream of their events; and runs of jobs that can be cancelled on the way.

A job is queued, running, then done, in error or cancelled. Its state lives in a keyed store of the stream with a timer
that forgets it a while after its end. Runs write events into a folder, which is the stream's source.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.publish import Store

EVENTS = "job string, kind string, rows long, detail string, at timestamp"
STATUS = "job string, status string, done long, total long, detail string, accepted boolean, at timestamp"
ENDED = ("done", "error", "cancelled")
#: Seconds after its end in which a job is still known; rows up to which a job is run at once; rows of a part.
EXPIRY, AT_ONCE, PART = 3600, 100, 32


class Jobs(StatefulProcessor):
    """From a job's events its statuses, one a change; an event that a job's state does not allow is answered as not accepted."""

    def __init__(self, expiry: int = EXPIRY) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, done long, total long, detail string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get() if self.job.exists() else None
        status, done, total, detail = tuple(held) if held else (None, 0, 0, None)
        for e in sorted(rows, key=lambda r: (r["at"], ORDER.get(r["kind"], 9))):
            to = moved(status, e["kind"])
            if to:
                status, detail = to, e["detail"] if e["detail"] is not None else detail
                total = e["rows"] if e["kind"] == "submitted" else total
                done += e["rows"] if e["kind"] == "progress" else 0
                if to in ENDED:
                    self.handle.registerTimer(int(e["at"].timestamp() * 1000) + self.expiry * 1000)
            yield Row(job=key[0], status=status or "unknown", done=done, total=total, detail=detail if to else e["detail"], accepted=bool(to), at=e["at"])
        if status:
            self.job.update((status, done, total, detail))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.job.get() if self.job.exists() else None
        self.job.clear()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if held:
            yield Row(job=key[0], status="expired", done=held[1], total=held[2], detail=held[3], accepted=True, at=datetime.fromtimestamp(at))

    def close(self) -> None:
        pass


#: Events of one moment in the order in which they are taken.
ORDER = {"submitted": 0, "started": 1, "progress": 2, "cancel": 3, "finished": 4, "failed": 4, "cancelled": 4}
#: What an event makes of a job that is in a state.
MOVES = {
    (None, "submitted"): "queued", ("queued", "started"): "running", ("running", "progress"): "running", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelling",
    ("cancelling", "progress"): "cancelling", ("cancelling", "cancelled"): "cancelled", ("cancelling", "finished"): "done", ("cancelling", "failed"): "error",
    ("running", "finished"): "done", ("running", "failed"): "error", ("running", "cancelled"): "cancelled", ("queued", "failed"): "error",
}


def moved(status: str | None, kind: str) -> str | None:
    return MOVES.get((status, kind))


def statuses(events: DataFrame, expiry: int = EXPIRY, late: str = "10 minutes") -> DataFrame:
    """The stream of statuses of a stream of events (job, kind, rows, detail, at); needs the RocksDB state store.

    Timers follow event time: a job is forgotten once events `expiry` seconds after its end have been seen and `late` has
    passed too. Events of a forgotten job are answered with the status unknown.
    """
    keyed = events.withWatermark("at", late).groupBy("job")
    return keyed.transformWithState(Jobs(expiry), STATUS, "append", "eventtime")


def rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Runner:
    """Runs ingest jobs of a store, tells their events, and stops where a cancel was asked for in time."""

    def __init__(self, store: Store, clock: Callable[[], float] = time.time) -> None:
        self.store, self.clock = store, clock

    def tell(self, job: str, kind: str, rows: int = 0, detail: str | None = None) -> None:
        said = {"job": job, "kind": kind, "rows": rows, "detail": detail, "at": time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(self.clock())) + f".{int(self.clock() % 1 * 1e6):06d}Z"}
        self.store._create(f"events/{uuid.uuid4().hex}.json", json.dumps(said))

    def events(self) -> DataFrame:
        """The events as a stream."""
        path, files = self.store._path(f"{self.store.root}/events")
        files.mkdirs(path)
        return self.store.spark.readStream.schema(EVENTS).json(f"{self.store.root}/events")

    def cancel(self, job: str) -> None:
        """Ask a job to stop. One that is committed when it looks goes on to its end."""
        self.tell(job, "cancel")
        self.store.mark(f"cancelled/{name(job)}")

    def cancelled(self, job: str) -> bool:
        return name(job) in self.store.names("cancelled")

    def run(self, job: str, rows: DataFrame, made: Callable[[DataFrame, DataFrame], dict[str, DataFrame]], part: int = PART) -> str:
        """'committed', 'replayed', 'cancelled' or 'error': parts of about `part` rows each, which appear together or not.

        `made` gives the tables of a part from its rows and from the hashes that this job has written so far. A job whose
        rows were committed before, under this name or another, is a replay: jobs are known by what they hold.
        """
        total = rows.count()
        self.tell(job, "submitted", total)
        if self.cancelled(job):
            return "cancelled"
        self.tell(job, "started")
        batch, count = payload_hash(rows), max(1, -(-total // part))
        dealt = rows.withColumn("__part", F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(count)))
        sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())  # one row a part

        def parts(number: int) -> Iterator[dict[str, DataFrame]]:
            for k, _ in sizes:
                yield made(dealt.filter(F.col("__part") == k).drop("__part"), self.store.staged(number, "hashes", "content_hash string"))

        try:
            said = self.store.publish_parts(batch, parts, lambda: self.cancelled(job), told=lambda k: self.tell(job, "progress", sizes[k - 1][1]))
        except Exception as e:
            self.tell(job, "failed", detail=str(e)[:500])
            return "error"
        self.tell(job, "cancelled" if said == "cancelled" else "finished", detail=said)
        return said


def name(job: str) -> str:
    """A job's name as a file's."""
    return hashlib.sha256(job.encode()).hexdigest()


def payload_hash(rows: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: counts and sums of row hashes."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    told = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(f"{told['n']}:{told['s']}:{told['x']}".encode()).hexdigest()
