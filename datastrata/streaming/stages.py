"""Freshness kept up as files arrive: a state per stage and a timer per schedule.

``freshness`` says once what is stale; here each arrival of a file meets the claims of that path, and only the stages
that make such claims are looked at again. A stage's state is what fails of it, the newest arrival of each of its paths
and the status it was last given, so a stage is as large as its own claims and a path's stages are spread by stage.
Schedules come due by timers when the watermark passes them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from datastrata.functions.scalars import EPOCH, INTERVALS, cron_next
from datastrata.operators import freshness

CHANGED = "stage string, fresh boolean, status string, reason string, micros long, turn long"
START = ["stage", "phase", "ord", "path", "code", "reason", "schedule", "ran"]
DUE = (1, 0, "")  # the key of a schedule's check
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def due_ms(schedule: str, ran: int) -> int | None:
    """When a schedule that ran at the second ``ran`` is due again, in milliseconds; null if never."""
    if schedule == "manual":
        return None
    if schedule in INTERVALS:
        return 1000 * (ran + INTERVALS[schedule])
    return (cron_next(schedule, EPOCH + dt.timedelta(seconds=ran)) - EPOCH) // dt.timedelta(milliseconds=1)


class StageStates(StatefulProcessor):
    """Arrivals, judged, of one stage -> a row each time that its status or reason becomes another.

    An arrival that is older than the last one of its path changes nothing; of equally old ones the one of the greatest hash counts, so
    that neither their order nor a repeat matters.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failing = handle.getMapState("failing", "phase int, ord int, path string", "code string, reason string")
        self.newest = handle.getMapState("newest", "phase int, ord int, path string", "micros long, found string")
        self.shown = handle.getValueState("shown", "status string, reason string, turn long")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        r = initialState
        if r.code is not None:
            self.failing.updateValue((r.phase, r.ord, r.path), (r.code, r.reason))
        if r.schedule is not None and (at := due_ms(r.schedule, r.ran)) is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, last = self._before(), None
        for r in rows:
            claim, age = (r.phase, r.ord, r.path), (r.micros, r.found or "")
            old = self.newest.getValue(claim) if self.newest.containsKey(claim) else None
            if old is not None and tuple(old) > age:
                continue
            self.newest.updateValue(claim, age)
            if r.code is not None:
                self.failing.updateValue(claim, (r.code, r.reason))
            elif self.failing.containsKey(claim):
                self.failing.removeKey(claim)
            last = r.micros if last is None else max(last, r.micros)
        if last is not None:
            yield from self._changed(key, before, last)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._before()
        self.failing.updateValue(DUE, ("stale", "fetch schedule due"))
        yield from self._changed(key, before, expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def _status(self) -> tuple[str, str]:
        """The first check that fails, by phase, order and reason."""
        first = min(((k[0], k[1], v[1], v[0]) for k, v in self.failing.iterator()), default=None)
        return ("fresh", "up-to-date") if first is None else (first[3], first[2])

    def _before(self) -> tuple[str, str, int]:
        """What was last shown: at first, what the initial state says."""
        return self.shown.get() if self.shown.exists() else (*self._status(), 0)

    def _changed(self, key: tuple, before: tuple[str, str, int], at: int) -> Iterator[Row]:
        status, reason = self._status()
        changed = (status, reason) != (before[0], before[1])
        turn = before[2] + changed
        if changed or not self.shown.exists():
            self.shown.update((status, reason, turn))
        if changed:
            yield Row(stage=key[0], fresh=status == "fresh", status=status, reason=reason, micros=at, turn=turn)

    def close(self) -> None:
        pass


def _claims(stages: DataFrame, outs: DataFrame, deps: DataFrame) -> DataFrame:
    """The claims that files can change, with what else is needed to judge them. Outputs of side effects are not looked at,
    and a dependency that another stage makes goes by what that stage declares."""
    claims = freshness._claims(outs, deps).where("NOT git")
    quiet = stages.where(freshness.is_side_effect()).select("path")
    count = outs.groupBy("stage").agg((F.count("*") <= 1).alias("single"))
    made = outs.groupBy("path").agg(F.min("md5").alias("declared"), F.lit(True).alias("made"))
    loud = claims.join(quiet.select(F.col("path").alias("stage"), F.lit(2).alias("phase")), ["stage", "phase"], "left_anti")
    return loud.join(count, "stage", "left").join(made, "path", "left").where("phase = 2 OR made IS NULL").drop("git")


def _start(stages: DataFrame, outs: DataFrame, deps: DataFrame, files: DataFrame, git: DataFrame | None, now) -> DataFrame:
    """What fails at the beginning, and a row for each schedule that is not due yet."""
    quiet = stages.where(freshness.is_side_effect()).select(F.col("path").alias("stage"), F.lit(2).alias("phase"))
    claims = freshness._claims(outs, deps)
    if git is None:
        claims = claims.where("NOT git")
    checks = freshness.path_checks(claims, freshness._facts(outs, files, git), "path").where("code IS NOT NULL").join(quiet, ["stage", "phase"], "left_anti")
    single = outs.groupBy("stage").agg((F.count("*") <= 1).alias("single"))
    none, never = F.lit(None).cast("string"), F.lit(None).cast("long")
    reason = F.when((F.col("phase") == 2) & F.col("single"), F.col("alone")).otherwise(F.col("reason"))
    rows = checks.join(single, "stage", "left").select("stage", "phase", "ord", "path", "code", reason.alias("reason"), none.alias("schedule"), never.alias("ran"))
    timed = freshness.schedule_checks(stages, now)
    due = timed.select("stage", "phase", "ord", F.lit("").alias("path"), "code", "reason", none, never)
    waits = stages.where("fetch_schedule IS NOT NULL AND fetch_last_run IS NOT NULL").join(timed.select(F.col("stage").alias("path")), "path", "left_anti")
    later = waits.select("path", F.lit(1), F.lit(0), F.lit(""), none, none, "fetch_schedule", F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("fetch_last_run").cast("timestamp_ntz")))
    rows = rows.unionAll(due).unionAll(later)
    if "error" in stages.columns:
        bad = stages.where("error IS NOT NULL")
        rows = rows.unionAll(bad.select("path", F.lit(0), F.lit(0), F.lit(""), F.lit("error"), "error", none, never))
    return rows.toDF(*START)


def changes(
    arrivals: DataFrame, stages: DataFrame, outs: DataFrame, deps: DataFrame, files: DataFrame, now, git: DataFrame | None = None, late: str = "1 hour"
) -> DataFrame:
    """A stream ``arrivals(path, md5, error, seen)`` -> a stream ``(stage, fresh, status, reason, at, turn)`` of the stages whose status changes.

    ``md5`` and ``error`` both null: the file is gone. The rest is as for ``freshness.freshness``, whose result at ``now`` is the status
    that the stream starts from; ``latest`` puts both together. Files that arrive more than ``late`` behind the newest are left out; null
    paths and times meet no claim. Schedules come due as the watermark, ``late`` behind the newest arrival, passes them. A stage's turns count up,
    so a restarted stream goes on where it was. Times are the session's; its zone should be UTC. State needs the store of ``state_store``.
    """
    there = F.col("md5").isNotNull() | F.col("error").isNotNull()
    marked = arrivals.where("seen IS NOT NULL").select("path", F.col("md5").alias("found"), "error", there.alias("there"), "seen").withWatermark("seen", late)
    met = marked.join(_claims(stages, outs, deps), "path")
    rows = freshness.judged(met, "path", "seen", "found", "single")
    reason = F.when((F.col("phase") == 2) & F.col("single"), F.col("alone")).otherwise(F.col("reason"))
    rows = rows.select("stage", "phase", "ord", "path", "code", reason.alias("reason"), F.unix_micros("seen").alias("micros"), "seen", "found")
    start = _start(stages, outs, deps, files, git, now)
    out = rows.groupBy("stage").transformWithState(StageStates(), CHANGED, "append", "eventTime", initialState=start.groupBy("stage"))
    return out.select("stage", "fresh", "status", "reason", F.timestamp_micros("micros").alias("at"), "turn")


def latest(before: DataFrame, seen: DataFrame) -> DataFrame:
    """The status ``before`` the stream and the changes seen since -> a row per stage: its last change, else what it was."""
    row = F.struct("turn", "fresh", "status", "reason")
    both = before.withColumn("turn", F.lit(0).cast("long")).select("stage", row.alias("r")).unionAll(seen.select("stage", row.alias("r")))
    return both.groupBy("stage").agg(F.max("r").alias("r")).select("stage", "r.fresh", "r.status", "r.reason")


@contextmanager
def state_store(spark: SparkSession):
    """Streams started in here keep their state in RocksDB; a stream takes its settings as it starts, so they are put back at the end."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def replay(arrivals: DataFrame, out: str, checkpoint: str, *parts, **options) -> DataFrame:
    """All arrivals that there are, run through ``changes`` into a Parquet table, which is returned; run again, it takes what has come since."""
    spark = arrivals.sparkSession
    with state_store(spark):
        rows = changes(arrivals, *parts, **options)
        run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
