"""The append-only audit log as a stream: an extension beyond batch parity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def hourly(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and kind; rows later than ``late`` are left out, so that state stays bounded."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("hour"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("hour.start").alias("hour"), "event_type", "n", "total")
    )


def runs(log: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs of a case: events with no gap of an hour; a run ends stale when nothing follows."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("run"), "user_id")
        .agg(F.count("*").alias("n"), F.max_by("event_type", "ts").alias("last_type"))
        .select("user_id", F.col("run.start").alias("begun"), F.col("run.end").alias("stale_at"), "n", "last_type")
    )


RUN = "user_id long, begun timestamp, last timestamp, n long, last_type string"


def _sweep(gap: pd.Timedelta):
    """Ends runs of one user; the state is the run that is open."""

    def go(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended: list[tuple] = []
        run = list(state.get) if state.exists else None
        if state.hasTimedOut:
            ended, run = [tuple(run)], None
            state.remove()
        events = sorted((t, kind) for part in parts for t, kind in zip(part["ts"], part["event_type"], strict=True))
        for t, kind in events:
            at = t.value
            if run and at - run[1] > gap.value:
                ended.append(tuple(run))
                run = None
            if run is None:
                run = [at, at, 1, kind]
            elif run[0] - at > gap.value:
                ended.append((at, at, 1, kind))  # late, and not of the run that is open
            else:
                run = [min(run[0], at), max(run[1], at), run[2] + 1, kind if at >= run[1] else run[3]]
        if run:
            state.update(tuple(run))
            state.setTimeoutTimestamp(max(run[1] + gap.value, state.getCurrentWatermarkMs() * 10**6) // 10**6 + 1)
        if ended:
            begun, last, n, kind = zip(*ended, strict=True)
            yield pd.DataFrame({"user_id": key[0], "begun": pd.to_datetime(begun), "last": pd.to_datetime(last), "n": n, "last_type": kind})

    return go


def stale_runs(log: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(user_id, begun, last, n, last_type) of runs that ended: a timer sweeps each when the log has moved on by ``gap`` and ``late``.

    A run's events have no gap of more than ``gap``. State holds one open run a user. Runs
    still open when the log ends aren't given.
    """
    state = "begun long, last long, n long, last_type string"
    users = log.where("user_id is not null and ts is not null").withWatermark("ts", late).groupBy("user_id")
    return users.applyInPandasWithState(_sweep(pd.Timedelta(gap)), RUN, state, "append", GroupStateTimeout.EventTimeTimeout)


def ended_runs(log: DataFrame, gap: str = "1 hour") -> DataFrame:
    """The runs of a whole log at once, those still open too: what ``stale_runs`` gives, by window order."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_type")
    begins = F.coalesce(F.col("ts") - F.lag("ts").over(by_user) > F.expr(f"interval {gap}"), F.lit(True))
    numbered = log.where("user_id is not null and ts is not null").withColumn("run", F.sum(begins.cast("int")).over(by_user))
    return numbered.groupBy("user_id", "run").agg(F.min("ts").alias("begun"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_type")).alias("last_type")).drop("run")


def append(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet log, once for each row; there is no way to change or delete rows."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
