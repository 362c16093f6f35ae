"""Streams: ingest states, time-to-live, incremental de-duplication (P1-P6), and event-time windows, which are extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.session import ship

# States of an ingest job in order; the last two end it.
STATES = ("queued", "parsing", "categorizing", "extracting", "chunking", "embedding", "storing", "graph", "complete", "failed")
TERMINAL = ("complete", "failed")


def latest_state(events: DataFrame) -> DataFrame:
    """Each job's state from its log: the latest event, of equally late ones the furthest."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("ts", place.alias("p"))).alias("state"), F.max("ts").alias("ts"), F.count("*").alias("n_events"))


def job_states(log: DataFrame, ttl_seconds: int, delay: str = "10 minutes", terminal_only: bool = True) -> DataFrame:
    """P1-P4 on a stream: (job_id, state, ts, evicted) whenever a job's state changes, and once more, evicted, when its time is over.

    log: job_id, state, ts. The state is the latest event's, of equally late ones the furthest's, as latest_state() has it, so
    that late and repeated events change nothing. Events that are later than delay allows are left out. An ended job (any, if not
    terminal_only) is evicted when event time has passed its last event by more than ttl_seconds; its state goes with it, and an
    event that comes afterwards begins the job anew.
    """
    ship(log.sparkSession)
    kind = log.schema["job_id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        at, rank = held.get if held.exists else (None, -1)
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": [STATES[rank]], "ts": [pd.Timestamp(at, unit="us")], "evicted": [True]})
            return
        before = (at, rank)
        for frame in frames:
            for state, ts in frame[["state", "ts"]].itertuples(index=False):
                seen = (int(ts.value // 1000), STATES.index(state) if state in STATES else -1)
                if seen[1] >= 0 and (at is None or seen > (at, rank)):
                    at, rank = seen
        if at is None:
            return
        held.update((at, rank))
        over = at // 1000 + 1000 * ttl_seconds
        if STATES[rank] in TERMINAL or not terminal_only:
            held.setTimeoutTimestamp(max(over, held.getCurrentWatermarkMs() + 1))
        if (at, rank) != before:
            yield pd.DataFrame({"job_id": [key[0]], "state": [STATES[rank]], "ts": [pd.Timestamp(at, unit="us")], "evicted": [False]})

    timed = log.withWatermark("ts", delay).groupBy("job_id")
    return timed.applyInPandasWithState(step, f"job_id {kind}, state string, ts timestamp, evicted boolean", "at long, rank int", "append", GroupStateTimeout.EventTimeTimeout)


def active(states: DataFrame) -> DataFrame:
    """Jobs by state, and whether any is still going."""
    return states.agg(F.count("*").alias("n"), F.count_if(F.col("state").isin(*TERMINAL)).alias("n_done"), F.coalesce(F.bool_or(~F.col("state").isin(*TERMINAL)), F.lit(False)).alias("active"))


def evicted(jobs: DataFrame, now: Column, ttl_seconds: int, most: int = 100, terminal_only: bool = True) -> DataFrame:
    """Jobs that stay: of ended ones (or all) those within their time, and of them the latest most."""
    age = F.unix_timestamp(now) - F.unix_timestamp("ts")
    done = F.col("state").isin(*TERMINAL) if terminal_only else F.lit(True)
    young = jobs.filter(~done | (age <= ttl_seconds))
    return young.filter(~done).unionByName(young.filter(done).orderBy(F.desc("ts"), "job_id").limit(most))


def fresh(rows: DataFrame, now: Column, ttl_seconds: int, created: str = "created_at") -> DataFrame:
    """Rows not older than their time and not from the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(created)
    return rows.filter((age >= 0) & (age <= ttl_seconds))


def decayed(weight: Column, age_days: Column, half_life: float = 90.0) -> Column:
    """P5."""
    return weight * F.pow(F.lit(0.5), age_days / half_life)


def new_content(batch: DataFrame, known: DataFrame, digest: str = "content_hash") -> DataFrame:
    """Of a batch the first row of each content that isn't known yet."""
    return batch.dropDuplicates([digest]).join(known.select(digest), digest, "left_anti").select(batch.columns)


def deduplicated_stream(stream: DataFrame, digest: str = "content_hash", time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """P6 on a stream: each content once; with an event time, state is dropped after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([digest]) if time else stream.dropDuplicates([digest])


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each micro-batch to handle; handle must be idempotent by batch number, which makes delivery exactly once."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(events: DataFrame, size: str, slide: str | None = None, time: str = "ts", value: str = "value", delay: str = "1 hour") -> DataFrame:
    """Extension: count and sum by tumbling or sliding window and type. On a stream late rows count up to the delay."""
    base = events.withWatermark(time, delay) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return base.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("starts"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    base = events.withWatermark(time, delay) if events.isStreaming else events
    return base.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")
