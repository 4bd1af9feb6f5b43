"""Alerts, audit ids and rate limits on arriving rows."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import MICROS, epoch_micros, event_time
from ..operators.audit import MAX_ATTEMPTS, RATE_SECONDS, AttemptWindow
from ..operators.monitoring import ALERT, alerts_labelled, breaches

log = logging.getLogger(__name__)

Channel = Callable[[DataFrame, int], None]


def stream_alerts(samples: DataFrame, rules: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Alerts of an arriving sample stream: the earliest breach of each rule and second.

    An alert comes out when the watermark passes its second, so the order of arrival does
    not matter; rows later than ``delay`` are dropped.
    """
    timed = samples.withColumn("_at", event_time(F.col("ts"))).withWatermark("_at", delay)
    found = breaches(timed, rules, keep=["_at"])
    first = F.min_by(F.struct(*ALERT[1:]), F.struct("ts", "current_value")).alias("_a")
    second = F.window("_at", "1 second").alias("_second")
    return found.groupBy(second, "alert_id").agg(first).select("alert_id", "_a.*")


def stream_alerts_labelled(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules with a label condition on arriving samples, in update mode.

    State is one running sum per rule; a rule comes out in every batch that moves its sum
    at or above the threshold.
    """
    return alerts_labelled(samples, rules)


def alert_writer(
    alerts: DataFrame, store: Channel, channels: Sequence[Channel], checkpoint: str
) -> DataStreamWriter:
    """Store every batch of alerts, then hand it to all channels.

    A failed store fails the batch, which is then repeated.  A failing channel is logged
    and does not stop the rest.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            store(kept, number)
            for channel in channels:
                try:
                    channel(kept, number)
                except Exception as error:  # noqa: BLE001 - channels are user code
                    log.warning("alert channel failed: %s", error)
        finally:
            kept.unpersist()

    return alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deliver)


def stream_dedup(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Arriving events, each id once within the watermark delay.

    An event without an id equals no other: it passes as it is.
    """
    timed = events.withColumn("_at", event_time(F.col("ts"))).withWatermark("_at", delay)
    named = timed.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return named.unionByName(timed.where(F.col(key).isNull())).drop("_at")


def stream_rate_limit(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    window_seconds: int = RATE_SECONDS,
    delay: str = "2 minutes",
) -> DataFrame:
    """Decisions ``(identifier, attempt_id, us, allowed)`` in event-time order.

    Rows wait until the watermark passes them, so the result equals the batch
    operator's.  State per identifier: the waiting rows and at most
    ``max_attempts`` accepted times.
    """
    width = window_seconds * MICROS

    def decide(
        key: tuple, frames: Iterable[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        accepted, times, ids = state.get if state.exists else ([], [], [])
        times, ids = list(times), list(ids)
        for frame in frames:
            times.extend(frame["us"])
            ids.extend(frame["attempt_id"])
        mark = state.getCurrentWatermarkMs() * 1000
        order = np.lexsort((np.array(ids), np.array(times))) if ids else np.array([], dtype=int)
        times = np.array(times, dtype=np.int64)[order]
        ids = np.array(ids, dtype=np.int64)[order]
        ripe = int(np.searchsorted(times, mark))
        window = AttemptWindow(max_attempts, width, accepted)
        allowed = np.zeros(ripe, dtype=bool)
        allowed[window.accept_from(times[:ripe])] = True
        waiting = times[ripe:]
        recent = [t for t in window.accepted if t > mark - width]
        if len(waiting):
            state.update((recent, waiting.tolist(), ids[ripe:].tolist()))
            state.setTimeoutTimestamp(int(waiting[0]) // 1000 + 1)
        elif recent:
            state.update((recent, [], []))
            state.setTimeoutTimestamp((recent[-1] + width) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(
            {
                "identifier": [key[0]] * ripe,
                "attempt_id": ids[:ripe],
                "us": times[:ripe],
                "allowed": allowed,
            }
        )

    timed = attempts.withColumn("_at", event_time(F.col("ts"))).withWatermark("_at", delay)
    keyed = timed.select(
        F.col("identifier").cast("string").alias("identifier"),
        F.col("attempt_id").cast("bigint").alias("attempt_id"),
        epoch_micros(F.col("ts")).alias("us"),
        "_at",
    )
    return keyed.groupBy("identifier").applyInPandasWithState(
        decide,
        "identifier string, attempt_id long, us long, allowed boolean",
        "accepted array<long>, times array<long>, ids array<long>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
