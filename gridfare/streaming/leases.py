"""Image locks as leases: one holder per image, renewed by heartbeats, ended by unlock or by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LEASE_SECONDS = 180
OUTPUT = "image_id long, holder string, granted_at timestamp, ended_at timestamp, reason string"
COLUMNS = ["image_id", "holder", "granted_at", "ended_at", "reason"]
STATE = "holder string, granted_at timestamp, expires_at timestamp"


class Lease:
    """The lock of one image while its events pass by in time order."""

    def __init__(self, length: pd.Timedelta, held: tuple | None = None) -> None:
        self.length, self.held = length, held

    def expire(self, now: pd.Timestamp) -> tuple | None:
        """The lease that ran out by ``now``, if there is one."""
        if self.held is None or now < self.held[2]:
            return None
        ended = (self.held[0], self.held[1], self.held[2], "expired")
        self.held = None
        return ended

    def act(self, now: pd.Timestamp, user: str, action: str) -> tuple | None:
        """Apply one event; the lease it ended, if any."""
        mine = self.held is not None and self.held[0] == user
        if action in ("lock", "heartbeat") and mine:
            self.held = (user, self.held[1], now + self.length)
        elif action == "lock" and self.held is None:
            self.held = (user, now, now + self.length)
        elif self.held is not None and ((action == "unlock" and mine) or action == "force_unlock"):
            ended = (self.held[0], self.held[1], now, action)
            self.held = None
            return ended
        return None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def independent_spans(events: DataFrame, *, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Add ``span``: events of one image in different spans cannot share a lease.

    An image with no event during one whole lease length is free afterwards. Spans are found on distinct time buckets,
    of which an image has at most one per lease length, so a busy image does not gather its events in one window.
    """
    bucket = F.floor(F.col("ts").cast("timestamp").cast("double") / seconds).alias("bucket")
    tagged = events.withColumn("bucket", bucket)
    used = tagged.select("image_id", "bucket").distinct()
    order = Window.partitionBy("image_id").orderBy("bucket")
    fresh = F.when(F.col("bucket") - F.lag("bucket").over(order) <= 1, 0).otherwise(1)
    spans = used.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order)).drop("fresh")
    return tagged.join(spans, ["image_id", "bucket"]).drop("bucket")


def lock_leases(events: DataFrame, *, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Every lease with its holder, start, end and why it ended; a lease still open ends when it expires.

    Rows reach the fold sorted, one span after the other, and only the current lease is kept: a group is never
    collected.
    """
    length = pd.Timedelta(seconds=seconds)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, lease = None, Lease(length)
        for batch in batches:
            out: list[tuple] = []
            for image, span, ts, user, action in batch.itertuples(index=False, name=None):
                if place != (image, span):
                    if place is not None and lease.held:
                        out.append((place[0], *lease.expire(lease.held[2])))
                    place, lease = (image, span), Lease(length)
                for ended in (lease.expire(ts), lease.act(ts, user, action)):
                    if ended:
                        out.append((image, *ended))
            yield _frame(out)
        if place is not None and lease.held:
            yield _frame([(place[0], *lease.expire(lease.held[2]))])

    needed = events.where("action <> 'save'").select(
        "image_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "user", "action"
    )
    spread = independent_spans(needed, seconds=seconds).repartition("image_id", "span")
    ordered = spread.sortWithinPartitions("image_id", "span", "ts", "event_id")
    return ordered.select("image_id", "span", "ts", "user", "action").mapInPandas(fold, OUTPUT)


def stream_lock_leases(events: DataFrame, *, seconds: int = LEASE_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """The same leases from a stream: state is the current lease, an event-time timer ends it.

    Events of one image must arrive in time order up to the order inside a batch.
    """
    length = pd.Timedelta(seconds=seconds)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(pd.Timestamp(v) if i else v for i, v in enumerate(state.get)) if state.exists else None
        lease, out = Lease(length, held), []
        if state.hasTimedOut:
            out.append((key[0], *lease.expire(lease.held[2])))
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, user, action in rows[["ts", "user", "action"]].itertuples(index=False, name=None):
                for ended in (lease.expire(ts), lease.act(ts, user, action)):
                    if ended:
                        out.append((key[0], *ended))
        if lease.held is None:
            if state.exists:
                state.remove()
        else:
            state.update((lease.held[0], lease.held[1].to_pydatetime(), lease.held[2].to_pydatetime()))
            until = int(lease.held[2].timestamp() * 1000)
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield _frame(out)

    needed = events.where("action <> 'save'").select(
        "image_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "user", "action"
    )
    timed = needed.withWatermark("ts", lateness)
    return timed.groupBy("image_id").applyInPandasWithState(
        fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
