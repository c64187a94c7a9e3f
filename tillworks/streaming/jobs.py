"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tillworks.operators.dedup import latest_order
from tillworks.operators.quality import Rule, gate
from tillworks.sources.scans import stamped
from tillworks.sources.keyed import write_upsert
from tillworks.sources.sinks import dual_write

IDLE_US = 3_600_000_000


def run_to_parquet(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Appends a stream to Parquet, once over what is there or continuously."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_in_steps(arrivals: Sequence[Callable[[], object]], start: Callable[[], StreamingQuery]) -> list[dict]:
    """Lets each arrival put its data where the stream reads, then runs the query over what is there and to its end, so that each
    step meets the watermark of the one before. Returns the progress after each step, with `stateRows`, the rows still held."""
    told = []
    for arrive in arrivals:
        arrive()
        query = start()
        query.awaitTermination()
        last = dict(query.lastProgress or {})
        told.append({**last, "stateRows": sum(op["numRowsTotal"] for op in last.get("stateOperators", []))})
    return told


def stream_bronze(raw: DataFrame, rules: tuple[Rule, ...], observation: Observation | str | None = None) -> DataFrame:
    """Stamped rows that pass the dropping rules; the observation counts every broken rule per batch."""
    return gate(stamped(raw), rules, observation)


def stream_scd1(stream: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The latest row per key in any order of arrival, kept in state; for update mode.

    State holds one row per key for good. `upsert_batches` needs no state and suits tables whose keys
    keep growing.
    """
    ordered = F.struct(*latest_order(stream.columns, keys, sequence))
    latest = stream.groupBy(*keys).agg(F.max(ordered).alias("_latest"))
    return latest.select(*keys, "_latest.*").select(*stream.columns)


def upsert_batches(root: str, keys: Sequence[str], sequence: str, base: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch becomes one version of a keyed table; a repeated batch replaces itself.

    A stream that goes on from its checkpoint needs no `base`. One that starts over on a table already
    holding versions counts from `next_version`, so as not to replace them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_upsert(batch, root, keys, sequence, base + batch_id)

    return write


def dual_sink(
    hot_root: str, analytics: Callable[[DataFrame, int], DataFrame | None], status_root: str, within: str | None = None, slices: int = 1,
) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: hot table first, analytics second, a status row per receipt (see `dual_write`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            status = dual_write(batch, batch_id, hot_root, analytics, within=within, slices=slices)
            status.write.mode("overwrite").parquet(f"{status_root}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def stream_dedup(stream: DataFrame, at: str = "ingested_ts", key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Drops re-deliveries that arrive within `delay`; state is let go behind the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def stream_join(headers: DataFrame, items: DataFrame, delay: str = "1 hour", apart: str = "30 minutes") -> DataFrame:
    """Headers left-joined with items that arrive within `apart` of them on either side."""
    h = headers.withWatermark("ingested_ts", delay).alias("h")
    i = items.withWatermark("ingested_ts", delay).alias("i")
    near = F.expr(
        f"i.ingested_ts BETWEEN h.ingested_ts - INTERVAL {apart} AND h.ingested_ts + INTERVAL {apart}"
    )
    shared = [F.col(f"h.{c}") for c in headers.columns]
    extra = [F.col(f"i.{c}") for c in items.columns if c not in headers.columns]
    return h.join(i, (F.col("h.transaction_id") == F.col("i.transaction_id")) & near, "left").select(*shared, *extra)


def stream_sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity, given out once they are closed behind the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.session_window(at, gap), user).agg(
        F.min(at).alias("started_at"), F.max(at).alias("last_active_at"), F.count(F.lit(1)).alias("events")
    ).drop("session_window")


class TokenBucket(StatefulProcessor):
    """A token bucket per user that outlives batches.

    A user is forgotten after an hour of event time, or after the time that fills the bucket if that
    is longer, so forgetting never changes an answer.
    """

    def __init__(self, rate: float, burst: int, output: list[str], request_id: str):
        self.cost_us = round(1_000_000 / rate)
        self.full = burst * self.cost_us
        self.idle_us = max(IDLE_US, self.full)
        self.output = output
        self.request_id = request_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "credit LONG, last LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["at_micros", self.request_id])
        credit, last = self.state.get() if self.state.exists() else (self.full, int(arrived["at_micros"].iloc[0]))
        refused = []
        for at in arrived["at_micros"]:
            credit = min(self.full, credit + max(0, int(at) - last))
            last = max(last, int(at))
            allowed = credit >= self.cost_us
            credit -= self.cost_us if allowed else 0
            refused.append(not allowed)
        self.state.update((credit, last))
        self.handle.registerTimer((last + self.idle_us) // 1000 + 1)
        yield arrived[refused][self.output]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (self.state.get()[1] + self.idle_us) // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_throttle(
    requests: DataFrame, user: str, at: str, request_id: str, rate: float = 2.0, burst: int = 20, delay: str = "1 minute"
) -> DataFrame:
    """Requests refused as they arrive, in order of their time within a micro-batch.

    Needs the RocksDB state store. One user's rows of one micro-batch are held in memory, so the size
    of a micro-batch (files or offsets per trigger) is the bound.
    """
    when = F.col(at).cast("timestamp")
    timed = requests.filter(when.isNotNull()).select(user, request_id, when.alias(at), F.unix_micros(when).alias("at_micros"))
    output = timed.drop("at_micros").schema
    return timed.withWatermark(at, delay).groupBy(user).transformWithStateInPandas(
        statefulProcessor=TokenBucket(rate, burst, output.names, request_id), outputStructType=output,
        outputMode="append", timeMode="eventTime",
    )
