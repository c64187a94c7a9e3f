"""Access log to audit rows, sessions of activity, and request throttling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.operators.governance import redact_json

# Route prefixes with action and resource type, and the requests that leave no audit row.
ROUTES = (
    ("/receipt/", "lookup", "receipt"),
    ("/search/", "search", "receipt"),
    ("/search/fuzzy", "fuzzy_search", "receipt"),
    ("/cs/context/", "context_lookup", "customer"),
    ("/receipt/deliver", "deliver", "receipt"),
    ("/audit/", "audit_query", "audit"),
)
SKIPPED_PATHS = (
    "/health", "/docs", "/openapi.json", "/redoc", "/favicon.ico",
    "/fluent-bit-status", "/status", "/ping", "/metrics",
)
SKIPPED_FOLDERS = ("/_next/", "/static/", "/assets/")
STATIC_FILES = ("js", "css", "map", "svg", "png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "eot")
NO_RESOURCE = ("fuzzy", "deliver", "log")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def classify_route(path: Column | str, routes: Sequence[tuple[str, str, str]] = ROUTES) -> Column:
    """Struct of action and resource type by the longest matching prefix; unknown without one."""
    col = _col(path)

    def named(action: str, kind: str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(kind).alias("resource_type"))

    chosen = F.when(col.isNull(), named("unknown", "unknown"))
    for prefix, action, kind in sorted(routes, key=lambda r: -len(r[0])):
        chosen = chosen.when(col.startswith(prefix), named(action, kind))
    return chosen.otherwise(named("unknown", "unknown"))


def resource_id(path: Column | str) -> Column:
    """The last segment of a path of two or more, unless it names an operation."""
    parts = F.split(F.regexp_replace(_col(path), "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) >= 2) & ~last.isin(*NO_RESOURCE), last)


def skip_path(path: Column | str) -> Column:
    col = _col(path)
    skipped = col.isin(*SKIPPED_PATHS) | col.rlike(r"\.(" + "|".join(STATIC_FILES) + ")$")
    for folder in SKIPPED_FOLDERS:
        skipped = skipped | col.startswith(folder)
    return skipped


def audit_rows(access: DataFrame) -> DataFrame:
    """Audit rows of an access log, batch or stream.

    The log holds request_id, path, email, params (JSON object), body (JSON), result_count,
    ip_address, user_agent and created_at. The audit id is the request id, so a log read twice gives
    the same rows.
    """
    kept = access.filter(~skip_path("path"))
    body = redact_json(F.col("body"))
    route = classify_route("path")
    email = F.coalesce("email", F.lit("unknown"))
    prepared = kept.withColumns({"_route": route, "_body": body})
    params = F.coalesce("params", F.lit("{}"))
    with_body = F.concat(
        F.regexp_replace(params, r"\}\s*$", ""), F.when(params.rlike(r"^\s*\{\s*\}\s*$"), F.lit("")).otherwise(F.lit(",")),
        F.lit('"body":'), F.col("_body"), F.lit("}"),
    )
    has_body = F.col("_body").isNotNull() & ~F.col("_body").isin("{}", "[]", "null")
    query_params = F.when(has_body, with_body).when(~params.rlike(r"^\s*\{\s*\}\s*$"), params)
    return prepared.select(
        F.col("request_id").cast("string").alias("audit_id"),
        email.alias("rep_id"), email.alias("rep_email"), F.lit("cs_rep").alias("rep_role"),
        F.col("_route.action").alias("action"), F.col("_route.resource_type").alias("resource_type"),
        resource_id("path").alias("resource_id"), query_params.alias("query_params"),
        F.col("result_count").cast("int").alias("result_count"), "ip_address",
        F.substring(F.coalesce("user_agent", F.lit("")), 1, 500).alias("user_agent"), "created_at",
    )


def _slot_of(micros: Column, gap_us: int) -> Column:
    """The start of the time slot of one gap that a time falls into."""
    return micros - F.pmod(micros, F.lit(gap_us))


def _slots(events: DataFrame, user: str, at: str, gap_us: int) -> DataFrame:
    """Activity per user and time slot of one gap, each with the start of the session it belongs to.

    Two events of one slot are closer than the gap, so a session can only start at a slot's first
    event. A user, however active, has at most one row per slot here.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    slots = events.filter(F.col(at).isNotNull()).groupBy(
        F.col(user).alias("_user"), _slot_of(micros, gap_us).alias("_slot")
    ).agg(F.min(micros).alias("_first"), F.max(micros).alias("_last"), F.count(F.lit(1)).alias("_n"))
    by_time = Window.partitionBy("_user").orderBy("_slot")
    before = F.lag("_last").over(by_time)
    starts = F.when(before.isNull() | (F.col("_first") - before > gap_us), F.col("_first"))
    return slots.withColumn("_starts", starts).withColumn(
        "_session", F.max("_starts").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_starts")


def session_activity(events: DataFrame, user: str = "user_id", at: str = "ts", gap_minutes: int = 30) -> DataFrame:
    """Sessions per user: runs of events at most the gap apart."""
    slots = _slots(events, user, at, gap_minutes * 60_000_000)
    return slots.groupBy("_user", "_session").agg(
        F.timestamp_micros(F.min("_first")).alias("started_at"),
        F.timestamp_micros(F.max("_last")).alias("last_active_at"),
        F.sum("_n").alias("events"),
    ).withColumnRenamed("_user", user).drop("_session")


#: Requests that a block of a run holds, in whole slots of time; a task walks a block at a time.
BLOCK = 20_000

# What a stretch of requests does to the credit it meets: pieces (low, high, value, slope) in order of the credit at its start;
# credits from low to high end at value + slope * (credit - low).
Pieces = list[tuple[int, int, int, int]]


def _after_request(pieces: Pieces, gap: int, cost: int, full: int) -> Pieces:
    """The pieces after one more request, `gap` after the one before: refill to the brim, then pay if the credit is enough.

    A piece is cut where it reaches the brim, above which all credits become one, and where it falls short of the cost. Pieces
    that have paid equally often join again; what is left is a few for each request the bucket has room for, and at worst one for
    each request within the time that fills the bucket.
    """
    out: Pieces = []

    def add(low: int, high: int, value: int, slope: int) -> None:
        if value >= cost:
            value -= cost
        if out:
            l, _, v, s = out[-1]
            if s == slope and value == v + slope * (low - l):
                out[-1] = (l, high, v, s)
                return
        out.append((low, high, value, slope))

    for low, high, value, slope in pieces:
        value += gap
        if not slope or value >= full:
            add(low, high, min(value, full), 0)
            continue
        brim = low + full - value  # the credit that just fills the bucket
        top = min(high, brim - 1)
        enough = low + cost - value
        if low < enough <= top:
            add(low, enough - 1, value, 1)
            add(enough, top, cost, 1)
        else:
            add(low, top, value, 1)
        if high >= brim:
            add(brim, high, full, 0)
    return out


def _at(pieces: Pieces, credit: int) -> int:
    low, _, value, slope = next(p for p in pieces if p[0] <= credit <= p[1])
    return value + slope * (credit - low)


def _block_pieces(cost: int, full: int):
    """For each block of a run, its rows in order, the pieces as flat numbers."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pieces, last = None, [], 0

        def done() -> pd.DataFrame:
            return pd.DataFrame({"_user": [current[0]], "_session": [current[1]], "_block": [current[2]], "_pieces": [[x for p in pieces for x in p]]})

        for batch in batches:
            for user, session, block, before, at in zip(batch["_user"], batch["_session"], batch["_block"], batch["_before"], batch["_at"]):
                if (user, session, block) != current:
                    if current is not None:
                        yield done()
                    current, pieces = (user, session, block), [(0, full, 0, 1)]
                    last = at if before != before or before is None else int(before)
                pieces = _after_request(pieces, at - last, cost, full)
                last = at
        if current is not None:
            yield done()

    return work


def _carried(full: int):
    """The credit with which each block of a run begins, from the pieces of the blocks before it."""
    def work(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        credit, found = full, []
        for flat in blocks["_pieces"]:
            found.append(credit)
            flat = list(map(int, flat))
            credit = _at([tuple(flat[k: k + 4]) for k in range(0, len(flat), 4)], credit)
        return pd.DataFrame({"_user": blocks["_user"], "_session": blocks["_session"], "_block": blocks["_block"], "_credit": found})

    return work


def _refused_rows(cost: int, full: int):
    """Walks the rows of blocks in order, each block from the credit it begins with."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, credit, last = None, full, 0
        for batch in batches:
            refused = []
            for user, session, block, before, start, at in zip(
                    batch["_user"], batch["_session"], batch["_block"], batch["_before"], batch["_credit"], batch["_at"]):
                if (user, session, block) != current:
                    current, credit = (user, session, block), int(start)
                    last = at if before != before or before is None else int(before)
                credit = min(full, credit + (at - last))
                last = at
                allowed = credit >= cost
                credit -= cost if allowed else 0
                refused.append(not allowed)
            yield batch[np.array(refused, bool)]

    return walk


def throttle_violations(
    requests: DataFrame, user: str, at: str, request_id: str, rate: float = 2.0, burst: int = 20, block: int = BLOCK
) -> DataFrame:
    """Requests a token bucket per user refuses, at `rate` tokens a second and room for `burst`.

    After a pause long enough to fill the bucket nothing before it matters, so each user's requests fall into independent runs.
    Runs of at most `burst` requests cannot be refused and are settled by counting. The others are cut into blocks of about
    `block` requests. What a block does to any credit it may begin with is a short list of pieces, found for all blocks at once;
    carried along a run, a few numbers for each block, they give the credit each block begins with, and then all blocks are
    walked at once. So a user without any pause spreads over the tasks. Time counts in whole microseconds; requests at the same
    time go by their id; requests without a time take no part.
    """
    cost_us = round(1_000_000 / rate)
    gap_us = burst * cost_us
    slots = _slots(requests, user, at, gap_us)
    run = Window.partitionBy("_user", "_session").orderBy("_slot")
    numbered = (
        slots.withColumn("_size", F.sum("_n").over(Window.partitionBy("_user", "_session"))).filter(F.col("_size") > burst)
        .withColumn("_block", F.floor((F.sum("_n").over(run) - F.col("_n")) / block)).withColumn("_earlier", F.lag("_last").over(run))
    )
    first = Window.partitionBy("_user", "_session", "_block").orderBy("_slot")
    crowded = numbered.select(
        "_user", "_slot", "_session", "_block", F.first("_earlier").over(first).alias("_before"), (F.col("_size") > block).alias("_long"))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = requests.select(F.col(user).alias("_user"), F.col(request_id).alias("_id"), F.col(at).alias("_time"), micros.alias("_at"),
                            _slot_of(micros, gap_us).alias("_slot"))
    placed = timed.join(crowded, ["_user", "_slot"]).drop("_slot")
    place = ["_user", "_session", "_block"]

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(*place).sortWithinPartitions(*place, "_at", "_id")

    kind = requests.schema[user].dataType.simpleString()
    long = in_order(placed.filter("_long").select(*place, "_before", "_at", "_id"))
    pieces = long.mapInPandas(_block_pieces(cost_us, gap_us), f"_user {kind}, _session long, _block long, _pieces array<long>")
    starts = pieces.groupBy("_user", "_session").applyInPandas(_carried(gap_us), f"_user {kind}, _session long, _block long, _credit long")
    begun = placed.join(starts, place, "left").withColumn("_credit", F.coalesce("_credit", F.lit(gap_us).cast("long"))).drop("_long")
    walked = in_order(begun)
    refused = walked.mapInPandas(_refused_rows(cost_us, gap_us), walked.schema)
    return refused.select(F.col("_user").alias(user), F.col("_id").alias(request_id), F.col("_time").alias(at))
