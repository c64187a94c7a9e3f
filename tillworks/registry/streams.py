"""Sources, sinks and streams over the test tables; a stream's output has to equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.operators import audit, quality, reconcile
from tillworks.operators.dedup import dedup_items
from tillworks.registry.base import (
    BOTH, LINES, RAW_ITEMS, RAW_RECEIPTS, RECEIPTS, clean_items, clean_receipts, flat, query, ts,
)
from tillworks.registry.governance import _AUDIT_NAMES, _AUDIT_SQL, _LOG, _THROTTLE_SQL, THROTTLE, access_log
from tillworks.plans import batch, gold, silver
from tillworks.registry.gold import SPENDING
from tillworks.session import run_folder
from tillworks.sources import keyed, scans, sinks
from tillworks.sources import warehouse as wh
from tillworks.streaming import jobs


def order_stream(spark, folder):
    return wh.order_headers(scans.stream_file(spark, folder, "orders"))


def line_stream(spark, folder):
    return wh.line_rows(scans.stream_file(spark, folder, "lineitem"))


_ITEM = ["transaction_id", "item_seq", "sku", "quantity", "extended_cents", "discount_cents"]
_HEADER = ["transaction_id", "customer_id", "total_cents", "tender_type", "card_last4"]


@query("scan_receipts", f"WITH {RAW_RECEIPTS} SELECT {', '.join(_HEADER)} FROM raw_receipts")
def q_scan_receipts(spark, folder):
    return scans.stamped(wh.order_headers(wh.table(spark, folder, "orders"))).filter(F.col("_bronze_ts").isNotNull()).select(*_HEADER)


@query("scan_items", f"WITH {RAW_ITEMS} SELECT {', '.join(_ITEM)} FROM raw_items")
def q_scan_items(spark, folder):
    return flat(scans.stamped(wh.raw_items(spark, folder, with_product=False)).select(*_ITEM))


@query("stream_bronze", f"WITH {RAW_ITEMS} SELECT {', '.join(_ITEM)} FROM raw_items WHERE quantity > 0 AND extended_cents >= 0")
def q_stream_bronze(spark, folder):
    out = run_folder(spark, "bronze")
    rules = quality.ITEM_RULES[:4]
    gated = jobs.stream_bronze(line_stream(spark, folder), rules)
    jobs.run_to_parquet(gated, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows").select(*_ITEM))


_LINES_SQL = f"WITH {LINES} SELECT transaction_id, item_seq, sku, quantity, extended_cents, discount_cents, {ts('ingested_ts')} AS ingested_ts FROM lines"


@query("stream_scd1", _LINES_SQL)
def q_stream_scd1(spark, folder):
    """Latest row per line kept in state; every batch of changed rows goes to a keyed table."""
    out = run_folder(spark, "scd1")
    stream = line_stream(spark, folder)
    latest = jobs.stream_scd1(stream, ["transaction_id", "item_seq"], "ingested_ts")
    write = jobs.upsert_batches(f"{out}/rows", ["transaction_id", "item_seq"], "ingested_ts")
    jobs.run_batches(latest, write, f"{out}/checkpoint", mode="update").awaitTermination()
    rows = keyed.read_current(spark, f"{out}/rows", stream.schema, ["transaction_id", "item_seq"], "ingested_ts")
    return flat(rows.select(*_ITEM, "ingested_ts"))


@query("stream_sync", _LINES_SQL)
def q_stream_sync(spark, folder):
    """Without state: each micro-batch is one version, the reader picks the winners."""
    out = run_folder(spark, "sync")
    stream = line_stream(spark, folder)
    write = jobs.upsert_batches(f"{out}/rows", ["transaction_id", "item_seq"], "ingested_ts")
    jobs.run_batches(stream, write, f"{out}/checkpoint").awaitTermination()
    rows = keyed.read_current(spark, f"{out}/rows", stream.schema, ["transaction_id", "item_seq"], "ingested_ts")
    return flat(rows.select(*_ITEM, "ingested_ts"))


#: Time at which the feed is cut for the streams that let state go, and one after all of it.
_CUT, _END = "1998-06-01", "2100-01-01"


def _in_two(rows, folder):
    """Arrivals of a feed in order of time: before the cut, after it, a row that moves the watermark past the end, and one more to
    whose step that watermark applies."""
    early = F.col("ingested_ts") < F.lit(_CUT).cast("timestamp")
    end = rows.sparkSession.range(1).select(*(
        F.lit({"ingested_ts": _END, "transaction_id": "-1"}.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    return [lambda part=part: part.write.mode("append").parquet(folder) for part in (rows.filter(early), rows.filter(~early), end, end)]


@query("stream_dedup", f"""WITH {RAW_ITEMS},
sent AS (SELECT transaction_id || '-' || item_seq AS event_id, min(ingested_ts) AS t, transaction_id AS k FROM raw_items GROUP BY 1, 3)
SELECT event_id, {ts('t')} AS ingested_ts FROM sent
UNION ALL SELECT event_id, {ts('t + INTERVAL 1500 DAYS')} FROM sent WHERE k % 5 = 0 AND t < TIMESTAMP '{_CUT}' AND t + INTERVAL 1500 DAYS >= TIMESTAMP '{_CUT}'""")
def q_stream_dedup(spark, folder):
    """Every line is delivered again ten minutes later, one in five once more after years: the first copies are dropped, the late
    ones come through, as their ids have been let go."""
    out = run_folder(spark, "dedup")
    lines = wh.raw_items(spark, folder, with_product=False)
    sent = lines.groupBy(F.concat_ws("-", "transaction_id", "item_seq").alias("event_id"), "transaction_id").agg(F.min("ingested_ts").alias("ingested_ts"))
    again = sent.withColumn("ingested_ts", F.col("ingested_ts") + F.expr("INTERVAL 10 MINUTES"))
    late = sent.withColumn("_then", F.col("ingested_ts") + F.expr("INTERVAL 1500 DAYS")).filter(
        (F.col("transaction_id") % 5 == 0) & (F.col("ingested_ts") < F.lit(_CUT).cast("timestamp")) & (F.col("_then") >= F.lit(_CUT).cast("timestamp")))
    every = (sent.unionByName(again).unionByName(late.drop("ingested_ts").withColumnRenamed("_then", "ingested_ts"))
             .select("event_id", "ingested_ts"))

    def start():
        unique = jobs.stream_dedup(scans.scan(spark, f"{out}/in", every.schema, stream=True), delay="1 hour")
        return jobs.run_to_parquet(unique, f"{out}/rows", f"{out}/checkpoint")

    before, after, *_ = _in_two(every, f"{out}/in")
    # ids are let go at the end of a step whose watermark has passed them
    tick = spark.range(1).select(F.lit(None).cast("string").alias("event_id"), F.lit(_CUT).cast("timestamp").alias("ingested_ts"))
    jobs.run_in_steps([before, lambda: tick.write.mode("append").parquet(f"{out}/in"), after], start)
    rows = spark.read.parquet(f"{out}/rows").filter("event_id IS NOT NULL")
    # within a step either of two copies ten minutes apart may come first
    return flat(rows.withColumn("ingested_ts", F.date_trunc("day", "ingested_ts")))


@query("stream_join", f"""WITH {RAW_RECEIPTS}, {RAW_ITEMS}
SELECT h.transaction_id, h.total_cents, i.item_seq, i.extended_cents FROM raw_receipts h LEFT JOIN raw_items i ON i.transaction_id = h.transaction_id
AND i.ingested_ts BETWEEN h.ingested_ts - INTERVAL 40 DAYS AND h.ingested_ts + INTERVAL 40 DAYS""")
def q_stream_join(spark, folder):
    """Header-item pairs of two streams, and the headers that met no item, which come out behind the watermark."""
    out = run_folder(spark, "join")
    headers = wh.order_headers(wh.table(spark, folder, "orders")).select("transaction_id", "ingested_ts", "total_cents")
    lines = wh.line_rows(wh.table(spark, folder, "lineitem")).select("transaction_id", "ingested_ts", "item_seq", "extended_cents")

    def start():
        joined = jobs.stream_join(
            scans.scan(spark, f"{out}/headers", headers.schema, stream=True), scans.scan(spark, f"{out}/lines", lines.schema, stream=True),
            delay="1 day", apart="40 days",
        )
        return jobs.run_to_parquet(joined, f"{out}/rows", f"{out}/checkpoint")

    steps = zip(_in_two(headers, f"{out}/headers"), _in_two(lines, f"{out}/lines"))
    jobs.run_in_steps([lambda a=a, b=b: (a(), b()) for a, b in steps], start)
    rows = spark.read.parquet(f"{out}/rows").filter("transaction_id >= 0")
    return rows.select("transaction_id", "total_cents", "item_seq", "extended_cents")


@query("stream_header_item_join", f"""WITH {BOTH}
SELECT r.transaction_id, i.item_seq, i.product_desc, r.total_cents FROM receipts r LEFT JOIN items i ON i.transaction_id = r.transaction_id""")
def q_header_item_join(spark, folder):
    """The batch twin of the stream join, without a time bound."""
    pairs = silver.header_items(clean_receipts(spark, folder), clean_items(spark, folder))
    return pairs.select("transaction_id", "item_seq", "product_desc", "total_cents")


@query("audit_stream", f"WITH {_LOG} SELECT {_AUDIT_SQL} FROM audit")
def q_audit_stream(spark, folder):
    out = run_folder(spark, "audit")
    log = access_log(spark, folder, scans.stream_file(spark, folder, "events"))
    jobs.run_to_parquet(audit.audit_rows(log), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows").select(*_AUDIT_NAMES))


@query("stream_throttle", _THROTTLE_SQL)
def q_stream_throttle(spark, folder):
    out = run_folder(spark, "throttle")
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = scans.stream_file(spark, folder, "events")
        refused = jobs.stream_throttle(stream, "user_id", "ts", "event_id", **THROTTLE)
        jobs.run_to_parquet(refused, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema("user_id bigint, event_id bigint").parquet(f"{out}/rows")


@query("stream_sessions", f"""WITH flagged AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOURS THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM flagged),
sessions AS (SELECT user_id, min(ts) AS a, max(ts) AS z, count(*) AS events FROM numbered GROUP BY user_id, s)
SELECT user_id, {ts('a')} AS started_at, {ts('z')} AS last_active_at, events FROM sessions
WHERE z + INTERVAL 6 HOURS < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def q_stream_sessions(spark, folder):
    """Closed sessions only: the last ones stay open until later events move the watermark."""
    out = run_folder(spark, "sessions")
    sessions = jobs.stream_sessions(scans.stream_file(spark, folder, "events"), gap="6 hours")
    jobs.run_to_parquet(sessions, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return flat(spark.read.parquet(f"{out}/rows"))


@query("write_upsert", _LINES_SQL)
def q_write_upsert(spark, folder):
    """The feed written in two versions, by return flag, gives the latest rows whatever came first."""
    out = run_folder(spark, "upsert")
    lines = wh.table(spark, folder, "lineitem")
    for version, returned in enumerate((True, False)):
        part = lines.filter((F.col("l_returnflag") == "R") == returned)
        keyed.write_upsert(wh.line_rows(part), out, ["transaction_id", "item_seq"], "ingested_ts", version)
    schema = wh.line_rows(lines).schema
    rows = keyed.read_current(spark, out, schema, ["transaction_id", "item_seq"], "ingested_ts")
    return flat(rows.select(*_ITEM, "ingested_ts"))


@query("write_if_absent", """WITH a AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT b.o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'created' ELSE 'exists' END AS status, coalesce(a.first_order, b.first_order) AS first_order
FROM b LEFT JOIN a ON a.o_custkey = b.o_custkey""")
def q_write_if_absent(spark, folder):
    out = run_folder(spark, "absent")
    orders = wh.table(spark, folder, "orders")
    first = orders.filter(F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")
    second = orders.filter(F.col("o_orderstatus") != "F").select("o_custkey", "o_orderkey")
    keyed.write_if_absent(first, out, ["o_custkey"], 0)
    status = keyed.write_if_absent(second, out, ["o_custkey"], 1)
    stored = keyed.read_versions(spark, out, first.schema)
    return status.join(stored.select("o_custkey", F.col("o_orderkey").alias("first_order")), "o_custkey")


@query("sync_changes", """SELECT o_orderkey AS transaction_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) + CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS total_cents
FROM orders WHERE o_orderstatus <> 'P'""")
def q_sync_changes(spark, folder):
    """A serving table brought up to date by change rows: orders underway leave it, open ones change, others come in."""
    out = run_folder(spark, "changes")
    orders = wh.table(spark, folder, "orders")
    total = F.floor(F.col("o_totalprice") * 100 + F.lit(0.5)).cast("bigint")
    known = orders.filter(F.col("o_orderkey") % 3 > 0).select(F.col("o_orderkey").alias("transaction_id"), total.alias("total_cents"))
    now = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("transaction_id"), (total + (F.col("o_orderstatus") == "O").cast("bigint")).alias("total_cents"))
    keys = ["transaction_id"]
    keyed.write_changes(known.withColumn("_change_type", F.lit("insert")), out, keys, 0)
    served = keyed.read_current(spark, out, known.schema, keys)
    keyed.write_changes(reconcile.change_feed(served, now, keys), out, keys, 1)
    return keyed.read_current(spark, out, known.schema, keys)


@query("write_append_strict", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_write_append_strict(spark, folder):
    out = run_folder(spark, "append")
    rows = wh.table(spark, folder, "nation")
    for _ in range(2):
        sinks.write_append_strict(rows, out, rows.schema)
    return spark.read.schema(rows.schema).parquet(out)


@query("clustered_write", f"WITH {RECEIPTS} SELECT transaction_id, customer_id, total_cents FROM receipts")
def q_clustered_write(spark, folder):
    out = run_folder(spark, "clustered")
    sinks.clustered_write(clean_receipts(spark, folder), out, ["customer_id", "transaction_ts"])
    return spark.read.parquet(out).select("transaction_id", "customer_id", "total_cents")


@query("zorder_write", f"WITH {RECEIPTS} SELECT transaction_id, customer_id, {ts('transaction_ts')} AS transaction_ts, total_cents FROM receipts")
def q_zorder_write(spark, folder):
    """Laid out so that a filter on the customer or on the time skips files."""
    out = run_folder(spark, "zorder")
    sinks.zorder_write(clean_receipts(spark, folder), out, ["customer_id", "transaction_ts"], 16)
    return flat(spark.read.parquet(out).select("transaction_id", "customer_id", "transaction_ts", "total_cents"))


def nested_events(spark, folder):
    """Clean receipts with all their lines nested, as a point of sale sends them."""
    return nested(silver.receipt_lookup_silver(clean_receipts(spark, folder), clean_items(spark, folder), part_size=None))


def nested(folded):
    return folded.withColumns({
        "transaction_id": F.col("transaction_id").cast("string"),
        "items": F.transform("items_detail", lambda i: F.struct(
            i["upc"].alias("upc"), i["sku"].cast("string").alias("sku"), i["product_desc"].alias("product_desc"),
            i["quantity"].alias("quantity"), i["unit_price_cents"].alias("unit_price_cents"),
            i["extended_cents"].alias("extended_cents"), i["discount_cents"].alias("discount_cents"),
            i["department_code"].alias("department_code"),
        )),
    }).drop("items_detail", "event_id", "ingested_ts", "departments", "item_count", "items_extended_cents", "item_parts", "first_names")


@query("explode_receipts", f"""WITH {BOTH}, numbered AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY item_seq) AS seq FROM items)
SELECT CAST(r.transaction_id AS VARCHAR) AS transaction_id, r.total_cents, CAST(i.seq AS INTEGER) AS item_seq, CAST(i.sku AS VARCHAR) AS sku, i.extended_cents
FROM receipts r LEFT JOIN numbered i ON i.transaction_id = r.transaction_id""")
def q_explode_receipts(spark, folder):
    headers, items = sinks.explode_receipts(nested_events(spark, folder), "2024-01-01 00:00:00")
    lines = items.select("event_id", "item_seq", "sku", "extended_cents")
    return headers.select("event_id", "transaction_id", "total_cents").join(lines, "event_id", "left").drop("event_id")


@query("dual_sink", f"""WITH {RECEIPTS}
SELECT transaction_id, CASE WHEN tender_type = 'CHECK' THEN 'failed' WHEN transaction_id % 10 = 3 THEN 'partial' ELSE 'success' END AS status FROM receipts""")
def q_dual_sink(spark, folder):
    """Receipts paid by check get a tender nobody knows, so that the rules refuse them; the analytics side refuses one in ten."""
    out = run_folder(spark, "dual")
    spoilt = clean_receipts(spark, folder).withColumn(
        "tender_type", F.when(F.col("tender_type") == "CHECK", "CHEQUE").otherwise(F.col("tender_type"))
    )
    spoilt.write.parquet(f"{out}/in")
    stream = scans.scan(spark, f"{out}/in", spoilt.schema, stream=True)

    def analytics(part, number):
        odd = F.col("transaction_id") % 10 == 3
        part.filter(~odd).write.mode("overwrite").parquet(f"{out}/analytics/part={number}")
        return part.filter(odd).select("transaction_id", F.lit("odd").alias("reason"))

    write = jobs.dual_sink(f"{out}/hot", analytics, f"{out}/status", within="transaction_ts", slices=2)
    jobs.run_batches(stream, write, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/status").select("transaction_id", "status")


@query("clean_items", f"WITH {LINES} SELECT transaction_id, item_seq FROM lines")
def q_clean_items(spark, folder):
    checked = quality.accepted(quality.validate_items(wh.raw_items(spark, folder)))
    return dedup_items(checked).select("transaction_id", "item_seq")


_SPENDING_SQL = f"""WITH {SPENDING}
SELECT customer_id, department_code, month_key, total_spend_cents, total_discount_cents, item_count, trip_count FROM spending"""
_SPENT = ["customer_id", "department_code", "month_key", "total_spend_cents", "total_discount_cents", "item_count", "trip_count"]


@query("run_batch", _SPENDING_SQL)
def q_run_batch(spark, folder):
    """All gold tables from the raw feed; the spending table is returned."""
    root = run_folder(spark, "batch")
    return batch.run_batch(wh.raw_receipts(spark, folder), wh.raw_items(spark, folder), root)["spending_summary"].select(*_SPENT)


@query("run_stream", _SPENDING_SQL)
def q_run_stream(spark, folder):
    """The same table, with the silver layer fed by streams."""
    root = run_folder(spark, "stream")
    streams = {"receipts": order_stream(spark, folder).withColumn("store_id", F.lit(1)), "items": line_stream(spark, folder)}
    headers, lines = batch.run_stream(spark, streams, root, item_rules=quality.ITEM_RULES[:4])
    items = silver.catalog_enrich(lines, wh.products(spark, folder))
    return gold.spending_summary(items, headers).select(*_SPENT)
