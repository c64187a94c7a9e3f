"""Lookup, context, reconciliation and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.functions import receipt_text as rt
from tillworks.operators import lookup, reconcile
from tillworks.plans import batch, context, silver
from tillworks.registry.base import BOTH, GOLD, ITEMS, RECEIPTS, clean_items, clean_receipts, flat, query, text_ts, ts
from tillworks.registry.gold import PROFILES, SPENDING, gold_table, spending_table
from tillworks.session import run_folder
from tillworks.sources import keyed, scans
from tillworks.sources import warehouse as wh

_PAGE = ["customer_id", "position", "transaction_id", "store_name", "transaction_ts", "total_cents"]
_PAGE_SQL = f"customer_id, position, transaction_id, store_name, {ts('transaction_ts')} AS transaction_ts, total_cents"
AS_OF = "2001-06-15"


def line_items(spark, folder):
    """Clean items in the columns of the line-item table."""
    return clean_items(spark, folder).select(
        "transaction_id", F.col("item_seq").alias("line_number"), "sku", F.col("product_desc").alias("product_name"),
        "brand", F.col("department_code").alias("category_l1"), "quantity", "unit_price_cents",
        F.col("extended_cents").alias("line_total_cents"), "discount_cents",
    )


@query("receipt_detail", f"""WITH {GOLD}
SELECT g.transaction_id, g.total_cents,
       coalesce((SELECT string_agg(product_desc || ':' || extended_cents || ':' || sku || ':' || brand || ':' || CAST(quantity AS INTEGER) || ':' || department_code, '|' ORDER BY item_seq)
                 FROM items i WHERE i.transaction_id = g.transaction_id),
                'Unknown Item:' || g.total_cents || ':1') AS line_items
FROM gold g""")
def q_receipt_detail(spark, folder):
    receipts = clean_receipts(spark, folder).withColumn(
        "items_detail", F.to_json(F.array(F.struct(F.lit(1).alias("line"), F.col("total_cents").alias("total"))))
    )
    detail = lookup.receipt_detail(receipts, line_items(spark, folder))
    texts = F.transform("line_items", lambda i: F.concat_ws(
        ":", i["name"], i["price_cents"], i["sku"], i["brand"], i["quantity"].cast("int"), i["category"]
    ))
    return detail.select("transaction_id", "total_cents", F.array_join(texts, "|").alias("line_items"))


@query("receipt_without_lines", f"WITH {RECEIPTS} SELECT transaction_id, total_cents FROM receipts")
def q_receipt_without_lines(spark, folder):
    detail = lookup.receipt_detail(clean_receipts(spark, folder), line_items(spark, folder), include_line_items=False)
    return detail.select("transaction_id", "total_cents")


@query("customer_history", f"""WITH {RECEIPTS}
SELECT {_PAGE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_ts DESC, transaction_id) AS position FROM receipts)
WHERE position > 2 AND position <= 22""")
def q_customer_history(spark, folder):
    page = lookup.customer_history(clean_receipts(spark, folder), limit=20, offset=2).select(*_PAGE)
    return flat(page.withColumn("position", F.col("position").cast("bigint")))


@query("recent_receipts", f"""WITH {RECEIPTS}
SELECT {_PAGE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_ts DESC, transaction_id) AS position FROM receipts)
WHERE position <= 5""")
def q_recent_receipts(spark, folder):
    page = lookup.recent_receipts(clean_receipts(spark, folder)).select(*_PAGE)
    return flat(page.withColumn("position", F.col("position").cast("bigint")))


@query("recent_spending", f"""WITH {SPENDING}
SELECT customer_id, department_code, month_key, total_spend_cents, trip_count FROM spending WHERE month_key >= '2001-03'""")
def q_recent_spending(spark, folder):
    rows = lookup.recent_spending(spending_table(spark, folder), AS_OF, 3)
    return rows.select("customer_id", "department_code", "month_key", "total_spend_cents", "trip_count")


@query("serving_spending", f"""WITH {SPENDING}
SELECT customer_id, department_code AS category_l1, month_key || '-01' AS summary_month, total_spend_cents AS total_cents,
       trip_count AS visit_count FROM spending""")
def q_serving_spending(spark, folder):
    return flat(context.serving_spending(spending_table(spark, folder)))


_DELIVERIES = """deliveries AS (
  SELECT event_id, user_id, event_type, o_custkey AS owner, o_orderkey AS found,
         CASE event_type WHEN 'click' THEN 'email' WHEN 'view' THEN 'print' ELSE event_type END AS method, ts
  FROM events LEFT JOIN orders ON o_orderkey = event_id * 2)
"""


def delivery_requests(spark, folder):
    """Every event read as a request to deliver a receipt; half of the numbers lie past the last receipt."""
    kind = F.col("event_type")
    return wh.table(spark, folder, "events").select(
        F.col("event_id").alias("delivery_id"), (F.col("event_id") * 2).alias("transaction_id"),
        F.lit(None).cast("bigint").alias("customer_id"),
        F.when(kind == "click", "email").when(kind == "view", "print").otherwise(kind).alias("method"),
        F.concat(F.lit("to-"), "user_id").alias("target"), F.col("user_id").cast("string").alias("rep"),
        F.col("ts").cast("timestamp").alias("asked_at"),
    )


@query("deliver_batch", f"""WITH {_DELIVERIES}
SELECT event_id AS delivery_id, event_id * 2 AS transaction_id, owner AS customer_id, method AS delivery_method,
       'to-' || user_id AS delivery_target, CAST(user_id AS VARCHAR) AS delivered_by_rep, 'sent' AS status,
       '2024-02-01 00:00:00' AS created_at
FROM deliveries WHERE found IS NOT NULL AND method IN ('email', 'print')""")
def q_deliver_batch(spark, folder):
    sent, _ = lookup.deliver_batch(delivery_requests(spark, folder), clean_receipts(spark, folder), "2024-02-01")
    return flat(sent)


@query("deliver_batch_refused", f"""WITH {_DELIVERIES}
SELECT event_id AS delivery_id, CASE WHEN found IS NULL THEN 'Receipt not found' ELSE 'Unknown delivery method: ' || method END AS error
FROM deliveries WHERE found IS NULL OR method NOT IN ('email', 'print')""")
def q_deliver_batch_refused(spark, folder):
    _, refused = lookup.deliver_batch(delivery_requests(spark, folder), clean_receipts(spark, folder), "2024-02-01")
    return refused.select("delivery_id", "error")


@query("delivery_history", f"""SELECT customer_id, delivery_id, created_at FROM (
  SELECT user_id AS customer_id, event_id AS delivery_id, {ts('ts')} AS created_at,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 50""")
def q_delivery_history(spark, folder):
    log = wh.table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("delivery_id"), F.col("ts").cast("timestamp").alias("created_at")
    )
    return flat(lookup.delivery_history(log))


@query("conversation_history", "SELECT conv_id, turn, role, text FROM conversations")
def q_conversation_history(spark, folder):
    return lookup.conversation_history(wh.table(spark, folder, "conversations"), ["conv_id"], "turn")


@query("agent_state", """SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS last_text, count(DISTINCT turn % 3) AS turn_count
FROM conversations WHERE turn IS NOT NULL GROUP BY conv_id""")
def q_agent_state(spark, folder):
    """The state of every conversation after its turns have come in three batches: the latest turn, and how often it was written."""
    root = run_folder(spark, "agent-state")
    turns = wh.table(spark, folder, "conversations").filter("turn IS NOT NULL").select("conv_id", "turn", "role", F.col("text").alias("last_text"))
    for version in range(3):
        keyed.write_upsert(turns.filter(F.col("turn") % 3 == version), root, ["conv_id"], "turn", version)
    return keyed.read_current(spark, root, turns.schema, ["conv_id"], "turn", "turn_count")


@query("recent_turns", """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS rn FROM conversations) WHERE rn <= 2""")
def q_recent_turns(spark, folder):
    return lookup.recent_turns(wh.table(spark, folder, "conversations"), ["conv_id"], "turn", 2)


@query("query_cache_table", f"""SELECT sha256(lower(trim(event_type || ' ' || props))) AS query_hash, count(*) AS hit_count,
       {ts('min(ts)')} AS created_at, {ts("min(ts) + INTERVAL 24 HOURS")} AS expires_at
FROM events GROUP BY 1 HAVING min(ts) + INTERVAL 24 HOURS > TIMESTAMP '2024-01-02 06:00:00'""")
def q_query_cache_table(spark, folder):
    asked = wh.table(spark, folder, "events").select(
        F.concat_ws(" ", F.upper("event_type"), "props").alias("q"), F.col("ts").cast("timestamp").alias("at")
    )
    return flat(lookup.query_cache_table(asked, "q", "at", "2024-01-02 06:00:00"))


_CONTEXT = PROFILES + f""", often AS (
  SELECT customer_id, date_diff('day', min(transaction_ts), max(transaction_ts)) / nullif(count(*) - 1, 0) AS every FROM receipts GROUP BY 1),
counted AS (SELECT transaction_id, count(*) AS lines FROM items GROUP BY 1),
prefer AS (
  SELECT customer_id, store_id AS pid, store_name AS pname, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, store_id) AS rn
  FROM receipts GROUP BY 1, 2, 3),
page AS (
  SELECT customer_id, string_agg(transaction_id || '@' || {ts('transaction_ts')} || coalesce('@' || lines, ''), '|' ORDER BY position) AS recent,
         string_agg(store_name || ' ' || strftime(transaction_ts, '%Y-%m-%d') || ' ' || format('${{:,.2f}}', total_cents / 100.0), '; ' ORDER BY position) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY transaction_ts DESC, transaction_id) AS position
        FROM receipts LEFT JOIN counted USING (transaction_id))
  WHERE position <= 5 GROUP BY 1),
spent0 AS (
  SELECT customer_id, department_code, strftime(transaction_ts, '%Y-%m') AS month_key, CAST(sum(extended_cents) AS BIGINT) AS spend
  FROM items i JOIN receipts r ON r.transaction_id = i.transaction_id WHERE strftime(transaction_ts, '%Y-%m') BETWEEN '2001-03' AND '2001-06' GROUP BY 1, 2, 3),
spent AS (
  SELECT customer_id, string_agg(month_key || '/' || department_code || '/' || spend, '|' ORDER BY month_key DESC, spend DESC, department_code DESC) AS spending,
         string_agg(department_code || ' ' || month_key || ' ' || format('${{:,.2f}}', spend / 100.0), '; ' ORDER BY month_key DESC, spend DESC, department_code DESC)
           FILTER (WHERE n <= 10) AS shown_spend
  FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month_key DESC, spend DESC, department_code DESC) AS n FROM spent0) GROUP BY 1)
"""


def context_rows(spark, folder):
    """Context rows over stored headers, items and spending, which are read several times."""
    root = run_folder(spark, "context")
    headers = batch.stored(clean_receipts(spark, folder), f"{root}/receipts")
    items = batch.stored(clean_items(spark, folder), f"{root}/items")
    spending = batch.write_gold(headers, items, root, ("spending_summary",))["spending_summary"]
    receipts = silver.receipt_headers(headers, items)
    return context.customer_context(context.serving_profiles(headers, spending), receipts, spending, AS_OF)


@query("customer_context", f"""WITH {_CONTEXT}
SELECT p.customer_id, total_transactions AS visits, lifetime_spend_cents, pid AS preferred_store_id, top_categories AS categories, recent, spending
FROM profiles p JOIN prefer ON prefer.customer_id = p.customer_id AND rn = 1 LEFT JOIN top t ON t.customer_id = p.customer_id
LEFT JOIN page ON page.customer_id = p.customer_id LEFT JOIN spent ON spent.customer_id = p.customer_id""")
def q_customer_context(spark, folder):
    return context_rows(spark, folder).select(
        "customer_id", F.col("profile.total_transactions").alias("visits"), F.col("profile.lifetime_spend_cents"),
        F.col("profile.preferred_store_id"), F.array_join("profile.top_categories", "|").alias("categories"),
        F.array_join(F.transform("recent_receipts", lambda r: F.concat_ws("@", r["transaction_id"], text_ts(r["transaction_ts"]), r["item_count"])), "|").alias("recent"),
        F.array_join(F.transform("spending_by_category", lambda s: F.concat_ws(
            "/", s["month_key"], s["department_code"], s["total_spend_cents"])), "|").alias("spending"),
    )


@query("rep_briefing", f"""WITH {_CONTEXT}
SELECT p.customer_id, 'Lifetime spend ' || format('${{:,.2f}}', lifetime_spend_cents / 100.0) || ', average basket ' ||
       format('${{:,.2f}}', avg_basket_cents / 100.0) || ', visits ' || total_transactions ||
       coalesce(', one every ' || CAST(floor(every + 0.5) AS BIGINT) || ' days', '') || '. Prefers ' || pname || '. Buys ' ||
       coalesce(replace(top_categories, '|', ', '), 'nothing on record') || '. Receipts: ' || coalesce(shown, 'none') ||
       '. Recent spend: ' || coalesce(shown_spend, 'none') || '.' AS briefing
FROM profiles p JOIN prefer ON prefer.customer_id = p.customer_id AND rn = 1 LEFT JOIN top t ON t.customer_id = p.customer_id
LEFT JOIN page ON page.customer_id = p.customer_id LEFT JOIN spent ON spent.customer_id = p.customer_id LEFT JOIN often ON often.customer_id = p.customer_id""")
def q_rep_briefing(spark, folder):
    return context.rep_briefing(context_rows(spark, folder)).select("customer_id", "briefing")


@query("scoped_sql", f"""WITH {SPENDING}
SELECT month_key, CAST(sum(total_spend_cents) AS BIGINT) AS spend, CAST(count(*) AS BIGINT) AS n FROM spending WHERE customer_id = 101 GROUP BY 1 ORDER BY 1 DESC LIMIT 50""")
def q_scoped_sql(spark, folder):
    tables = {"spending_summary": spending_table(spark, folder)}
    text = ("SELECT month_key, sum(total_spend_cents) AS spend, count(*) AS n FROM spending_summary "
            "WHERE customer_id = {{customer_id}} GROUP BY month_key ORDER BY month_key DESC")
    return context.scoped_sql(spark, tables, text, customer_id=101)


_HOT = BOTH + """, hot AS (SELECT * FROM receipts),
lake AS (SELECT r.* FROM receipts r JOIN orders ON o_orderkey = r.transaction_id WHERE o_orderstatus <> 'P')
"""


def lake_receipts(spark, folder):
    """Receipts whose order is settled; the open ones are still on their way to the lake."""
    settled = wh.table(spark, folder, "orders").filter(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("transaction_id"))
    return clean_receipts(spark, folder).join(settled, "transaction_id", "left_semi")


@query("gap_anti_join", f"""WITH {_HOT}
SELECT transaction_id, total_cents FROM hot WHERE transaction_ts >= TIMESTAMP '2001-07-01' AND transaction_id NOT IN (SELECT transaction_id FROM lake)""")
def q_gap_anti_join(spark, folder):
    missing = reconcile.gap_anti_join(clean_receipts(spark, folder), lake_receipts(spark, folder), "2001-08-01", 31 * 24)
    return missing.select("transaction_id", "total_cents")


@query("reconcile_gap_summary", f"""WITH {_HOT}, missing AS (
  SELECT * FROM hot WHERE transaction_ts >= TIMESTAMP '1995-08-01' AND transaction_id NOT IN (SELECT transaction_id FROM lake))
SELECT count(*) AS gap_count, {ts('min(transaction_ts)')} AS oldest_missing_ts, {ts('max(transaction_ts)')} AS newest_missing_ts,
       CAST(52608 AS INTEGER) AS lookback_hours, 'Gap detected — consider triggering a Gold pipeline refresh.' AS recommendation FROM missing""")
def q_reconcile_gap_summary(spark, folder):
    hours = 2192 * 24
    missing = reconcile.gap_anti_join(clean_receipts(spark, folder), lake_receipts(spark, folder), "2001-08-01", hours)
    return flat(reconcile.reconcile_gap_summary(missing, hours))


@query("repair_gaps", f"WITH {_HOT} SELECT transaction_id, total_cents FROM hot")
def q_repair_gaps(spark, folder):
    hot, lake = clean_receipts(spark, folder), lake_receipts(spark, folder)
    missing = reconcile.gap_anti_join(hot, lake, "2001-08-02", 24 * 365 * 50)
    return reconcile.repair_gaps(lake, missing).select("transaction_id", "total_cents")


@query("hot_cold_receipts", f"""WITH {_HOT}
SELECT h.transaction_id, coalesce(l.total_cents, h.total_cents + 1) AS total_cents, CASE WHEN l.transaction_id IS NULL THEN 'hot' ELSE 'lake' END AS source
FROM hot h LEFT JOIN lake l ON l.transaction_id = h.transaction_id""")
def q_hot_cold_receipts(spark, folder):
    hot = clean_receipts(spark, folder).withColumn("total_cents", F.col("total_cents") + 1)
    return reconcile.hot_cold_receipts(hot, lake_receipts(spark, folder)).select("transaction_id", "total_cents", "source")


@query("verify_counts", """SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS before_rows, count(*) FILTER (WHERE o_orderstatus = 'P') AS moved_rows,
       count(*) AS after_rows, TRUE AS matches FROM orders""")
def q_verify_counts(spark, folder):
    orders = wh.table(spark, folder, "orders")
    return reconcile.verify_counts(
        orders.filter(F.col("o_orderstatus") != "P"), orders.filter(F.col("o_orderstatus") == "P"), orders
    )


@query("table_validation", """SELECT 'orders' AS table_name, TRUE AS present, (SELECT count(*) FROM orders) AS row_count
UNION ALL SELECT 'lineitem', TRUE, (SELECT count(*) FROM lineitem) UNION ALL SELECT 'missing', FALSE, NULL""")
def q_table_validation(spark, folder):
    places = {name: f"{folder}/{name}.parquet" for name in ("orders", "lineitem", "missing")}
    return reconcile.table_validation(spark, places)


@query("change_feed", """WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'),
new AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED')
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
       CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS _change_type,
       CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus OR o.o_totalprice <> n.o_totalprice""")
def q_change_feed(spark, folder):
    orders = wh.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    priority = F.col("o_orderpriority")
    old = orders.filter(priority != "5-LOW").drop("o_orderpriority")
    new = orders.filter(priority != "4-NOT SPECIFIED").withColumn(
        "o_orderstatus", F.when(priority == "1-URGENT", "X").otherwise(F.col("o_orderstatus"))
    ).drop("o_orderpriority")
    return reconcile.change_feed(old, new, ["o_orderkey"])


@query("delete_customer", f"""WITH {RECEIPTS} SELECT transaction_id, customer_id FROM receipts
WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_delete_customer(spark, folder):
    erased = wh.table(spark, folder, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("customer_id"))
    return reconcile.delete_customers(clean_receipts(spark, folder), erased).select("transaction_id", "customer_id")


@query("catalog_enrich", f"WITH {ITEMS} SELECT transaction_id, item_seq, sku, product_desc, department_code, brand FROM items")
def q_catalog_enrich(spark, folder):
    return clean_items(spark, folder).select("transaction_id", "item_seq", "sku", "product_desc", "department_code", "brand")


@query("federated_join", f"""WITH {GOLD}
SELECT r.transaction_id, r.total_cents, g.item_count, g.month_key FROM receipts r JOIN gold g ON g.transaction_id = r.transaction_id""")
def q_federated_join(spark, folder):
    serving = clean_receipts(spark, folder).select("transaction_id", "total_cents")
    lake = gold_table(spark, folder).select("transaction_id", "item_count", "month_key")
    return scans.federated_join(serving, lake, ["transaction_id"])


@query("page_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1000")
def q_page_scan(spark, folder):
    return scans.page_scan(wh.table(spark, folder, "orders"), "o_orderkey", 1000, after=100).select("o_orderkey", "o_custkey")


@query("has_department", f"WITH {GOLD} SELECT transaction_id FROM gold WHERE list_has_any(string_split(departments, '|'), ['PROMO', 'LARGE'])")
def q_has_department(spark, folder):
    return gold_table(spark, folder).filter(rt.has_department("departments", ["PROMO", "LARGE"])).select("transaction_id")
