"""Dedup, silver and gold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.functions import receipt_text as rt
from tillworks.operators.dedup import dedup_items, dedup_receipts
from tillworks.plans import gold, silver
from tillworks.registry.base import (
    BOTH, GOLD, ITEMS, LINES, RECEIPTS, SILVER, clean_items, clean_receipts, detail_text, flat, query, ts,
)
from tillworks.sources import warehouse as wh

_HEADER_SQL = (
    f"transaction_id, event_id, store_id, store_name, customer_id, {ts('transaction_ts')} AS transaction_ts, "
    "subtotal_cents, tax_cents, total_cents, tender_type, card_last4"
)
_HEADER = [
    "transaction_id", "event_id", "store_id", "store_name", "customer_id", "transaction_ts",
    "subtotal_cents", "tax_cents", "total_cents", "tender_type", "card_last4",
]


def silver_table(spark, folder):
    """Receipts with all their lines, whatever their number."""
    return silver.receipt_lookup_silver(clean_receipts(spark, folder), clean_items(spark, folder), part_size=None)


def gold_table(spark, folder):
    return gold.receipt_lookup(silver_table(spark, folder))


@query("dedup_receipts", f"WITH {RECEIPTS} SELECT {_HEADER_SQL} FROM receipts")
def q_dedup_receipts(spark, folder):
    return flat(dedup_receipts(wh.raw_receipts(spark, folder)).select(*_HEADER))


@query("dedup_items", f"""WITH {LINES}
SELECT transaction_id, item_seq, sku, quantity, unit_price_cents, extended_cents, discount_cents,
       {ts('ingested_ts')} AS ingested_ts FROM lines""")
def q_dedup_items(spark, folder):
    kept = dedup_items(wh.raw_items(spark, folder, with_product=False))
    return flat(kept.select(
        "transaction_id", "item_seq", "sku", "quantity", "unit_price_cents", "extended_cents",
        "discount_cents", "ingested_ts",
    ))


@query("items_per_receipt", f"""WITH {SILVER}
SELECT transaction_id, CAST(0 AS BIGINT) AS item_part, item_count, CAST(items_extended_cents AS BIGINT) AS items_extended_cents,
       items_detail, departments FROM folded""")
def q_items_per_receipt(spark, folder):
    folded = silver.items_per_receipt(clean_items(spark, folder))
    return flat(folded.withColumn("items_detail", detail_text()))


@query("receipt_lookup_silver", f"""WITH {SILVER}
SELECT {_HEADER_SQL}, item_count, CAST(items_extended_cents AS BIGINT) AS items_extended_cents, departments, items_detail FROM silver""")
def q_receipt_lookup_silver(spark, folder):
    rows = silver_table(spark, folder).withColumn("items_detail", detail_text())
    return flat(rows.select(*_HEADER, "item_count", "items_extended_cents", "departments", "items_detail"))


@query("receipt_lookup", f"""WITH {GOLD}
SELECT transaction_id, store_id, store_name, customer_id, {ts('transaction_ts')} AS transaction_ts, subtotal_cents,
       tax_cents, total_cents, tender_type, card_last4, item_count, item_summary, departments, items_detail,
       CAST(items_extended_cents AS BIGINT) AS items_extended_cents, month_key, week_key,
       CAST(NULL AS VARCHAR) AS pos_terminal_id, CAST(NULL AS VARCHAR) AS cashier_id, CAST(CASE WHEN item_count IS NOT NULL THEN 1 END AS BIGINT) AS item_parts
FROM gold""")
def q_receipt_lookup(spark, folder):
    return flat(gold_table(spark, folder).withColumn("items_detail", detail_text()))


@query("item_summary", f"WITH {GOLD} SELECT transaction_id, item_summary FROM gold")
def q_item_summary(spark, folder):
    return gold_table(spark, folder).select("transaction_id", "item_summary")


@query("item_summary_qty", f"""WITH {ITEMS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY item_seq) AS rn,
                  count(*) OVER (PARTITION BY transaction_id) AS n FROM items)
SELECT transaction_id,
       string_agg((CASE WHEN quantity <> 1 THEN CAST(CAST(quantity AS BIGINT) AS VARCHAR) || 'x ' ELSE '' END) || product_desc, ', '
                  ORDER BY rn) || CASE WHEN max(n) > 3 THEN ' + ' || (max(n) - 3) || ' more' ELSE '' END AS item_summary
FROM ranked WHERE rn <= 3 GROUP BY transaction_id""")
def q_item_summary_qty(spark, folder):
    return summary_qty(clean_items(spark, folder))


def summary_qty(items):
    labelled = items.withColumn("product_desc", rt.quantity_label(F.col("quantity"), F.col("product_desc")))
    return silver.line_figures(labelled).select("transaction_id", rt.item_summary("first_names", "item_count").alias("item_summary"))


@query("item_summary_top5", f"""WITH {SILVER}
SELECT transaction_id, CASE WHEN item_count > 5 THEN five_names || ', +' || (item_count - 5) || ' more'
                            ELSE five_names END AS item_summary FROM folded""")
def q_item_summary_top5(spark, folder):
    return summary_five(clean_items(spark, folder))


def summary_five(items):
    return silver.line_figures(items).select("transaction_id", rt.summary_top5("first_names", "item_count").alias("item_summary"))


@query("calendar_keys", f"""WITH {RECEIPTS}
SELECT transaction_id, strftime(transaction_ts, '%Y-%m') AS month_key,
       strftime(transaction_ts, '%Y') || '-W' || lpad(CAST(weekofyear(transaction_ts) AS VARCHAR), 2, '0') AS week_key,
       strftime(transaction_ts, '%G-W%V') AS iso_week_key
FROM receipts""")
def q_calendar_keys(spark, folder):
    return clean_receipts(spark, folder).select(
        "transaction_id", rt.month_key("transaction_ts").alias("month_key"),
        rt.week_key("transaction_ts").alias("week_key"), rt.week_key("transaction_ts", iso=True).alias("iso_week_key"),
    )


SPENDING = BOTH + """,
spending AS (
  SELECT customer_id, department_code, strftime(transaction_ts, '%Y-%m') AS month_key,
         CAST(sum(extended_cents) AS BIGINT) AS total_spend_cents,
         CAST(sum(discount_cents) AS BIGINT) AS total_discount_cents,
         count(*) AS item_count, count(DISTINCT i.transaction_id) AS trip_count,
         min(transaction_ts) AS first_purchase, max(transaction_ts) AS last_purchase
  FROM items i JOIN receipts r ON r.transaction_id = i.transaction_id
  WHERE customer_id IS NOT NULL GROUP BY 1, 2, 3)
"""


def spending_table(spark, folder):
    return gold.spending_summary(clean_items(spark, folder), clean_receipts(spark, folder))


@query("spending_summary", f"""WITH {SPENDING}
SELECT * REPLACE ({ts('first_purchase')} AS first_purchase, {ts('last_purchase')} AS last_purchase) FROM spending""")
def q_spending_summary(spark, folder):
    return flat(spending_table(spark, folder))


TOP_DEPARTMENTS = BOTH + """,
dept AS (
  SELECT customer_id, department_code, CAST(sum(extended_cents) AS BIGINT) AS dept_spend_cents
  FROM items i JOIN receipts r ON r.transaction_id = i.transaction_id WHERE customer_id IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY dept_spend_cents DESC, department_code) AS rank FROM dept),
top AS (
  SELECT customer_id, string_agg(department_code || ':' || dept_spend_cents, '|' ORDER BY rank) AS top_departments,
         string_agg(department_code, '|' ORDER BY rank) AS top_categories
  FROM ranked WHERE rank <= 5 GROUP BY customer_id)
"""


def _departments_text():
    return F.array_join(
        F.transform("top_departments", lambda d: F.concat_ws(":", d["department_code"], d["dept_spend_cents"])), "|"
    )


@query("top_departments", f"WITH {TOP_DEPARTMENTS} SELECT customer_id, top_departments FROM top")
def q_top_departments(spark, folder):
    rows = gold.top_departments(clean_items(spark, folder), clean_receipts(spark, folder))
    return rows.withColumn("top_departments", _departments_text())


@query("top_categories", f"WITH {TOP_DEPARTMENTS} SELECT customer_id, top_categories FROM top")
def q_top_categories(spark, folder):
    return flat(gold.top_categories(clean_items(spark, folder), clean_receipts(spark, folder)))


PROFILES = TOP_DEPARTMENTS + """,
totals AS (
  SELECT customer_id, count(*) AS total_transactions, CAST(sum(total_cents) AS BIGINT) AS lifetime_spend_cents,
         CAST(sum(total_cents) // count(*) AS BIGINT) AS avg_basket_cents,
         min(transaction_ts) AS first_transaction, max(transaction_ts) AS last_transaction,
         count(DISTINCT store_id) AS stores_visited, count(DISTINCT strftime(transaction_ts, '%Y-%m')) AS active_months
  FROM receipts WHERE customer_id IS NOT NULL GROUP BY 1),
profiles AS (SELECT totals.*, top_departments FROM totals LEFT JOIN top USING (customer_id))
"""


def profile_table(spark, folder):
    return gold.customer_profiles(clean_items(spark, folder), clean_receipts(spark, folder))


@query("customer_profiles", f"""WITH {PROFILES}
SELECT * REPLACE ({ts('first_transaction')} AS first_transaction, {ts('last_transaction')} AS last_transaction) FROM profiles""")
def q_customer_profiles(spark, folder):
    return flat(profile_table(spark, folder).withColumn("top_departments", _departments_text()))


@query("product_catalog", f"""WITH {ITEMS}
SELECT CAST(sku AS VARCHAR) AS product_key, CAST(NULL AS VARCHAR) AS upc, sku, product_desc, department_code,
       count(*) AS purchase_count, {ts('max(ingested_ts)')} AS last_seen
FROM items GROUP BY sku, product_desc, department_code""")
def q_product_catalog(spark, folder):
    return flat(gold.product_catalog(clean_items(spark, folder)))


@query("product_catalog_latest", f"""WITH {ITEMS},
catalog AS (SELECT product_desc AS product_key, sku, department_code, count(*) AS purchase_count, max(ingested_ts) AS last_seen
            FROM items GROUP BY 1, 2, 3)
SELECT product_key, sku, department_code, purchase_count, {ts('last_seen')} AS last_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY last_seen DESC, purchase_count DESC, sku DESC) AS rn FROM catalog)
WHERE rn = 1""")
def q_product_catalog_latest(spark, folder):
    by_name = clean_items(spark, folder).select(
        F.col("product_desc").alias("upc"), "sku", F.col("sku").alias("product_desc"), "department_code", "ingested_ts"
    )
    latest = gold.product_catalog_latest(gold.product_catalog(by_name))
    return flat(latest.select("product_key", "sku", "department_code", "purchase_count", "last_seen"))


@query("receipt_stats", f"""WITH {RECEIPTS}
SELECT count(*) AS total_receipts, count(DISTINCT customer_id) AS unique_customers, count(DISTINCT store_name) AS unique_stores,
       {ts('min(transaction_ts)')} AS earliest, {ts('max(transaction_ts)')} AS latest, min(total_cents) AS min_cents,
       max(total_cents) AS max_cents, CAST(sum(total_cents) // count(*) AS BIGINT) AS avg_cents,
       CAST(sum(total_cents) AS BIGINT) AS revenue_cents FROM receipts""")
def q_receipt_stats(spark, folder):
    return flat(gold.receipt_stats(clean_receipts(spark, folder)))


@query("line_item_stats", f"""WITH {LINES}
SELECT count(*) AS total_lines, count(DISTINCT transaction_id) AS total_receipts, count(DISTINCT sku) AS unique_skus,
       CAST(sum(extended_cents) AS BIGINT) AS revenue_cents, count(*) FILTER (WHERE sku = 7) AS sku_lines FROM lines""")
def q_line_item_stats(spark, folder):
    return gold.line_item_stats(dedup_items(wh.raw_items(spark, folder, with_product=False)), sku=7)


@query("visit_frequency", f"""WITH {RECEIPTS}
SELECT customer_id, count(*) AS visits,
       round(date_diff('day', min(transaction_ts), max(transaction_ts)) / nullif(count(*) - 1, 0), 6) AS visit_frequency_days
FROM receipts GROUP BY 1""")
def q_visit_frequency(spark, folder):
    rows = gold.visit_frequency(clean_receipts(spark, folder))
    return rows.withColumn("visit_frequency_days", F.round("visit_frequency_days", 6))


@query("preferred_store", f"""WITH {RECEIPTS},
v AS (SELECT customer_id, tender_type, store_id, store_name, count(*) AS visits FROM receipts GROUP BY ALL)
SELECT customer_id, preferred_store_id, preferred_store_name, visits FROM (
  SELECT customer_id, store_id AS preferred_store_id, store_name AS preferred_store_name, sum(visits)::BIGINT AS visits,
         row_number() OVER (PARTITION BY customer_id ORDER BY sum(visits) DESC, store_id) AS rn FROM v GROUP BY 1, 2, 3)
WHERE rn = 1""")
def q_preferred_store(spark, folder):
    return gold.preferred_store(clean_receipts(spark, folder))


@query("purchase_frequency", f"""WITH {LINES}, {RECEIPTS},
days AS (SELECT DISTINCT customer_id, sku, CAST(transaction_ts AS DATE) AS day
         FROM lines l JOIN receipts r ON r.transaction_id = l.transaction_id)
SELECT customer_id, sku, count(*) AS purchase_days,
       round(date_diff('day', min(day), max(day)) / nullif(count(*) - 1, 0), 6) AS avg_days_between
FROM days GROUP BY 1, 2""")
def q_purchase_frequency(spark, folder):
    lines = dedup_items(wh.raw_items(spark, folder, with_product=False))
    rows = gold.purchase_frequency(lines, clean_receipts(spark, folder))
    return rows.withColumn("avg_days_between", F.round("avg_days_between", 6))
