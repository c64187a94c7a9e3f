"""Named queries over the test tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.operators.dedup import dedup_items, dedup_receipts
from tillworks.plans.silver import catalog_enrich
from tillworks.sources import warehouse as wh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def text_ts(col: Column | str) -> Column:
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd HH:mm:ss")


def flat(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, decimals as doubles, string arrays joined, for comparison."""
    shown = {}
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            shown[field.name] = text_ts(col)
        elif isinstance(field.dataType, T.DateType):
            shown[field.name] = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(field.dataType, T.DecimalType):
            shown[field.name] = col.cast("double")
        elif isinstance(field.dataType, T.NullType):
            shown[field.name] = col.cast("string")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            shown[field.name] = F.array_join(col, "|")
    return df.withColumns(shown) if shown else df


def clean_receipts(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_receipts(wh.raw_receipts(spark, folder))


def clean_items(spark: SparkSession, folder: str) -> DataFrame:
    """Deduplicated on the narrow line rows, then described."""
    lines = dedup_items(wh.raw_items(spark, folder, with_product=False))
    return catalog_enrich(lines, wh.products(spark, folder))


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def ts(col: str) -> str:
    return TS.format(col)


RAW_RECEIPTS = """
raw_receipts AS (
  SELECT event_id, transaction_id, store_id, store_name, customer_id, transaction_ts,
         total_cents - total_cents // 11 AS subtotal_cents, total_cents // 11 AS tax_cents, total_cents,
         tender_type, CASE WHEN tender_type IN ('CREDIT', 'DEBIT')
                           THEN lpad(CAST(customer_id % 10000 AS VARCHAR), 4, '0') END AS card_last4,
         transaction_ts AS ingested_ts
  FROM (SELECT 'evt-' || o_orderkey AS event_id, o_orderkey AS transaction_id, c_nationkey AS store_id,
               n_name AS store_name, o_custkey AS customer_id, o_orderdate AS transaction_ts,
               CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS total_cents,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CREDIT' WHEN '2' THEN 'DEBIT'
                    WHEN '3' THEN 'CASH' WHEN '4' THEN 'EBT' ELSE 'CHECK' END AS tender_type
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey))
"""

RAW_ITEMS = """
raw_items AS (
  SELECT event_id, transaction_id, item_seq, sku, quantity,
         CAST(floor(extended_cents / quantity) AS BIGINT) AS unit_price_cents,
         extended_cents, discount_cents, ingested_ts
  FROM (SELECT 'evt-' || l_orderkey AS event_id, l_orderkey AS transaction_id, l_linenumber AS item_seq,
               l_partkey AS sku, l_quantity AS quantity,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS extended_cents,
               CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS discount_cents,
               l_shipdate AS ingested_ts
        FROM lineitem))
"""

LINES = RAW_ITEMS + """,
lines AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id, item_seq
             ORDER BY ingested_ts DESC, discount_cents DESC, event_id DESC, extended_cents DESC,
                      quantity DESC, sku DESC, unit_price_cents DESC) AS rn
    FROM raw_items)
  WHERE rn = 1 AND extended_cents >= 0)
"""

ITEMS = LINES + """,
items AS (
  SELECT lines.*, p_name AS product_desc, p_type AS department_code, p_brand AS brand
  FROM lines LEFT JOIN part ON p_partkey = sku)
"""

RECEIPTS = RAW_RECEIPTS + """,
receipts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ingested_ts DESC) AS rn FROM raw_receipts)
  WHERE rn = 1 AND total_cents > 0)
"""

BOTH = RECEIPTS + "," + ITEMS

SILVER = BOTH + """,
folded AS (
  SELECT transaction_id, count(*) AS item_count, sum(extended_cents) AS items_extended_cents,
         array_to_string(list(product_desc ORDER BY item_seq)[1:3], ', ') AS first_names,
         array_to_string(list(product_desc ORDER BY item_seq)[1:5], ', ') AS five_names,
         array_to_string(list_sort(list(DISTINCT department_code)), '|') AS departments,
         array_to_string(list(item_seq || ':' || sku || ':' || extended_cents ORDER BY item_seq), '|') AS items_detail
  FROM items GROUP BY transaction_id),
silver AS (
  SELECT r.*, item_count, items_extended_cents, departments, items_detail, first_names, five_names
  FROM receipts r LEFT JOIN folded USING (transaction_id))
"""

GOLD = SILVER + """,
gold AS (
  SELECT *, CASE WHEN item_count > 3 THEN first_names || ' + ' || (item_count - 3) || ' more'
                 ELSE first_names END AS item_summary,
         strftime(transaction_ts, '%Y-%m') AS month_key,
         strftime(transaction_ts, '%Y') || '-W' || lpad(CAST(weekofyear(transaction_ts) AS VARCHAR), 2, '0') AS week_key
  FROM silver)
"""


def detail_text(col: str = "items_detail") -> Column:
    return F.array_join(
        F.transform(col, lambda i: F.concat_ws(":", i["item_seq"], i["sku"], i["extended_cents"])), "|"
    )
