"""Receipt detail, customer history, spending, deliveries, conversations: for one customer or for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks import schemas
from tillworks.operators.dedup import top_per_key
from tillworks.operators.search import newest_first
from tillworks.plans.silver import PART_SIZE, in_parts, shown_lines


def _only(df: DataFrame, column: str, value: object | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def parse_items_detail(text: Column | str) -> Column:
    """Line items in a JSON array: name, price and quantity with their defaults; bad JSON gives an empty array."""
    items = F.from_json(F.col(text) if isinstance(text, str) else text, schemas.ITEMS_DETAIL_JSON)
    real = F.filter(F.coalesce(items, F.array().cast(schemas.ITEMS_DETAIL_JSON)), lambda i: i.isNotNull())
    return F.transform(real, lambda i: F.struct(
        F.coalesce(i["item"], F.lit("Unknown Item")).alias("name"),
        F.coalesce(i["total"], F.lit(0)).cast("bigint").alias("price_cents"),
        F.lit(None).cast("string").alias("sku"),
        F.lit(None).cast("string").alias("brand"),
        F.coalesce(i["qty"], F.lit(1.0)).alias("quantity"),
        F.lit(None).cast("string").alias("category"),
    ))


def _fold(lines: DataFrame, keys: list[str]) -> DataFrame:
    row = F.struct(
        F.col("line_number").isNull().alias("unnumbered"), "line_number",
        F.col("product_name").alias("name"), F.col("line_total_cents").alias("price_cents"),
        F.col("sku").cast("string").alias("sku"), "brand",
        F.coalesce(F.col("quantity").cast("double"), F.lit(0.0)).alias("quantity"), F.col("category_l1").alias("category"),
    )
    shown = ("name", "price_cents", "sku", "brand", "quantity", "category")
    ordered = F.sort_array(F.collect_list(row))
    return lines.groupBy(*keys).agg(F.transform(ordered, lambda r: F.struct(*(r[f].alias(f) for f in shown))).alias("line_items"))


def line_parts(lines: DataFrame, part_size: int = PART_SIZE) -> DataFrame:
    """Line arrays per receipt and part, in order, for every receipt whatever its length; unnumbered lines are parts -1, -2, …"""
    return _fold(in_parts(lines, "line_number", part_size), ["transaction_id", "item_part"])


def receipt_detail(
    receipts: DataFrame, lines: DataFrame, transaction_id: object | None = None,
    items_json: str | None = "items_detail", part_size: int | None = None, include_line_items: bool = True,
) -> DataFrame:
    """Receipts with their line items in order as one array, one row each; without lines the JSON column is read instead.

    The array holds every line. With a part size it holds the lowest part of `line_parts`, and `line_parts` tells how many
    there are. With `include_line_items` off the lines are not read at all.
    """
    receipts = _only(receipts, "transaction_id", transaction_id)
    if not include_line_items:
        return receipts
    lines = _only(lines, "transaction_id", transaction_id)
    if part_size is None:
        shown = _fold(lines, ["transaction_id"]).withColumn("line_parts", F.lit(1).cast("bigint"))
    else:
        shown = shown_lines(line_parts(lines, part_size), "line_items", "line_parts")
    fallback = F.array().cast(shown.schema["line_items"].dataType)
    spare = [parse_items_detail(items_json)] if items_json is not None else []
    return receipts.join(shown, "transaction_id", "left").withColumn("line_items", F.coalesce("line_items", *spare, fallback))


def customer_history(
    receipts: DataFrame, customer_id: object | None = None, limit: int = 20, offset: int = 0
) -> DataFrame:
    """A page of receipts, newest first: of one customer, or of every customer at once."""
    if customer_id is not None:
        page = _only(receipts, "customer_id", customer_id).orderBy(*newest_first())
        return (page.offset(offset) if offset else page).limit(limit)
    loyal = receipts.filter(F.col("customer_id").isNotNull())
    ranked = top_per_key(loyal, ["customer_id"], newest_first(), offset + limit, "position")
    return ranked.filter(F.col("position") > offset)


def recent_receipts(receipts: DataFrame, customer_id: object | None = None, limit: int = 5) -> DataFrame:
    return customer_history(receipts, customer_id, limit)


def recent_spending(
    spending: DataFrame, as_of: str, months: int = 3, customer_id: object | None = None
) -> DataFrame:
    """Spending rows of the month of `as_of` and the `months` before it, latest and largest first."""
    first = F.date_format(F.add_months(F.lit(as_of).cast("date"), -months), "yyyy-MM")
    return _only(spending, "customer_id", customer_id).filter(F.col("month_key") >= first).orderBy(
        F.desc("month_key"), F.desc("total_spend_cents"), F.asc("customer_id"), F.asc("department_code")
    )


def delivery_history(deliveries: DataFrame, customer_id: object | None = None, limit: int = 50) -> DataFrame:
    """The newest deliveries of one customer, or of every customer."""
    order = [F.desc("created_at"), F.asc("delivery_id")]
    if customer_id is not None:
        return _only(deliveries, "customer_id", customer_id).orderBy(*order).limit(limit)
    return top_per_key(deliveries, ["customer_id"], order, limit)


def deliver_batch(requests: DataFrame, receipts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Log rows for good delivery requests and, apart, the refused ones with an `error`.

    A request without a customer takes the customer of its receipt. `requests` holds delivery_id,
    transaction_id, customer_id, method, target and rep.
    """
    known = receipts.select(
        F.col("transaction_id"), F.col("customer_id").alias("_owner"), F.lit(True).alias("_found")
    )
    checked = requests.join(known, "transaction_id", "left").withColumn("error", F.when(
        F.col("_found").isNull(), F.lit("Receipt not found")
    ).when(
        ~F.coalesce(F.col("method").isin("email", "print"), F.lit(False)),
        F.concat(F.lit("Unknown delivery method: "), F.coalesce("method", F.lit(""))),
    ))
    sent = checked.filter(F.col("error").isNull()).select(
        "delivery_id", "transaction_id", F.coalesce("customer_id", "_owner").alias("customer_id"),
        F.col("method").alias("delivery_method"), F.col("target").alias("delivery_target"),
        F.coalesce("rep", F.lit("unknown")).alias("delivered_by_rep"), F.lit("sent").alias("status"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
    )
    refused = checked.filter(F.col("error").isNotNull()).drop("_owner", "_found")
    return sent, refused


def conversation_history(memory: DataFrame, keys: list[str], order: str, conversation: dict | None = None) -> DataFrame:
    """Turns in order within each conversation. Rows stay rows, so a conversation may be of any length."""
    for name, value in (conversation or {}).items():
        memory = memory.filter(F.col(name) == F.lit(value))
    return memory.orderBy(*keys, order)


def recent_turns(memory: DataFrame, keys: list[str], order: str, limit: int = 10) -> DataFrame:
    """The latest turns of every conversation."""
    rest = [F.desc(c) for c in memory.columns if c not in (*keys, order)]
    return top_per_key(memory, keys, [F.desc(order), *rest], limit)


def query_cache_table(queries: DataFrame, text: str, at: str, as_of: str, hours: int = 24) -> DataFrame:
    """One row per normalised query still in date: hash, hits, first use and expiry."""
    normal = F.lower(F.trim(F.col(text)))
    seen = queries.groupBy(F.sha2(normal, 256).alias("query_hash")).agg(
        F.count(F.lit(1)).alias("hit_count"), F.min(at).alias("created_at")
    ).withColumn("expires_at", F.col("created_at") + F.expr(f"INTERVAL {int(hours)} HOURS"))
    return seen.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp"))
