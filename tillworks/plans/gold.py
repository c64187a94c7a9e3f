"""Gold tables: receipts for lookup, spending, customers, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.receipt_text import item_summary, month_key, product_key, week_key
from tillworks.operators.dedup import top_per_key

# Columns and order of the lookup table.
RECEIPT_COLUMNS = (
    "transaction_id", "store_id", "store_name", "pos_terminal_id", "cashier_id", "customer_id",
    "transaction_ts", "subtotal_cents", "tax_cents", "total_cents", "tender_type", "card_last4",
    "item_count", "item_summary", "departments", "items_detail", "items_extended_cents",
    "month_key", "week_key",
)


def receipt_lookup(silver: DataFrame) -> DataFrame:
    """Receipts ready for lookup, one row each; `item_parts` tells how many line parts a receipt has."""
    return silver.withColumns({
        "item_summary": item_summary("first_names", "item_count"),
        "month_key": month_key("transaction_ts"),
        "week_key": week_key("transaction_ts"),
    }).select(*RECEIPT_COLUMNS, "item_parts")


def _loyal(headers: DataFrame, *columns: str) -> DataFrame:
    return headers.filter(F.col("customer_id").isNotNull()).select("transaction_id", "customer_id", *columns)


def _receipt_departments(items: DataFrame) -> DataFrame:
    """Items summed per receipt and department, so that the join carries one row per pair."""
    return items.groupBy("transaction_id", "department_code").agg(
        F.sum("extended_cents").alias("spend"),
        F.sum("discount_cents").alias("discount"),
        F.count(F.lit(1)).alias("lines"),
    )


def spending_summary(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Spend by customer, department and month. `headers` holds one row per transaction.

    After the first sum a receipt appears once per department, so counting rows counts trips and no
    distinct count is needed.
    """
    return (
        _receipt_departments(items)
        .join(_loyal(headers, "transaction_ts"), "transaction_id")
        .groupBy("customer_id", "department_code", month_key("transaction_ts").alias("month_key"))
        .agg(
            F.sum("spend").alias("total_spend_cents"),
            F.sum("discount").alias("total_discount_cents"),
            F.sum("lines").alias("item_count"),
            F.count(F.lit(1)).alias("trip_count"),
            F.min("transaction_ts").alias("first_purchase"),
            F.max("transaction_ts").alias("last_purchase"),
        )
    )


def customer_totals(headers: DataFrame) -> DataFrame:
    """Lifetime figures per loyalty customer."""
    return customer_overview(headers).drop("visit_frequency_days", "preferred_store_id", "preferred_store_name")


def department_spend(items: DataFrame, headers: DataFrame) -> DataFrame:
    return (
        _receipt_departments(items)
        .join(_loyal(headers), "transaction_id")
        .groupBy("customer_id", "department_code")
        .agg(F.sum("spend").alias("dept_spend_cents"))
    )


def _top(spend: DataFrame, limit: int) -> DataFrame:
    order = [F.desc("dept_spend_cents"), F.asc("department_code")]
    ranked = top_per_key(spend, ["customer_id"], order, limit, "rank")
    in_order = F.sort_array(F.collect_list(F.struct("rank", "department_code", "dept_spend_cents")))
    return ranked.groupBy("customer_id").agg(
        F.transform(in_order, lambda d: F.struct(d["department_code"], d["dept_spend_cents"])).alias("top_departments")
    )


def top_departments(items: DataFrame, headers: DataFrame, limit: int = 5) -> DataFrame:
    """The departments a customer spends most in, in order, as an array of at most `limit` structs."""
    return _top(department_spend(items, headers), limit)


def top_departments_of(spending: DataFrame, limit: int = 5) -> DataFrame:
    """The same from a spending summary, without touching the items again."""
    spend = spending.groupBy("customer_id", "department_code").agg(F.sum("total_spend_cents").alias("dept_spend_cents"))
    return _top(spend, limit)


def customer_profiles(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Lifetime figures and top departments; where spending is stored, join `top_departments_of` instead."""
    return customer_totals(headers).join(top_departments(items, headers), "customer_id", "left")


def categories(top: DataFrame) -> DataFrame:
    """Only the names of the top departments."""
    return top.select(
        "customer_id", F.transform("top_departments", lambda d: d["department_code"]).alias("top_categories")
    )


def top_categories(items: DataFrame, headers: DataFrame) -> DataFrame:
    return categories(top_departments(items, headers))


def days_between_visits(first: str, last: str, visits: str) -> Column:
    return F.datediff(last, first) / F.nullif(F.col(visits) - 1, F.lit(0))


def customer_overview(headers: DataFrame) -> DataFrame:
    """Lifetime figures, visit frequency and preferred store of every customer from one pass.

    A hot customer shrinks to one row per store in the map tasks; the distinct months travel as small
    sets, so no distinct count has to expand the rows.
    """
    per_store = _loyal(headers, "transaction_ts", "total_cents", "store_id", "store_name").groupBy(
        "customer_id", "store_id"
    ).agg(
        F.count(F.lit(1)).alias("trips"), F.sum("total_cents").alias("spend"),
        F.min("transaction_ts").alias("first_ts"), F.max("transaction_ts").alias("last_ts"),
        F.max("store_name").alias("store_name"), F.collect_set(month_key("transaction_ts")).alias("months"),
    )
    favourite = F.min(F.struct(-F.col("trips"), F.col("store_id"), F.col("store_name")))
    totals = per_store.groupBy("customer_id").agg(
        F.sum("trips").alias("total_transactions"), F.sum("spend").alias("lifetime_spend_cents"),
        F.min("first_ts").alias("first_transaction"), F.max("last_ts").alias("last_transaction"),
        F.count("store_id").alias("stores_visited"),
        F.size(F.array_distinct(F.flatten(F.collect_list("months")))).alias("active_months"),
        favourite.alias("_store"),
    )
    return totals.select(
        "*", F.expr("lifetime_spend_cents div total_transactions").alias("avg_basket_cents"),
        days_between_visits("first_transaction", "last_transaction", "total_transactions").alias("visit_frequency_days"),
        F.col("_store.store_id").alias("preferred_store_id"), F.col("_store.store_name").alias("preferred_store_name"),
    ).drop("_store")


def visit_frequency(headers: DataFrame) -> DataFrame:
    """Average days between visits; NULL for a single visit."""
    visits = _loyal(headers, "transaction_ts").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("visits"), F.min("transaction_ts").alias("first"), F.max("transaction_ts").alias("last")
    )
    days = days_between_visits("first", "last", "visits")
    return visits.select("customer_id", "visits", days.alias("visit_frequency_days"))


def preferred_store(headers: DataFrame) -> DataFrame:
    """The store a customer visits most; ties go to the lower id."""
    visits = _loyal(headers, "store_id", "store_name").groupBy("customer_id", "store_id").agg(
        F.count(F.lit(1)).alias("visits"), F.max("store_name").alias("store_name")
    )
    return top_per_key(visits, ["customer_id"], [F.desc("visits"), F.asc("store_id")]).select(
        "customer_id", F.col("store_id").alias("preferred_store_id"),
        F.col("store_name").alias("preferred_store_name"), "visits",
    )


def product_catalog(items: DataFrame) -> DataFrame:
    """Products seen on receipts, at the grain of code, description and department."""
    return items.withColumn("product_key", product_key()).groupBy(
        "product_key", "upc", "sku", "product_desc", "department_code"
    ).agg(F.count(F.lit(1)).alias("purchase_count"), F.max("ingested_ts").alias("last_seen"))


def product_catalog_latest(catalog: DataFrame) -> DataFrame:
    """One row per product key, the one seen last."""
    order = [F.desc("last_seen"), F.desc("purchase_count"), F.desc("product_desc"), F.desc("department_code")]
    return top_per_key(catalog, ["product_key"], order)


def purchase_frequency(items: DataFrame, headers: DataFrame) -> DataFrame:
    """How often a customer buys a product: average days between the days of purchase.

    Only the first and last day and the number of distinct days matter, so no ordered window is needed.
    """
    days = (
        items.select("transaction_id", "sku")
        .join(_loyal(headers, "transaction_ts"), "transaction_id")
        .select("customer_id", "sku", F.to_date("transaction_ts").alias("day"))
        .distinct()
    )
    gap = F.datediff(F.max("day"), F.min("day")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))
    return days.groupBy("customer_id", "sku").agg(
        F.count(F.lit(1)).alias("purchase_days"), gap.alias("avg_days_between")
    )


def receipt_stats(headers: DataFrame) -> DataFrame:
    """One row of totals over all receipts, money in cents."""
    spread = headers.groupBy("customer_id", "store_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("transaction_ts").alias("a"), F.max("transaction_ts").alias("z"),
        F.min("total_cents").alias("lo"), F.max("total_cents").alias("hi"), F.sum("total_cents").alias("s"),
    )
    return spread.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_receipts"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("store_name").alias("unique_stores"),
        F.min("a").alias("earliest"), F.max("z").alias("latest"),
        F.min("lo").alias("min_cents"), F.max("hi").alias("max_cents"),
        F.expr("sum(s) div sum(n)").alias("avg_cents"), F.sum("s").alias("revenue_cents"),
    )


def line_item_stats(lines: DataFrame, sku: str | None = None) -> DataFrame:
    """One row of totals over all line items; with `sku`, also how many lines hold that product."""
    wanted = F.sum((F.col("sku") == sku).cast("bigint")) if sku is not None else F.lit(0).cast("bigint")
    receipts = lines.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("extended_cents").alias("s"), wanted.alias("w")
    )
    # each side has one distinct count, so neither repeats its rows; the two rows of totals meet in one
    by_receipt = receipts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_lines"), F.count("transaction_id").alias("total_receipts"),
        F.lit(None).cast("bigint").alias("unique_skus"), F.sum("s").alias("revenue_cents"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("sku_lines"),
    )
    by_sku = lines.select("sku").distinct().agg(F.count("sku").alias("unique_skus"))
    both = by_receipt.unionByName(by_sku, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in by_receipt.columns))
    return both if sku is not None else both.drop("sku_lines")
