"""The order tables read as a receipt feed: headers, line items, products, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cents(amount: Column | str) -> Column:
    """Dollars held as a double to whole cents, rounded half up."""
    col = F.col(amount) if isinstance(amount, str) else amount
    return F.floor(col * 100 + 0.5).cast("bigint")


def tender() -> Column:
    """Order priority read as a tender type."""
    rank = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(rank == "1", "CREDIT").when(rank == "2", "DEBIT").when(rank == "3", "CASH")
        .when(rank == "4", "EBT").otherwise("CHECK")
    )


def order_headers(orders: DataFrame) -> DataFrame:
    """Receipt headers without their store, straight from the order rows (batch or stream)."""
    total = cents("o_totalprice")
    tax = F.floor(total / 11)
    return orders.select(
        F.concat(F.lit("evt-"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_ts"),
        (total - tax).alias("subtotal_cents"),
        tax.alias("tax_cents"),
        total.alias("total_cents"),
        tender().alias("tender_type"),
        F.when(
            tender().isin("CREDIT", "DEBIT"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
        ).alias("card_last4"),
        F.col("o_orderdate").cast("timestamp").alias("ingested_ts"),
    )


def stores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name")
    )


def raw_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipt headers with their store: the nation of the customer."""
    shoppers = (
        table(spark, folder, "customer")
        .select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("store_id"))
        .join(stores(spark, folder), "store_id")
    )
    return (
        order_headers(table(spark, folder, "orders"))
        .join(shoppers, "customer_id")
        .withColumns({
            "pos_terminal_id": F.lit(None).cast("string"),
            "cashier_id": F.lit(None).cast("string"),
        })
    )


def line_rows(lineitem: DataFrame) -> DataFrame:
    """Item rows without product text, straight from the line rows (batch or stream)."""
    extended = cents("l_extendedprice")
    return lineitem.select(
        F.concat(F.lit("evt-"), F.col("l_orderkey").cast("string")).alias("event_id"),
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_linenumber").alias("item_seq"),
        F.lit(None).cast("string").alias("upc"),
        F.col("l_partkey").alias("sku"),
        F.col("l_quantity").cast("decimal(10,3)").alias("quantity"),
        F.floor(F.try_divide(extended, F.col("l_quantity"))).cast("bigint").alias("unit_price_cents"),
        extended.alias("extended_cents"),
        cents(F.col("l_extendedprice") * F.col("l_discount")).alias("discount_cents"),
        F.col("l_shipdate").cast("timestamp").alias("ingested_ts"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_desc"),
        F.col("p_type").alias("department_code"), F.col("p_brand").alias("brand"),
    )


def raw_items(spark: SparkSession, folder: str, with_product: bool = True) -> DataFrame:
    """Line items of the feed; product text and department come with the line unless left out."""
    lines = line_rows(table(spark, folder, "lineitem"))
    if not with_product:
        return lines
    described = products(spark, folder).drop("brand")
    return lines.join(described, "sku", "left")


def product_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Product vectors; the label is the category and the vector id doubles as the SKU."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sku"), F.col("label").alias("category"), "embedding"
    )


def with_names(vectors: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    named = products(spark, folder).select("sku", F.col("product_desc").alias("product_name"))
    return vectors.join(named, "sku", "left")
