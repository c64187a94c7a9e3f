"""Rebuilding line items from receipt summaries and moving an old backup into the raw feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions.receipt_text import split_summary
from tillworks.operators.substring import contains_pairs

PRODUCT = "struct<sku:string,name:string,brand:string,category_l1:string,category_l2:string,price_cents:bigint>"
_FIELDS = ("sku", "name", "brand", "category_l1", "category_l2", "price_cents")

# The product of an item no keyword fits, and the least left for the items after one.
MISC = {"sku": "SKU-9999", "brand": "Generic", "category_l1": "MISC", "category_l2": "OTHER", "price_cents": 599}
LEAST_REMAINING = 100
#: Stands for a missing price; above any subtotal.
_NO_BOUND = 1 << 40


def _misc(name: Column) -> Column:
    values = {**{k: F.lit(v) for k, v in MISC.items()}, "name": F.trim(name)}
    return F.struct(*(values[f].alias(f) for f in _FIELDS)).cast(PRODUCT)


def match_names(names: DataFrame, name: str, catalog: DataFrame) -> DataFrame:
    """Distinct names with `product`: that of the first keyword found in the name, by priority, keyword and sku.

    Names and keywords meet on equal pieces of text, so neither side is paired out and none is sent whole to the workers.
    """
    distinct = names.select(name).distinct()
    product = F.struct(*_FIELDS).cast(PRODUCT).alias("_product")
    hits = contains_pairs(
        distinct.withColumn("_lower", F.lower(name)), "_lower", catalog.select("keyword", "priority", product), "keyword"
    )
    order = F.struct("priority", "keyword", F.col("_product.sku").alias("sku"), "_product")
    best = hits.groupBy(name).agg(F.min(order)["_product"].alias("_product"))
    return distinct.join(best, name, "left").select(name, F.coalesce("_product", _misc(F.col(name))).alias("product"))


def keyword_product_match(df: DataFrame, name: str, catalog: DataFrame) -> DataFrame:
    """Every row with the product of its item name."""
    return df.join(match_names(df, name, catalog), name, "left").withColumn(
        "product", F.coalesce("product", _misc(F.col(name)))
    )


def allocate_line_prices(prices: Column, subtotal: Column) -> Column:
    """Splits a subtotal over items in order.

    Each item gets its price, but leaves at least 100 cents; the last gets the remainder. An item can
    come out at zero or below.
    """
    start = F.struct(subtotal.cast("bigint").alias("left"), F.array().cast("array<bigint>").alias("given"))

    def step(state: Column, price: Column) -> Column:
        given = F.when(F.size(state["given"]) == F.size(prices) - 1, state["left"]).otherwise(
            F.least(price, state["left"] - LEAST_REMAINING)
        )
        return F.struct((state["left"] - given).alias("left"), F.concat(state["given"], F.array(given)).alias("given"))

    return F.aggregate(prices, start, step)["given"]


def allocate_receipt_lines(lines: DataFrame, price: str, subtotal: Column, order: Sequence[Column]) -> DataFrame:
    """Lines with `given`, their share of the receipt's subtotal as `allocate_line_prices` splits it, and their `position`;
    `order` has to break all ties.

    What is left before a line follows from the running sum of the prices and its highest value so far, so that no receipt is
    gathered in an array. A line without a price takes all but the least remainder, as if its price had no bound.
    """
    by = Window.partitionBy("transaction_id").orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    total = subtotal.cast("bigint")
    numbered = lines.withColumns({
        "position": F.row_number().over(by),
        "_n": F.count(F.lit(1)).over(Window.partitionBy("transaction_id")),
        "_price": F.coalesce(F.col(price).cast("bigint"), F.lit(_NO_BOUND)),
    }).withColumn("_sum", F.sum("_price").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    left = numbered.withColumn("_left", F.when(F.col("position") == 1, total).otherwise(
        F.greatest(total, F.max("_sum").over(upto) + LEAST_REMAINING) - (F.col("_sum") - F.col("_price"))
    ))
    given = F.when(F.col("position") == F.col("_n"), F.col("_left")).otherwise(F.least("_price", F.col("_left") - LEAST_REMAINING))
    return left.withColumn("given", given).drop("_n", "_price", "_sum", "_left")


def _lines(products: DataFrame) -> DataFrame:
    """From transaction_id, subtotal and the ordered `products` array to line rows."""
    priced = products.withColumn(
        "given", allocate_line_prices(F.transform("products", lambda p: p["price_cents"]), F.col("subtotal_cents"))
    )
    line = priced.select("transaction_id", F.posexplode(F.arrays_zip("products", "given")).alias("position", "line"))
    p, given = F.col("line.products"), F.col("line.given")
    return line.select(
        "transaction_id", (F.col("position") + 1).alias("line_number"),
        p["sku"].alias("sku"), p["name"].alias("product_name"), p["brand"].alias("brand"),
        p["category_l1"].alias("category_l1"), p["category_l2"].alias("category_l2"),
        F.lit(1).cast("decimal(10,3)").alias("quantity"),
        given.alias("unit_price_cents"), given.alias("line_total_cents"),
        F.lit(0).cast("bigint").alias("discount_cents"), F.lit(True).alias("is_taxable"),
        F.lit(None).cast("decimal(10,3)").alias("weight_lb"),
        (given <= 0).alias("non_positive"),
    )


def rebuild_line_items(receipts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Line items from the item summary of each receipt, priced from the catalog within its subtotal.

    Equal rows are worked out once and given as often as they came.
    """
    key = ["transaction_id", "subtotal_cents", "names", "copies"]
    listed = receipts.filter(F.col("item_summary") != "").select(
        "transaction_id", "subtotal_cents", split_summary("item_summary").alias("names")
    ).groupBy(*key[:3]).agg(F.count(F.lit(1)).alias("copies"))
    exploded = listed.select(*key, F.posexplode("names").alias("position", "item_name"))
    matched = keyword_product_match(exploded, "item_name", catalog)
    back = matched.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("position", "product"))).alias("ordered")
    )
    every = back.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return _lines(every.withColumn("products", F.transform("ordered", lambda o: o["product"])))



BRONZE_COLUMNS = (
    "event_id", "transaction_id", "store_id", "store_name", "pos_terminal_id", "cashier_id", "customer_id",
    "transaction_ts", "subtotal_cents", "tax_cents", "total_cents", "tender_type", "card_last4", "raw_payload",
    "ingested_ts", "_rescued_data",
)


def migrate_backup_to_bronze(backup: DataFrame, source: str = "backup_migration") -> DataFrame:
    """Old backup rows in the shape of the raw receipts.

    A card means credit, none cash; tax is a tenth of the total, cut to whole cents. The event id is
    derived from the row, so that a repeated run gives the same ids.
    """
    carded = F.coalesce(F.trim("last4_card"), F.lit("")) != ""
    seed = F.concat_ws("|", F.col("transaction_id").cast("string"), F.col("created_at").cast("string"))
    nothing = F.lit(None).cast("string")
    shaped = backup.select(
        "*",
        F.concat(F.lit("evt-"), F.substring(F.sha2(seed, 256), 1, 12)).alias("event_id"),
        F.col("purchase_timestamp").alias("transaction_ts"),
        F.col("last4_card").alias("card_last4"),
        F.col("created_at").alias("ingested_ts"),
        F.when(carded, "CREDIT").otherwise("CASH").alias("tender_type"),
        F.expr("total_cents div 10").alias("tax_cents"),
        nothing.alias("store_id"), nothing.alias("pos_terminal_id"), nothing.alias("cashier_id"),
        nothing.alias("_rescued_data"),
        F.to_json(F.struct(
            "transaction_id", "store_name", "total_cents", F.col("purchase_timestamp").alias("timestamp"),
            F.lit(source).alias("source"),
        )).alias("raw_payload"),
    )
    total = F.col("total_cents").cast("bigint")
    return shaped.withColumns({"subtotal_cents": total - F.col("tax_cents"), "total_cents": total}).select(*BRONZE_COLUMNS)
