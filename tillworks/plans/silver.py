"""Clean headers with figures of their line items, and the lines as arrays in a table of their own.

A receipt is always one row: counts, sums, departments, the first names and the lines shown beside the header cover all its
lines. A table of its own holds the lines in parts keyed by transaction and part, at most `PART_SIZE` lines each by their rank,
for readers that want arrays of bounded size even when one transaction id holds a large share of all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.operators.dedup import top_per_key

PART_SIZE = 500
#: Names kept for summaries.
FIRST_NAMES = 5

ITEM_FIELDS = (
    "item_seq", "product_desc", "upc", "sku", "quantity", "unit_price_cents", "extended_cents",
    "discount_cents", "department_code",
)


def in_parts(lines: DataFrame, seq: str = "item_seq", part_size: int = PART_SIZE, together: bool = False) -> DataFrame:
    """Lines with their `item_part`: 0 for the first `part_size` numbered lines of a receipt by rank, then 1, 2, …; -1, -2, …
    for lines without a number.

    Lines are ranked within blocks of numbers, and blocks by a running count, so that no task sorts all lines of a receipt. Where
    the lines lie `together` by receipt already, as in buckets, one window ranks them without a shuffle, with the same result.
    """
    unnumbered = -(2**62)
    blocked = lines.withColumn("_block", F.coalesce(F.floor(F.col(seq) / part_size).cast("bigint"), F.lit(unnumbered)))
    if together:
        # lines of no receipt stay in parts by their number
        stray = F.when(F.col("transaction_id").isNull(), F.col("_block"))
        within = Window.partitionBy("transaction_id", F.col(seq).isNull(), stray).orderBy(seq, F.xxhash64(*lines.columns))
        ranked = blocked.withColumn("_rank", F.row_number().over(within) - 1)
        start = F.when(F.col("transaction_id").isNull() & F.col(seq).isNotNull(), F.col("_block") * part_size).otherwise(F.lit(0))
        return _with_part(ranked, lines.columns, seq, F.floor((start + F.col("_rank")) / part_size))
    upto = Window.partitionBy("transaction_id", F.col("_block") == unnumbered).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocked.groupBy("transaction_id", "_block").agg(F.count(F.lit(1)).alias("_lines")).select(
        "transaction_id", "_block", F.coalesce(F.sum("_lines").over(upto), F.lit(0)).alias("_before"))
    within = Window.partitionBy("transaction_id", "_block").orderBy(seq, F.xxhash64(*lines.columns))
    ranked = blocked.withColumn("_rank", F.row_number().over(within) - 1).join(before, ["transaction_id", "_block"], "left")
    # lines of no receipt meet no count and stay in parts by their number
    start = F.coalesce("_before", F.when(F.col(seq).isNotNull(), F.col("_block") * part_size), F.lit(0))
    return _with_part(ranked, lines.columns, seq, F.floor((start + F.col("_rank")) / part_size))


def _with_part(ranked: DataFrame, columns: list[str], seq: str, part: Column) -> DataFrame:
    part = F.when(F.col(seq).isNull(), -1 - part.cast("bigint")).otherwise(part.cast("bigint"))
    return ranked.select(*(F.col(f"`{c}`") for c in columns), part.alias("item_part"))


def part_order(part: str = "item_part") -> Column:
    """Sorts parts in line order, those of lines without a number last."""
    return F.when(F.col(part) >= 0, F.col(part)).otherwise(F.lit(2**62) - F.col(part))


def shown_lines(parts: DataFrame, lines: str, count: str) -> DataFrame:
    """One row per receipt: its first part of lines and how many parts there are."""
    return parts.groupBy("transaction_id").agg(F.min_by(lines, part_order()).alias(lines), F.count(F.lit(1)).alias(count))


def _fold(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("extended_cents").alias("items_extended_cents"),
        F.sort_array(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items_detail"),
        F.sort_array(F.collect_set("department_code")).alias("departments"),
    )


def items_per_receipt(items: DataFrame, part_size: int = PART_SIZE, together: bool = False) -> DataFrame:
    """Counts, sums, ordered item structs and department sets per receipt and part, for every receipt whatever its length.

    `together` tells that the items lie in buckets of their receipt (see `in_parts`)."""
    return _fold(in_parts(items, part_size=part_size, together=together), ["transaction_id", "item_part"])


def line_figures(items: DataFrame) -> DataFrame:
    """`item_count`, `items_extended_cents`, `departments` and the names of the first lines, one row per receipt with lines.

    Sums are added up in each task before the shuffle, and only the first lines of a receipt leave a task.
    """
    whole = items.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("extended_cents").alias("items_extended_cents"),
        F.sort_array(F.collect_set("department_code")).alias("departments"),
    )
    order = [F.asc_nulls_last("item_seq"), F.asc("product_desc")]
    first = top_per_key(items.select("transaction_id", "item_seq", "product_desc"), ["transaction_id"], order, FIRST_NAMES, "at")
    names = first.groupBy("transaction_id").agg(F.sort_array(F.collect_list(F.struct("at", "product_desc"))).alias("_first"))
    return whole.join(names, "transaction_id", "left").withColumn(
        "first_names", F.transform("_first", lambda n: n["product_desc"])
    ).drop("_first")


def receipt_headers(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers with the `line_figures` of their items, one row each."""
    return headers.join(line_figures(items), "transaction_id", "left")


def whole_receipts(items: DataFrame) -> DataFrame:
    """The `line_figures` of each receipt and, as `items_detail`, all its lines in order, those without a number last.

    One grouping of the lines gives it all. A row holds its whole receipt, as its reader asks for; `items_per_receipt` has the
    lines in parts of bounded size.
    """
    line = F.struct(F.col("item_seq").isNull().alias("unnumbered"), *ITEM_FIELDS)
    folded = items.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.sum("extended_cents").alias("items_extended_cents"),
        F.sort_array(F.collect_set("department_code")).alias("departments"),
        F.sort_array(F.collect_list(line)).alias("_lines"),
    )
    return folded.select(
        "transaction_id", "item_count", "items_extended_cents", "departments",
        F.transform(F.slice("_lines", 1, FIRST_NAMES), lambda i: i["product_desc"]).alias("first_names"),
        F.transform("_lines", lambda i: F.struct(*(i[f].alias(f) for f in ITEM_FIELDS))).alias("items_detail"),
    )


def receipt_lookup_silver(
    headers: DataFrame, items: DataFrame, part_size: int | None = None, parts: DataFrame | None = None
) -> DataFrame:
    """Headers with the figures and all lines of their receipt, one row each; `items_detail` is NULL where there are none.

    Who wants rows of bounded size asks for a `part_size`: `items_detail` then holds the first part only, `item_parts` tells how
    many there are, and `items_per_receipt` (given as `parts` where it is stored) holds them all.
    """
    if part_size is None and parts is None:
        whole = whole_receipts(items).withColumn("item_parts", F.lit(1).cast("bigint"))
        return headers.join(whole, "transaction_id", "left")
    parts = items_per_receipt(items, part_size or PART_SIZE) if parts is None else parts
    shown = shown_lines(parts.select("transaction_id", "item_part", "items_detail"), "items_detail", "item_parts")
    return receipt_headers(headers, items).join(shown, "transaction_id", "left")


def catalog_enrich(items: DataFrame, catalog: DataFrame, key: str = "sku") -> DataFrame:
    """Items with the catalog's columns; items the catalog does not know stay."""
    extra = [c for c in catalog.columns if c == key or c not in items.columns]
    return items.join(catalog.select(*extra), key, "left")


def header_items(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Headers with each of their items; headers without items stay."""
    extra = [c for c in items.columns if c == "transaction_id" or c not in headers.columns]
    return headers.join(items.select(*extra), "transaction_id", "left")

