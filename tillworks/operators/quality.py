"""Quality rules: rows pass, drop or are only counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    drops: bool = True


RECEIPT_RULES = (
    Rule("valid_transaction_id", "transaction_id IS NOT NULL"),
    Rule("valid_store_id", "store_id IS NOT NULL"),
    Rule("valid_timestamp", "transaction_ts IS NOT NULL"),
    Rule("non_negative_total", "total_cents >= 0"),
    Rule("has_event_id", "event_id IS NOT NULL", drops=False),
)

ITEM_RULES = (
    Rule("valid_transaction_id", "transaction_id IS NOT NULL"),
    Rule("valid_item_identifier", "upc IS NOT NULL OR sku IS NOT NULL"),
    Rule("positive_quantity", "quantity > 0"),
    Rule("non_negative_extended", "extended_cents >= 0"),
    Rule("has_product_desc", "product_desc IS NOT NULL", drops=False),
)

SILVER_RECEIPT_RULES = (Rule("positive_total_cents", "total_cents > 0"),)
SILVER_ITEM_RULES = (Rule("positive_extended_cents", "extended_cents >= 0"),)

# Tender types a receipt may carry.
TENDERS = ("CREDIT", "DEBIT", "CASH", "EBT", "CHECK", "GIFT")
TOTAL_TOLERANCE_CENTS = 5


def _broken(rule: Rule) -> Column:
    return ~F.coalesce(F.expr(rule.condition), F.lit(False))


def gate(df: DataFrame, rules: tuple[Rule, ...], observation: Observation | str | None = None) -> DataFrame:
    """Rows meeting every dropping rule (an unknown outcome drops); an observation counts each broken rule."""
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            *(F.count_if(_broken(rule)).alias(rule.name) for rule in rules),
        )
    for rule in rules:
        if rule.drops:
            df = df.filter(rule.condition)
    return df


def dq_report(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per rule: rows passed, dropped, warned; one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *(F.count_if(_broken(r)).alias(f"b{i}") for i, r in enumerate(rules))
    )
    lines = F.array(*(
        F.struct(
            F.lit(rule.name).alias("rule"),
            (F.col("n") - F.col(f"b{i}")).alias("passed"),
            (F.col(f"b{i}") if rule.drops else F.lit(0)).cast("bigint").alias("dropped"),
            (F.lit(0) if rule.drops else F.col(f"b{i}")).cast("bigint").alias("warned"),
        )
        for i, rule in enumerate(rules)
    ))
    return counts.select(F.inline(lines))


def _reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that are broken; an unknown outcome counts as met."""
    found = F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items()))
    return F.filter(found, lambda r: r.isNotNull())


def validate_receipt(headers: DataFrame) -> DataFrame:
    """Adds `reasons`: what the header breaks; empty for a valid one."""
    gap = F.abs(F.col("subtotal_cents") + F.col("tax_cents") - F.col("total_cents"))
    return headers.withColumn("reasons", _reasons({
        "transaction_id missing": F.col("transaction_id").isNull(),
        "store_id missing": F.col("store_id").isNull(),
        "transaction_ts missing": F.col("transaction_ts").isNull(),
        "total_cents missing": F.col("total_cents").isNull(),
        "negative amount": (F.col("subtotal_cents") < 0) | (F.col("tax_cents") < 0) | (F.col("total_cents") < 0),
        "total differs": gap > TOTAL_TOLERANCE_CENTS,
        "unknown tender": F.col("tender_type").isNotNull() & ~F.col("tender_type").isin(*TENDERS),
    }))


def validate_items(items: DataFrame) -> DataFrame:
    """Adds `reasons` per line; an empty code counts as missing."""
    def missing(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    return items.withColumn("reasons", _reasons({
        "no upc or sku": missing("upc") & missing("sku"),
        "product_desc missing": F.col("product_desc").isNull(),
        "negative quantity": F.col("quantity") < 0,
        "negative amount": (F.col("unit_price_cents") < 0) | (F.col("extended_cents") < 0) | (F.col("discount_cents") < 0),
    }))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") == 0).drop("reasons")


def rejects(validated: DataFrame) -> DataFrame:
    return validated.filter(F.size("reasons") > 0)


def request_bounds(requests: DataFrame) -> DataFrame:
    """Adds `reasons` to write requests whose texts, amounts, card or item count are out of bounds.

    `item_count`, where the requests have it, counts lines that `items` may not show.
    """
    def too_long(name: str, most: int, least: int = 0) -> Column:
        return ~F.length(F.col(name).cast("string")).between(least, most)

    def outside(name: str, most: int) -> Column:
        return ~F.col(name).between(0, most)

    counts = [F.col("item_count")] if "item_count" in requests.columns else []
    lines = F.greatest(F.size("items"), F.lit(0), *counts)
    return requests.withColumn("reasons", _reasons({
        "transaction_id length": F.col("transaction_id").isNull() | too_long("transaction_id", 100, 1),
        "store_id length": F.col("store_id").isNull() | too_long("store_id", 50, 1),
        "store_name length": too_long("store_name", 200),
        "customer_id length": too_long("customer_id", 100),
        "subtotal_cents range": outside("subtotal_cents", 1_000_000_000),
        "tax_cents range": outside("tax_cents", 100_000_000),
        "total_cents range": F.col("total_cents").isNull() | outside("total_cents", 1_000_000_000),
        "tender_type length": too_long("tender_type", 20),
        "card_last4 format": ~F.col("card_last4").rlike("^[0-9]{4}$"),
        "item_summary length": too_long("item_summary", 1000),
        "too many items": lines > 500,
    }))
