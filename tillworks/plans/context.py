"""Customer context: profile, newest receipts and recent spending as one nested row per customer."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.functions.receipt_text import cents_to_dollars
from tillworks.operators.lookup import recent_receipts
from tillworks.operators.plan_audit import foreign_parts
from tillworks.operators.search import capped_result
from tillworks.plans import gold


def serving_profiles(headers: DataFrame, spending: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Profiles under the names readers ask for; names and tier come from an optional customer table."""
    top = gold.categories(gold.top_departments_of(spending))
    profiles = gold.customer_overview(headers).join(top, "customer_id", "left")
    return profiles if customers is None else profiles.join(customers, "customer_id", "left")


def serving_spending(spending: DataFrame) -> DataFrame:
    return spending.select(
        "customer_id", F.col("department_code").alias("category_l1"),
        F.to_date(F.concat("month_key", F.lit("-01"))).alias("summary_month"),
        F.col("total_spend_cents").alias("total_cents"), F.col("trip_count").alias("visit_count"),
    )


def customer_context(
    profiles: DataFrame, receipts: DataFrame, spending: DataFrame, as_of: str,
    customer_id: object | None = None, newest: int = 5, months: int = 3,
) -> DataFrame:
    """One row per customer. A customer with receipts but no profile is kept with a NULL profile.

    The receipts array holds at most `newest` rows; the spending array has one row per department and
    month of the last few months.
    """
    if customer_id is not None:
        profiles, receipts, spending = (
            df.filter(F.col("customer_id") == F.lit(customer_id)) for df in (profiles, receipts, spending)
        )
    page = recent_receipts(
        receipts.select("customer_id", "transaction_id", "store_id", "store_name", "transaction_ts", "total_cents", "item_count"),
        None, newest,
    )
    latest = page.groupBy("customer_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "transaction_id", "store_id", "store_name", "transaction_ts", "total_cents", "item_count"
    ))).alias("recent_receipts"))
    first = F.date_format(F.add_months(F.lit(as_of).cast("date"), -months), "yyyy-MM")
    spent = spending.filter(F.col("month_key").between(first, F.date_format(F.lit(as_of).cast("date"), "yyyy-MM"))).groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("month_key"), F.col("total_spend_cents"), F.col("department_code"), F.col("trip_count"),
        )), asc=False).alias("spending_by_category")
    )
    fields = [c for c in profiles.columns if c != "customer_id"]
    profile = profiles.select("customer_id", F.struct(*fields).alias("profile"))
    return profile.join(latest, "customer_id", "full").join(spent, "customer_id", "left")


# Fixed value: what a rep reads where there is no profile.
NO_PROFILE_TEXT = "No customer profile found. This may be a guest or non-loyalty customer."


def rep_briefing(context: DataFrame) -> DataFrame:
    """Adds `briefing`, a plain text summary of a context row."""
    p = F.col("profile")

    def listed(rows: Column) -> Column:
        return F.when(F.size(rows) > 0, F.array_join(rows, "; ")).otherwise(F.lit("none"))

    receipts = F.transform("recent_receipts", lambda r: F.concat(
        F.coalesce(r["store_name"], r["store_id"].cast("string")), F.lit(" "),
        F.date_format(r["transaction_ts"], "yyyy-MM-dd"), F.lit(" "), cents_to_dollars(r["total_cents"]),
    ))
    spend = F.transform(F.slice("spending_by_category", 1, 10), lambda s: F.concat(
        s["department_code"], F.lit(" "), s["month_key"], F.lit(" "), cents_to_dollars(s["total_spend_cents"]),
    ))
    store = F.coalesce(p["preferred_store_name"], p["preferred_store_id"].cast("string"), F.lit("unknown"))
    text = F.concat(
        F.lit("Lifetime spend "), cents_to_dollars(p["lifetime_spend_cents"]),
        F.lit(", average basket "), cents_to_dollars(p["avg_basket_cents"]),
        F.lit(", visits "), p["total_transactions"].cast("string"),
        F.coalesce(F.concat(F.lit(", one every "), F.floor(p["visit_frequency_days"] + 0.5).cast("string"), F.lit(" days")), F.lit("")),
        F.lit(". Prefers "), store,
        F.lit(". Buys "), F.coalesce(F.array_join(p["top_categories"], ", "), F.lit("nothing on record")),
        F.lit(". Receipts: "), listed(receipts),
        F.lit(". Recent spend: "), listed(spend), F.lit("."),
    )
    return context.withColumn("briefing", F.when(p.isNull(), F.lit(NO_PROFILE_TEXT)).otherwise(text))


def _scoped(name: str, tables: dict[str, DataFrame], customer_id: object | None, open_tables: Sequence[str]) -> DataFrame | None:
    """One customer's rows of a table; None where they cannot be told."""
    df = tables[name]
    if customer_id is None or name in open_tables:
        return df
    own = F.col("customer_id") == F.lit(customer_id)
    if "customer_id" in df.columns:
        return df.filter(own)
    receipts = next((t for t in tables.values() if {"customer_id", "transaction_id"} <= set(t.columns)), None)
    if receipts is None or "transaction_id" not in df.columns:
        return None
    return df.join(receipts.filter(own).select("transaction_id"), "transaction_id", "left_semi").select(*df.columns)


def scoped_sql(
    spark: SparkSession, tables: dict[str, DataFrame], text: str, customer_id: object | None = None, rows: int = 50,
    open_tables: Sequence[str] = (),
) -> DataFrame:
    """A SELECT over views that already hold one customer's rows only, at most `rows` of its result.

    Customer placeholders in the text become a bound parameter. A table without a customer column shows the rows of the
    customer's receipts, found by transaction id in another of the tables; without that it is refused, unless it is named in
    `open_tables`. What the text reads is judged on its analysed plan: any table, view, file, program or function that yields
    rows other than the views given is refused, under whatever name and at whatever depth.
    """
    if not text.lstrip().upper().startswith("SELECT"):
        raise ValueError("not a SELECT")
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for setting in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(setting, spark.conf.get(setting))
    bound = text.replace("{{customer_id}}", ":customer_id").replace("{customer_id}", ":customer_id")
    args = {"customer_id": "" if customer_id is None else customer_id} if ":customer_id" in bound else None
    shared, closed = {}, []
    for name in tables:
        df = _scoped(name, tables, customer_id, open_tables)
        if df is None:
            closed.append(name)
            continue
        shared[name] = f"scoped_{uuid.uuid4().hex}"
        df.createGlobalTempView(shared[name])
        session.table(f"global_temp.{shared[name]}").createOrReplaceTempView(name)
    try:
        result = session.sql(bound, args=args) if args else session.sql(bound)
        foreign = foreign_parts(result, shared)
    except AnalysisException as error:
        hint = f"; without a customer column: {closed}" if closed else ""
        raise ValueError(f"{error.getCondition() or 'not understood'}{hint}") from error
    finally:
        for view in shared.values():
            spark.catalog.dropGlobalTempView(view)
    if foreign:
        raise ValueError(f"not one of the given tables: {sorted(set(foreign))}")
    return capped_result(result, rows)
