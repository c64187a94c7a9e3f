"""Hot store against lake: gaps, repair, one view of both, change rows, counts, erasure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.operators.dedup import top_per_key

# The two recommendations.
GAP_TEXT = "Gap detected — consider triggering a Gold pipeline refresh."
NO_GAP_TEXT = "No gap detected. Synced tables are current."


def gap_anti_join(
    hot: DataFrame, lake: DataFrame, as_of: str, hours: int = 24, apart_hours: int | None = 24
) -> DataFrame:
    """Hot receipts of the last hours that the lake does not have.

    A receipt's time differs between the stores by at most `apart_hours`, so only the part of the lake from that long before the
    first hot receipt is read. Where nothing is known of it, None has the whole lake read.
    """
    def since(span: int) -> Column:
        return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(span)} HOURS")

    if apart_hours is not None:
        lake = lake.filter(F.col("transaction_ts") >= since(hours + apart_hours))
    recent = hot.filter(F.col("transaction_ts") >= since(hours))
    return recent.join(lake.select("transaction_id"), "transaction_id", "left_anti")


def reconcile_gap_summary(missing: DataFrame, hours: int = 24) -> DataFrame:
    summary = missing.agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.min("transaction_ts").alias("oldest_missing_ts"), F.max("transaction_ts").alias("newest_missing_ts"),
    )
    return summary.withColumns({
        "lookback_hours": F.lit(hours),
        "recommendation": F.when(F.col("gap_count") > 0, GAP_TEXT).otherwise(NO_GAP_TEXT),
    })


def repair_gaps(lake: DataFrame, missing: DataFrame) -> DataFrame:
    """The lake with the missing hot receipts added, in the columns of the lake."""
    return lake.unionByName(missing.select(*(c for c in missing.columns if c in lake.columns)), allowMissingColumns=True)


def hot_cold_receipts(hot: DataFrame, lake: DataFrame) -> DataFrame:
    """Both stores as one, the lake's row winning where both have the receipt.

    The lake holds a receipt once and is not ranked again; only its ids meet the small hot store.
    """
    shared = [c for c in lake.columns if c in hot.columns]
    order = [F.desc(c) for c in shared if c != "transaction_id"]
    only_hot = hot.select(*shared).join(lake.select("transaction_id"), "transaction_id", "left_anti")
    picked = top_per_key(only_hot, ["transaction_id"], order).select(*shared, F.lit("hot").alias("source"))
    return lake.select(*shared, F.lit("lake").alias("source")).unionByName(picked)


def verify_counts(before: DataFrame, moved: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what was there, what moved, what is there now, and whether it adds up."""
    sized = None
    for name, df in (("before_rows", before), ("moved_rows", moved), ("after_rows", after)):
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        sized = part if sized is None else sized.unionByName(part)
    row = sized.agg(*(
        F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
        for name in ("before_rows", "moved_rows", "after_rows")
    ))
    return row.withColumn("matches", F.col("after_rows") - F.col("before_rows") == F.col("moved_rows"))


def table_validation(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Which of the named Parquet tables or catalog tables are there, and how many rows they hold."""
    found = None
    for name, place in tables.items():
        df = _read_if_there(spark, place)
        row = (
            df.agg(F.count(F.lit(1)).alias("row_count")) if df is not None
            else spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
        ).select(F.lit(name).alias("table_name"), F.lit(df is not None).alias("present"), "row_count")
        found = row if found is None else found.unionByName(row)
    return found


def _read_if_there(spark: SparkSession, place: str) -> DataFrame | None:
    if "/" not in place:
        return spark.read.table(place) if spark.catalog.tableExists(place) else None
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(place) if there else None


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted, updated or deleted between two versions; unchanged rows are left out.

    Updates carry the new values. Both sides hold one row per key.
    """
    values = [c for c in new.columns if c not in keys]
    before = old.select(*keys, F.struct(*values).alias("_old"))
    after = new.select(*keys, F.struct(*values).alias("_new"))
    joined = before.join(after, list(keys), "full")
    kind = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    changed = joined.withColumn("_change_type", kind).filter(F.col("_change_type").isNotNull())
    rows = changed.select(*keys, "_change_type", F.coalesce("_new", "_old").alias("_row"))
    return rows.select(*keys, "_change_type", "_row.*")


def delete_customers(df: DataFrame, erased: DataFrame) -> DataFrame:
    """All rows but those of the customers on the erasure list; rows without a customer stay."""
    return df.join(erased.select("customer_id"), "customer_id", "left_anti").select(*df.columns)
