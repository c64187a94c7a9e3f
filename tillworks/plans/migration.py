"""Old backup rows moved to the raw receipts as one job that can be cut short and run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.operators.backfill import migrate_backup_to_bronze
from tillworks.sources.keyed import exists

MANIFEST = "range long, moved_rows long, stored_rows long, matches boolean"
_PLAN = "range long, low string, high string"


def _planned(source: DataFrame, root: str, key: str, ranges: int) -> list[tuple[int, str | None, str | None]]:
    """The ranges of the key, settled by the first run and read by all later ones; ends are open, low counts and high does not."""
    spark = source.sparkSession
    if not exists(spark, f"{root}/plan/_SUCCESS"):
        kind = source.schema[key].dataType
        if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
            steps = [i / ranges for i in range(1, ranges)]
            # at most one bound for each range comes to the driver
            cuts = source.agg(F.percentile_approx(key, steps, 10_000).cast("array<string>")).first()[0] if steps else []
            cuts = list(dict.fromkeys(cuts or []))
        else:
            raise ValueError(f"{key} has no ranges")
        rows = [(i, low, high) for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None]))]
        spark.createDataFrame(rows, _PLAN).coalesce(1).write.mode("overwrite").parquet(f"{root}/plan")
    return [tuple(r) for r in spark.read.schema(_PLAN).parquet(f"{root}/plan").orderBy("range").collect()]


def _within(source: DataFrame, key: str, low: str | None, high: str | None) -> Column:
    """Whether a row belongs to a range, in a form that reaches the scan; rows without a key go with the first."""
    kind = source.schema[key].dataType
    tests = []
    if low is not None:
        tests.append(F.col(key) >= F.lit(low).cast(kind))
    if high is not None:
        below = F.col(key) < F.lit(high).cast(kind)
        tests.append(below if low is not None else below | F.col(key).isNull())
    return tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else F.lit(True)


def finished(spark: SparkSession, root: str) -> DataFrame:
    """The manifest: a row for each range that is moved and counted."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest") if exists(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)


def migrate_job(source: DataFrame, root: str, schema: T.StructType, key: str = "transaction_id", ranges: int = 16) -> list[int]:
    """Moves backup rows range by range of their key into `<root>/bronze` and returns the ranges this run has moved.

    A range is transformed, held against the declared schema, written in whole to a part of its own, and counted once while it
    is written and once from what is stored; then it enters the manifest. A run that was cut short leaves at most one part
    without an entry, which the next run writes anew; finished ranges are not read again. Counts that differ stop the job.
    """
    spark = source.sparkSession
    done = {r["range"] for r in finished(spark, root).select("range").collect()}
    moved_now = []
    for number, low, high in _planned(source, root, key, ranges):
        if number in done:
            continue
        rows = migrate_backup_to_bronze(source.filter(_within(source, key, low, high)))
        shape = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
        declared = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if shape != declared:
            raise ValueError(f"schema mismatch: {sorted(set(shape) ^ set(declared)) or 'column order'}")
        seen = Observation(f"range-{number}")
        part = f"{root}/bronze/range={number}"
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(part)
        moved, stored = seen.get["n"], spark.read.schema(rows.schema).parquet(part).count()
        if moved != stored:
            raise ValueError(f"range {number}: {moved} rows moved, {stored} stored")
        entry = spark.createDataFrame([(number, moved, stored, True)], MANIFEST)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/part={number}")
        moved_now.append(number)
    return moved_now


def migrated(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished ranges."""
    done = [r["range"] for r in finished(spark, root).select("range").collect()]
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("range", T.LongType())])).parquet(f"{root}/bronze")
    return rows.filter(F.col("range").isin(done)).drop("range")
