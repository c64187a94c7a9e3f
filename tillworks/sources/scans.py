"""Reading: declared-schema scans, batch and stream, relational sources, keyed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """Raw rows of a Parquet folder under a declared schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)


def stream_file(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """One table of a folder that holds several, as a stream, under the schema it was written with."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stamped(df: DataFrame) -> DataFrame:
    """Raw rows with the time they passed into the bronze layer."""
    return df.withColumn("_bronze_ts", F.current_timestamp())


def jdbc_options(
    url: str, table: str, column: str | None = None, lower: object | None = None, upper: object | None = None,
    parts: int = 1, fetchsize: int = 10_000, **properties: str,
) -> dict[str, str]:
    """Options of a relational read, split into `parts` ranges of `column` where one is named."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetchsize), **properties}
    if column is not None:
        if lower is None or upper is None:
            raise ValueError("a split column needs its lower and upper bound")
        options |= {
            "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts),
        }
    return options


def jdbc_scan(spark: SparkSession, url: str, table: str, **settings: object) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **settings)).load()


def page_scan(df: DataFrame, key: str, rows: int = 1000, after: object | None = None) -> DataFrame:
    """The next rows in key order behind the last key of the page before; the key condition reaches the scan."""
    behind = df if after is None else df.filter(F.col(key) > F.lit(after))
    return behind.orderBy(key).limit(rows)


def federated_join(serving: DataFrame, lake: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A serving table and a lake table side by side; columns both have come from the serving side."""
    extra = [c for c in lake.columns if c in keys or c not in serving.columns]
    return serving.join(lake.select(*extra), keys, how)
