"""The whole way from raw feed to gold tables, as one batch or from streams.

Silver and gold are written and read back, so that each later step starts from a stored table: work is
done once, and a lost executor costs the running stage only. A batch stores silver in buckets of the
transaction: lines are shuffled once, and what goes by receipt after that reads bucket by bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tillworks.operators.dedup import dedup_items, dedup_receipts
from tillworks.operators.quality import ITEM_RULES, RECEIPT_RULES, Rule, gate
from tillworks.plans import gold
from tillworks.plans.silver import items_per_receipt, receipt_lookup_silver
from tillworks.sources.keyed import exists, next_version, read_current
from tillworks.streaming.jobs import run_batches, stream_bronze, upsert_batches

GOLD_TABLES = ("receipt_lookup", "spending_summary", "customer_profiles", "product_catalog")
#: Bytes of input files that make one bucket of silver, and the most buckets.
BUCKET_BYTES, MAX_BUCKETS = 8_000_000, 20_000


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows written to a folder and read back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, path: str, key: str, buckets: int, *order: str) -> DataFrame:
    """As `stored`, in files by the hash of the key and sorted; the frame returned knows, so groupings and joins by key need no shuffle.

    Spark knows of buckets through its catalog only. The table's name goes once the frame is there; the files stay."""
    spark, name = df.sparkSession, f"in_buckets_{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd").option("path", path)
    try:
        writer.bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
        return spark.read.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def bucket_count(df: DataFrame) -> int:
    """Buckets by the size of the files that the rows come from; as many as a shuffle has parts where they come from no files."""
    spark, size = df.sparkSession, 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    parts = -(-size // BUCKET_BYTES) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(parts, MAX_BUCKETS)


def write_silver(
    raw_headers: DataFrame, raw_items: DataFrame, root: str,
    header_rules: tuple[Rule, ...] = RECEIPT_RULES, item_rules: tuple[Rule, ...] = ITEM_RULES,
) -> tuple[DataFrame, DataFrame]:
    """Gated and deduplicated headers and items as stored tables, both in the same number of buckets by transaction."""
    parts = bucket_count(raw_items)
    headers = dedup_receipts(gate(raw_headers, header_rules), parts)
    items = dedup_items(gate(raw_items, item_rules), parts)
    return (
        stored_in_buckets(headers, f"{root}/receipts", "transaction_id", parts),
        stored_in_buckets(items, f"{root}/items", "transaction_id", parts, "item_seq"),
    )


def write_gold(
    headers: DataFrame, items: DataFrame, root: str, tables: tuple[str, ...] = GOLD_TABLES, together: bool = False
) -> dict[str, DataFrame]:
    """The gold tables asked for; profiles build on the stored spending instead of joining items again.

    `receipt_lines`, stored beside `receipt_lookup`, holds the lines in parts of bounded size. `together` tells that the items lie
    in buckets of their transaction.
    """
    made: dict[str, DataFrame] = {}
    if "receipt_lookup" in tables:
        made["receipt_lines"] = stored(items_per_receipt(items, together=together), f"{root}/receipt_lines")
        lookup = gold.receipt_lookup(receipt_lookup_silver(headers, items))
        made["receipt_lookup"] = stored(lookup, f"{root}/receipt_lookup")
    if {"spending_summary", "customer_profiles"} & set(tables):
        made["spending_summary"] = stored(gold.spending_summary(items, headers), f"{root}/spending_summary")
    if "customer_profiles" in tables:
        profiles = gold.customer_totals(headers).join(
            gold.top_departments_of(made["spending_summary"]), "customer_id", "left"
        )
        made["customer_profiles"] = stored(profiles, f"{root}/customer_profiles")
    if "product_catalog" in tables:
        made["product_catalog"] = stored(gold.product_catalog(items), f"{root}/product_catalog")
    return made


def run_batch(raw_headers: DataFrame, raw_items: DataFrame, root: str, **rules: tuple[Rule, ...]) -> dict[str, DataFrame]:
    headers, items = write_silver(raw_headers, raw_items, f"{root}/silver", **rules)
    return {"receipts": headers, "items": items, **write_gold(headers, items, f"{root}/gold", together=True)}


def _first_version(spark: SparkSession, root: str, name: str) -> int:
    """The version of the first micro-batch: above those there when the checkpoint was new, and kept beside it since."""
    if not exists(spark, f"{root}/checkpoints/{name}"):
        base = next_version(spark, f"{root}/{name}")
        spark.range(base, base + 1).write.mode("overwrite").parquet(f"{root}/bases/{name}")
    return spark.read.schema("id long").parquet(f"{root}/bases/{name}").first().id if exists(
        spark, f"{root}/bases/{name}") else 0


def run_stream(
    spark: SparkSession, streams: Mapping[str, DataFrame], root: str,
    header_rules: tuple[Rule, ...] = RECEIPT_RULES, item_rules: tuple[Rule, ...] = ITEM_RULES,
) -> tuple[DataFrame, DataFrame]:
    """Takes in what the header and item streams hold now and returns the current silver tables.

    Each run adds versions to the keyed tables; a run that is cut short goes on from its checkpoint.
    """
    plan = {
        "receipts": (["transaction_id"], header_rules, "total_cents > 0"),
        "items": (["transaction_id", "item_seq"], item_rules, "extended_cents >= 0"),
    }
    current = []
    started = []
    for name, (keys, rules, _) in plan.items():
        gated = stream_bronze(streams[name], rules).drop("_bronze_ts")
        base = _first_version(spark, root, name)
        write = upsert_batches(f"{root}/{name}", keys, "ingested_ts", base)
        started.append(run_batches(gated, write, f"{root}/checkpoints/{name}"))
    for query in started:
        query.awaitTermination()
    for name, (keys, _, holds) in plan.items():
        rows = read_current(spark, f"{root}/{name}", streams[name].schema, keys, "ingested_ts")
        current.append(rows.filter(holds))
    return current[0], current[1]
