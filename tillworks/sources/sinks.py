"""Writing: strict appends, layout, rows to a database, nested events to rows, and receipts to two stores. Keyed tables
(idempotent inserts, upserts, deletes) are in `keyed`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.operators.quality import validate_receipt
from tillworks.sources.keyed import write_if_absent


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def write_append_strict(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Appends rows whose columns are exactly the declared ones, in name, type and order."""
    if _shape(df.schema) != _shape(schema):
        differing = set(_shape(df.schema)) ^ set(_shape(schema))
        raise ValueError(f"schema mismatch: {sorted(differing) or 'column order'}")
    df.write.mode("append").parquet(path)


def clustered_write(df: DataFrame, path: str, columns: Sequence[str], parts: int | None = None, mode: str = "overwrite") -> None:
    """Rows range-split and sorted by the columns, so that a filter on them skips files and row groups."""
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode(mode).parquet(path)


#: Quantile ranks of a column in the interleaved layout, as a power of two.
RANK_BITS = 6


def _ordinal(df: DataFrame, column: str) -> Column:
    """A number in the order of the column: itself, its time, or the first letters of a text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.rpad(F.substring(F.col(column), 1, 6), 6, "\0").cast("binary").substr(1, 7)), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


#: Rows a file of the interleaved layout holds at most, give or take the sampling of the ranges.
FILE_ROWS = 1_000_000


def interleaved(df: DataFrame, columns: Sequence[str], bits: int = RANK_BITS) -> tuple[Column, int]:
    """Where a row lies on a curve through all columns alike: the bits of its quantile ranks, one column after the other (Morton
    order), and how many rows there are. Ranks make it independent of the columns' units and skew; NULL ranks first."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    # 2 ** bits - 1 numbers for each column come to the driver
    ranks = [F.percentile_approx(_ordinal(df, c), steps, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]
    cuts = df.agg(*ranks, F.count(F.lit(1)).alias("rows")).first()
    key = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        bounds = F.lit([float(x) for x in dict.fromkeys(cuts[i] or [])] or [0.0])
        value = _ordinal(df, c)
        # a second parameter would be the place in the array
        rank = F.when(value.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= value)))
        for bit in range(bits):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long")
            key = key + F.shiftleft(one, bit * len(columns) + i)
    return key, cuts["rows"]


def zorder_write(df: DataFrame, path: str, columns: Sequence[str], parts: int, bits: int = RANK_BITS, mode: str = "overwrite") -> None:
    """Rows in files along a curve through several columns, so that a filter on any one of them skips most files; of `parts` files
    and n columns about parts ** (1 - 1 / n) hold a value of one column. Rows within a file are sorted by the columns. Tables of
    more than `parts` times FILE_ROWS rows get more files, and a crowded place on the curve is split by the columns themselves, so
    that no task sorts much more than FILE_ROWS rows but where they agree in all columns."""
    if bits * len(columns) > 62:
        raise ValueError("too many bits")
    curve, rows = interleaved(df, columns, bits)
    keyed = df.withColumn("_curve", curve)
    files = max(parts, -(-rows // FILE_ROWS))
    keyed.repartitionByRange(files, "_curve", *columns).sortWithinPartitions(*columns).drop("_curve").write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """A catalog table hashed and sorted by a key; tables with the same key and buckets join without a shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.read.table(table)


def rows_to_database(df: DataFrame, connect: Callable[[], object], statement: str, batch: int = 1000) -> None:
    """Sends rows to a relational store from the executors, `batch` at a time.

    The statement has to be idempotent (insert on conflict), since a lost task sends its rows again.
    """
    columns = df.columns

    def send(rows) -> None:
        connection = connect()
        cursor = connection.cursor()
        held: list[tuple] = []
        for row in rows:
            held.append(tuple(row[c] for c in columns))
            if len(held) == batch:
                cursor.executemany(statement, held)
                held.clear()
        if held:
            cursor.executemany(statement, held)
        connection.commit()
        connection.close()

    df.foreachPartition(send)


def explode_receipts(events: DataFrame, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """Nested receipt events to raw headers and raw items that share an event id; lines count from 1.

    The id is the transaction id and a hash of the event and its arrival, so both results and every
    retry agree on it. Only the header rows carry the event as JSON.
    """
    mark = F.lower(F.hex(F.xxhash64(*events.columns, F.lit(ingested_at))))
    named = events.withColumns({
        "event_id": F.concat_ws("-", "transaction_id", mark),
        "ingested_ts": F.lit(ingested_at).cast("timestamp"),
    })
    headers = named.withColumn("raw_payload", F.to_json(F.struct(*events.columns))).select(
        "event_id", "transaction_id", "store_id", "store_name", "pos_terminal_id", "cashier_id", "customer_id",
        "transaction_ts", "subtotal_cents", "tax_cents", "total_cents", "tender_type", "card_last4",
        "raw_payload", "ingested_ts",
    )
    lines = named.select("event_id", "transaction_id", "ingested_ts", F.posexplode("items").alias("at", "item"))
    items = lines.select(
        "event_id", "transaction_id", (F.col("at") + 1).alias("item_seq"),
        "item.upc", "item.sku", "item.product_desc", "item.quantity", "item.unit_price_cents",
        "item.extended_cents", F.coalesce("item.discount_cents", F.lit(0)).cast("bigint").alias("discount_cents"),
        "item.department_code", "ingested_ts",
    )
    return headers, items


def dual_write(
    batch: DataFrame, batch_id: int, hot_root: str, analytics: Callable[[DataFrame, int], DataFrame | None],
    key: str = "transaction_id", within: str | None = None, slices: int = 1,
) -> DataFrame:
    """Writes receipts to the hot table, which must succeed, then to the analytics sink at best effort.

    Returns a status for each receipt: failed (refused by the checks), success, or partial where only the analytics side failed,
    with what it said among the reasons. The sink is called for each of `slices` hash slices of the batch with a number of its own
    (batch_id * slices + slice), so that one failure leaves the other slices' receipts a success; a sink that can tell more
    returns rows of the key and a `reason` for the receipts it refused, at most one for each. The batch is read several times:
    persist it.
    """
    checked = validate_receipt(batch).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    good = checked.filter(F.size("reasons") == 0).drop("reasons")
    write_if_absent(good.drop("_slice"), hot_root, [key], batch_id, within)
    broken: dict[int, str] = {}
    refused = None
    for number in range(slices):
        part = good.filter(F.col("_slice") == number).drop("_slice")
        try:
            told = analytics(part, batch_id * slices + number)
        except Exception as error:  # the hot rows are safe; reconciliation finds what is missing here
            broken[number] = f"analytics: {type(error).__name__}"
            continue
        if told is not None:
            told = told.select(key, F.concat(F.lit("analytics: "), F.col("reason")).alias("_refused"))
            refused = told if refused is None else refused.unionByName(told)
    fault = F.lit(None).cast("string")
    for number, text in broken.items():
        fault = F.when(F.col("_slice") == number, F.lit(text)).otherwise(fault)
    judged = checked.withColumn("_fault", fault)
    if refused is not None:
        judged = judged.join(refused, key, "left").withColumn("_fault", F.coalesce("_fault", "_refused"))
    bad = F.size("reasons") > 0
    status = F.when(bad, "failed").when(F.col("_fault").isNotNull(), "partial").otherwise("success")
    reasons = F.when(bad | F.col("_fault").isNull(), F.col("reasons")).otherwise(F.array("_fault"))
    return judged.select(key, status.alias("status"), F.lit(batch_id).cast("bigint").alias("batch_id"), reasons.alias("reasons"))
