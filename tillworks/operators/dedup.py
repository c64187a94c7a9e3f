"""Latest row per key for at-least-once feeds.

Ranking and keeping the first row lets Spark drop all but one row per key in every map task before
the shuffle (WindowGroupLimit), so a key re-delivered any number of times costs one row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SALTS = 64


def _hashable(df: DataFrame) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f"`{name}`" for name, kind in kinds.items() if "map<" not in kind and "variant" not in kind] or ["*"]


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int = 1, rank_name: str | None = None
) -> DataFrame:
    """The first `limit` rows of every key in the given order; `order` has to break all ties.

    Up to the session's `spark.sql.optimizer.windowGroupLimitThreshold` Spark keeps only that many rows of a key in each
    task before the shuffle. Beyond it the rows are ranked in salted parts first, with the same result.
    """
    rank = rank_name or "_rank"
    if limit >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        part = F.pmod(F.xxhash64(*_hashable(df)), F.lit(_SALTS))
        salted = df.withColumn("_salt", part)
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_first", F.row_number().over(first)).filter(F.col("_first") <= limit).drop("_salt", "_first")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank) <= limit)
    return kept if rank_name else kept.drop(rank)


# Columns that settle ties, greatest value first, in batch, stream and stored tables alike. Columns added to a feed later,
# such as product texts, count only between rows that agree in all of these.
TIES = (
    "ingested_ts", "event_id", "discount_cents", "extended_cents", "quantity", "sku", "upc", "unit_price_cents",
    "total_cents", "subtotal_cents", "tax_cents", "transaction_ts", "customer_id", "store_id", "tender_type", "card_last4",
)


def latest_order(columns: Sequence[str], keys: Sequence[str], sequence: str) -> list[str]:
    """The columns, greatest first, by which the latest row of a key is told."""
    rest = [c for c in columns if c not in (*keys, sequence)]
    declared = [c for c in TIES if c in rest]
    return [sequence, *declared, *sorted(set(rest) - set(declared))]


def latest_per_key(df: DataFrame, keys: Sequence[str], sequence: str = "ingested_ts") -> DataFrame:
    """One row per key, the latest by `sequence`; ties go to the greatest of the TIES columns, then of the others by name."""
    return top_per_key(df, keys, [F.desc(c) for c in latest_order(df.columns, keys, sequence)])


def first_of_runs(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over sorted rows: the first row of each run that agrees in the keys, NULL agreeing with NULL."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.array([last is None] + [False] * (batch.num_rows - 1))
            for key in keys:
                column = batch.column(key)
                before = pa.concat_arrays([last.column(key) if last else pa.nulls(1, column.type), column.slice(0, batch.num_rows - 1)])
                differs = pc.or_(pc.fill_null(pc.not_equal(column, before), False), pc.xor(column.is_null(), before.is_null()))
                new = pc.or_(new, differs)
            yield batch.filter(new)
            last = batch.slice(batch.num_rows - 1, 1)

    return kept


def latest_together(df: DataFrame, keys: Sequence[str], by: str, parts: int, sequence: str = "ingested_ts") -> DataFrame:
    """The rows of `latest_per_key`, left in `parts` partitions by the hash of `by`, one of the keys, so that groupings by it need no
    further shuffle.

    The window's own shuffle would go by all keys. Its drop of all but one row of a key in each task is made up for before the
    shuffle: rows sorted by key and rank leave a task only where the key changes, and neighbours alike shuffle as fewer bytes.
    """
    order = [F.desc(c) for c in latest_order(df.columns, keys, sequence)]
    first = df.sortWithinPartitions(*keys, *order).mapInArrow(first_of_runs(keys), df.schema)
    return latest_per_key(first.repartition(parts, by), keys, sequence)


def dedup_receipts(headers: DataFrame, parts: int | None = None) -> DataFrame:
    """One header per transaction; headers without a positive total leave. With `parts`, hashed into that many by transaction."""
    keys = ["transaction_id"]
    latest = latest_together(headers, keys, "transaction_id", parts) if parts else latest_per_key(headers, keys)
    return latest.filter(F.col("total_cents") > 0)


def dedup_items(items: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per transaction and line; lines with a negative amount leave. With `parts`, hashed into that many by transaction."""
    keys = ["transaction_id", "item_seq"]
    latest = latest_together(items, keys, "transaction_id", parts) if parts else latest_per_key(items, keys)
    return latest.filter(F.col("extended_cents") >= 0)
