"""Keyed tables: Parquet folders of `version=N` parts, bucketed by the hash of the key.

A write fills exactly one version, so that a repeated attempt replaces its own output and nothing else; a delete is a row too, a
tombstone. Readers pick the winning row per key. All versions share one bucketing, so picking, counting, compacting and the
meeting of a batch with what is there read the buckets side by side: only the batch is shuffled, never the history, and a look-up
of given keys reads the buckets that can hold them. Nothing already written is rewritten until the table is compacted into a new
folder.

The folder is the table; its `_keyed.json` holds schema, keys and number of buckets. Each Spark application that opens it names it
in its catalog as an external table, which dropping the name does not remove.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillworks.operators.dedup import latest_order, latest_per_key, top_per_key

#: Buckets of a table unless told otherwise; as many tasks read it at a time, so a table of terabytes wants thousands.
BUCKETS = 16
#: How many writes a row stands for (more than one after compaction), whether it is a tombstone, and the version.
WRITES, DELETED, VERSION = "_writes", "_deleted", "version"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return bool(system.exists(place))


def next_version(spark: SparkSession, root: str) -> int:
    """One above the versions a keyed table holds."""
    if not exists(spark, root):
        return 0
    system, place = _place(spark, root)
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return 1 + max((int(n.split("=")[1]) for n in names if n.startswith(f"{VERSION}=")), default=-1)


def _described(spark: SparkSession, root: str) -> dict | None:
    system, place = _place(spark, f"{root}/_keyed.json")
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def _created(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> dict:
    found = _described(spark, root)
    if found is None:
        found = {"schema": schema.json(), "keys": list(keys), "buckets": buckets}
        system, place = _place(spark, f"{root}/_keyed.json")
        stream = system.create(place, False)
        stream.write(bytearray(json.dumps(found), "utf-8"))
        stream.close()
    if found["keys"] != list(keys):
        raise ValueError(f"the table is keyed by {found['keys']}")
    return found


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _named(spark: SparkSession, root: str) -> str | None:
    """The table's name in the catalog, its versions brought up to date; None where nothing was written yet."""
    found = _described(spark, root)
    if found is None:
        return None
    name = f"keyed_{hashlib.md5(root.encode(), usedforsecurity=False).hexdigest()[:20]}"
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        columns = [f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields]
        columns += [f"{DELETED} boolean", f"{WRITES} bigint", f"{VERSION} bigint"]
        keys = ", ".join(map(_quoted, found["keys"]))
        where = root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(columns)}) USING parquet PARTITIONED BY ({VERSION}) "
                  f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {found['buckets']} BUCKETS LOCATION '{where}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.catalog.refreshTable(name)
    return name


def _written(rows: DataFrame, root: str, version: int, keys: Sequence[str], buckets: int, spread: bool = True) -> None:
    """The rows, tombstone mark and write count included, as one version."""
    spark = rows.sparkSession
    schema = T.StructType([f for f in rows.schema.fields if f.name not in (DELETED, WRITES)])
    table = _created(spark, root, schema, keys, buckets)
    name = _named(spark, root)
    # one task for each bucket, else each task would leave a file in all of them
    rows = rows.repartition(table["buckets"], *map(_quoted, keys)) if spread else rows
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # replaces this version only, and may read the others
    try:
        rows.select(*map(_quoted, schema.names), DELETED, WRITES, F.lit(int(version)).cast("bigint").alias(VERSION)).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def _marked(df: DataFrame, deleted: Column | None = None) -> DataFrame:
    mark = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    return df.withColumns({DELETED: mark, WRITES: F.lit(1).cast("bigint")})


def all_rows(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows of all versions with their marks; empty where nothing was written yet."""
    name = _named(spark, root)
    if name is None:
        marks = [T.StructField(DELETED, T.BooleanType()), T.StructField(WRITES, T.LongType()), T.StructField(VERSION, T.LongType())]
        return spark.createDataFrame([], T.StructType([*schema.fields, *marks]))
    rows = spark.table(name).select(*map(_quoted, schema.names), DELETED, WRITES, VERSION)
    return rows if before is None else rows.filter(F.col(VERSION) < before)


def read_versions(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows of a keyed table but its tombstones, with their version; empty where nothing was written yet."""
    return all_rows(spark, root, schema, before).filter(~F.col(DELETED)).drop(DELETED, WRITES)


def _winners(rows: DataFrame, schema: T.StructType, keys: Sequence[str], sequence: str | None) -> DataFrame:
    """The winning row per key, tombstones included: of equal `sequence` a tombstone, then the greatest of the declared ties."""
    if sequence is None:
        return top_per_key(rows, keys, [F.desc(VERSION)])
    first, *ties = latest_order(schema.names, keys, sequence)
    return top_per_key(rows, keys, [F.desc(first), F.desc(DELETED), *map(F.desc, ties), F.desc(VERSION)])


def read_current(
    spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], sequence: str | None = None,
    count_as: str | None = None,
) -> DataFrame:
    """The winning row per key: the latest `sequence`, or the latest version where none is named. Keys whose winner is a
    tombstone are left out.

    `count_as` adds how many times the key was written.
    """
    rows = all_rows(spark, root, schema)
    if count_as is not None:
        rows = rows.withColumn(count_as, F.sum(WRITES).over(Window.partitionBy(*keys)))
    current = _winners(rows, schema, keys, sequence).filter(~F.col(DELETED))
    return current.select(*map(_quoted, schema.names), *([count_as] if count_as else []))


def write_upsert(
    df: DataFrame, root: str, keys: Sequence[str], sequence: str, version: int, buckets: int = BUCKETS
) -> None:
    """Adds or replaces rows by key; within the batch and against the table the latest `sequence` wins."""
    _written(_marked(latest_per_key(df, keys, sequence).select(*df.columns)), root, version, keys, buckets)


def write_changes(
    changes: DataFrame, root: str, keys: Sequence[str], version: int, sequence: str | None = None, buckets: int = BUCKETS,
) -> None:
    """Takes in change rows (`_change_type`: insert, update or delete) as one version; deletes become tombstones.

    A key has one change row in a batch, or else a `sequence` by which the latest wins, a delete among equals. Without a sequence
    a later version wins.
    """
    rows = _marked(changes, F.col("_change_type") == "delete").drop("_change_type")
    if sequence is not None:
        schema = T.StructType([f for f in rows.schema.fields if f.name not in (DELETED, WRITES)])
        rows = _winners(rows.withColumn(VERSION, F.lit(version)), schema, keys, sequence).drop(VERSION)
    _written(rows, root, version, keys, buckets)


def write_if_absent(
    df: DataFrame, root: str, keys: Sequence[str], version: int, within: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Inserts rows whose key is not there, or there as a tombstone only; the first write of a key stays.

    Returns the keys of `df` with a status, created or exists. Repeating a version gives the same rows and the same statuses,
    since only earlier versions count as being there. Of those only the key columns are read, bucket by bucket, and only row
    groups whose first key lies in the range of the batch; so keys that grow with time meet recent data only. `within` may name
    another column that never differs between two writes of a key, such as the time of sale, which narrows the range further.
    """
    spark = df.sparkSession
    there = all_rows(spark, root, df.schema, before=version)
    ranges = [c for c in (keys[0], within) if c is not None]
    bounds = df.agg(*[f(F.col(_quoted(c))).alias(f"{n}{i}") for i, c in enumerate(ranges) for n, f in (("low", F.min), ("high", F.max))]).first()
    for i, c in enumerate(ranges):
        if bounds[f"low{i}"] is not None:
            there = there.filter(F.col(_quoted(c)).between(F.lit(bounds[f"low{i}"]), F.lit(bounds[f"high{i}"])) | F.col(_quoted(c)).isNull())
    there = there.groupBy(*keys).agg(F.max_by(DELETED, VERSION).alias(DELETED)).filter(~F.col(DELETED)).select(*keys)
    rest = [F.asc(c) for c in df.columns if c not in keys and not isinstance(df.schema[c].dataType, T.MapType)]
    first = top_per_key(df, keys, rest or [F.lit(1)])
    fresh = first.join(there, list(keys), "left_anti").select(*df.columns)
    _written(_marked(fresh), root, version, keys, buckets)
    created = (all_rows(spark, root, df.schema).filter(F.col(VERSION) == version).select(*keys).withColumn("_new", F.lit(True)))
    status = F.when(F.col("_new"), "created").otherwise("exists")
    return df.select(*keys).distinct().join(created, list(keys), "left").select(*keys, status.alias("status"))


def compact(
    spark: SparkSession, root: str, target: str, schema: T.StructType, keys: Sequence[str], sequence: str | None,
    keep_deletes: bool = True,
) -> None:
    """Writes the winning rows of a keyed table, with their number of writes, as the single version of a new folder, bucket by
    bucket without a shuffle. Tombstones stay, so that a row that comes late does not bring its key back, unless told otherwise."""
    found = _described(spark, root)
    if found is None:
        return
    rows = all_rows(spark, root, schema)
    total = rows.withColumn("_total", F.sum(WRITES).over(Window.partitionBy(*keys)))
    won = _winners(total, schema, keys, sequence)
    kept = won if keep_deletes else won.filter(~F.col(DELETED))
    _written(kept.select(*map(_quoted, schema.names), DELETED, F.col("_total").alias(WRITES)), target, 0, keys, found["buckets"], spread=False)


def read_keys(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], wanted: Sequence[object], sequence: str | None = None) -> DataFrame:
    """The current rows of a few values of the single key column: only the buckets that can hold them are read."""
    rows = all_rows(spark, root, schema).filter(F.col(_quoted(keys[0])).isin(list(wanted)))
    return _winners(rows, schema, keys, sequence).filter(~F.col(DELETED)).select(*map(_quoted, schema.names))
