"""Helpers the operators share: tables in the shared folder, text buffers, files of workers."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tillworks.session import run_folder

#: Rows of an Arrow batch while the session still has Spark's own default; long texts then stay within memory.
BATCH_ROWS = 500
SLAB = 4 << 20
#: Folders of helper tables written in this process, for their owner to release.
FOLDERS: list[str] = []


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def landed(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and a lost executor costs no rerun."""
    folder = run_folder(df.sparkSession, name)
    FOLDERS.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def drop_finished(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that nothing refers to any more, as its periodic GC would."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of UTF-8 bytes and their offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slabs(batch: pa.RecordBatch, column: str, limit: int = SLAB) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most `limit` text bytes; a longer text makes a piece of its own."""
    offsets = text_bytes(batch.column(column))[1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def byte_table(seed: int) -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)


def mounted(uri: str) -> str | None:
    """The path of a file that every machine sees in its own file system, None for one in a remote store."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") or "://" not in uri else None


def put_file(uri: str, payload: bytes) -> None:
    """Writes a whole file below the shared folder under a name of its own, then moves it into place."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file:///" + uri.removeprefix("file:").lstrip("/"))
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(payload)
    store.move(part, path)


def part_rows(uri: str, names: list[str]) -> dict[str, np.ndarray | list]:
    """The columns of all Parquet files of one folder of the shared store; no rows where there is no such folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file:///" + uri.removeprefix("file:").lstrip("/"))
    files = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    tables = [pq.ParquetFile(store.open_input_file(f)).read(columns=names) for f in sorted(files)]
    return {n: [x for t in tables for x in t.column(n).to_pylist()] for n in names}


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the greatest needs, after a byte that says how many."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(packed: bytes) -> np.ndarray:
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def get_file(uri: str) -> bytes:
    """The whole of a file below the shared folder."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else "file:///" + uri.removeprefix("file:").lstrip("/"))
    with store.open_input_stream(path) as source:
        return source.read()


class TwoGenerations:
    """A dict whose size is bounded: the older half goes when the newer half is full."""

    def __init__(self, make, limit: int = 300_000):
        self.make, self.limit, self.new, self.old = make, limit, {}, {}

    def __call__(self, keys: list) -> list:
        found = list(map(self.new.get, keys))
        if None not in found:
            return found
        new, old = self.new, self.old
        missing = {k for k, v in zip(keys, found) if v is None}
        fresh = []
        for k in missing:
            value = old.get(k)
            if value is None:
                fresh.append(k)
            else:
                new[k] = value
        if fresh:
            new.update(zip(fresh, self.make(fresh)))
        found = list(map(new.get, keys))
        if len(new) > self.limit:
            self.old, self.new = new, {}
        return found
