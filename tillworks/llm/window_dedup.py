"""Repeated windows of words, found by a count-min prefilter and an exact second pass.

A window is `WORDS` consecutive words of one text (words between white space, unchanged). A word goes if a window over it has the
same words as a window of a document with a smaller id. Windows are judged on the input, not on what is left.

First pass: the windows of a chunk of texts fall into cells of a count-min sketch with DEPTH rows; a chunk sends the cells it
uses, sorted and delta-coded, to the shards that hold the merged sketch, and learns which of them more than one window uses. The
counts are never below the true ones, so a window that occurs twice is estimated as repeated in every row. Second pass: only
windows so estimated are grouped exactly, by 128 bits of hash less the 32 that nothing needs, with the smallest id of each. A chunk
sends each of its windows once, however often it holds it, and gets a bit back for each; so a window that a third of all texts hold
costs one key for each chunk. The width of the sketch follows the number of windows and the number of shards its size, so tasks
stay alike at every size; no sketch is sent to all workers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillworks.llm.common import FOLDERS, drop_finished, landed, mix64, narrow, part_rows, slabs, small_batches, text_bytes, widened
from tillworks.llm.words import words_of
from tillworks.session import run_folder

WORDS = 13
DEPTH = 2
#: Cells of a row of the sketch for each window, at least; at four, one in twenty windows that occur once is estimated as repeated.
SPARE = 4
CHUNK_BYTES = 2 << 20
#: Cells of the sketch that one shard holds, as a power of two; and windows that a shard of the exact pass may hold, on average.
SHARD_BITS = 24
SHARD_WINDOWS = 2_000_000
LEAST_SHARDS = 64
_LAST = np.iinfo(np.int64).max
_SEEDS = np.random.default_rng(71).integers(0, 2**64, DEPTH, np.uint64)
_ODD = np.random.default_rng(72).integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)


class Windows:
    """The words and windows of the texts of one chunk."""

    def __init__(self, rows: pa.RecordBatch, id_col: str, text_col: str):
        self.data, self.offsets = text_bytes(rows.column(rows.schema.get_field_index(text_col)))
        ids = rows.column(rows.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(_LAST)
        self.starts, self.stops, hashes = words_of(self.data, self.offsets, fold=False)
        self.owner = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.n_words = np.bincount(self.owner, minlength=rows.num_rows)
        after = (np.cumsum(self.n_words)[self.owner] - np.arange(len(hashes))) if len(hashes) else np.zeros(0, np.int64)
        self.at = np.flatnonzero(after >= WORDS)
        self.ids = ids.to_numpy(zero_copy_only=False)[self.owner[self.at]]
        keys = []
        for odd in _ODD:
            # hash of the words from each on, by doubling: 1, 2, 4, 8 words, then 8 + 4 + 1
            runs, power = {1: mix64(hashes ^ odd)}, {1: odd}
            for k in (1, 2, 4):
                runs[2 * k] = runs[k][:-k] * power[k] + runs[k][k:] if len(hashes) > k else runs[k][:0]
                power[2 * k] = np.uint64(pow(int(power[k]), 2, 2**64))
            h, done = np.zeros(len(self.at), np.uint64), 0
            for k in (8, 4, 1):
                if len(self.at):
                    h = h * power[k] + runs[k][self.at + done]
                done += k
            keys.append(mix64(h))
        self.key, self.check = keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32)

    def cells(self, bits: int) -> np.ndarray:
        """The cell of each window in each row of a sketch with rows of 2 ** bits cells, row after row."""
        return np.concatenate([(mix64(self.key ^ seed) >> np.uint64(64 - bits)) | (np.uint64(r) << np.uint64(bits))
                               for r, seed in enumerate(_SEEDS)])


class Suspects:
    """The windows of a chunk that the sketch estimates as repeated: each key once, with the smallest id that has it."""

    def __init__(self, windows: Windows, bits: int, shard_bits: int, answers: list[tuple[int, bytes]]):
        cells = windows.cells(bits)
        used, where = np.unique(cells, return_inverse=True)
        hit = _spread(used >> np.uint64(shard_bits), answers)
        self.which = np.flatnonzero(hit[where].reshape(DEPTH, -1).all(0)) if len(used) else np.zeros(0, np.int64)
        key, check, ids = windows.key[self.which], windows.check[self.which], windows.ids[self.which]
        order = np.lexsort((check, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.key, self.check = key[order][first], check[order][first]
        self.low = np.minimum.reduceat(ids[order], first) if len(first) else ids


def _spread(shard: np.ndarray, answers: list[tuple[int, bytes]]) -> np.ndarray:
    """A truth value for each entry from the bits that its shard has answered; entries are sorted by shard, silence means no."""
    out = np.zeros(len(shard), bool)
    for s, bits in answers:
        low, high = np.searchsorted(shard, np.uint64(s), "left"), np.searchsorted(shard, np.uint64(s), "right")
        out[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low).astype(bool)
    return out


def _cut(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard, begin and end of each run of equal shards."""
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] + np.uint64(1))), len(shard))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(shard[low]), low, high


def _chunks(docs: DataFrame, text_col: str) -> DataFrame:
    """chunk, words, rows: whole rows with all their columns in compressed chunks of about CHUNK_BYTES of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            for piece in slabs(batch, text_col, CHUNK_BYTES):
                words = len(words_of(*text_bytes(piece.column(piece.schema.get_field_index(text_col))), fold=False)[0])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([words], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["chunk", "words", "rows"])
                chunk += 1

    return docs.mapInArrow(run, "chunk long, words long, rows binary")


class _Answers:
    """The answers to a chunk, from the folder of the part of the chunks it belongs to; one part is held at a time."""

    def __init__(self, folder: str):
        self.folder, self.part, self.found = folder, None, {}

    def __call__(self, chunk: int) -> list[tuple[int, bytes]]:
        if self.part != chunk >> 33:
            self.part, self.found = chunk >> 33, {}
            rows = part_rows(f"{self.folder}/part={self.part}", ["chunk", "shard", "bits"])
            for c, s, bits in zip(rows["chunk"], rows["shard"], rows["bits"]):
                self.found.setdefault(c, []).append((s, bits))
        return self.found.get(chunk, [])


def _answered(sent: DataFrame, answer, name: str) -> str:
    """The answers to what chunks sent to shards, in a folder for each part of the chunks. `answer` makes the bits of all rows of a
    shard; answers without a set bit are left out."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        bits = answer(rows)
        keep = [k for k, b in enumerate(bits) if b.any()]
        return pa.table({"part": pa.array([rows["chunk"][k] >> 33 for k in keep], pa.int64()),
                         "chunk": pa.array([rows["chunk"][k] for k in keep], pa.int64()),
                         "shard": pa.array([rows["shard"][k] for k in keep], pa.int64()),
                         "bits": pa.array([np.packbits(bits[k]).tobytes() for k in keep], pa.binary())})

    found = sent.groupBy("shard").applyInArrow(run, "part long, chunk long, shard long, bits binary")
    folder = run_folder(sent.sparkSession, name)
    FOLDERS.append(folder)
    found.repartition("part").write.partitionBy("part").parquet(folder)
    drop_finished(sent.sparkSession)
    return folder


def _merged(rows: dict[str, list]) -> list[np.ndarray]:
    """Which cells of a shard of the sketch hold more than one window, for the cells of each chunk."""
    mask = np.uint64((1 << rows["span"][0]) - 1)
    counts = np.zeros(int(mask) + 1, np.uint8)
    cells = [np.cumsum(widened(p)).astype(np.int64) for p in rows["cells"]]
    for c, twice in zip(cells, rows["twice"]):
        more = 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(c))
        counts[c] = np.minimum(counts[c] + more, 2)
    return [counts[c] >= 2 for c in cells]


def _grouped(rows: dict[str, list]) -> list[np.ndarray]:
    """Which windows of each chunk occur in a document with a smaller id than the smallest that the chunk has."""
    key = np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]])
    check = np.concatenate([np.frombuffer(x, "<u4") for x in rows["checks"]])
    low = np.concatenate([widened(x).astype(np.int64) + base for x, base in zip(rows["lows"], rows["base"])])
    order = np.lexsort((check, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    first = np.flatnonzero(fresh)
    least = np.minimum.reduceat(low[order], first)
    late = np.empty(len(order), bool)
    late[order] = low[order] > least[np.cumsum(fresh) - 1]
    return np.split(late, np.cumsum([len(x) // 8 for x in rows["keys"]])[:-1])


def _unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def _judged(docs: DataFrame, id_col: str, text_col: str, make, schema: str | T.StructType) -> DataFrame:
    """What `make` gives for the rows of each chunk, their windows, and which of all words go."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    spark = docs.sparkSession
    small_batches(spark)
    chunks = landed(_chunks(docs, text_col), "window-chunks")
    total = chunks.agg(F.sum("words")).first()[0] or 0
    bits = max(16, (SPARE * total - 1).bit_length())
    space = bits + (DEPTH - 1).bit_length()
    span = min(SHARD_BITS, space - (LEAST_SHARDS - 1).bit_length())
    exact = max(LEAST_SHARDS - 1, total // SHARD_WINDOWS).bit_length()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                used, count = np.unique(Windows(_unpacked(rows), id_col, text_col).cells(bits), return_counts=True)
                shard = used >> np.uint64(span)
                base = shard << np.uint64(span)
                out = [(s, narrow(np.diff(used[a:b] - base[a:b], prepend=np.uint64(0))), np.packbits(count[a:b] > 1).tobytes())
                       for s, a, b in _cut(shard)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()), pa.array([span] * len(out), pa.int64()),
                     pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())],
                    names=["shard", "chunk", "span", "cells", "twice"])

    part = chunks.select("chunk", "rows")
    estimated = _answered(part.mapInArrow(sketch, "shard long, chunk long, span long, cells binary, twice binary"), _merged, "window-estimates")

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = _Answers(estimated)
        for batch in batches:
            for chunk, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Suspects(Windows(_unpacked(rows), id_col, text_col), bits, span, answers(chunk))
                out = []
                for s, a, b in _cut(found.key >> np.uint64(64 - exact)):
                    base = int(found.low[a:b].min())
                    out.append((s, found.key[a:b].astype("<u8").tobytes(), found.check[a:b].astype("<u4").tobytes(), base,
                                narrow(found.low[a:b].astype(np.uint64) - np.uint64(base % 2**64))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64()),
                     pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()),
                     pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.binary())],
                    names=["shard", "chunk", "keys", "checks", "base", "lows"])

    repeated = _answered(part.mapInArrow(suspects, "shard long, chunk long, keys binary, checks binary, base long, lows binary"),
                         _grouped, "window-repeats")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimates, repeats = _Answers(estimated), _Answers(repeated)
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = _unpacked(packed)
                windows = Windows(rows, id_col, text_col)
                found = Suspects(windows, bits, span, estimates(chunk))
                late = _spread(found.key >> np.uint64(64 - exact), repeats(chunk))
                goes = late[found.group] | (windows.ids[found.which] > found.low[found.group])
                at = windows.at[found.which[goes]]
                edge = np.zeros(len(windows.starts) + 1, np.int32)
                edge[at] += 1
                np.add.at(edge, at + WORDS, -1)
                yield make(rows, windows, np.cumsum(edge[:-1]) > 0)

    return part.mapInArrow(judge, schema)


def _kept(windows: Windows, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that stay as bytes, each with a space after it, and where each text's begin."""
    keep = np.flatnonzero(~gone)
    sizes = windows.stops[keep] - windows.starts[keep] + 1
    ends = np.cumsum(sizes)
    source = np.repeat(windows.starts[keep] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    out = np.append(windows.data, np.uint8(32))[np.minimum(source, len(windows.data))]
    out[ends - 1] = 32
    return out, np.concatenate([[0], np.cumsum(np.bincount(windows.owner[keep], sizes, len(windows.n_words)).astype(np.int64))])


def window_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 (of the words that stay, one space between them), a row for each row of `docs`.

    A null text has no words; a text of fewer than WORDS words has no window and loses nothing. Rows with the same id do not judge
    each other; a null id counts as greater than all others. Texts of any length are looked at whole, a long one as a chunk of its
    own. Ids must be whole numbers. Other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))

    def make(rows: pa.RecordBatch, windows: Windows, gone: np.ndarray) -> pa.RecordBatch:
        out, offsets = _kept(windows, gone)
        view = memoryview(out)
        digests = [hashlib.sha256(view[a:max(a, b - 1)]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        removed = np.bincount(windows.owner[gone], minlength=rows.num_rows)
        return pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index(id_col)), pa.array(windows.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)),
             pa.array(digests, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _judged(docs, id_col, text_col, make, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def without_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with all their columns; texts that lose words become the words that stay, one space between them, all
    others are unchanged. For nulls, ties and empty tables see `window_digests`."""
    def make(rows: pa.RecordBatch, windows: Windows, gone: np.ndarray) -> pa.RecordBatch:
        out, offsets = _kept(windows, gone)
        touched = np.bincount(windows.owner[gone], minlength=rows.num_rows) > 0
        place = rows.schema.get_field_index(text_col)
        texts = rows.column(place).to_pylist()
        for k in np.flatnonzero(touched).tolist():
            texts[k] = out[offsets[k]: max(offsets[k], offsets[k + 1] - 1)].tobytes().decode("utf-8")
        return rows.set_column(place, rows.schema.field(place), pa.array(texts, rows.schema.field(place).type))

    return _judged(docs, id_col, text_col, make, docs.schema)
