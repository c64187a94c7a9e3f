"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `length` bytes, by passes from the most significant digit on; a suffix alone in
its group is settled and leaves, and the groups left after the last digit are exactly the repeated windows.

The first digit is the smallest 32-byte gram of the window (by a hash, the rightmost of equals). Neighbouring windows share it,
so the first pass carries one row for each run of windows with the same gram, about one in eighty positions. That pass also
sorts the first window of each run and the last of each text through all their bytes. Where both ends of a run are repeated,
the windows between them cover nothing new. The windows of the other runs go on to the next pass only if their gram occurs
again; there they are sorted through all bytes. Keys of whole windows have 128 bits, those of grams 64.

Texts lie in chunks in the shared folder, a long text whole in a chunk of its own; its windows are looked at in overlapping
pieces. Only keys travel: a chunk sends each of its keys once, with a mark if it holds it twice, and gets a bit back for each that
says whether it occurs elsewhere; so a passage that a third of all texts hold costs one key for each chunk and no task meets all
its copies. Every pass works the keys of the passes before out again and reads their bits from the folder of its part of the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import FOLDERS, byte_table, drop_finished, landed, part_rows, slabs, small_batches, text_bytes
from tillworks.session import run_folder

CHUNK_BYTES = 1 << 20
GRAM = 32
BLOCK = 16
GRAMS, FIRSTS, BLOCKS, WINDOWS = range(4)
#: Windows looked at together; texts of any length pass in pieces that overlap by a window. Gram places within a piece take
#: the low 24 bits of a key.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
#: Chunks whose keys a shard of the sort may hold, on average.
CHUNKS_A_SHARD = 64
LEAST_SHARDS = 64
_TABLE = byte_table(17)
_ODD = np.random.default_rng(18).integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """chunk, rows: whole rows with all their columns in compressed chunks of about CHUNK_BYTES of text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for batch in batches:
            for piece in slabs(batch, text_col, CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])
                chunk += 1

    return docs.mapInArrow(run, "chunk long, rows binary")


def unpacked(rows: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(rows.as_buffer()).read_next_batch()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    h, width = _TABLE[data], 1
    for odd in _ODD[:5]:
        h = h[:-width] * odd + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= _ODD[5]
    h ^= h >> np.uint64(32)
    return h


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows to sort in the first pass: their positions, whether the next one is in the same text, and the hash and place of
    the gram that the windows from each to the next share. Every text of at least `length` bytes has its first and last window among them."""
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    long = sizes >= length
    if not long.any():
        return empty, empty.astype(bool), empty.astype(np.uint64), empty
    n, span = len(data) - length + 1, length - GRAM + 1
    valid = np.zeros(n + 1, np.int32)
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, np.minimum(offsets[1:][long] - length + 1, n), -1)
    inside = np.cumsum(valid[:-1]) > 0
    first, last = offsets[:-1][long], offsets[1:][long] - length
    ends = np.zeros(n, bool)
    ends[last] = True
    found = []
    before = -1
    for low in range(0, n, PIECE):
        high = min(low + PIECE, n)
        h = gram_hashes(data[low: high + length - 1])
        # smallest hash first, rightmost first among equals
        key = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
        width = 1
        while width * 2 <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width:])
        where = (_PLACE - (key & _PLACE)).astype(np.int64)
        here = inside[low:high]
        begins = here & (where + low != np.append(before, where[:-1] + low))
        begins[1:] |= here[1:] & ~here[:-1]
        for edge in (first, last):
            begins[edge[(edge >= low) & (edge < high)] - low] = True
        at = np.flatnonzero(begins)
        found.append((at + low, ~ends[at + low], h[where[at]], where[at] + low))
        before = where[-1] + low
    return tuple(np.concatenate(part) for part in zip(*found))


def window_keys(data: np.ndarray, at: np.ndarray, length: int) -> list[bytes]:
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return [digest(view[p: p + length]) for p in at.tolist()]


def open_windows(runs: tuple, repeated: np.ndarray, again: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all runs whose gram occurs again: their positions, those of their grams, and whether they ask. `repeated`
    and `again` tell for each run whether its first window and its gram occur again.

    A window asks unless it is known to be repeated, or lies between two repeated ones that cover all it could. The others
    are there to be found by those that ask."""
    at, joined, _, where = runs
    if not len(at):
        return at, at, joined
    gap = np.where(joined, np.diff(np.append(at, at[-1] + 1)), 1)
    settled = repeated & np.append(repeated[1:], False) & (gap <= length) & joined
    able = np.flatnonzero(again)
    sizes = gap[able]
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    asks = ~np.repeat(settled[able], sizes) & ((step > 0) | ~np.repeat(repeated[able], sizes))
    return np.repeat(at[able], sizes) + step, np.repeat(where[able], sizes), asks


def block_keys(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit keys of blocks (gram place, block number): the bytes that all windows of a block share."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    size = length - BLOCK + 1
    return np.array([digest(view[m - BLOCK * j: m - BLOCK * j + size], j) for m, j in places.tolist()], np.uint64)


def blocks_of(positions: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct blocks of the windows, and each window's block."""
    number = (where - positions) // BLOCK
    width = np.int64(1) << 20
    found, back = np.unique(where * width + number, return_inverse=True)
    return np.stack([found // width, found % width], axis=1), back


KEYS = "shard long, chunk long, kind int, twice boolean, asks boolean, keys binary"
ANSWERS = "part long, chunk long, kind int, sent long, bits binary"


class Sent:
    """The distinct keys (rows of one or two 64-bit numbers) of one kind in a chunk, in the order in which they are sent: by
    shard, and apart by whether they were found twice and ask."""

    def __init__(self, keys: np.ndarray, shards: int, asks: np.ndarray | None = None):
        order = np.lexsort(keys.T[::-1])
        ranked = keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (ranked[1:] != ranked[:-1]).any(1)
        first = np.flatnonzero(fresh)
        group = (ranked[first, 0] % np.uint64(shards)).astype(np.int64) * 4
        if len(first):
            group += 2 * (np.diff(np.append(first, len(keys))) > 1)
            group += 1 if asks is None else np.logical_or.reduceat(asks[order], first)
        by_group = np.argsort(group, kind="stable")
        self.group, self.keys = group[by_group], ranked[first][by_group]
        place = np.empty(len(first), np.int64)
        place[by_group] = np.arange(len(first))
        #: where each of the keys given stands among those sent
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = place[np.cumsum(fresh) - 1]

    def rows(self, chunk: int, kind: int) -> list[tuple]:
        edges = np.flatnonzero(np.diff(self.group, prepend=-1, append=-1))
        return [(g >> 2, chunk, kind, bool(g & 2), bool(g & 1), self.keys[low:high].tobytes())
                for low, high, g in zip(edges[:-1], edges[1:], self.group[edges[:-1]].tolist())]

    def told(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """The answer to each of the keys given, in their order; silence means no."""
        out = np.zeros(len(self.keys), bool)
        for g, bits in answers:
            low, high = np.searchsorted(self.group, [g, g + 1])
            out[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
        return out[self.place]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)],
                    names=[name for name, _ in fields])


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _answers(table: pa.Table) -> pa.Table:
    """For the keys sent to one shard a bit each: whether the key occurs again, there or in another chunk, and is asked for."""
    out = []
    kinds = table.column("kind").to_numpy()
    for kind in np.unique(kinds).tolist():
        part = table.filter(pa.array(kinds == kind))
        blobs = [np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, 1 if kind in (GRAMS, BLOCKS) else 2) for b in part.column("keys")]
        sizes = [len(b) for b in blobs]
        keys = np.concatenate(blobs)
        chunk, shard = part.column("chunk").to_pylist(), part.column("shard").to_numpy()
        twice, asks = (np.array(part.column(c).to_pylist(), bool) for c in ("twice", "asks"))
        order = np.lexsort(keys.T[::-1])
        ranked = keys[order]
        first = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(1)))
        many = np.diff(np.append(first, len(keys)))
        told = (many > 1) | np.logical_or.reduceat(np.repeat(twice, sizes)[order], first)
        told &= np.logical_or.reduceat(np.repeat(asks, sizes)[order], first)
        again = np.empty(len(keys), bool)
        again[order] = np.repeat(told, many)
        for c, g, bits in zip(chunk, (shard * 4 + twice * 2 + asks).tolist(), np.split(again, np.cumsum(sizes)[:-1])):
            if bits.any():
                out.append((c >> 33, c, kind, g, np.packbits(bits).tobytes()))
    return _table(out, ANSWERS)


def _answered(sent: DataFrame) -> str:
    """The folder of the answers to the keys sent, with a folder in it for each part of the chunks."""
    spark = sent.sparkSession
    folder = run_folder(spark, "passage-answers")
    FOLDERS.append(folder)
    sent.groupBy("shard").applyInArrow(_answers, ANSWERS).repartition("part").write.partitionBy("part").parquet(folder)
    drop_finished(spark)
    return folder


class Answers:
    """The answers of all passes so far, those to one part of the chunks at a time."""

    def __init__(self, folders: list[str]):
        self.folders, self.part, self.found = folders, None, {}

    def __call__(self, chunk: int, kind: int) -> list[tuple[int, bytes]]:
        if self.part != chunk >> 33:
            self.part, self.found = chunk >> 33, {}
            for folder in self.folders:
                rows = part_rows(f"{folder}/part={self.part}", ["chunk", "kind", "sent", "bits"])
                for c, k, group, bits in zip(rows["chunk"], rows["kind"], rows["sent"], rows["bits"]):
                    self.found.setdefault((c, k), []).append((group, bits))
        return self.found.get((chunk, kind), [])


class Chunk:
    """A chunk's texts and what the passes so far have found of them."""

    def __init__(self, name: int, rows: pa.Scalar, text_col: str, length: int, shards: int):
        self.name, self.batch, self.length, self.shards = name, unpacked(rows), length, shards
        self.data, self.offsets = text_bytes(self.batch.column(text_col))
        self.runs = window_runs(self.data, self.offsets, length)
        self.firsts = Sent(_digests(window_keys(self.data, self.runs[0], length)), shards)
        # a gram counts once for each place in the text, however many runs share it
        _, at, self.gram = np.unique(self.runs[3], return_index=True, return_inverse=True)
        self.grams = Sent(self.runs[2][at].reshape(-1, 1), shards)

    def settle(self, answers: Answers) -> None:
        self.repeated = self.firsts.told(answers(self.name, FIRSTS))
        again = self.grams.told(answers(self.name, GRAMS))[self.gram]
        self.open, where, self.asks = open_windows(self.runs, self.repeated, again, self.length)
        blocks, self.block = blocks_of(self.open, where)
        asks = np.bincount(self.block, weights=self.asks, minlength=len(blocks)) > 0
        self.blocks = Sent(block_keys(self.data, blocks, self.length).reshape(-1, 1), self.shards, asks)

    def narrow(self, answers: Answers) -> None:
        kept = self.blocks.told(answers(self.name, BLOCKS))[self.block]
        self.open, self.asks = self.open[kept], self.asks[kept]
        self.windows = Sent(_digests(window_keys(self.data, self.open, self.length)), self.shards, self.asks)

    def mask(self, answers: Answers) -> np.ndarray:
        """Which bytes a repeated window covers."""
        starts = np.concatenate([self.runs[0][self.repeated], self.open[self.windows.told(answers(self.name, WINDOWS))]])
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def _with_repeats(docs: DataFrame, text_col: str, length: int, finish, schema) -> DataFrame:
    """Runs the passes and hands each chunk's rows and the mask of repeated bytes to `finish`."""
    chunks = landed(packed(docs, text_col), "passages")
    shards = max(LEAST_SHARDS, chunks.count() // CHUNKS_A_SHARD)

    def each(folders: list[str], make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answers = Answers(folders)
            for batch in batches:
                for name, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from make(Chunk(name, rows, text_col, length, shards), answers)

        return run

    def first(chunk: Chunk, answers: Answers) -> list[pa.RecordBatch]:
        return _table(chunk.firsts.rows(chunk.name, FIRSTS) + chunk.grams.rows(chunk.name, GRAMS), KEYS).to_batches()

    def second(chunk: Chunk, answers: Answers) -> list[pa.RecordBatch]:
        chunk.settle(answers)
        return _table(chunk.blocks.rows(chunk.name, BLOCKS), KEYS).to_batches()

    def third(chunk: Chunk, answers: Answers) -> list[pa.RecordBatch]:
        chunk.settle(answers)
        chunk.narrow(answers)
        return _table(chunk.windows.rows(chunk.name, WINDOWS), KEYS).to_batches()

    def last(chunk: Chunk, answers: Answers) -> list[pa.RecordBatch]:
        chunk.settle(answers)
        chunk.narrow(answers)
        return finish(chunk.batch, chunk.data, chunk.offsets, chunk.mask(answers))

    folders: list[str] = []
    for step in (first, second, third):
        folders = [*folders, _answered(chunks.mapInArrow(each(folders, step), KEYS))]
    return chunks.mapInArrow(each(folders, last), schema)


def repeat_digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row of `docs`.

    Removed is each byte covered by a `length`-byte string that also starts anywhere else in the input. Null texts are empty;
    null ids and repeated rows stay, repeated rows being copies of each other; texts shorter than `length` lose nothing;
    other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(batch, data, offsets, mask):
        removed = np.concatenate([[0], np.cumsum(mask)])
        rises = mask.copy()
        rises[1:] &= ~mask[:-1]
        rises[offsets[:-1][offsets[:-1] < len(mask)]] = mask[offsets[:-1][offsets[:-1] < len(mask)]]
        spans = np.concatenate([[0], np.cumsum(rises)])
        sums = [hashlib.sha256(data[a:b][~mask[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
        return [pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(spans[offsets])),
             pa.array(sums, pa.string())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])]

    return _with_repeats(docs.select(F.col(id_col), F.col(text_col)), text_col, length, finish,
                         f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with repeated passages cut from their texts; all other columns stay as they are.

    A letter of several bytes that is only partly covered stays. A null text stays null; a text all of which is repeated
    becomes empty.
    """
    at = docs.columns.index(text_col)

    def finish(batch, data, offsets, mask):
        keep = ~mask
        # a letter's bytes share the fate of the one that is kept
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead):
            letter = np.searchsorted(lead, np.arange(len(data)), "right") - 1
            keep = np.maximum.reduceat(keep, lead)[np.maximum(letter, 0)]
        texts = [data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
        old = batch.column(at)
        new = pa.array([t if v else None for t, v in zip(texts, old.is_valid().to_pylist())], old.type)
        return [pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)]

    return _with_repeats(docs, text_col, length, finish, docs.schema)
