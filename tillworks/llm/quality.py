"""Quality scores by a factorisation machine.

Features are hashed words with their share of the text, and statistics of its structure and metadata. The machine adds to the
linear part the low-rank interactions of all pairs of features; with the identity
sum over pairs <v_i, v_j> x_i x_j = 1/2 (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) a text is scored in time linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import slabs, small_batches, text_bytes
from tillworks.llm.words import KIND, words_of

BUCKETS = 1 << 15
FACTORS = 4
STATS = 16
#: Labelled rows a model is fitted on at most, chosen by a hash of their id; half of them of each label where there are so many.
SAMPLE = 6000
EPOCHS = 30

def features(data: np.ndarray, offsets: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct hashed words (text, bucket, square root of the share of words) and each text's statistics."""
    n = len(offsets) - 1
    starts, stops, hashes = words_of(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    kind = KIND[data]
    line = data == 10
    same = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    again = np.bincount(owner[1:][same], minlength=n) / some
    key, times = np.unique(owner << 15 | (hashes >> np.uint64(64 - 15)).astype(np.int64), return_counts=True)
    holder = key >> 15
    distinct = np.bincount(holder, minlength=n) / some
    length = np.bincount(owner, weights=stops - starts, minlength=n) / some
    single = np.bincount(owner, weights=(stops - starts) == 1, minlength=n) / some
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    odd_end = np.bincount(owner, weights=KIND[last] == 0, minlength=n) / some
    stats = np.stack([
        np.ones(n), np.log1p(count) / 5, again, distinct, length / 10, single, odd_end,
        share(kind == 0) * 5, share(kind == 2) * 5, share(kind == 4) * 3, share(kind == 16) * 5, share(kind == 1) * 3,
        share(kind == 32), share(line) * 20, np.where(count == 0, 1.0, 0.0),
        np.where(np.isnan(declared), 0.0, np.log1p(np.abs(np.nan_to_num(declared))) / 10)], axis=1)
    return holder, key & (BUCKETS - 1), np.sqrt(times / some[holder]), stats


class Machine:
    """w0 + <w, x> + pairwise interactions, over BUCKETS hashed words followed by STATS statistics."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v = w, v

    @staticmethod
    def fresh(seed: int = 7) -> "Machine":
        rng = np.random.default_rng(seed)
        return Machine(np.zeros(BUCKETS + STATS), rng.normal(0, 0.02, (BUCKETS + STATS, FACTORS)))

    def raw(self, n: int, owner: np.ndarray, bucket: np.ndarray, x: np.ndarray, stats: np.ndarray) -> tuple:
        """The machine's output for n texts and the sums over their features."""
        linear = np.bincount(owner, weights=self.w[bucket] * x, minlength=n) + stats @ self.w[BUCKETS:]
        sums = np.empty((n, FACTORS))
        for f in range(FACTORS):
            sums[:, f] = np.bincount(owner, weights=self.v[bucket, f] * x, minlength=n)
        sums += stats @ self.v[BUCKETS:]
        norm = (self.v**2).sum(1)
        squares = np.bincount(owner, weights=norm[bucket] * x * x, minlength=n) + stats**2 @ norm[BUCKETS:]
        return linear + 0.5 * ((sums**2).sum(1) - squares), sums


def fit(rows: list[tuple], seed: int = 7) -> Machine:
    """Adagrad on the logistic loss. rows: (label, buckets, shares, stats) of each text; without both labels it stays blank."""
    labels = np.array([r[0] for r in rows], np.float64)
    machine = Machine.fresh(seed)
    if len(set(labels)) < 2:
        machine.w[BUCKETS] = 4.0 * (labels.mean() - 0.5) if len(labels) else 0.0
        machine.v[:] = 0
        return machine
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    rng = np.random.default_rng(seed)
    gw, gv = np.full(BUCKETS + STATS, 1e-6), np.full((BUCKETS + STATS, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            sizes = [len(rows[i][1]) for i in part]
            owner = np.repeat(np.arange(len(part)), sizes)
            bucket = np.concatenate([rows[i][1] for i in part]).astype(np.int64)
            x = np.concatenate([rows[i][2] for i in part])
            stats = np.stack([rows[i][3] for i in part])
            raw, sums = machine.raw(len(part), owner, bucket, x, stats)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[part]) * weight[part] / len(part)
            index = np.concatenate([bucket, np.tile(np.arange(BUCKETS, BUCKETS + STATS), len(part))])
            value = np.concatenate([x, stats.ravel()])
            g = np.concatenate([slope[owner], np.repeat(slope, STATS)]) * value
            text = np.concatenate([owner, np.repeat(np.arange(len(part)), STATS)])
            used, back = np.unique(index, return_inverse=True)
            step = np.bincount(back, weights=g) + 1e-5 * machine.w[used]
            gw[used] += step**2
            moved = 0.1 * step / np.sqrt(gw[used])
            steps = []
            for f in range(FACTORS):
                steps.append(np.bincount(back, weights=g * (sums[text, f] - machine.v[index, f] * value))
                             + 1e-4 * machine.v[used, f])
            machine.w[used] -= moved
            for f, own in enumerate(steps):
                gv[used, f] += own**2
                machine.v[used, f] -= 0.05 * own / np.sqrt(gv[used, f])
    return machine


def labelled_sample(labels: DataFrame, label_col: str, keep: Column, size: int, id_col: str = "doc_id") -> DataFrame:
    """id, label: at most `size` labelled rows among those `keep` admits, half of each label, by a hash of the id.

    Rows with a null id or label do not count; a repeated id counts once, with its greatest label."""
    rows = (labels.filter(keep & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label")))
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(size // 2) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars") -> Machine:
    """Fits on the sampled texts; their features reach one task, bounded by SAMPLE rows."""
    small_batches(docs.sparkSession)
    meta = F.col(meta_col).cast("double") if meta_col in docs.columns else F.lit(None).cast("double")
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("declared"))
             .join(F.broadcast(sample), "id").select("label", "text", "declared", "id"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text"):
                data, offsets = text_bytes(piece.column(1))
                declared = piece.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                owner, bucket, x, stats = features(data, offsets, declared)
                ends = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                words, shares = [], []
                for low, high in zip(ends[:-1], ends[1:]):
                    words.append(bucket[low:high].astype("<i4").tobytes())
                    shares.append(x[low:high].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(3).cast(pa.string()), pa.array(words, pa.binary()), pa.array(shares, pa.binary()),
                     pa.array([s.astype("<f8").tobytes() for s in stats], pa.binary())],
                    names=["label", "id", "words", "shares", "stats"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["label"], np.frombuffer(r["words"], "<i4"), np.frombuffer(r["shares"], "<f4").astype(np.float64),
                 np.frombuffer(r["stats"], "<f8")) for b in batches for r in b.to_pylist()]
        machine = fit(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([machine.w.astype("<f8").tobytes()], pa.binary()), pa.array([machine.v.astype("<f8").tobytes()], pa.binary())],
            names=["w", "v"])

    found = (texts.mapInArrow(extract, "label double, id string, words binary, shares binary, stats binary")
             .repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "words").drop("id")
             .mapInArrow(learn, "w binary, v binary").collect())
    if not found:
        return fit([])
    return Machine(np.frombuffer(found[0].w, "<f8"), np.frombuffer(found[0].v, "<f8").reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars") -> DataFrame:
    """id, score (0 to 1), a row for each row of `docs`; null texts count as empty, null ids and repeated rows stay.

    Only the id, the text and the declared length are read; a missing or null length counts as unknown.
    """
    small_batches(docs.sparkSession)
    meta = F.col(meta_col).cast("double") if meta_col in docs.columns else F.lit(None).cast("double")
    w, v = machine.w.astype(np.float64), machine.v.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(w, v)
        for batch in batches:
            for piece in slabs(batch, "text"):
                data, offsets = text_bytes(piece.column(1))
                declared = piece.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                raw = own.raw(piece.num_rows, *features(data, offsets, declared))[0]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), meta.alias("declared"))
            .mapInArrow(run, f"`{id_col}` {kind}, score double"))
