"""Toxicity by a subsequence string kernel machine with Nyström landmarks.

The kernel of two strings sums over all sequences of ORDER letters that both hold in order, each occurrence counting GAP to the
power of the letters it skips (within a stretch of at most REACH), so insults with gaps or inserted characters still match. A
support-vector machine is trained on sentences in the space of the kernel's values at landmark words (Nyström). The kernel
being an inner product over letter sequences, the machine folds into one weight per sequence, and a text is scored in one
vectorised pass. A sentence is as toxic as its worst phrase, a phrase being a word, or a run of words of fewer than ORDER
letters, with whatever sequences reach out of it; a text is as toxic as its worst sentence, calibrated on the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import slabs, small_batches, text_bytes

ORDER = 4
REACH = 7
GAP = 0.6
LANDMARKS = 192
ROUNDS = 4
#: Labelled texts the machine is trained on at most, half of each label where there are so many.
SAMPLE = 4000
#: Clean phrases of these texts, drawn at random, that each round of training uses beside the worst phrase of every text.
CLEAN_PHRASES = 3000
#: Bytes of a phrase at most; longer ones go in pieces, and no sequence across a cut is lost.
LONGEST = 64
_PAD = REACH + 1
_SHIFTS = [(0, *c) for c in combinations(range(1, REACH), ORDER - 1)]

# letter codes: 1 to 26 for a-z, 27 to 31 for other scripts' bytes, 0 for what is no letter
_CODE = np.zeros(256, np.int32)
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 5
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes with a gap after each text, wider than any sequence; the first position and the text of each phrase."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    where = np.arange(len(data)) + _PAD * owner
    codes = np.zeros(len(data) + _PAD * n, np.int32)
    codes[where] = _CODE[data]
    begins = np.zeros(len(data), bool)
    if len(data):
        blank = _BLANK[data]
        edge = np.zeros(len(data), bool)
        edge[offsets[:-1][np.diff(offsets) > 0]] = True
        words = np.flatnonzero((~blank & np.append(True, blank[:-1])) | edge)
        letters = np.add.reduceat((_CODE[data] > 0).astype(np.int64), words)
        long = letters >= ORDER
        unit = words[long | np.append(True, long[:-1]) | edge[words]]
        sizes = np.diff(np.append(unit, len(data)))
        over = sizes > LONGEST
        cuts = [s + np.arange(0, z, LONGEST) for s, z in zip(unit[over], sizes[over])]
        begins[np.concatenate([unit, *cuts])] = True
    starts = np.flatnonzero(begins)
    return codes, where[starts] if len(starts) else starts, owner[starts] if len(starts) else starts


def sequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of gaps: the index of the sequence that begins at each position, and its weight."""
    n = len(codes) - REACH
    for shifts in _SHIFTS:
        index = codes[:n]
        for s in shifts[1:]:
            index = index << 5 | codes[s: s + n]
        holes = codes[:n] > 0
        for s in shifts[1:]:
            holes &= codes[s: s + n] > 0
        yield np.where(holes, index, 0), GAP ** (shifts[-1] + 1 - ORDER)


def phrase_sums(codes: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kernel machine's sum of each phrase. The table is 0 wherever a code is 0."""
    if not len(starts):
        return np.zeros(0)
    n = len(codes) - REACH
    total = np.zeros(len(codes), np.float32)
    for shifts in _SHIFTS:
        index = codes[:n]
        for s in shifts[1:]:
            index = index << 5 | codes[s: s + n]
        total[:n] += table[index] * np.float32(GAP ** (shifts[-1] + 1 - ORDER))
    return np.add.reduceat(total, starts, dtype=np.float64)


class KernelMachine:
    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.index, self.weight, self.bias, self.slope, self.shift = index, weight, bias, slope, shift
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(1 << (5 * ORDER), np.float32)
            self._table[self.index] = self.weight
        return self._table

    def worst(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest phrase value of each text; a text without phrases has the bias alone."""
        codes, starts, owner = spread(data, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        if len(starts):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[first]] = np.maximum.reduceat(phrase_sums(codes, starts, self.table()), first) + self.bias
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(data, offsets) + self.shift, -30, 30)))


def _landmark_words(texts: list[bytes], labels: np.ndarray) -> tuple[list[bytes], dict[bytes, float]]:
    """Words most typical of either label, by smoothed log-odds over texts, three quarters of them of the toxic one."""
    seen: dict[bytes, list[int]] = {}
    for text, label in zip(texts, labels):
        for word in set(text.lower().split()):
            seen.setdefault(word.strip(b".,;:!?'\"()-|"), [0, 0])[int(label)] += 1
    n = np.bincount(labels.astype(int), minlength=2) + 2.0
    odds = {w: np.log((b + 0.5) / n[1]) - np.log((a + 0.5) / n[0]) for w, (a, b) in seen.items() if len(w) >= ORDER}
    ranked = sorted(odds, key=lambda w: (-odds[w], w))
    k = LANDMARKS * 3 // 4
    common = sorted((w for w in odds if odds[w] < 0), key=lambda w: (-seen[w][0], w))[: LANDMARKS - k]
    return list(dict.fromkeys(ranked[:k] + common)), odds


def _svm(z: np.ndarray, y: np.ndarray, cost: float = 100.0) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps; the classes weigh the same."""
    x = np.hstack([z, np.ones((len(z), 1))])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y) / 100
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        able = y * (x @ w) < 1
        xa = x[able] * c[able, None]
        new = np.linalg.solve(ridge + x[able].T @ xa, xa.T @ y[able])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(texts: list[bytes], labels: np.ndarray) -> KernelMachine:
    """Trains on the phrases of labelled texts' sentences. All phrases of a clean text are clean, and
    CLEAN_PHRASES of them are trained on besides the worst one of each text; of a toxic text the one that looks worst so far is
    toxic, first by its words, then by the machine of the round before. With one label only, or none, the
    machine knows no sequence and leans to that label."""
    none = np.zeros(0, np.int64), np.zeros(0, np.float32)
    if len(set(labels.tolist())) < 2:
        return KernelMachine(*none, 0.0, 0.0, 4.0 * (float(labels.mean()) - 0.5) if len(labels) else -2.0)
    words, odds = _landmark_words(texts, labels)
    marks, mark_starts, mark_owner = spread(*_joined(words))
    rows = [(np.searchsorted(mark_starts, np.flatnonzero(i), "right") - 1, i[i > 0], w) for i, w in sequences(marks)]
    known = np.unique(np.concatenate([i for _, i, _ in rows]))
    if not len(known):
        return KernelMachine(*none, 0.0, 0.0, -2.0)
    column = np.full(1 << (5 * ORDER), -1, np.int32)
    column[known] = np.arange(len(known))
    land = np.zeros((len(words), len(known)), np.float32)
    for sentence, index, w in rows:
        np.add.at(land, (mark_owner[sentence], column[index]), np.float32(w))
    land /= np.maximum(np.linalg.norm(land, axis=1, keepdims=True), 1e-6)
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    half = vectors / np.sqrt(np.maximum(values, 1e-3))

    data, offsets = _joined(texts)
    codes, starts, owner = spread(data, offsets)
    ends = np.append(starts[1:], len(codes))
    toxic = labels[owner] == 1
    tops = np.array([max((odds.get(w.strip(b".,;:!?'\"()-|"), 0.0) for w in _span(data, offsets, owner[k], starts[k], ends[k])),
                         default=0.0) if toxic[k] else 0.0 for k in range(len(starts))])
    rng = np.random.default_rng(3)
    clean = np.flatnonzero(~toxic)
    some = rng.permutation(clean)[:CLEAN_PHRASES]
    worst = tops
    for _ in range(ROUNDS):
        best = np.lexsort((-worst, owner))
        first = best[np.append(True, owner[best][1:] != owner[best][:-1])]
        chosen = np.unique(np.concatenate([first, some]))
        y = np.where(toxic[chosen], 1.0, -1.0)
        z = _features(codes, starts, ends, chosen, column, land) @ half
        w, bias = _svm(z, y)
        weight = ((half @ w) @ land).astype(np.float32)
        machine = KernelMachine(known, weight, bias, 1.0, 0.0)
        worst = phrase_sums(codes, starts, machine.table())
    raw = machine.worst(data, offsets)
    machine.slope, machine.shift = _calibrated(raw, labels)
    return machine


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _span(data: np.ndarray, offsets: np.ndarray, owner: int, start: int, end: int) -> list[bytes]:
    low = start - _PAD * owner
    return data[low: min(end - _PAD * owner, offsets[owner + 1])].tobytes().lower().split()


def _features(codes, starts, ends, chosen, column, land) -> np.ndarray:
    """Kernel values of the chosen phrases at the landmarks."""
    out = np.empty((len(chosen), len(land)))
    for low in range(0, len(chosen), 200):
        part = chosen[low: low + 200]
        sizes = ends[part] - starts[part]
        row = np.repeat(np.arange(len(part)), sizes)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[part], sizes)
        held = np.zeros((len(part), land.shape[1]), np.float32)
        padded = np.append(codes, np.zeros(REACH, np.int32))
        for shifts in _SHIFTS:
            index = padded[at]
            some = index > 0
            for s in shifts[1:]:
                letter = padded[at + s]
                some &= letter > 0
                index = index << 5 | letter
            c = column[index]
            some &= c >= 0
            flat = row[some] * np.int64(land.shape[1]) + c[some]
            found, n = np.unique(flat, return_counts=True)
            held.ravel()[found] += n * np.float32(GAP ** (shifts[-1] + 1 - ORDER))
        out[low: low + 200] = held @ land.T
    return out


def _calibrated(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the training texts' values, by Newton steps with a ridge."""
    x = np.stack([raw, np.ones(len(raw))], 1)
    y = np.where(labels == 1, 1 - 1 / (2 + (labels == 1).sum()), 1 / (2 + (labels == 0).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KernelMachine:
    """Trains on the sampled texts (id, label), which one task holds, bounded by SAMPLE rows."""
    small_batches(docs.sparkSession)
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
             .select("id", "label", "text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t.encode() if t else b"", v) for b in batches
                for v, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        m = fit([t for t, _ in rows], np.array([v for _, v in rows], np.float64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.index.astype("<i8").tobytes()], pa.binary()), pa.array([m.weight.astype("<f4").tobytes()], pa.binary()),
             pa.array([m.bias]), pa.array([m.slope]), pa.array([m.shift])], names=["i", "w", "bias", "slope", "shift"])

    found = (texts.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "label", "text").select("label", "text")
             .mapInArrow(learn, "i binary, w binary, bias double, slope double, shift double").collect())
    if not found:
        return fit([], np.zeros(0))
    r = found[0]
    return KernelMachine(np.frombuffer(r.i, "<i8"), np.frombuffer(r.w, "<f4"), r.bias, r.slope, r.shift)


def score(docs: DataFrame, machine: KernelMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), a row for each row of `docs`; null texts count as empty, null ids and repeated rows stay. Other
    columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(machine.scores(*text_bytes(piece.column(1))))],
                                                 names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"`{id_col}` {kind}, score double"))


def keep_below(docs: DataFrame, machine: KernelMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores below the threshold, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, text_col):
                yield piece.filter(pa.array(machine.scores(*text_bytes(piece.column(at))) < threshold))

    return docs.mapInArrow(run, docs.schema)
