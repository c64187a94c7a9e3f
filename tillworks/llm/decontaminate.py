"""Benchmark passages in texts, found by the q-gram lemma and verified by banded alignment.

An item of L letters that occurs with at most e edits shares at least L - q + 1 - q e of its q-grams with the text, all of them
on neighbouring diagonals (text place less item place). Hits are counted in bands of diagonals that overlap by half, so that
one band holds them all; only bands that reach the bound are aligned. Texts and items are compared in lower case with white
space runs as single blanks.

Items go to the workers in blocks of bounded size, with one pass over the texts for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import SLAB, slabs, small_batches, strings

Q = 8
#: Edits allowed, as a share of the item's letters.
EDIT_SHARE = 0.1
#: Letters of a block of items.
BLOCK_LETTERS = 4 << 20
_ODD = np.random.default_rng(31).integers(0, 2**63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, each followed by a zero, and where each text begins."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q letters from each place on."""
    h, width = codes.astype(np.uint64) * _ODD[3], 1
    while width < Q:
        odd = _ODD[width.bit_length() - 1]
        h = h[:-width] * odd + (h[width:] ^ (h[width:] >> np.uint64(31)))
        width *= 2
    h ^= h >> np.uint64(32)
    h *= _ODD[3]
    return h


class Items:
    """A block of items with an index of their q-grams."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.texts = ids, texts
        size = np.array([len(t) for t in texts], np.int64)
        # an edit budget that leaves at least one q-gram untouched
        self.edits = np.minimum((EDIT_SHARE * size).astype(np.int64), (size - Q) // Q)
        self.need = size - Q + 1 - Q * self.edits
        codes, begins = codes_of(texts)
        h = grams(codes)
        owner = np.searchsorted(begins, np.arange(len(h)), "right") - 1
        inside = np.arange(len(h)) - begins[owner] <= size[owner] - Q
        place = np.flatnonzero(inside)
        order = np.argsort(h[place], kind="stable")
        place = place[order]
        self.item, self.at = owner[place], place - begins[owner[place]]
        self.hash, first = np.unique(h[place], return_index=True)
        self.first = np.append(first, len(place))
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the occurrence with fewest edits, the first of equals, for each text and item."""
        codes, begins = codes_of(texts)
        if len(codes) < Q:
            return []
        h = grams(codes)
        place = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        known = np.searchsorted(self.hash, h[place])
        known[known == len(self.hash)] = 0
        some = self.hash[known] == h[place]
        place, known = place[some], known[some]
        n = self.first[known + 1] - self.first[known]
        entry = np.repeat(self.first[known] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.item[entry], np.repeat(place, n) - self.at[entry]
        width = self.edits[item] + 1
        band = diagonal // width
        # the start of a band may lie before the first letter
        key = (item.astype(np.int64) << 40) + band + (1 << 32)
        found, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        found = found[count >= self.need[found >> 40]]
        best: dict[tuple[int, int], tuple] = {}
        for one, low in zip((found >> 40).tolist(), ((found & ((1 << 40) - 1)) - (1 << 32)).tolist()):
            size, edits = len(self.texts[one]), int(self.edits[one])
            low *= edits + 1
            high = low + 2 * (edits + 1)
            # the texts the band crosses
            for text in range(max(0, int(np.searchsorted(begins, low, "right")) - 1),
                              min(len(texts), int(np.searchsorted(begins, high + size, "left")))):
                base, known_best = int(begins[text]), best.get((text, one))
                if known_best and known_best[0] == 0:
                    continue
                hit = aligned(self.texts[one], texts[text], low - base, high - base, edits)
                if hit and (known_best is None or hit < known_best):
                    best[text, one] = hit
        return [(text, one, *hit) for (text, one), hit in sorted(best.items())]


def aligned(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item in the text on diagonals low to high, or None beyond the budget."""
    begin, end = max(0, low - budget), min(len(text), high + len(item) + budget)
    part = text[begin:end]
    at = part.find(item)
    if at >= 0:
        return 0, begin + at, begin + at + len(item)
    if not budget or end - begin < len(item) - budget or _least_edits(item, part) > budget:
        return None
    return _edit_band(np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4"),
                      np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), low - budget, high + budget, budget)


def _least_edits(item: str, part: str) -> int:
    """Fewest edits that turn the item into some stretch of the part: column differences as bits of two whole numbers."""
    places: dict[str, int] = {}
    for k, letter in enumerate(item):
        places[letter] = places.get(letter, 0) | 1 << k
    full, top = (1 << len(item)) - 1, len(item) - 1
    up, down = full, 0
    now = best = len(item)
    for letter in part:
        same = places.get(letter, 0)
        level = same | down
        carried = (((same & up) + up) ^ up) | same
        more = down | (full & ~(carried | up))
        less = up & carried
        now += (more >> top & 1) - (less >> top & 1)
        if now < best:
            best = now
        more <<= 1
        up = (less << 1 | ~(level | more)) & full
        down = more & level & full
    return best


def _edit_band(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Edit distance of the whole item to any stretch of the text, on diagonals low to high only."""
    width = high - low + 1
    far = len(item) + len(text) + 1
    step = np.arange(width)
    starts = low + step
    cost = np.where((starts >= 0) & (starts <= len(text)), 0, far)
    origin = starts.copy()
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i, letter in enumerate(item):
        # cell k of row i + 1 lies before text place i + 1 + low + k
        place = i + low + step
        there = (place >= 0) & (place < len(text))
        same = there & (padded[np.where(there, place, len(text))] == letter)
        across = np.where(there, cost + ~same, far)
        down = np.append(cost[1:], far) + 1
        take = down < across
        new = np.where(take, down, across)
        from_ = np.where(take, np.append(origin[1:], 0), origin)
        ok = (place + 1 >= 0) & (place + 1 <= len(text))
        new = np.where(ok, new, far)
        run = np.minimum.accumulate((new - step) * np.int64(width + 1) + step)
        source = run % (width + 1)
        cost = np.where(ok, run // (width + 1) + step, far)
        origin = from_[source]
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(origin[k]), len(item) + low + k


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    ids, texts, held = [], [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).toLocalIterator():
        text = normal(r.text)
        if len(text) < Q:
            continue
        ids.append(r.id)
        texts.append(text)
        held += len(text)
        if held > BLOCK_LETTERS:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """id, item_id, edits, start, end: for each text the items it holds within their edit budget, with the place of the best
    occurrence in the normalised text.

    Null and empty texts hold none; items that are null or shorter than Q letters identify nothing and take no part; repeated
    items and texts each give their rows. Other columns are not read. Without items, or texts, the result is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, item_id {kinds[1]}, edits long, start long, end long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(block: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_LETTERS letters and their index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slabs(batch, "text", SLAB // 2):
                    own = sent.value
                    hits = own.find([normal(t) for t in strings(piece.column(1))])
                    columns = list(zip(*hits)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(columns[0], pa.int64())), pa.array([own.ids[k] for k in columns[1]], pa.int64()),
                         *(pa.array(c, pa.int64()) for c in columns[2:])], names=[id_col, "item_id", "edits", "start", "end"])

        return rows.mapInArrow(run, schema)

    parts = [scan(block) for block in _blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slabs(batch, text_col, SLAB // 2):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[hit[0] for hit in sent.value.find([normal(t) for t in strings(piece.column(at))])]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
