"""Ranked lexical search over posting lists with range-maximum tables.

A posting list holds the impacts of one term in document order, with a sparse table that gives the greatest impact of any stretch
of it in two look-ups. The score of no document in an interval exceeds the sum of its terms' greatest impacts there. Intervals of
documents are taken best bound first; each is split at the document with the greatest impact, which is scored exactly, and small
ones are scored whole. The search of an item ends when no interval left can hold a document better than its k-th.

Documents are indexed in shards that fit a worker; postings are kept for the terms of the items asked only, and the k best of a
task's earlier shards are the mark that later ones have to beat. Each task then sends k rows for each item, whatever its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillworks.llm.common import landed, slabs, small_batches, text_bytes
from tillworks.llm.words import word_hashes

#: Fixed values of the impact formula.
SCALE, WEIGHT, LENGTH_BASE, LENGTH_SHARE, SATURATION = 1_000_000_000, 1000, 75, 25, 12
#: Items answered in one pass over the postings, and documents and postings of an index shard.
ITEMS = 5000
SHARD_DOCS, SHARD_POSTINGS = 65_536, 4_000_000
#: Intervals of at most LEAF documents are scored whole; a round takes the best STEP intervals of each item.
LEAF, STEP = 24, 16
_LAST = np.iinfo(np.int64).max
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and 64-bit hash of the terms: runs of digits, letters and characters beyond ASCII, A-Z as a-z."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    other = ~_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~other & (edge[:-1] | np.concatenate([[True], other[:-1]])))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    stops = np.flatnonzero(~other & (edge[1:] | np.concatenate([other[1:], [True]]))) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    return np.searchsorted(offsets, starts, "right") - 1, word_hashes(lower, other, starts, stops)


class Items:
    """A block of items: their distinct terms, and for each item its terms with how often it has them."""

    def __init__(self, ids: list, texts: list):
        joined = pa.array([t or "" for t in texts], pa.large_string())
        owner, hashes = terms_of(*text_bytes(joined))
        self.ids = ids
        self.hashes, term = np.unique(hashes, return_inverse=True)
        pairs, count = np.unique(owner * max(1, len(self.hashes)) + term, return_counts=True)
        self.term, self.times = pairs % max(1, len(self.hashes)), count
        self.begin = np.searchsorted(pairs // max(1, len(self.hashes)), np.arange(len(ids) + 1))


class Shard:
    """Posting lists of some documents with their range-maximum tables."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs = n_docs
        self.doc, self.impact = doc[order].astype(np.int64), impact[order]
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.place = term[order].astype(np.int64) * n_docs + self.doc
        # level k holds the place of the greatest of the 2 ** k impacts from each place on; longer stretches than a list are not asked for
        longest = int(np.diff(self.begin).max()) if len(doc) else 0
        self.tables = [np.arange(len(order), dtype=np.int32)]
        while 2 << (len(self.tables) - 1) <= longest:
            last, step = self.tables[-1], 1 << (len(self.tables) - 1)
            later = last[step:]
            earlier = last[: len(later)]
            grown = last.copy()
            grown[: len(later)] = np.where(self.impact[later] > self.impact[earlier], later, earlier)
            self.tables.append(grown)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the greatest impact in [low, high) of the postings, the first of equals; -1 for an empty stretch."""
        out = np.full(len(low), -1, np.int64)
        some = np.flatnonzero(high > low)
        if not len(some):
            return out
        low, high = low[some], high[some]
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(some), np.int64)
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            a, b = self.tables[k][low[here]], self.tables[k][high[here] - (1 << k)]
            found[here] = np.where(self.impact[b] > self.impact[a], b, a)
        out[some] = found
        return out

    def find(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where in the list of a term the documents from `doc` on begin."""
        return np.searchsorted(self.place, term * self.n_docs + doc)


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [low, high) and the range each is from."""
    sizes = high - low
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + low[owner], owner


class Best:
    """The k best documents of each item so far: greatest score, then smallest key."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.key = (np.zeros(0, np.int64) for _ in range(3))
        self.mark = np.zeros(items, np.int64)  # score to reach
        self.edge = np.full(items, _LAST)  # greatest key that still counts at that score

    def add(self, item: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        good = (score > self.mark[item]) | ((score == self.mark[item]) & (key < self.edge[item]) & (score > 0))
        if not good.any():
            return
        item, score, key = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.key, key)))
        order = np.lexsort((key, -score, item))
        item, score, key = item[order], score[order], key[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        self.item, self.score, self.key = item[keep], score[keep], key[keep]
        full = rank == self.k - 1
        self.mark[item[full]], self.edge[item[full]] = score[full], key[full]


def search(shard: Shard, items: Items, best: Best, keys: np.ndarray) -> None:
    """Takes the documents of a shard into `best`; keys[d] is the key of document d, rising with d."""
    n = len(items.ids)
    item, low, high = np.arange(n), np.zeros(n, np.int64), np.full(n, shard.n_docs)

    def spread(item):
        pair, row = _ranges(items.begin[item], items.begin[item + 1])
        return items.term[pair], items.times[pair], row

    def bounds(item, low, high):
        """For each interval the bound of its scores and the document that contributes the greatest part."""
        term, times, row = spread(item)
        top = shard.greatest(shard.find(term, low[row]), shard.find(term, high[row]))
        value = np.where(top >= 0, shard.impact[top] * times, 0) if len(shard.impact) else np.zeros(len(top), np.int64)
        bound = np.zeros(len(item), np.int64)
        np.add.at(bound, row, value)
        split = low.copy()
        order = np.lexsort((value, row))
        last = order[np.flatnonzero(np.diff(row, append=len(item)))]
        split[row[last]] = np.where(value[last] > 0, shard.doc[top[last]] if len(shard.doc) else 0, low[row[last]])
        return bound, split

    bound, split = bounds(item, low, high)
    while True:
        live = (bound > best.mark[item]) | ((bound == best.mark[item]) & (bound > 0) & (keys[np.minimum(low, shard.n_docs - 1)] < best.edge[item]))
        item, low, high, bound, split = (x[live] for x in (item, low, high, bound, split))
        if not len(item):
            return
        order = np.lexsort((-bound, item))
        first = np.arange(len(order)) - np.searchsorted(item[order], item[order]) < STEP
        now, later = order[first], order[~first]
        i, a, b, s = item[now], low[now], high[now], split[now]
        whole = b - a <= LEAF
        # the documents to score now: all of small intervals, and the one that splits each of the others
        one, two = np.where(whole, a, s), np.where(whole, b, s + 1)
        term, times, row = spread(i)
        place, pair = _ranges(shard.find(term, one[row]), shard.find(term, two[row]))
        width = max(LEAF, 1)
        sums = np.zeros(len(i) * width, np.int64)
        slot = row[pair] * width + shard.doc[place] - one[row[pair]]
        np.add.at(sums, slot, shard.impact[place] * times[pair])
        hit = np.flatnonzero(sums)
        best.add(i[hit // width], sums[hit], keys[one[hit // width] + hit % width])
        i, a, b, s = (x[~whole] for x in (i, a, b, s))
        new_item, new_low, new_high = np.concatenate([i, i]), np.concatenate([a, s + 1]), np.concatenate([s, b])
        some = new_high > new_low
        new_item, new_low, new_high = new_item[some], new_low[some], new_high[some]
        new_bound, new_split = bounds(new_item, new_low, new_high)
        item, low, high, bound, split = (np.concatenate([x[later], y]) for x, y in (
            (item, new_item), (low, new_low), (high, new_high), (bound, new_bound), (split, new_split)))


def _postings(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """For each slab of texts its documents with at least one term (ids, numbers of terms) and their postings of the given terms:
    term numbers, documents by place and occurrences, all packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text"):
                owner, found = terms_of(*text_bytes(piece.column(1)))
                n = np.bincount(owner, minlength=piece.num_rows)
                there = np.flatnonzero(n)
                at = np.minimum(np.searchsorted(hashes, found), max(0, len(hashes) - 1))
                known = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
                pair, tf = np.unique(np.searchsorted(there, owner[known]) * max(1, len(hashes)) + at[known], return_counts=True)
                ids = piece.column(0).take(pa.array(there))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([n[there].astype("<i8").tobytes()], pa.binary()),
                     pa.array([(pair % max(1, len(hashes))).astype("<i4").tobytes()], pa.binary()),
                     pa.array([(pair // max(1, len(hashes))).astype("<i4").tobytes()], pa.binary()),
                     pa.array([tf.astype("<i4").tobytes()], pa.binary()),
                     pa.array([len(there)], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                    names=["ids", "sizes", "term", "doc", "tf", "docs", "terms"])

    return docs.mapInArrow(run, "ids array<long>, sizes binary, term binary, doc binary, tf binary, docs long, terms long")


def _frequencies(postings: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_buffer(), "<i4"), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["term", "n"])

    # one row for each term of a block of items at most
    found = postings.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def _lengths(sizes: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with so many terms; in numbers of any size where 64 bits would not do."""
    if len(sizes) and LENGTH_SHARE * int(sizes.max()) * docs >= 2**63:
        return np.array([LENGTH_BASE + LENGTH_SHARE * int(n) * docs // terms for n in sizes], np.int64)
    return LENGTH_BASE + LENGTH_SHARE * sizes * docs // max(1, terms)


def _top(postings: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its number in the block), key (the id, nulls as the greatest), score: at most k for each item and task."""
    count = postings.agg(F.sum("docs"), F.sum("terms")).first()
    n, total = count[0] or 0, count[1] or 0
    df = _frequencies(postings, len(items.hashes))
    weight = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        held, postings_held = [], 0

        def flush() -> None:
            ids = np.concatenate([h[0] for h in held])
            m = _lengths(np.concatenate([h[1] for h in held]), n, total)
            shift = np.cumsum([0, *(len(h[0]) for h in held)])
            term = np.concatenate([h[2] for h in held]).astype(np.int64)
            doc = np.concatenate([h[3] + s for h, s in zip(held, shift)]).astype(np.int64)
            tf = np.concatenate([h[4] for h in held]).astype(np.int64)
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            impact = weight[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
            if len(ids) and len(term):
                search(Shard(term, rank[doc], impact, len(items.hashes), len(ids)), items, best, ids[order])

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.array([_LAST if x is None else x for x in r["ids"]], np.int64)
                held.append((ids, np.frombuffer(r["sizes"], "<i8"), *(np.frombuffer(r[c], "<i4") for c in ("term", "doc", "tf"))))
                postings_held += len(held[-1][2])
                if sum(len(h[0]) for h in held) >= SHARD_DOCS or postings_held >= SHARD_POSTINGS:
                    flush()
                    held, postings_held = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array(best.key, pa.int64()), pa.array(best.score, pa.int64())],
                                         names=["item", "key", "score"])

    return postings.select("ids", "sizes", "term", "doc", "tf").mapInArrow(run, "item long, key long, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item, rank (from 1), id, score: the k documents with the highest score above 0 for each row of `items`, all if fewer.

    Equal scores go by ascending id, nulls last; rows with the same id are documents of their own. A null or empty text has no
    term: such a document is not counted and never found, such an item finds nothing, and rows of `items` with the same id are
    answered each. Texts are read whole, a long one as a slab of its own. Ids of documents must be whole numbers (the greatest
    64-bit one counts as null). Items are taken in blocks of ITEMS, each a pass over all documents. Other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = items.schema[item_col].dataType
    out = spark.createDataFrame([], T.StructType([
        T.StructField(item_col, kind), T.StructField("rank", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("score", T.LongType())]))

    def answered(block: list) -> DataFrame:
        asked = Items([r[0] for r in block], [r[1] for r in block])
        postings = landed(_postings(texts, asked.hashes), "search-postings")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("key"))
        top = _top(postings, asked, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(asked.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField(item_col, kind)]))
        key = F.when(F.col("key") != _LAST, F.col("key")).cast(docs.schema[id_col].dataType)
        return top.join(names, "item").select(item_col, "rank", key.alias(id_col), "score")

    block: list = []
    for row in items.select(F.col(f"`{item_col}`"), F.col(f"`{item_text_col}`")).toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            out, block = out.unionByName(answered(block)), []
    return out.unionByName(answered(block)) if block else out
