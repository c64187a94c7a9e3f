"""Near-duplicates by order MinHash and banded alignment.

A text is the sequence of its overlapping five-word shingles (words between white space, case of A-Z aside; a text of fewer
words is one shingle). Two texts are near-duplicates if m / (a + b - m) >= 0.8, where a and b are their numbers of shingles
and m the length of the longest common subsequence of shingles: a Jaccard similarity that respects order.

Candidates: each shingle is labelled with its occurrence number, and each of SKETCHES hashes keeps the TAKE smallest labelled
shingles in text order; texts that agree in a whole sketch meet. With similarity s that happens for one sketch with a
probability of about s ** TAKE, so of pairs at the threshold fewer than one in a million meet nowhere. Pairs are verified by a
common-subsequence alignment kept to the band of diagonals that the threshold allows.

Classes are the connected components of all verified links, exact copies included. A bucket is not paired out: its members are
first aligned with hubs. Texts that share a bucket with another class after that meet again by their rarest shingles: of two
texts with s >= 0.8 one of the rarest fifth of shingles of each is shared, so texts that have only a common passage, however
frequent, part here, and no link is lost. Again hubs go first, and only texts still in different classes are then compared, and
only if the outlines of their shingles differ in no more bits than those of similar texts can.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import SLAB, landed, mix64, slabs, small_batches, text_bytes
from tillworks.llm.words import words_of

WORDS = 5
SKETCHES = 20
TAKE = 3
SIMILAR = 0.8
_SEEDS = np.random.default_rng(43).integers(0, 2**63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LABEL = np.uint64(0xC2B2AE3D27D4EB4F)
#: Rounds in which the texts of a rare shingle are aligned with one hub, the first in a new random order each time.
ROUNDS = 4
#: Size of the table of shingle frequencies, as a power of two.
SLOT_BITS = 20
#: Shingles up to which all sketches of a text are drawn at once.
AT_ONCE = 50_000
#: 64-bit words of the outline of a text.
OUTLINE = 8


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts in order, and where each text's begin. A text without words has none."""
    n = len(offsets) - 1
    starts, _, hashes = words_of(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    h = np.zeros(len(hashes), np.uint64)
    left = (first + count)[owner] - np.arange(len(hashes))  # words from here to the end of the text
    for k in range(WORDS):
        here = np.flatnonzero(left > k)
        h[here] = h[here] * _MIX + hashes[here + k]
    keep = (left >= WORDS) | (np.arange(len(hashes)) == first[owner])
    sizes = np.where(count > 0, np.maximum(count - WORDS + 1, 1), 0)
    return mix64(h[keep]), np.concatenate([[0], np.cumsum(sizes)])


def occurrences(s: np.ndarray) -> np.ndarray:
    """The shingles with their occurrence number mixed in, so that equal shingles of a text differ."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    labelled = np.empty(len(s), np.uint64)
    labelled[order] = mix64(ranked + (np.arange(len(s)) - begin).astype(np.uint64) * _LABEL)
    return labelled


def outline(labelled: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * OUTLINE groups of labelled shingles: whether the text has an odd number of them. The outlines of two
    texts differ in at most as many bits as there are shingles that only one of them has."""
    odd = np.bincount((labelled >> np.uint64(8)).astype(np.int64) % (64 * OUTLINE), minlength=64 * OUTLINE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(s: np.ndarray) -> np.ndarray:
    """The hash of each sketch of a text with the shingles s."""
    labelled = occurrences(s)
    take = min(TAKE, len(s))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, AT_ONCE * SKETCHES // max(1, len(s)))
    for low in range(0, SKETCHES, min(step, SKETCHES)):
        seeds = _SEEDS[low: low + min(step, SKETCHES)]
        drawn = labelled[None, :] * seeds[:, None]
        rows = np.arange(len(seeds))
        places = np.empty((len(seeds), take), np.int64)
        for k in range(take):
            places[:, k] = drawn.argmin(1)
            drawn[rows, places[:, k]] = np.iinfo(np.uint64).max
        places.sort(1)
        h = np.zeros(len(seeds), np.uint64)
        for k in range(take):
            h = h * _MIX + labelled[places[:, k]]
        out[low: low + len(seeds)] = mix64(h + seeds)
    return out


def common_subsequence(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence, on diagonals within the band; the rows are bits of whole numbers."""
    places: dict[int, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    width = 2 * band + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    row, gone = full, 0
    for j, c in enumerate(y):
        if j:
            gone += not row & 1
            row = row >> 1 | top
        hits = places.get(c, 0)
        if hits:
            low = j - band
            hits = (hits >> low if low >= 0 else hits << -low) & full
            if hits:
                met = row & hits
                row = ((row + met) | (row - met)) & full
    return gone + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, at_least: float = SIMILAR) -> float:
    """m / (a + b - m) where it reaches `at_least`; else 0 or a lower bound of it."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < at_least * max(n, m):
        return 0.0
    short = min(n, m)
    same = a[:short] == b[:short]
    head = short if same.all() else int(same.argmin())
    left = short - head
    same = a[n - left:][::-1] == b[m - left:][::-1]
    tail = left if same.all() else int(same.argmin())
    x, y = a[head: n - tail], b[head: m - tail]
    matched = head + tail
    if len(x) and len(y):
        ids = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
        x, y = ids[: len(x)], ids[len(x):]
        most = int(np.minimum(np.bincount(x, minlength=ids.max() + 1), np.bincount(y, minlength=ids.max() + 1)).sum()) + matched
        if most < at_least * (n + m - most):
            return 0.0
        # unmatched shingles of similar texts, and so the diagonals an alignment can stray
        band = int((n + m) * (1 - at_least) / (1 + at_least)) + 1
        matched += common_subsequence(x.tolist(), y.tolist(), min(band, max(len(x), len(y))))
    return matched / (n + m - matched)


def _fresh(names: list[str], name: str) -> str:
    while name.lower() in (n.lower() for n in names):
        name = f"_{name}"
    return name


def _sketched(rows: DataFrame) -> DataFrame:
    """row, id, k1, k2 (the text), bands: a row for each text. A text without words has no bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text", SLAB // 2):
                data, offsets = text_bytes(piece.column(2))
                s, ends = shingles(data, offsets)
                view = memoryview(np.ascontiguousarray(data))
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])),
                                     np.int64).reshape(-1, 2)
                bands = [sketches(s[a:b]).view(np.int64) if b > a else [] for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "id", "k1", "k2", "bands"])

    return rows.mapInArrow(run, f"row long, id {rows.schema['id'].dataType.simpleString()}, k1 long, k2 long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: the pairs whose texts (row, text) are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            sizes = [text_bytes(batch.column(k))[1] for k in (2, 3)]
            weight = sizes[0] + sizes[1]
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(weight, weight[low] + SLAB, "right")) - 1)
                part = batch.slice(low, high - low)
                (x, xs), (y, ys) = (shingles(*text_bytes(part.column(k))) for k in (2, 3))
                good = [similarity(x[a:b], y[c:d]) >= SIMILAR for a, b, c, d in zip(xs[:-1], xs[1:], ys[:-1], ys[1:])]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))
                low = high

    one = texts.select(F.col("row").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("row").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of the links (a, b), by repeated minimum over neighbours
    and over the label's own label; every round is written out."""
    both = landed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "links")
    labels = landed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n"))
                    .select("node", F.least("node", "n").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = met.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = landed(met.join(own, "label", "left").select("node", "old", F.coalesce("up", "label").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.filter(F.col("label") != F.col("old")).limit(1).count() == 0:
            return labels


def _slot(labelled: np.ndarray) -> np.ndarray:
    return (labelled >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How often shingles occur, in a table of fixed size; it only settles which shingles count as rare."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for piece in slabs(batch, "text", SLAB // 2):
                s, ends = shingles(*text_bytes(piece.column(0)))
                for a, b in zip(ends[:-1], ends[1:]):
                    np.add.at(total, _slot(occurrences(s[a:b])), 1)
        used = np.flatnonzero(total)
        for low in range(0, len(used), 100_000):
            part = used[low: low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    found = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << SLOT_BITS, np.int32)
    total[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**31 - 1)
    return total


def _rarest(texts: DataFrame, frequency: np.ndarray) -> DataFrame:
    """row, token, at, n, outline: of each text of n shingles the rarest, so many that similar texts share one, with their rank;
    the outline stands beside the first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text", SLAB // 2):
                s, ends = shingles(*text_bytes(piece.column(1)))
                for row, a, b in zip(piece.column(0).to_pylist(), ends[:-1], ends[1:]):
                    labelled = occurrences(s[a:b])
                    n = len(labelled)
                    keep = n - math.ceil(SIMILAR * n - 1e-9) + 1 if n else 0
                    first = labelled[np.lexsort((labelled, frequency[_slot(labelled)]))][:keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(keep, row)), pa.array(first.view(np.int64)), pa.array(np.arange(keep)),
                         pa.array(np.full(keep, n)), pa.array([outline(labelled)] + [None] * (keep - 1) if keep else [], pa.list_(pa.int64()))],
                        names=["row", "token", "at", "n", "outline"])

    return texts.select("row", "text").mapInArrow(run, "row long, token long, at long, n long, outline array<long>")


def _mixed(members: DataFrame, key: str) -> DataFrame:
    """The members (with a label) of keys that hold more than one label."""
    keys = (members.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"))
            .filter(F.col("low") != F.col("high")).select(key))
    return members.join(keys, key, "left_semi")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))


def _can_be_first(na: str, ia: str, nb: str, ib: str) -> Column:
    """Whether texts of na and nb shingles can be similar and the shingles ranked ia and ib, which are equal, be the first rare
    ones they share: lengths fit, enough shingles follow, and of the shorter text only the rarest ninth comes first."""
    na, ia, nb, ib = (F.col(c) for c in (na, ia, nb, ib))
    short, at = F.least(na, nb), F.when(na <= nb, ia).otherwise(ib)
    share = 2 * SIMILAR / (1 + SIMILAR)
    return ((short >= SIMILAR * F.greatest(na, nb) - 1e-6)
            & (F.least(na - ia, nb - ib) * (1 + SIMILAR) >= SIMILAR * (na + nb) - 1e-6)
            & (at < short - F.ceil(share * short - 1e-6) + 1))


def _alike(na: str, oa: str, nb: str, ob: str) -> Column:
    """Whether outlines differ in no more bits than those of similar texts of na and nb shingles can."""
    differing = sum((F.bit_count(F.col(oa)[k].bitwiseXOR(F.col(ob)[k])) for k in range(OUTLINE)), F.lit(0))
    return differing * (1 + SIMILAR) <= (F.col(na) + F.col(nb)) * (1 - SIMILAR) + 1e-6


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (a, b), the greater row first, without those already aligned."""
    def ordered(df):
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    return ordered(pairs).distinct().join(ordered(tested), ["a", "b"], "left_anti")


def _grown(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """The labels with more links (a, b) taken in: only the classes that the links join are worked through again."""
    if labels is None:
        return components(more)
    if more.isEmpty():
        return labels
    ends = more.select(F.col("a").alias("node")).union(more.select(F.col("b").alias("node"))).distinct()
    whole = landed(labels.join(ends, "node", "full").select("node", F.coalesce("label", "node").alias("label")), "labels")
    one = whole.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = whole.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = (more.join(one, "a").join(two, "b").filter(F.col("la") != F.col("lb"))
              .select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    merged = components(joined).select(F.col("node").alias("label"), F.col("label").alias("up"))
    return landed(whole.join(merged, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def classes(rows: DataFrame) -> DataFrame:
    """row, class (the row that stands for its class) of rows (row long, id, text); the row with the smallest id stands, null
    ids last, then the smallest row."""
    sketched = landed(_sketched(rows), "sketches")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    forms = landed(sketched.groupBy("k1", "k2").agg(F.min(order).alias("o"), F.first("bands").alias("bands"))
                   .select("k1", "k2", F.col("o.row").alias("row"), "bands"), "forms")
    members = forms.select("row", F.posexplode("bands").alias("sketch", "band"))
    # a hub by a random order that is the same in all buckets, so that a text has few different hubs
    rank = F.struct(F.xxhash64("row").alias("rank"), "row")
    hubs = members.groupBy("sketch", "band").agg(F.min(rank).alias("hub"), F.count("*").alias("n")).filter(F.col("n") > 1)
    met = landed(members.join(hubs.select("sketch", "band", F.col("hub.row").alias("hub")), ["sketch", "band"])
                 .select("row", F.xxhash64("sketch", "band").alias("bucket"), "hub"), "buckets")
    texts = landed(rows.select("row", "text").join(met.select("row").distinct(), "row", "left_semi"), "candidate-texts")
    stars = met.filter(F.col("row") != F.col("hub")).groupBy("row", "hub").agg(F.count("*").alias("votes"))
    best = stars.groupBy("row").agg(F.max(F.struct("votes", F.xxhash64("hub").alias("rank"), "hub")).alias("best"))
    first = landed(best.select(F.col("row").alias("a"), F.col("best.hub").alias("b")), "pairs")
    labels = _grown(None, landed(_verified(first, texts), "links"))
    tested = first
    # the other hubs of texts that are not yet in their hub's class
    named = labels.withColumnRenamed("node", "row")
    hub_named = labels.select(F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    apart = (stars.join(named, "row", "left").join(hub_named, "hub", "left")
             .filter(F.coalesce("label", "row") != F.coalesce("hub_label", "hub")).select(F.col("row").alias("a"), F.col("hub").alias("b"))
             .join(tested, ["a", "b"], "left_anti"))
    second = landed(apart, "pairs")
    tested = tested.unionByName(second)
    labels = _grown(labels, landed(_verified(second, texts), "links"))
    # texts that share a bucket with another class meet by their rarest shingles
    apart = _mixed(_labelled(met.select("bucket", "row"), labels), "bucket").select("row").distinct()
    left = landed(texts.join(apart, "row", "left_semi"), "apart-texts")
    rare = landed(_rarest(left, _frequencies(left)), "rare-shingles")
    outlines = rare.filter("at = 0").select("row", "outline")
    shared = landed(_mixed(_labelled(rare.drop("outline"), labels), "token").join(outlines, "row"), "shared-shingles")
    for k in range(ROUNDS):
        hubs = shared.groupBy("token").agg(F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("rank"), "row", "label", "n", "at", "outline")).alias("hub"))
        near = (shared.join(hubs, "token")
                .filter((F.col("label") != F.col("hub.label")) & _can_be_first("n", "at", "hub.n", "hub.at")
                        & _alike("n", "outline", "hub.n", "hub.outline"))
                .select(F.col("row").alias("a"), F.col("hub.row").alias("b")))
        pairs = landed(_untested(near, tested), "pairs")
        if pairs.isEmpty():
            break
        tested = tested.unionByName(pairs)
        labels = _grown(labels, landed(_verified(pairs, texts), "links"))
        shared = landed(_mixed(_labelled(shared.drop("label"), labels), "token"), "shared-shingles")
    one = shared.select("token", F.col("row").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("ia"),
                        F.col("outline").alias("oa"))
    two = shared.select("token", F.col("row").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("ib"),
                        F.col("outline").alias("ob"))
    rest = one.join(two, "token").filter((F.col("la") < F.col("lb")) & _can_be_first("na", "ia", "nb", "ib") & _alike("na", "oa", "nb", "ob"))
    fourth = landed(_untested(rest.select("a", "b"), tested), "pairs")
    labels = _grown(labels, landed(_verified(fourth, texts), "links"))
    joined = (forms.select("k1", "k2", "row").join(labels.withColumnRenamed("node", "row"), "row", "left")
              .select("k1", "k2", F.coalesce("label", "row").alias("label")))
    every = landed(sketched.select("row", "id", "k1", "k2").join(joined, ["k1", "k2"]).select("row", "id", "label"), "classes")
    stands = every.groupBy("label").agg(F.min(order).alias("o")).select("label", F.col("o.row").alias("class"), F.col("o.id").alias("class_id"))
    return every.join(stands, "label").select("row", "id", "class", "class_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, a row for each row of `docs`; class_id is the smallest id of the class.

    A null text is an empty one; empty texts are copies of each other, and so are texts that are equal byte for byte; null
    ids stay and stand for a class only if it has no other. Other columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = landed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                              F.coalesce(F.col(text_col), F.lit("")).alias("text")), "texts")
    return classes(rows).select(F.col("id").alias(id_col), "class_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stand for their class, with all their columns."""
    small_batches(docs.sparkSession)
    mark = _fresh(docs.columns, "row")
    kept = landed(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
    found = classes(kept.select(F.col(mark).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    gone = found.filter(F.col("row") != F.col("class")).select(F.col("row").alias(mark))
    return kept.join(gone, mark, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
