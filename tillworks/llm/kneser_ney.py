"""Text scores by an interpolated modified Kneser-Ney model of word pairs.

Spark counts words, then word pairs. The model lies in the shared folder as sorted arrays: the hashes of the words, whose places
are the words' numbers, and the packed numbers of the pairs, each beside their counts. Workers map the arrays into memory and
look up a whole slab of text at a time by binary search; nothing of the model's size passes through the driver.

Map tasks send counted keys in blobs, one for each shard. Pairs are dealt by their first word, so a shard knows all that
follows a word; the few first words that would swamp a shard are dealt by the whole pair, and their sums added up after.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import get_file, mix64, mounted, put_file, slabs, small_batches, text_bytes
from tillworks.llm.words import words_of
from tillworks.session import run_folder

END = np.uint64(0xE0D5A1B7C3F29468)
LEAST_SHARDS = 64
SHARD_BYTES = 64 << 20
#: A first word with more than this share of all tokens is dealt by the whole pair, so there are at most as many as its inverse.
HOT_SHARE = 1 / 64
#: Keys a map task holds before it sends them on.
HELD = 4_000_000

BLOBS = "shard long, ones binary, keys binary, counts binary"
PARTS = "kind string, shard long, file string, n long, numbers binary"


@dataclass
class Model:
    """Where the arrays lie and the numbers needed with them."""

    folder: str
    shards: int = LEAST_SHARDS
    tokens: int = 0
    words: int = 0
    vocabulary: list = field(default_factory=list)
    starts: np.ndarray | None = None
    hot: dict = field(default_factory=dict)
    pairs: dict = field(default_factory=dict)
    follows: dict = field(default_factory=dict)
    discounts: np.ndarray | None = None
    low_discounts: np.ndarray | None = None
    kinds: int = 0
    low_weight: float = 1.0


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text of each token in order: the words, then one end."""
    n = len(offsets) - 1
    starts, _, hashes = words_of(data, offsets)
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=n)
    tokens = np.full(len(hashes) + n, END, np.uint64)
    tokens[np.arange(len(hashes)) + owner] = hashes
    return tokens, np.repeat(np.arange(n), count + 1)


def _save(folder: str, name: str, array: np.ndarray) -> str:
    out = io.BytesIO()
    np.save(out, array)
    put_file(f"{folder}/{name}.npy", out.getvalue())
    return f"{name}.npy"


def _least_kind(array: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit, else in 64."""
    return array.astype("<u4" if not array.size or array.max() < 1 << 32 else "<u8")


class _Arrays:
    """The arrays a worker has open: mapped where the shared folder is mounted, else read into memory. Those used longest ago go
    when more than `files` are open or `held` bytes are in memory."""

    def __init__(self, files: int = 20_000, held: int = 256 << 20):
        self.files, self.held, self.size, self.open = files, held, 0, {}

    def __call__(self, folder: str, name: str) -> np.ndarray:
        uri = f"{folder}/{name}"
        array = self.open.pop(uri, None)
        if array is None:
            path = mounted(uri)
            array = np.load(path, mmap_mode="r") if path else np.load(io.BytesIO(get_file(uri)))
            self.size += self._bytes(array)
        self.open[uri] = array
        while len(self.open) > 1 and (len(self.open) > self.files or self.size > self.held):
            self.size -= self._bytes(self.open.pop(next(iter(self.open))))
        return array

    @staticmethod
    def _bytes(array: np.ndarray) -> int:
        return 0 if isinstance(array, np.memmap) else array.nbytes


_mapped = _Arrays()


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard: the keys counted once, and the others with their counts."""
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order], shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else []
    for low, high in zip(cuts, [*cuts[1:], len(shard)]):
        k, c = keys[low:high], counts[low:high]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard[low]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in
                                                   (k[c == 1], k[c > 1], c[c > 1].astype("<i8")))],
            names=["shard", "ones", "keys", "counts"])


def _merged(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    blobs = [[np.frombuffer(b.as_buffer(), k) for b in table.column(c)] for c, k in (("ones", kind), ("keys", kind), ("counts", "<i8"))]
    ones, keys, counts = (np.concatenate(b) for b in blobs)
    return _counted(np.concatenate([ones, keys]), np.concatenate([np.ones(len(ones), np.int64), counts]))


def _gathered(docs: DataFrame, keys_of, shard_of) -> DataFrame:
    """Counts the keys of all texts within each map task and deals them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for piece in slabs(batch, "text"):
                found, n = np.unique(keys_of(*text_bytes(piece.column(0))), return_counts=True)
                keys.append(found)
                counts.append(n.astype(np.int64))
                held += len(found)
                if held > HELD:
                    k, c = _counted(np.concatenate(keys), np.concatenate(counts))
                    if len(k) > HELD // 2:
                        yield from _dealt(k, c, shard_of(k))
                        k, c = k[:0], c[:0]
                    keys, counts, held = [k], [c], len(k)
        if keys:
            k, c = _counted(np.concatenate(keys), np.concatenate(counts))
            yield from _dealt(k, c, shard_of(k))

    return docs.mapInArrow(run, BLOBS)


def word_numbers(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number (-1 if unknown) and count of each word."""
    found, back = np.unique(hashes, return_inverse=True)
    number = np.full(len(found), -1, np.int64)
    count = np.zeros(len(found), np.int64)
    shard = (found >> np.uint64(64 - model.shards.bit_length() + 1)).astype(np.int64)
    cuts = np.searchsorted(shard, np.arange(model.shards + 1))
    for s, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if low < high and model.vocabulary[s]:
            keys, counts = (_mapped(model.folder, f) for f in model.vocabulary[s])
            at = np.minimum(np.searchsorted(keys, found[low:high]), len(keys) - 1)
            there = keys[at] == found[low:high]
            number[low:high] = np.where(there, model.starts[s] + at, -1)
            count[low:high] = np.where(there, counts[at], 0)
    return number[back], count[back]


def _pairs(numbers: np.ndarray, owner: np.ndarray, begin: int) -> np.ndarray:
    """The number before each token, `begin` at the start of a text."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.append(True, owner[1:] != owner[:-1])] = begin
    return before


def _pair_shard(keys: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    first = keys >> np.uint64(32)
    by = np.where(np.isin(first, hot), keys, first)
    return (mix64(by) % np.uint64(shards)).astype(np.int64)


def _discounts(kinds: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and more, from how many kinds occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in kinds)
    if not min(n1, n2, n3, n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(raw, 1))])


def _numbers(*values) -> bytes:
    return np.array(values, "<i8").tobytes()


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts the model over all texts of `docs`; null texts are empty, repeated rows count each time, other columns are not
    read. An empty table gives a model that knows no word."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = run_folder(spark, "kneser-ney")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a power of two, as words are dealt by the top bits of their hash
    shards = 1 << max(LEAST_SHARDS - 1, -(-size // SHARD_BYTES) - 1).bit_length()
    model = Model(folder, shards)
    top = np.uint64(64 - shards.bit_length() + 1)

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _merged(table, "<u8")
        name = f"words-{key[0].as_py()}-{uuid.uuid4().hex[:8]}"
        files = _save(folder, f"{name}-k", keys), _save(folder, f"{name}-c", counts.astype("<u8"))
        hot = counts > 0
        order = np.argsort(-counts[hot], kind="stable")[:64]
        return pa.table({"kind": ["words"], "shard": [key[0].as_py()], "file": ["|".join(files)], "n": [len(keys)],
                         "numbers": [_numbers(counts.sum(), *np.stack([order, counts[order]], 1).ravel())]})

    counted = _gathered(texts, lambda d, o: token_hashes(d, o)[0], lambda k: (k >> top).astype(np.int64))
    rows = counted.groupBy("shard").applyInArrow(merge_words, PARTS).collect()  # a row for each shard
    by_shard = {r.shard: r for r in rows}
    model.vocabulary = [tuple(by_shard[s].file.split("|")) if s in by_shard else None for s in range(shards)]
    sizes = np.array([by_shard[s].n if s in by_shard else 0 for s in range(shards)], np.int64)
    model.starts, model.words = np.cumsum(sizes) - sizes, int(sizes.sum())
    model.tokens = sum(int(np.frombuffer(r.numbers, "<i8")[0]) for r in rows)
    if model.words >= (1 << 32) - 1:
        raise ValueError("more than 2**32 words")
    hot = [model.starts[r.shard] + at for r in rows for at, c in np.frombuffer(r.numbers, "<i8")[1:].reshape(-1, 2)
           if c > model.tokens * HOT_SHARE]
    hot_words = np.array([*hot, model.words], np.uint64)  # the start of a text is as frequent as texts

    def pair_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        hashes, owner = token_hashes(data, offsets)
        numbers = word_numbers(model, hashes)[0]
        return _pairs(numbers, owner, model.words).astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)

    def merge_pairs(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _merged(table, "<u8")
        shard = key[0].as_py()
        name = f"pairs-{shard}-{uuid.uuid4().hex[:8]}"
        first, second = keys >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        sums = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], 1)
        contexts = first[at]
        files = (_save(folder, f"{name}-k", keys), _save(folder, f"{name}-c", _least_kind(counts)),
                 _save(folder, f"{name}-a", contexts.astype("<u4")), _save(folder, f"{name}-s", _least_kind(sums)))
        is_hot = np.isin(contexts, hot_words)
        kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        partial = np.concatenate([contexts[is_hot, None].astype(np.int64), sums[is_hot]], 1).ravel()
        out = [("pairs", shard, "|".join(files), len(keys), _numbers(*kinds, *partial))]
        ends, n = np.unique(second, return_counts=True)
        part = ends * shards // max(1, model.words)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for low, high in zip(cuts, [*cuts[1:], len(part)]):
            e, c = ends[low:high].astype("<u4"), n[low:high]
            blob = np.array([(c == 1).sum()], "<i8").tobytes() + e[c == 1].tobytes() + e[c > 1].tobytes() + c[c > 1].astype("<u4").tobytes()
            out.append(("follows", int(part[low]), "", 0, blob))
        return pa.table(dict(zip(("kind", "shard", "file", "n", "numbers"), map(list, zip(*out)))),
                        schema=pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("file", pa.string()), ("n", pa.int64()),
                                          ("numbers", pa.binary())]))

    paired = _gathered(texts, pair_keys, lambda k: _pair_shard(k, shards, hot_words))
    paired.groupBy("shard").applyInArrow(merge_pairs, PARTS).write.parquet(f"{folder}/pair-parts")
    parts = spark.read.schema(PARTS).parquet(f"{folder}/pair-parts")
    kinds = np.zeros(4, np.int64)
    for r in parts.filter(F.col("kind") == "pairs").collect():  # a row for each shard
        numbers = np.frombuffer(r.numbers, "<i8")
        model.pairs[r.shard] = tuple(r.file.split("|"))
        model.kinds += r.n
        kinds += numbers[:4]
        for word, *sums in numbers[4:].reshape(-1, 5).tolist():
            model.hot[word] = np.array(sums) + model.hot.get(word, 0)
    model.discounts = _discounts(kinds)

    def merge_follows(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        low, high = (-(-s * model.words // shards) for s in (shard, shard + 1))
        total = np.zeros(high - low + 1, np.int64)
        for blob in table.column("numbers"):
            raw = np.frombuffer(blob.as_buffer(), "<u4")
            ones = int(np.frombuffer(blob.as_buffer(), "<i8", 1)[0])
            rest = (len(raw) - 2 - ones) // 2
            total[raw[2: 2 + ones].astype(np.int64) - low] += 1
            total[raw[2 + ones: 2 + ones + rest].astype(np.int64) - low] += raw[2 + ones + rest:]
        name = _save(folder, f"follows-{shard}-{uuid.uuid4().hex[:8]}", total.astype("<u4"))
        return pa.table({"kind": ["follows"], "shard": [shard], "file": [name], "n": [low],
                         "numbers": [_numbers(*[(total == k).sum() for k in (1, 2, 3, 4)], (total >= 3).sum())]})

    kinds = np.zeros(5, np.int64)
    for r in parts.filter(F.col("kind") == "follows").groupBy("shard").applyInArrow(merge_follows, PARTS).collect():
        model.follows[r.shard] = (r.file, r.n)
        kinds += np.frombuffer(r.numbers, "<i8")
    model.low_discounts = _discounts(kinds[:4])
    if model.kinds:
        d = model.low_discounts
        model.low_weight = float(d[1] * kinds[0] + d[2] * kinds[1] + d[3] * kinds[4]) / model.kinds
    return model


def _low_order(model: Model, words: np.ndarray) -> np.ndarray:
    """Lowest-order probability of distinct word numbers in ascending order, from how many words each follows."""
    out = np.full(len(words), model.low_weight / (model.words + 1))
    part = np.where(words >= 0, words * model.shards // max(1, model.words), -1)
    cuts = np.searchsorted(part, np.arange(model.shards + 1))
    for s, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if low < high:
            file, base = model.follows[s]
            n = _mapped(model.folder, file)[words[low:high] - base].astype(np.int64)
            out[low:high] += (n - model.low_discounts[np.minimum(n, 3)]) / model.kinds
    return out


def pair_probabilities(model: Model, before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """P(word | word before) of each token; -1 stands for an unknown word."""
    found, back = np.unique(words, return_inverse=True)
    p = _low_order(model, found)[back]
    able = np.flatnonzero((before >= 0) & bool(model.kinds))
    # an unknown word after a known one has a key that is in no shard
    keys, where = np.unique(before[able].astype(np.uint64) << np.uint64(32)
                            | np.where(words[able] < 0, 0xFFFFFFFF, words[able]).astype(np.uint64), return_inverse=True)
    hot = np.array(sorted(model.hot), np.uint64)
    shard = _pair_shard(keys, model.shards, hot)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
    seen, weight = np.zeros(len(keys)), np.ones(len(keys))
    d = model.discounts
    for s, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if low == high or s not in model.pairs:
            continue
        own = order[low:high]
        k, c, a, sums = (_mapped(model.folder, f) for f in model.pairs[s])
        first = (keys[own] >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(a, first), len(a) - 1)
        known = a[at] == first
        total = np.where(known[:, None], sums[at], 0).astype(np.float64)
        total[:, 0] = np.where(known, total[:, 0], np.inf)
        at = np.minimum(np.searchsorted(k, keys[own]), len(k) - 1)
        n = np.where(k[at] == keys[own], c[at], 0).astype(np.int64)
        seen[own] = (n - d[np.minimum(n, 3)]) / total[:, 0]
        weight[own] = np.where(known, total[:, 1:] @ d[1:] / total[:, 0], 1.0)
    if len(hot):
        first = keys >> np.uint64(32)
        at = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        some = hot[at] == first
        total = np.array([model.hot[int(h)] for h in hot], np.float64)
        shares = total[:, 1:] @ d[1:] / total[:, 0]
        # the shard of a hot pair knows only its own part of the sum
        n = _hot_counts(model, keys, shard, some)
        seen[some] = ((n - d[np.minimum(n, 3)]) / total[at, 0])[some]
        weight[some] = shares[at][some]
    p[able] = seen[where] + weight[where] * p[able]
    return p


def _hot_counts(model: Model, keys: np.ndarray, shard: np.ndarray, some: np.ndarray) -> np.ndarray:
    n = np.zeros(len(keys), np.int64)
    for s in np.unique(shard[some]):
        if s in model.pairs:
            own = np.flatnonzero(some & (shard == s))
            k, c = (_mapped(model.folder, f) for f in model.pairs[s][:2])
            at = np.minimum(np.searchsorted(k, keys[own]), len(k) - 1)
            n[own] = np.where(k[at] == keys[own], c[at], 0)
    return n


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, a row for each row of `docs`.

    Scores are log10 probabilities: the base is that of add-0.1 word counts, the other the model's; the perplexity of a text
    is 10 ** (-score / n_tokens). A null text is empty and has its end only; null ids and repeated rows stay.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text"):
                n = piece.num_rows
                hashes, owner = token_hashes(*text_bytes(piece.column(1)))
                numbers, counts = word_numbers(model, hashes) if model.words else (np.full(len(hashes), -1), np.zeros(len(hashes)))
                base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                p = pair_probabilities(model, _pairs(numbers, owner, model.words), numbers)
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(np.bincount(owner, minlength=n)),
                    pa.array(np.bincount(owner, weights=counts > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, model.tokens, np.int64)), pa.array(np.bincount(owner, weights=base, minlength=n)),
                    pa.array(np.bincount(owner, weights=np.log10(p), minlength=n))],
                    names=[id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
