"""Spelling variants: words one inserted, deleted or replaced letter apart, found in a trie of letter-group counts.

A word's frequency vector counts its letters by group, frequent letters alone and rare ones together. One edit adds at most one
to one group (surplus) and takes at most one from another (deficit). The trie arranges words by length and then by the counts of
one group after the other; the search for a word goes down it with a budget of one surplus and one deficit, and the words at the
leaves it reaches are verified letter by letter.

The upper levels of the trie are keys that Spark shuffles by: a word goes once as a member to the node of its own counts and as a
seeker to the few nodes that the budget reaches; the lower levels are searched in the task. So many levels are upper ones that no
node holds more than NODE_WORDS words, unless all counts of more words than that agree. Each pair is sought from one side only:
from the shorter word, or from the word that has less of the first group in which the two differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import byte_table, landed, mix64, slabs, small_batches, text_bytes
from tillworks.llm.words import word_hashes

SLIP = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
#: Letters in groups of their own, and groups that the others share by code.
ALONE, SHARED = 20, 8
#: Words a node of the trie's upper part may hold, and pairs verified at once.
NODE_WORDS = 100_000
PAIRS = 1 << 18
LONGER, SAME, MEMBER = range(3)  # what a word is at a node
LONG = 64  # bytes of a run that are looked at in step with other runs
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.zeros(256, np.uint32)
for _k in range(256):
    _c = _k
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_k] = _c


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z as a-z, and owner, start and end of the runs of letters (A-Z, a-z, U+00C0 to U+00FF)."""
    empty = np.zeros(0, np.int64)
    if not len(data):
        return data, empty, empty, empty
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]])))
    stops = np.flatnonzero(letter & (edge[1:] | np.concatenate([~letter[1:], [True]]))) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    return lower, np.searchsorted(offsets, starts, "right") - 1, starts, stops


def checksums(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes, carried on from the checksums in `begin`."""
    crc = begin.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - stops, kind="stable")  # longest first
    sizes = (stops - starts)[order]
    at, crc = starts[order], crc[order]
    for k in range(min(LONG, int(sizes[0])) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(stops - starts > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k]: stops[k]].tobytes(), int(begin[k]))
    return out


def _counted(data: np.ndarray, offsets: np.ndarray, ids: list[str]) -> dict[bytes, int]:
    """Occurrences of the words of some texts, slips made, in UTF-8."""
    lower, owner, starts, stops = runs_of(data, offsets)
    out: dict[bytes, int] = {}
    if not len(starts):
        return out
    mark = np.zeros(len(lower) + 1, np.int8)
    mark[starts] = 1
    mark[stops] -= 1
    outside = np.cumsum(mark[:-1]) == 0
    hashes = word_hashes(lower, outside, starts, stops)
    # a run and its document once, with how often it is there
    key = mix64(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] + np.uint64(1)))
    times = np.diff(np.append(first, len(order)))
    run = order[first]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(lower, starts[run], stops[run], before[owner[run]])
    slip = h % np.uint32(SLIP) == 0
    raw = lower.tobytes()
    for r, n, crc in zip(run[slip].tolist(), times[slip].tolist(), h[slip].tolist()):
        word = raw[starts[r]: stops[r]].decode("utf-8")
        k = crc % len(word)
        word = (word[:k] + word[k + 1:]).encode("utf-8")
        out[word] = out.get(word, 0) + n
    run, times = run[~slip], times[~slip]
    same = np.argsort(hashes[run], kind="stable")
    ranked = hashes[run][same]
    first = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)))
    total = np.add.reduceat(times[same], first) if len(first) else times[:0]
    for r, n in zip(run[same][first].tolist(), total.tolist()):
        word = raw[starts[r]: stops[r]]
        out[word] = out.get(word, 0) + n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of at least LEAST_LETTERS letters with their occurrences over all texts, slips made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def rows():
            words = [w for w in held if len(w) >= LEAST_LETTERS]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for piece in slabs(batch, "text"):
                for word, n in _counted(*text_bytes(piece.column(1)), piece.column(0).to_pylist()).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > 500_000:
                    yield rows()
                    held = {}
        yield rows()

    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    return (texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.length("word") >= LEAST_LETTERS))


def letter_groups(vocabulary: DataFrame) -> dict[str, int]:
    """The group of each letter that has one of its own, by how many words hold it; the others go by code."""
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''")
    # one row for each letter, of which there are under a hundred
    found = letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(ALONE).collect()
    return {r.letter: k for k, r in enumerate(found)}


def _upper(word: Column, groups: dict[str, int], levels: int) -> list[Column]:
    """Length and the counts of the first groups, all of them letters of their own."""
    names = sorted(groups, key=groups.get)[:levels]
    return [F.length(word), *(F.length(word) - F.length(F.translate(word, c, "")) for c in names)]


def _levels(vocabulary: DataFrame, groups: dict[str, int]) -> int:
    """How many groups the upper part of the trie needs for nodes of at most NODE_WORDS words."""
    for levels in range(3, len(groups) + 1):
        keys = [c.alias(f"k{i}") for i, c in enumerate(_upper(F.col("word"), groups, levels))]
        most = vocabulary.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if most <= NODE_WORDS:
            return levels
    return len(groups)


def _reached(levels: int) -> list[tuple[int, ...]]:
    """What a seeker adds to length and upper counts to get to the nodes where its partners are."""
    still = [0] * levels
    out = []
    for up in (None, *range(levels)):
        longer = still.copy()
        if up is not None:
            longer[up] = 1
        out.append((1, *longer))
        for down in (None, *range(levels)):
            if up == down and up is not None or up is None and down is not None or up is not None and down is not None and down < up:
                continue  # the first difference is a surplus
            same = longer.copy()
            if down is not None:
                same[down] = -1
            out.append((0, *same))
    return out


class Trie:
    """Distinct frequency vectors of words of one length, level by level; a leaf is a vector."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.most = int(vectors.max()) + 3 if vectors.size else 3
        node = np.zeros(len(vectors), np.int64)
        self.children = []
        for level in range(vectors.shape[1]):
            keys, node = np.unique(node * self.most + vectors[:, level] + 1, return_inverse=True)
            self.children.append(keys)
        self.leaf = np.empty(len(np.unique(node)), np.int64)
        self.leaf[node] = np.arange(len(vectors))

    def reach(self, vectors: np.ndarray, surplus: int, deficit: int) -> tuple[np.ndarray, np.ndarray]:
        """Seekers and the members they reach when all of the budget is spent, or none of it; a deficit only after the surplus."""
        stack = [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.full(len(vectors), surplus), np.full(len(vectors), deficit))]
        found = []
        while stack:
            level, seeker, node, s, d = stack.pop()
            if len(seeker) > PAIRS:
                half = len(seeker) // 2
                stack += [(level, *(x[part] for x in (seeker, node, s, d))) for part in (slice(half, None), slice(half))]
                continue
            if level == len(self.children):
                done = (s == d) if surplus == deficit else (s == 0)
                found.append((seeker[done], self.leaf[node[done]]))
                continue
            count = vectors[seeker, level]
            more, less = np.flatnonzero(s > 0), np.flatnonzero((d > 0) & (s == 0) & (count > 0))
            take = np.concatenate([np.arange(len(seeker)), more, less])
            step = np.repeat([0, 1, -1], [len(seeker), len(more), len(less)])
            key = node[take] * self.most + np.minimum(count[take] + step, self.most - 2) + 1
            keys = self.children[level]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            there = (keys[at] == key) & (count[take] + step <= self.most - 3)
            take, step = take[there], step[there]
            stack.append((level + 1, seeker[take], at[there], s[take] - (step == 1), d[take] - (step == -1)))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or by one inserted in b where b has a column more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    same = np.cumprod(a == b[:, :n], 1, dtype=np.int8).sum(1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], 1, dtype=np.int8).sum(1)
    return same + tail >= n


class Words:
    """Words of one length as letters (code points), and their classes of equal frequency vectors."""

    def __init__(self, words: list[str], group: np.ndarray, n_groups: int):
        self.words = words
        length = len(words[0])
        self.letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)
        counts = np.zeros((len(words), n_groups), np.int16 if length < 30_000 else np.int64)
        np.add.at(counts, (np.repeat(np.arange(len(words)), length), group[self.letters].reshape(-1)), 1)
        self.vectors, where = np.unique(counts, axis=0, return_inverse=True)
        self.order = np.argsort(where.reshape(-1), kind="stable")
        self.begin = np.searchsorted(where.reshape(-1)[self.order], np.arange(len(self.vectors) + 1))


def _pairs(seekers: Words, members: Words, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words of seeker classes x and member classes y that one edit leads from one to the other, a bounded number at a time."""
    left, right = np.diff(seekers.begin)[x], np.diff(members.begin)[y]
    total = np.cumsum(left * right)
    done = 0
    while done < (total[-1] if len(total) else 0):
        stop = min(done + PAIRS, int(total[-1]))
        flat = np.arange(done, stop)
        pair = np.searchsorted(total, flat, "right")
        inner = flat - np.append(0, total)[pair]
        i = seekers.order[seekers.begin[x[pair]] + inner // right[pair]]
        j = members.order[members.begin[y[pair]] + inner % right[pair]]
        good = one_edit(seekers.letters[i], members.letters[j])
        yield i[good], j[good]
        done = stop


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: each word with each word one edit away, both ways; words are distinct."""
    groups = letter_groups(vocabulary)
    levels = _levels(vocabulary, groups)
    table = np.array([groups.get(chr(c), len(groups) + c % SHARED) for c in range(256)])
    n_groups = len(groups) + SHARED
    own = _upper(F.col("word"), groups, levels)

    def node(move: tuple[int, ...]) -> Column:
        fits = F.lit(True)
        for c, m in zip(own, move):
            fits = fits if m >= 0 else fits & (c > 0)
        return F.when(fits, F.concat_ws(",", *[(c + F.lit(m)).cast("string") for c, m in zip(own, move)]))

    seeks = [F.struct(node(m).alias("node"), F.lit(LONGER if m[0] else SAME).alias("role")) for m in _reached(levels)]
    roles = F.array(F.struct(node((0,) * (levels + 1)).alias("node"), F.lit(MEMBER).alias("role")), *seeks)
    placed = (vocabulary.select("word", "n", F.explode(roles).alias("at")).select("at.node", "at.role", "word", "n")
              .filter(F.col("node").isNotNull()))

    def run(rows: pa.Table) -> pa.Table:
        role, words, n = rows.column("role").to_numpy(), rows.column("word").to_pylist(), rows.column("n")
        there = np.flatnonzero(role == MEMBER)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(there):
            members = Words([words[k] for k in there], table, n_groups)
            trie = Trie(members.vectors)
            for kind in (LONGER, SAME):
                here = np.flatnonzero(role == kind)
                if not len(here):
                    continue
                seekers = Words([words[k] for k in here], table, n_groups)
                x, y = trie.reach(seekers.vectors, 1, int(kind == SAME))
                # classes that agree in all counts meet from both sides
                alike = (seekers.vectors[x] == members.vectors[y]).all(1)
                for i, j in _pairs(seekers, members, x[~alike], y[~alike]):
                    found.append((here[i], there[j]))
                for i, j in _pairs(seekers, members, x[alike], y[alike]):
                    one = np.array([words[p] < words[q] for p, q in zip(here[i], there[j])], bool)
                    found.append((here[i][one], there[j][one]))
        a, b = (np.concatenate([p[k] for p in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        a, b = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
        word = rows.column("word")
        return pa.table({"word": word.take(a), "n": n.take(a), "near": word.take(b), "near_n": n.take(b)})

    return placed.groupBy("node").applyInArrow(run, "word string, n long, near string, near_n long")


def forms(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: the near word with the greatest n, the first in code-point order of equals, if its n is at
    least RATIO times the word's."""
    best = (near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    follows = -F.col("best.less") >= RATIO * F.col("n")
    return (vocabulary.join(best, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.less")).alias("form_n")))


def roots(found: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to, for words with a form. n rises along the way, so it ends; each round doubles
    the steps taken."""
    reached = landed(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = landed(reached.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "spelling-roots")
        reached = new.select("word", "root")
        if new.filter("moved").limit(1).count() == 0:
            return reached


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of at least LEAST_LETTERS letters with LEAST_COUNT occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z as a-z; where the crc32 of `<id>:<run>` is a multiple of SLIP, the letter
    at its remainder by the length is left out of all occurrences of the run in that document. A null text has no words, a null id
    counts as an empty text, repeated rows count as often as they are there, other columns are not read. Texts and words of any
    length are taken whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    vocabulary = landed(count_words(docs, id_col, text_col).filter(F.col("n") >= LEAST_COUNT), "spelling-words")
    found = landed(forms(vocabulary), "spelling-forms")
    return (found.join(roots(found), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
