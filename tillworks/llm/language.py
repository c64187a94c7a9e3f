"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, counted in Spark over all learning texts. A text's own
n-grams are ranked the same way, and its language is the one with the smallest out-of-place distance: the sum, over the text's
n-grams, of how far their ranks differ, a missing n-gram counting as a whole profile length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import SLAB, slabs, small_batches, strings

#: n-grams in a profile; fixed by the usual form of the method.
PROFILE = 300
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 1- to 3-grams of the lower-cased words, with a blank before and after each word, packed in 21 bits a letter;
    and the text each belongs to. No n-gram reaches over a blank, and the blank alone is none."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    s = np.where(letter, codes, 0)[keep].astype(np.int64)
    owner = owner[keep]
    out, owners = [s[s > 0]], [owner[s > 0]]
    two = (s[:-1] + s[1:] > 0) & (owner[:-1] == owner[1:])
    out.append((s[:-1] << 21 | s[1:])[two] | 1 << 62)
    owners.append(owner[:-1][two])
    three = (s[1:-1] > 0) & (owner[:-2] == owner[2:])
    out.append((s[:-2] << 42 | s[1:-1] << 21 | s[2:])[three] | -(1 << 63))
    owners.append(owner[:-2][three])
    return np.concatenate(out), np.concatenate(owners)


def top_grams(values: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent values in order of rank, ties to the smaller value."""
    found, counts = np.unique(values, return_counts=True)
    if len(found) > size:
        floor = np.partition(counts, -size)[-size]
        able = counts >= floor
        found, counts = found[able], counts[able]
    return found[np.argsort(-counts, kind="stable")][:size]


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = PROFILE) -> dict[str, np.ndarray]:
    """Each language's n-grams in order of rank, counted over all rows with a language; rows without one do not count.

    What reaches the driver is `size` numbers for each language.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text", SLAB // 2):
                names, which = np.unique(np.array(piece.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
                values, owner = grams(strings(piece.column(1)))
                for k, name in enumerate(names):
                    found, n = np.unique(values[which[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * len(found), pa.string()), pa.array(found), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    rows = (docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
            .filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counted = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for r in top.select("lang", "rank", "gram").collect():
        profiles.setdefault(r.lang, []).append((r.rank, r.gram))
    return {lang: np.array([g for _, g in sorted(pairs)], np.int64) for lang, pairs in sorted(profiles.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            size: int = PROFILE) -> DataFrame:
    """id, lang_pred, score, a row for each row of `docs`.

    The score is 1 less the distance as a share of the greatest one. Ties go to the first language by name. A text that is
    null or has no letter, or without any profile, gives `und` with score 0. Repeated rows and null ids are kept.
    """
    small_batches(docs.sparkSession)
    langs = sorted(profiles)
    table = []
    for lang in langs:
        order = np.argsort(profiles[lang])
        table.append((profiles[lang][order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slabs(batch, "text", SLAB // 2):
                values, owner = grams(strings(piece.column(1)))
                order = np.argsort(owner, kind="stable")
                values = values[order]
                ends = np.searchsorted(owner[order], np.arange(piece.num_rows + 1))
                names, scores = [], []
                for low, high in zip(ends[:-1], ends[1:]):
                    own = top_grams(values[low:high], size)
                    if not len(own) or not langs:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    ranks = np.arange(len(own))
                    far = []
                    for found, rank in table:
                        at = np.minimum(np.searchsorted(found, own), len(found) - 1)
                        there = found[at] == own
                        far.append(int(np.where(there, np.abs(rank[at] - ranks), size).sum()))
                    best = int(np.argmin(far))
                    names.append(langs[best])
                    scores.append(1.0 - far[best] / (size * len(own)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double"))


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text leaves `rest`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == rest
