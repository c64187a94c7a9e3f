"""Vector columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED_BATCH = 100


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """One minus cosine distance; NULL for a zero vector or where the lengths differ."""
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(F.size(left) == F.size(right), dot(left, right) / F.nullif(norms, F.lit(0.0)))


def similarity_to(column: Column | str, values: Sequence[float]) -> Column:
    """Cosine similarity to one known vector, brought to unit length beforehand."""
    col = F.col(column) if isinstance(column, str) else column
    length = float(np.linalg.norm(np.asarray(values, dtype="float64")))
    if length == 0:
        return F.lit(None).cast("double")
    unit = literal_vector([float(v) / length for v in values])
    norm = F.nullif(F.sqrt(dot(col, col)), F.lit(0.0))
    return F.when(F.size(col) == len(values), dot(col, unit) / norm)


def embedder(embed: Callable[[list[str]], list[Sequence[float]]], batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A vector column function that sends texts to `embed` in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            listed = series.fillna("").tolist()
            found: list = []
            for start in range(0, len(listed), batch):
                found.extend(embed(listed[start:start + batch]))
            yield pd.Series([np.asarray(v, dtype="float32") for v in found], index=series.index)

    return vectors


def hashed_trigrams(text: Column, dim: int = 64) -> Column:
    """A stand-in for an embedding model: counts of letter trigrams hashed to `dim` places, in Spark."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))
    )
    places = F.transform(grams, lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(dim)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda place: F.size(F.filter(places, lambda p: p == place)).cast("float"),
    )
