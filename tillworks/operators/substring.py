"""Which short texts hold which needles, by equal keys instead of testing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_literal(pattern: Column) -> Column:
    """The longest stretch of a LIKE pattern without a wildcard, in lower case; every match holds it."""
    pieces = F.split(F.lower(pattern), r"[%_\\]")
    sized = F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("piece")))
    return F.array_max(sized)["piece"]


def pieces_of(text: Column, lengths: list[int]) -> Column:
    """All distinct substrings of `text` with one of the given lengths."""
    def of_length(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - n + 1)
        cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(n))) if n else F.array(F.lit(""))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    runs = [of_length(n) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*runs)))


def contains_pairs(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Pairs (text row, needle row) where the text holds the needle, both compared as they are.

    Texts are cut into substrings of the lengths that occur among the needles and joined on equality,
    so each produced pair is a true match. The set of lengths is as small as the longest needle.
    """
    found = needles.filter(F.col(needle).isNotNull()).select(F.length(needle)).distinct().collect()
    lengths = sorted(r[0] for r in found) or [0]
    cut = texts.withColumn("_piece", F.explode(pieces_of(F.col(text), lengths)))
    return cut.join(needles, F.col("_piece") == F.col(needle)).drop("_piece")
