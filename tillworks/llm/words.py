"""Words of many texts at once, as hashes."""

from __future__ import annotations

import numpy as np

from tillworks.llm.common import byte_table, mix64

_TABLE = byte_table(61)
#: Bit 1 marks white space, 2 digits, 4 and 8 capital and small letters, 16 punctuation, 32 bytes beyond ASCII.
KIND = np.zeros(256, np.uint8)
for _set, _bit in ((b" \t\n\r\x0b\x0c", 1), (bytes(range(48, 58)), 2), (bytes(range(65, 91)), 4), (bytes(range(97, 123)), 8),
                   (b".,;:!?'\"()-", 16), (bytes(range(128, 256)), 32)):
    KIND[list(_set)] = _bit


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash (case of A-Z aside, unless not `fold`) of the words, which white space and the ends of texts
    delimit."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    space = KIND[data] == 1
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~space & (edge[:-1] | np.concatenate([[True], space[:-1]]))
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    stops = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data) if fold else data
    return starts, stops, word_hashes(lower, space, starts, stops)


def word_hashes(data: np.ndarray, space: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    first = np.zeros(len(data), np.int64)
    first[starts] = 1
    word = np.cumsum(first)
    at = np.arange(len(data)) - np.concatenate([[0], starts])[word]
    power = np.ones(int((stops - starts).max()) + 1, np.uint64)
    power[1:] = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(power)
    terms = _TABLE[data] * power[np.minimum(at, len(power) - 1)]
    terms[space] = 0
    return mix64(np.add.reduceat(terms, starts))
