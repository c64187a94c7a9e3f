"""Sub-word encoding and decoding with a table of prefix end tokens.

In merge-type (BPE) encoding every prefix of a text has one encoding, and cutting its last token leaves the encoding of the
shorter prefix. So one token per prefix is enough: among the pieces that an automaton finds ending at a position, it is the
only one that is compatible with the last token of the prefix before it, that is, encoding the two alone gives just the two.
The ids are then read off backwards. Texts are cut where no piece can span, and the parts' ids are kept in a bounded cache.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tillworks.llm.common import TwoGenerations, small_batches, strings

SPACE = "▁"
PAIR_LIMIT = 2_000_000
PAIR_BASE = 1 << 24

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PrefixTableCodec:
    """Encodes and decodes as a byte-fallback BPE model with identity normalisation and a leading space does."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if sp.encode("") or sp.normalize(" a  ﬁ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("only models that keep the text as it is and add a leading space are supported")
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.kind = ["b" if sp.is_byte(i) else "c" if sp.is_control(i) else "u" if sp.is_unknown(i) else "n"
                     for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] == "n"}
        self.size = [len(p) for p in self.piece]
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(self.kind[i] != "b" for i in self.byte_id):
            raise ValueError("only models with byte fallback are supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        letters = set("".join(self.id))
        self.foreign = re.compile("([^" + re.escape("".join(sorted(letters))) + "])")
        # a piece with a space after another letter would span words
        self.spans = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id)
        line = "" if "\n" in letters else "\n"
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + ("|\n" if line else ""))
        self.pairs: dict[int, bool] = {}
        self.growth: dict[int, tuple | None] = {}
        self.cache = TwoGenerations(lambda parts: [self._part(p) for p in parts])
        self.surface = [p.replace(SPACE, " ").encode() if k == "n" else b"" if k == "c" else " ⁇ ".encode()
                        for p, k in zip(self.piece, self.kind)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])

    def _growth(self, token: int) -> tuple[list, list, list] | None:
        """The merges that make a piece, best first: their scores, and the first and last symbol before each and after all.

        None for a piece that its own text does not give."""
        parts = list(self.piece[token])
        score = self.score.get
        gains = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
        steps, first, last = [], [parts[0]], [parts[-1]]
        while gains:
            top = max(gains)
            if top == -np.inf:
                return None
            at = gains.index(top)
            joined = parts[at] + parts[at + 1]
            parts[at: at + 2] = [joined]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + joined, -np.inf)
            if at < len(gains):
                gains[at] = score(joined + parts[at + 1], -np.inf)
            steps.append(top)
            first.append(parts[0])
            last.append(parts[-1])
        steps.append(-np.inf)
        return steps, first, last

    def _stay_apart(self, left: int, right: int) -> bool:
        """Plays the merges of both pieces in order of score and sees whether one across the border comes first."""
        for token in (left, right):
            if token not in self.growth:
                self.growth[token] = self._growth(token)
        a, b = self.growth[left], self.growth[right]
        if a is None or b is None:
            return False
        (left_steps, _, ends), (right_steps, starts, _) = a, b
        i = j = 0
        while True:
            across = self.score.get(ends[i] + starts[j], -np.inf)
            # of equal scores the leftmost goes first: left piece, border, right piece
            if across > left_steps[i] and across >= right_steps[j]:
                return False
            if left_steps[i] >= right_steps[j]:
                if left_steps[i] == -np.inf:
                    return True
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are next to each other; left is -1 at the start."""
        key = left * PAIR_BASE + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIR_LIMIT:
                self.pairs.clear()
            known = self.pairs[key] = self._growth(right) is not None if left < 0 else self._stay_apart(left, right)
        return known

    def _run(self, text: str) -> list[int]:
        """Ids of a text all of whose letters have pieces."""
        unset = -2
        last = [unset] * (len(text) + 1)
        last[0] = -1
        known, sizes = self.pairs, self.size
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] == unset:
                before = last[end - sizes[token]]
                if before != unset:
                    fits = known.get(before * PAIR_BASE + token)
                    if fits or fits is None and self.compatible(before, token):
                        last[end] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            ids.append(token)
            at -= sizes[token]
        ids.reverse()
        return ids

    def _part(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        for k, run in enumerate(self.foreign.split(text)):
            if run:
                ids += [self.byte_id[b] for b in run.encode()] if k % 2 else self._run(run)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        parts = [text] if self.spans else self.parts.findall(text)
        return [i for part in self.cache(parts) for i in part]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD each."""
        lead = next((k for k, i in enumerate(ids) if self.kind[i] != "c"), None)
        if lead is None:
            return ""
        surface = self.surface
        body = b"".join([surface[i] for i in ids[lead + 1:]])
        first = surface[ids[lead]]
        if self.kind[ids[lead]] == "n" and first.startswith(b" "):
            first = first[1:]
        return (first + body).decode("utf-8", "each_byte")


_CODECS: dict[bytes, PrefixTableCodec] = {}


def codec(model: bytes) -> PrefixTableCodec:
    """One codec per worker and model, so that its caches serve all tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = PrefixTableCodec(model)
    return _CODECS[key]


def encode_texts(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> and the text decoded from them, a row for each row of `docs`.

    A null or empty text has no ids and decodes to the empty text. Repeated rows each give a row; a null id is kept. Other
    columns of any name are left out. A text is held by one task at a time, whatever its length. An empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        for batch in batches:
            ids = [table.encode(t) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([table.decode(i) for i in ids], pa.string())],
                names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: what `encode_texts` gives, digested within the same task."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codec(model)
        shown = [str(i) for i in range(len(table.piece))]
        for batch in batches:
            sizes, hashes, back = [], [], []
            for text in strings(batch.column(1)):
                ids = table.encode(text)
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(back)],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
