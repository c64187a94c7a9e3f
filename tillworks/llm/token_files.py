"""Token ids in files of fixed-width codes, and reading them back.

A file holds a stretch of the documents in ascending id order: a header, the documents' ids and ends, block offsets, and blocks
of BLOCK token ids, each id in the fewest bits that hold the vocabulary. Codes being equally wide, a block unpacks with a few
numpy calls, and token k is found at once from the offset of its block.

Tasks write whole files into the shared folder under their final name only when complete, so a lost task leaves none behind
that counts; a repeated task writes the same bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm.common import TwoGenerations, get_file, mix64, put_file, slabs, small_batches, strings
from tillworks.session import run_folder

MAGIC = b"TWIDS1\0\0"
HEADER = struct.Struct("<8sIIQQ")
BLOCK = 4096
#: Ids in a file at most, unless one document has more.
FILE_IDS = 8 << 20
#: Text bytes that are split at once, and parts whose ids a worker remembers in each of two generations. Both bound its memory.
SPLIT_BYTES = 1 << 20
REMEMBERED = 150_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The low `bits` of each id, least significant bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(wide[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def write_image(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """The bytes of a file with these documents."""
    blocks = [pack(ids[k: k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    return b"".join([
        HEADER.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.cumsum(sizes).astype("<u8").tobytes(), offsets.tobytes(), *blocks,
    ])


class TokenFile:
    """Random access to a file's ids and documents."""

    def __init__(self, image: bytes):
        magic, self.bits, self.block, n, self.n_ids = HEADER.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        ids = np.frombuffer(image, "<i8", n, at)
        there = np.frombuffer(image, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(d) if t else None for d, t in zip(ids, there)]
        self.ends = np.frombuffer(image, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        count = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(image, "<u8", count + 1, at).astype(np.int64)
        self.body = memoryview(image)[at + 8 * (count + 1):]

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start to end, unpacking only the blocks they lie in."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack(self.body[self.offsets[b]: self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block),
                        self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block: end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


#: The pattern by which byte-level vocabularies of this kind split texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """1 for letters, 2 for numbers, 3 for white space, 4 for the blank, 0 for the rest, by code point."""
    if not _CLASS:
        kinds = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            kinds[c] = 1 if kind == "L" else 2 if kind == "N" else 0
        # The code points that Unicode calls white space
        kinds[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        kinds[32] = 4
        _CLASS.append(kinds)
    return _CLASS[0]


def split_parts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, its code points, where the parts begin that SPLIT finds in texts without apostrophes, and how many lie
    before the end of each text.

    A part begins where the kind of letter changes; a blank goes with what follows it, and of a run of white space before
    other letters the last letter is apart from the rest.
    """
    whole = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    if not whole:
        return whole, points, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = _classes()[points]
    blank, space = kind == 4, kind >= 3
    same = np.where(space, 3, kind)
    first = np.ones(len(kind), bool)
    first[1:] = same[1:] != same[:-1]
    edge = np.zeros(len(kind) + 1, bool)
    edge[ends] = edge[0] = True
    first |= edge[:-1]
    begins = first.copy()
    # other letters after a blank begin with it
    begins[1:] &= space[1:] | ~blank[:-1] | edge[1:-1]
    # the last white space before other letters
    begins[:-1] |= space[:-1] & ~space[1:] & ~edge[1:-1]
    at = np.flatnonzero(begins)
    return whole, points, at, np.searchsorted(at, ends)


def distinct_parts(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of parts that begin at `at`, the first of each distinct one, and for all parts which of those they are. Parts are told by a
    hash and then compared letter by letter; should two differ under one hash, every part counts as its own."""
    sizes = np.diff(np.append(at, len(points)))
    inner = np.arange(len(points)) - np.repeat(at, sizes)
    power = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    terms = mix64(points.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[inner]
    _, first, which = np.unique(mix64(np.add.reduceat(terms, at)), return_index=True, return_inverse=True)
    like = first[which]
    if (sizes == sizes[like]).all() and (points == points[np.repeat(at[like], sizes) + inner]).all():
        return first, which
    return np.arange(len(at)), np.arange(len(at))


class ByteEncoder:
    """Library ids of whole texts. Where the tokenizer is a byte-level BPE that splits by SPLIT, texts are split first and the
    library's merges of the parts kept in a bounded cache; other tokenizers, and texts that hold one of the added tokens, go
    to the library whole."""

    def __init__(self, spec: str):
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        parts = json.loads(spec)
        split, model = parts.get("pre_tokenizer") or {}, parts["model"]
        self.cached = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                       and model.get("type") == "BPE" and not parts.get("normalizer")
                       and not model.get("dropout") and not model.get("ignore_merges"))
        added = [t["content"] for t in parts.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.split = regex.compile(SPLIT).findall
        # bytes that are no visible letter stand for themselves 256 places on, in order
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.cache = TwoGenerations(self._merged, REMEMBERED)

    def _merged(self, parts: list[str]) -> list[bytes]:
        merge, letters, pack_ids, blank = self.library.model.tokenize, self.letters, struct.pack, chr(self.letters[32])
        out = []
        for part in parts:
            # of the visible ASCII letters and the blank only the blank stands for itself elsewhere
            shown = part.replace(" ", blank) if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(letters)
            ids = [t.id for t in merge(shown)]
            out.append(pack_ids(f"<{len(ids)}I", *ids))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, one after the other."""
        plain = [self.cached and not self.added.search(t) for t in texts]
        quick = [p and "'" not in t for t, p in zip(texts, plain)]
        whole, points, at, ends = split_parts([t if q else "" for t, q in zip(texts, quick)])
        ids, edge = self._joined(whole, points, at)
        out = []
        low = 0
        for text, known, fast, high in zip(texts, plain, quick, ends.tolist()):
            if fast:
                out.append(ids[edge[low]: edge[high]].tobytes())
            elif known:
                out.append(b"".join(self.cache(self.split(text))))
            else:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            low = high
        return out

    def _joined(self, whole: str, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, and where those of each part begin; each distinct part is looked up once."""
        if not len(at):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        first, which = distinct_parts(points, at)
        stops = np.append(at[1:], len(points))
        found = self.cache([whole[a:b] for a, b in zip(at[first].tolist(), stops[first].tolist())])
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(x) >> 2 for x in found], np.int64)
        begins = np.cumsum(sizes) - sizes
        edge = np.concatenate([[0], np.cumsum(sizes[which])])
        return flat[np.repeat(begins[which] - edge[:-1], sizes[which]) + np.arange(edge[-1])], edge


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(spec: str) -> ByteEncoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = ByteEncoder(spec)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, spec: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                      folder: str | None = None) -> str:
    """Encodes whole texts with the tokenizer `spec` (JSON), appends `end_id`, and writes the files; returns their folder.

    A null or empty text has the end id only. Documents stand in ascending id order, null ids first, repeated ids in the
    order of a hash of the text; equal rows are all kept. Other columns of any name are not read. An empty table gives a
    folder without files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or run_folder(spark, "token-files")
    # names of two attempts never meet; only the attempt whose rows reach the manifest counts
    stamp = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec)
        bits = bits_for(max(encode.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        held: list[bytes] = []
        doc_ids: list = []
        count = number = 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(b) // 4 for b in held], np.int64)
            name = f"{part:06d}-{number:05d}-{stamp}-{attempt}.ids"
            put_file(f"{folder}/{name}", write_image(doc_ids, sizes, np.frombuffer(b"".join(held), "<u4"), bits))
            return pa.RecordBatch.from_pydict(
                {"file": [name], "n_ids": [int(sizes.sum())], "n_docs": [len(held)]},
                pa.schema([("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

        for batch in batches:
            encoded = (ids for piece in slabs(batch, "text", SPLIT_BYTES) for ids in encode(strings(piece.column(1))))
            for doc_id, own in zip(batch.column(0).to_pylist(), encoded):
                ids = own + end
                if held and count + len(ids) // 4 > FILE_IDS:
                    yield close()
                    held, doc_ids, count, number = [], [], 0, number + 1
                held.append(ids)
                doc_ids.append(doc_id)
                count += len(ids) // 4
        if held:
            yield close()

    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
               .withColumn("tie", F.xxhash64("text"))
               .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text"))
    ordered.mapInArrow(run, "file string, n_ids long, n_docs long").write.parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), ids binary (little-endian unsigned 32-bit), a row for each document."""
    small_batches(spark)
    # a row for each file, not for each document
    files = sorted((r.file, r.n_ids) for r in spark.read.parquet(f"{folder}/manifest").collect())
    base, total = {}, 0
    for name, n in files:
        base[name] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                file = TokenFile(get_file(f"{folder}/{name}"))
                for low in range(0, len(file.ends), 1000):
                    high = min(low + 1000, len(file.ends))
                    starts = np.concatenate([[int(file.ends[low - 1]) if low else 0], file.ends[low: high - 1]])
                    ids = file.tokens(int(starts[0]), int(file.ends[high - 1]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(file.doc_ids[low:high], pa.int64()), pa.array(starts + base[name], pa.int64()),
                        pa.array([ids[a - starts[0]: b - starts[0]].tobytes() for a, b in zip(starts, file.ends[low:high])],
                                 pa.binary())], names=[id_col, "start", "ids"])

    if not files:
        return spark.createDataFrame([], f"`{id_col}` long, start long, ids binary")
    # the names travel, the workers open the files
    named = spark.createDataFrame([(name,) for name, _ in files], "file string")
    return named.repartition(len(files)).mapInArrow(run, f"`{id_col}` long, start long, ids binary")


def token_file_digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of the documents in the files."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b.as_buffer() for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b.size // 4 for b in ids], pa.int64()),
                 pa.array([zlib.crc32(b) for b in ids], pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return read_token_files(spark, folder, id_col).mapInArrow(
        crc, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")
