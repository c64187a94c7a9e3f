"""The text operators against libraries, brute force and held-out labels, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import compare, connect
from tillworks.llm import (
    decontaminate,
    kneser_ney,
    language,
    order_minhash,
    quality,
    queries,
    sentencepiece_bpe,
    suffix_dedup,
    token_files,
    toxicity,
    vafile,
)

FOLDER = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


#: Null ids and texts, empty and blank texts, repeated rows and ids, a very long text, and columns named like inner ones.
AWKWARD = [
    (1, "plain text here"), (1, "plain text here"), (1, "another text under the same id"), (None, "no id at all"), (2, None),
    (3, ""), (4, "   \n\t "), (5, "ünï çödé 漢字 🙂 ▁ x"), (6, "word " * 30_000), (7, "x" * 50_000), (8, "a"), (None, None),
]
EXTRA = "doc_id long, text string, row long, id string, chunk long, score string, label int, block int, `text key` string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(d, t, 9, "id", 8, "s", 7, 6, "k") for d, t in AWKWARD], EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]


def run(name, spark):
    return queries.QUERIES[name](spark, FOLDER)


def same_rows(got, want):
    def key(row):
        return tuple((v is None, str(v)) for v in row)

    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# exact top-k search

def test_top_vectors_equals_sql(spark):
    name = "op1_vector_approximation"
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) is None


def test_top_vectors_with_ties_copies_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(vafile, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 4)
    monkeypatch.setattr(vafile, "CHUNK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, -1.0, 3.0]) for i in range(60)]
    rows += [(300, [1.0, 2.0]), (301, [0.5, 0.25]), (302, [3.0]), (303, None), (304, []), (305, [1.0, None, 2.0, 1.0, 1.0]),
             (306, [1.0, float("nan"), 2.0, 1.0, 1.0]), (307, [float("inf")] * 5), (None, [1.0] * 5), (0, [-9.0] * 5)]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows], "vec_id long, embedding array<double>, block string")
    whole = vafile.quantised(table, 256)
    got = vafile.top_vectors(whole, whole.filter("id % 10 = 0"), 5).collect()
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            kept[i] = max(kept.get(i, w), w)
    want = []
    for q in (i for i in kept if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(kept[q], v)), i) for i, v in kept.items() if i != q and len(v) == len(kept[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    same_rows(got, want)
    assert vafile.top_vectors(whole.limit(0), whole.limit(0)).count() == 0


# sub-word codec

@pytest.fixture(scope="module")
def pieces():
    model = queries.piece_model()
    return sentencepiece_bpe.codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_codec_equals_library(pieces, documents):
    own, library = pieces
    for _, text in documents:
        ids = own.encode(text)
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)
    rng = random.Random(1)
    letters = list("aab  \n\t▁éñ漢字🙂thein<s>0x0A\x00....====----")
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert own.encode(text) == library.encode(text)
        ids = [rng.choice([rng.randrange(32000), rng.randrange(259), 28705]) for _ in range(rng.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids)


def test_codec_rows(spark, awkward, nothing, pieces):
    _, library = pieces
    model = queries.piece_model()
    got = sentencepiece_bpe.encode_texts(awkward, model)
    assert got.columns == ["doc_id", "ids", "decoded"]
    same_rows([(r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()],
              [(d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t in AWKWARD])
    assert sentencepiece_bpe.encode_texts(nothing, model).count() == 0
    digests = sentencepiece_bpe.encode_digests(awkward, model).collect()
    assert len(digests) == len(AWKWARD)
    r = next(x for x in digests if x.doc_id == 8)
    ids = library.encode("a")
    assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# benchmark passages

def edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j - 1] + (c != d), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_passages_equal_brute_force():
    rng = random.Random(3)
    texts = [prose(k, 30)[: 60 + 9 * k] for k in range(12)] + ["short me", "tiny"]
    items = decontaminate.Items(list(range(13)), texts[:13])
    for _ in range(120):
        k = rng.randrange(13)
        letters = list(texts[k])
        for _ in range(rng.randint(0, int(0.15 * len(letters)) + 1)):
            at = rng.randrange(len(letters))
            letters[at: at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        text = prose(rng.random(), 10) + " " + "".join(letters) + " " + prose(rng.random(), 10)
        text = decontaminate.normal(text)
        best = edits(texts[k], text)
        found = [hit for hit in items.find(["unrelated", text]) if hit[1] == k]
        assert bool(found) == (best <= items.edits[k])
        if found:
            assert found[0][2] == best and found[0][0] == 1


def test_passages_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "Plain  TEXT here"), (1, "plain text here"), (2, None), (3, "tiny"), (4, "no id at all"), (5, "")],
                                  "item_id long, text string")
    got = decontaminate.find_items(awkward, items)
    same_rows([(r.doc_id, r.item_id, r.edits) for r in got.collect()], [(1, 1, 0)] * 4 + [(None, 4, 0)])
    left = decontaminate.without_items(awkward, items)
    assert left.schema == awkward.schema and left.count() == len(AWKWARD) - 3
    assert decontaminate.find_items(nothing, items).count() == 0
    assert decontaminate.find_items(awkward, items.limit(0)).count() == 0
    assert decontaminate.without_items(awkward, items.limit(0)).count() == len(AWKWARD)


# toxicity and quality

def test_toxicity_finds_gapped_words():
    rng = random.Random(2)
    texts, labels = [], []
    for k in range(240):
        words = prose(k, 30).split()
        if k % 2:
            words.insert(rng.randrange(30), rng.choice(["idiot", "moron", "worthless"]))
        texts.append((" ".join(words) + ".").encode())
        labels.append(float(k % 2))
    machine = toxicity.fit(texts, np.array(labels))
    fresh = [b"you are an idiot today.", b"you are an id-iot today.", b"you ar such a mor_on here.", b"alpha3 beta7 gamma2.", b""]
    scores = machine.scores(*toxicity._joined(fresh))
    assert (scores[:3] >= 0.7).all() and (scores[3:] < 0.7).all()


def test_toxicity_learns_held_out_labels(spark):
    rows = run("op4_string_kernel_toxicity", spark)
    assert rows.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    judged = rows.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    assert rows.count() == 200 and sum(r.predicted == r.toxic for r in judged) >= 0.8 * len(judged)


def test_quality_learns_held_out_labels(spark):
    rows = run("op6_factorisation_quality", spark)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    judged = rows.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert rows.count() == 200 and sum(r.predicted == r.quality for r in judged) >= 0.85 * len(judged)


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality.Machine(rng.normal(size=quality.BUCKETS + quality.STATS), rng.normal(size=(quality.BUCKETS + quality.STATS, 4)))
    data, offsets = toxicity._joined([b"one two two three", b"", b"One one!"])
    owner, bucket, x, stats = quality.features(data, offsets, np.array([1.0, np.nan, 3.0]))
    raw = machine.raw(3, owner, bucket, x, stats)[0]
    for text in range(3):
        index = [*bucket[owner == text], *range(quality.BUCKETS, quality.BUCKETS + quality.STATS)]
        value = [*x[owner == text], *stats[text]]
        want = sum(machine.w[i] * v for i, v in zip(index, value))
        want += sum(machine.v[index[i]] @ machine.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
        assert raw[text] == pytest.approx(want)


def test_classifiers_on_awkward_rows(spark, awkward, nothing):
    blank = quality.fit([])
    machine = toxicity.fit([], np.zeros(0))
    for rows in (quality.score(awkward, blank), toxicity.score(awkward, machine)):
        found = rows.collect()
        assert collections.Counter(r.doc_id for r in found) == collections.Counter(d for d, _ in AWKWARD)
        assert all(0 <= r.score <= 1 for r in found)
    assert quality.score(nothing, blank).count() == toxicity.score(nothing, machine).count() == 0
    kept = toxicity.keep_below(awkward, machine, 0.7)
    assert kept.schema == awkward.schema and kept.count() == len(AWKWARD)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    sample = quality.labelled_sample(labels, "toxic", F.lit(True), 10)
    same_rows(sample.collect(), [(1, 1.0), (3, 0.0)])
    assert 0 <= toxicity.train(awkward, sample).scores(*toxicity._joined([b"x"]))[0] <= 1
    assert quality.train(awkward, sample).w.shape == (quality.BUCKETS + quality.STATS,)
    assert toxicity.train(nothing, sample.limit(0)).index.size == 0


# language-model scores

def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute_scores(train, texts):
    counts = collections.Counter(w for t in train for w in tokens(t))
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *tokens(t)[:-1]], tokens(t)))
    after, follows = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
    for (a, b), n in pairs.items():
        after[a][0] += n
        after[a][min(n, 3)] += 1
        follows[b] += 1

    def discounts(values):
        kinds = collections.Counter(values)
        return kneser_ney._discounts(np.array([kinds[k] for k in (1, 2, 3, 4)]))

    high, low = discounts(pairs.values()), discounts(follows.values())
    total, v, n = len(pairs), len(counts), sum(counts.values())
    spare = sum(low[min(c, 3)] for c in follows.values()) / total if total else 1.0

    def p(a, b):
        base = spare / (v + 1) + ((follows[b] - low[min(follows[b], 3)]) / total if b in follows else 0)
        if a not in after:
            return base
        x = after[a]
        return (pairs[a, b] - high[min(pairs[a, b], 3)]) / x[0] + sum(high[k] * x[k] for k in (1, 2, 3)) / x[0] * base

    out = []
    for t in texts:
        w = tokens(t)
        out.append((len(w), sum(x in counts for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
                    sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w))))
    return out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g[:3]) == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9) and g[4] == pytest.approx(w[4], rel=1e-6, abs=1e-6)


def test_scores_equal_brute_force(spark, documents):
    got = {r.doc_id: tuple(r)[2:] for r in run("op5_kneser_ney", spark).collect()}
    train = [t for d, t in documents if zlib.crc32(str(d).encode()) % 10]
    close([got[d] for d, _ in documents], brute_scores(train, [t for _, t in documents]))


def test_scores_of_awkward_rows(spark, awkward, nothing):
    model = kneser_ney.train(awkward)
    got = kneser_ney.score(awkward, model).collect()
    key = {(d, len(tokens(t))): t for d, t in AWKWARD}
    assert len(got) == len(AWKWARD)
    got = [r for r in got]
    close([tuple(r)[1:] for r in got], brute_scores([t for _, t in AWKWARD], [key[r.doc_id, r.n_tokens] for r in got]))
    empty = kneser_ney.train(nothing)
    close([tuple(r)[1:] for r in kneser_ney.score(awkward.filter("doc_id = 8"), empty).collect()], brute_scores([], ["a"]))
    assert kneser_ney.score(nothing, model).count() == 0


def test_hot_first_words_add_up(spark):
    rng = random.Random(4)
    texts = [" ".join(["the", rng.choice(WORDS) + str(rng.randrange(400))] * 1 + [rng.choice(WORDS)]) for _ in range(800)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = kneser_ney.train(docs)
    assert len(model.hot) > 1
    got = sorted(kneser_ney.score(docs, model).collect())
    close([tuple(r)[1:] for r in got], brute_scores(texts, texts))


# repeated passages

def brute_repeats(texts, length=200):
    seen = collections.Counter(t[p: p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p: p + length]] > 1:
                mask[p: p + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((len(t), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, documents):
    got = {r.doc_id: tuple(r)[1:] for r in run("op7_suffix_radix_sort", spark).collect()}
    want = brute_repeats([t.encode() for _, t in documents])
    assert [got[d] for d, _ in documents] == want


def test_repeats_across_chunks(spark, monkeypatch):
    rng = random.Random(6)
    texts = [prose(k, 60) for k in range(30)]
    for _ in range(40):
        a, b = rng.sample(range(30), 2)
        at = rng.randrange(len(texts[a]) - 150)
        cut = texts[a][at: at + rng.choice([150, 199, 200, 201, 260, 390])]
        to = rng.randrange(len(texts[b]))
        texts[b] = texts[b][:to] + cut + texts[b][to:]
    texts += ["ab" * 400, "abab" * 60, "x" * 199, "x" * 200, "y" * 201, "", "é" * 150, "é" * 150]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_digests(docs, 200).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts])


def test_repeats_of_awkward_rows(spark, awkward, nothing):
    rows = AWKWARD
    got = sorted((tuple(r)[1:] for r in suffix_dedup.repeat_digests(awkward, 200).collect()))
    # brute force on the two long texts would take long; both repeat throughout
    short = [(t or "").encode() for _, t in rows if len(t or "") < 1000]
    want = brute_repeats(short) + [(n, n, 1, hashlib.sha256(b"").hexdigest()) for n in (150_000, 50_000)]
    assert got == sorted(want)
    cut = suffix_dedup.without_repeats(awkward, 200)
    assert cut.schema == awkward.schema
    left = {(r.doc_id, r.text) for r in cut.collect()}
    assert (6, "") in left and (7, "") in left and (2, None) in left and (1, "plain text here") in left
    assert suffix_dedup.repeat_digests(nothing, 200).count() == 0 and suffix_dedup.without_repeats(nothing, 200).count() == 0


def test_cut_text_keeps_whole_letters(spark):
    passage = "é" * 101
    docs = spark.createDataFrame([(1, "a" + passage + "ê"), (2, "b" + passage + "ë")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs, 200).collect()}
    assert got == {1: "aê", 2: "bë"}


# token files

def test_token_files_equal_library(spark, documents):
    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    got = {r.doc_id: tuple(r)[1:] for r in run("op8_token_files", spark).collect()}
    at = 0
    for d, t in documents:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_encoder_equals_library():
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    own, library = token_files.encoder(spec), Tokenizer.from_str(spec)
    rng = random.Random(5)
    letters = [*"ab 's'll  \n\t\x1c\x1f\x85\xa0 é漢🙂09.,\x00́ª²½", "<|endoftext|>", " the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own(texts) == want


def test_distinct_parts_are_told_by_their_letters(monkeypatch):
    texts = ["the cat the cat", "", " cat the", "x" * 300 + " the" * 3, "\n\n  é 漢字 é"]
    whole, points, at, ends = token_files.split_parts(texts)
    cuts = [*at.tolist(), len(whole)]
    parts = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
    first, which = token_files.distinct_parts(points, at)
    assert [parts[first[w]] for w in which] == parts and len(first) == len(set(parts)) and ends.tolist()[-1] == len(parts)
    monkeypatch.setattr(token_files, "mix64", lambda x: x * np.uint64(0))  # all hashes meet
    first, which = token_files.distinct_parts(points, at)
    assert [parts[first[w]] for w in which] == parts


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_pack_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, np.uint32, endpoint=False) if bits < 32 else rng.integers(0, 2**32, 10_001, np.uint32)
    sizes = np.array([0, 1, 5000, 4999, 1])
    sizes = np.append(sizes, len(ids) - sizes.sum())
    file = token_files.TokenFile(token_files.write_image([5, None, 7, 8, 9, 10], sizes, ids, bits))
    assert file.doc_ids == [5, None, 7, 8, 9, 10]
    ends = np.cumsum(sizes)
    for k in range(6):
        assert np.array_equal(file.document(k), ids[ends[k] - sizes[k]: ends[k]])
    assert np.array_equal(file.tokens(4000, 9000), ids[4000:9000])
    assert len(token_files.pack(ids[:100], bits)) == -(-100 * bits // 8)


def test_token_files_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    library = Tokenizer.from_str(spec)
    folder = token_files.write_token_files(awkward, spec, 0)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in AWKWARD), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got])[:-1]]
    want = collections.Counter(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in AWKWARD)
    assert collections.Counter(bytes(r.ids) for r in got) == want
    assert token_files.token_file_digests(spark, token_files.write_token_files(nothing, spec, 0)).count() == 0


# near-duplicates

def test_subsequence_equals_table():
    rng = random.Random(8)
    for _ in range(300):
        x, y = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
            row = new
        assert order_minhash.common_subsequence(x, y, max(len(x), len(y), 1)) == row[-1]


def lcs_similarity(s, t):
    row = [0] * (len(t) + 1)
    for a in s:
        new = [0]
        for j, b in enumerate(t):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(s) + len(t) - row[-1])


def brute_classes(texts):
    found = []
    for t in texts:
        words = tokens(t)[:-1]
        found.append([tuple(words[i: i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else [])
    top = list(range(len(texts)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            a, b = found[i], found[j]
            close_enough = (texts[i] or "") == (texts[j] or "")
            if not close_enough and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                shared = sum((collections.Counter(a) & collections.Counter(b)).values())
                close_enough = shared >= 0.8 * (len(a) + len(b) - shared) and lcs_similarity(a, b) >= 0.8
            if close_enough:
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return [root(k) for k in range(len(texts))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [prose(k, rng.choice([3, 30, 80, 150])) for k in range(25)]
    for _ in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["new", "other"])
        if rng.random() < 0.2:
            words = words[len(words) // 2:] + words[: len(words) // 2]
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_classes_of_awkward_rows(spark, awkward, nothing):
    got = order_minhash.near_duplicates(awkward)
    assert got.columns == ["doc_id", "class_id"]
    same_rows(got.collect(), [(1, 1), (1, 1), (1, 1), (None, None), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8), (None, 2)])
    kept = order_minhash.one_of_each(awkward)
    assert kept.schema == awkward.schema
    same_rows([r.doc_id for r in kept.select("doc_id").collect()] and kept.select("doc_id").collect(),
              [(1,), (1,), (None,), (2,), (4,), (5,), (6,), (7,), (8,)])
    assert order_minhash.near_duplicates(nothing).count() == 0 and order_minhash.one_of_each(nothing).count() == 0


# language

def test_language_of_held_out_texts(spark):
    rows = run("op10_rank_order_language", spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    judged = rows.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert rows.count() == 200 and sum(r.lang_pred == r.lang for r in judged) >= 0.95 * len(judged)


def test_language_of_awkward_rows(spark, awkward, nothing):
    learn = spark.createDataFrame([("aa", "banana bandana"), ("bb", "zigzag fizz"), ("bb", None), (None, "lost"), ("cc", "123")],
                                  "lang string, text string")
    profiles = language.learn_profiles(learn)
    assert sorted(profiles) == ["aa", "bb"]
    got = language.predict(awkward, profiles).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id in (2, 3, 4)}
    assert {r.lang_pred for r in by.values()} == {"und"} and {r.score for r in by.values()} == {0.0}
    fresh = spark.createDataFrame([(1, "Banana!"), (2, "fizzzig"), (3, "42")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(fresh, profiles).collect()} == {1: "aa", 2: "bb", 3: "und"}
    assert language.predict(nothing, profiles).count() == 0
    assert {r.lang_pred for r in language.predict(awkward, language.learn_profiles(learn.limit(0))).collect()} == {"und"}


def test_grams_of_a_word():
    values, owner = language.grams(["Ab c", "", "a1b"])
    assert len(values) == (3 + 5 + 3) + (2 + 4 + 2) and set(owner) == {0, 2}


def test_suffix_dedup_takes_texts_over_16_mb(spark):
    rng = np.random.default_rng(41)
    long, passage = rng.integers(97, 123, (1 << 24) + 5000).astype(np.uint8), rng.integers(97, 123, 300).astype(np.uint8)
    for at, left, right in ((1000, 48, 49), ((1 << 24) + 2000, 52, 53)):
        long[at: at + 302] = [left, *passage, right]
    once = rng.integers(97, 123, 250).astype(np.uint8)
    long[5_000_000: 5_000_252] = [50, *once, 51]
    rows = [(1, long.tobytes().decode()), (2, "<" + once.tobytes().decode() + ">")]
    got = {r.doc_id: r for r in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"), 200).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == ((1 << 24) + 5000, 850, 3)
    assert (got[2].n_removed, got[2].n_spans) == (250, 1)


@pytest.mark.parametrize("piece", [7, 300])
def test_window_runs_do_not_depend_on_the_piece(monkeypatch, piece):
    rng = np.random.default_rng(42)
    data, offsets = rng.integers(97, 99, 4000).astype(np.uint8), np.array([0, 900, 950, 2500, 4000])
    whole = suffix_dedup.window_runs(data, offsets, 200)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    for a, b in zip(whole, suffix_dedup.window_runs(data, offsets, 200)):
        assert np.array_equal(a, b)


def test_large_finite_components_are_not_dropped_silently(spark):
    def rows(x):
        return spark.createDataFrame([(1, [1.0, 2.0]), (2, [x, 1.0])], "vec_id long, embedding array<double>")

    for x in (float("inf"), float("nan"), None):
        assert [r.id for r in vafile.quantised(rows(x)).collect()] == [1]
    assert sorted(r.id for r in vafile.quantised(rows(2.0**52)).collect()) == [1, 2]
    for x in (2.0**53, -(2.0**60)):
        with pytest.raises(Exception, match="2\\*\\*61 or more"):
            vafile.quantised(rows(x)).collect()


@pytest.mark.parametrize("power", [16, 22, 24, 30])
def test_scores_of_large_components_are_exact(spark, power):
    rng = np.random.default_rng(power)
    rows = [(i, [float(x) for x in rng.integers(-(2**power), 2**power, 6)]) for i in range(200)]
    whole = vafile.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1 if power == 30 else 256)
    scaled = {i: [int(x) * (1 if power == 30 else 256) for x in v] for i, v in rows}
    want = []
    for q in range(0, 200, 20):
        scored = sorted((-sum(a * b for a, b in zip(scaled[q], v)), i) for i, v in scaled.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    if max(abs(r[3]) for r in want) < 2**63:
        same_rows(vafile.top_vectors(whole, whole.filter("id % 20 = 0")).collect(), want)
    else:
        with pytest.raises(Exception, match="beyond 64-bit"):
            vafile.top_vectors(whole, whole.filter("id % 20 = 0")).collect()


def test_scores_that_no_long_holds_fail_clearly(spark):
    rows = spark.createDataFrame([(0, [2.0**39, 1.0]), (1, [2.0**39, 2.0]), (2, [-3.0, 1.0])], "vec_id long, embedding array<double>")
    whole = vafile.quantised(rows)
    with pytest.raises(Exception, match="beyond 64-bit"):
        vafile.top_vectors(whole, whole.filter("id = 0")).collect()
    # wide products that are not among the answers do no harm
    cross = spark.createDataFrame([(0, [2.0**39, 0.0]), (1, [0.0, 5.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    whole = vafile.quantised(cross)
    got = vafile.top_vectors(whole, whole.filter("id = 0")).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**47 * 256), (1, 0)]


def test_clean_phrases_are_a_parameter_of_the_training(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)).encode() + (b" nasty insult" if k % 2 else b"") for k in range(60)]
    labels = np.array([k % 2 for k in range(60)], np.float64)
    full = toxicity.fit(texts, labels)
    monkeypatch.setattr(toxicity, "CLEAN_PHRASES", 1)
    few = toxicity.fit(texts, labels)
    assert len(full.weight) == len(few.weight) and not np.array_equal(full.weight, few.weight)


def test_kneser_ney_arrays_hold_large_counts_and_little_memory(tmp_path, monkeypatch):
    large, small = kneser_ney._least_kind(np.array([1, 2**32])), kneser_ney._least_kind(np.array([[2**32 - 1]]))
    assert large.tolist() == [1, 2**32] and small.dtype == np.dtype("<u4") and small.tolist() == [[2**32 - 1]]
    assert kneser_ney._least_kind(np.zeros(0, np.int64)).tolist() == []
    folder = f"file:{tmp_path}"
    for k in range(4):
        kneser_ney._save(folder, f"a{k}", np.full(100, k))
    mapped = kneser_ney._Arrays(files=2)
    assert [int(mapped(folder, f"a{k % 4}.npy")[0]) for k in range(9)] == [k % 4 for k in range(9)]
    assert len(mapped.open) == 2 and mapped.size == 0 and all(isinstance(a, np.memmap) for a in mapped.open.values())
    monkeypatch.setattr(kneser_ney, "mounted", lambda uri: None)  # as in a store that only readers of its own can open
    remote = kneser_ney._Arrays(held=2000)
    assert [int(remote(folder, f"a{k % 4}.npy")[0]) for k in range(9)] == [k % 4 for k in range(9)]
    assert len(remote.open) == 2 and remote.size == 1600


def test_outlines_rule_out_no_similar_texts(spark):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(60):
        a = rng.integers(0, 2**63, int(rng.integers(1, 900)), np.uint64)
        b = np.where(rng.random(len(a)) < 0.09 * (k % 3), rng.integers(0, 2**63, len(a), np.uint64), a)
        b = order_minhash.occurrences(b if k % 5 else rng.permutation(b)[: max(1, len(b) - k)])
        a = order_minhash.occurrences(a)
        common = len(np.intersect1d(a, b))
        rows.append((len(a), order_minhash.outline(a).tolist(), len(b), order_minhash.outline(b).tolist(), common / (len(a) + len(b) - common)))
    other = order_minhash.occurrences(rng.integers(0, 2**63, 300, np.uint64))
    rows.append((300, order_minhash.outline(other).tolist(), *rows[0][:2], 0.0))
    df = spark.createDataFrame(rows, "na long, oa array<long>, nb long, ob array<long>, s double")
    got = df.select("s", order_minhash._alike("na", "oa", "nb", "ob").alias("kept")).collect()
    assert all(r.kept for r in got if r.s >= order_minhash.SIMILAR) and sum(r.s >= order_minhash.SIMILAR for r in got) > 10
    assert not got[-1].kept and sum(not r.kept for r in got) > 5


def test_a_worker_remembers_a_bounded_number_of_parts(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        encode = token_files.ByteEncoder(f.read())
    texts = [f"word{k} " * 3 for k in range(400)]
    for text in texts:
        got = encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == encode.library.encode(text, add_special_tokens=False).ids
    assert len(encode.cache.new) + len(encode.cache.old) <= 2 * 60
