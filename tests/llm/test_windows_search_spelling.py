"""Repeated windows, ranked search and spelling variants against SQL and brute force, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import AWKWARD, EXTRA, FOLDER, prose, same_rows
from tests.oracle import compare, connect
from tillworks.llm import queries, ranked_search, spelling, window_dedup


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(d, t, 9, "id", 8, "s", 7, 6, "k") for d, t in AWKWARD], EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.mark.parametrize("name", ["op11_count_min_windows", "op12_interval_maxima"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.QUERIES[name], queries.SQL[name], FOLDER) is None


# repeated windows

def brute_windows(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = [float("inf") if d is None else d for d, _ in rows]
    first = {}
    for d, w in zip(key, words):
        for k in range(len(w) - 12):
            x = tuple(w[k: k + 13])
            first[x] = min(first.get(x, d), d)
    out = []
    for (d, _), i, w in zip(rows, key, words):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k: k + 13])] < i:
                gone[k: k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_windows_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.randrange(-20, 200), prose(k, rng.choice([5, 12, 13, 14, 60]))) for k in range(80)]
    for _ in range(120):
        a, b = rng.choice(rows)[1].split(), rng.choice(rows)[1].split()
        at, to, n = rng.randrange(len(a)), rng.randrange(len(b)), rng.choice([12, 13, 20])
        rows.append((rng.choice([None, rng.randrange(300)]), " \t".join(b[:to] + a[at: at + n] + b[to:])))
    rows += [(k % 40, "Common " * 6 + "passage of thirteen words that one third of all documents holds" + f" tail{k % 7}") for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same_rows([tuple(r) for r in window_dedup.window_digests(docs).collect()], brute_windows(rows))


def test_windows_of_awkward_rows(spark, awkward, nothing):
    same_rows([tuple(r) for r in window_dedup.window_digests(awkward).collect()], brute_windows(AWKWARD))
    long = "one two three four five six seven eight nine ten eleven twelve  thirteen"
    docs = spark.createDataFrame([(2, long + " Tail", 5), (1, long, 6), (None, long.replace(" ", "\n"), 7), (3, long.title(), 8)],
                                 "doc_id int, text string, words int")
    cut = window_dedup.without_windows(docs)
    assert cut.schema == docs.schema
    same_rows([tuple(r) for r in cut.collect()], [(2, "Tail", 5), (1, long, 6), (None, "", 7), (3, long.title(), 8)])
    kept = window_dedup.without_windows(awkward)
    assert kept.schema == awkward.schema
    same_rows([(r.doc_id, r.text) for r in kept.collect()], AWKWARD)
    assert window_dedup.window_digests(nothing).count() == window_dedup.without_windows(nothing).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        window_dedup.window_digests(docs.selectExpr("cast(doc_id as string) doc_id", "text"))


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(3)
    chunks = [np.unique(rng.integers(0, 64, 20)) for _ in range(5)]
    twice = [rng.random(len(c)) < 0.1 for c in chunks]
    rows = {"span": [6] * 5, "cells": [window_dedup.narrow(np.diff(c.astype(np.uint64), prepend=np.uint64(0))) for c in chunks],
            "twice": [np.packbits(t).tobytes() for t in twice]}
    count = collections.Counter()
    for c, t in zip(chunks, twice):
        count.update(dict(zip(c.tolist(), (1 + t).tolist())))
    for c, hits in zip(chunks, window_dedup._merged(rows)):
        assert hits.tolist() == [count[x] >= 2 for x in c.tolist()]


# ranked search

def test_search_equals_sums_over_documents():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n_docs, n_terms = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        pair = np.unique(rng.integers(0, n_docs * n_terms, rng.integers(1, n_docs * n_terms // 2 + 2)))
        term, doc = pair % n_terms, pair // n_terms
        impact = rng.integers(0, rng.choice([3, 1000]), len(pair))
        items = ranked_search.Items([0, 1, 2], ["", None, ""])
        asked = [np.unique(rng.integers(0, n_terms, rng.integers(0, 5))) for _ in range(3)]
        items.term = np.concatenate(asked).astype(np.int64)
        items.times = rng.integers(1, 3, len(items.term))
        items.begin = np.cumsum([0, *map(len, asked)])
        keys = np.sort(rng.integers(0, 1000, n_docs))
        best = ranked_search.Best(3, 5)
        ranked_search.search(ranked_search.Shard(term, doc, impact, n_terms, n_docs), items, best, keys)
        for i in range(3):
            sums = np.zeros(n_docs, np.int64)
            for t, times in zip(asked[i], items.times[items.begin[i]:]):
                np.add.at(sums, doc[term == t], impact[term == t] * times)
            want = sorted((-s, k) for s, k in zip(sums.tolist(), keys.tolist()) if s > 0)[:5]
            assert sorted(zip((-best.score[best.item == i]).tolist(), best.key[best.item == i].tolist())) == want


def brute_ranks(rows, items, k):
    def terms(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    docs = [(d, collections.Counter(terms(t)), len(terms(t))) for d, t in rows if terms(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in docs:
            m = 75 + 25 * size * n // total
            score = sum(int(1000 * np.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def test_ranks_of_awkward_rows(spark, awkward, nothing, monkeypatch):
    asked = [(1, "plain TEXT, text here"), (1, "plain TEXT, text here"), (2, None), (3, "!?"), (4, "word ünï"), (None, "id AT a"), (5, "unseen")]
    items = spark.createDataFrame([(i, t, 0) for i, t in asked], "item_id int, text string, rank int")
    for block in (5000, 2):
        monkeypatch.setattr(ranked_search, "ITEMS", block)
        got = ranked_search.rank_documents(awkward, items, 3)
        assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
        same_rows([tuple(r) for r in got.collect()], brute_ranks(AWKWARD, asked, 3))
    assert ranked_search.rank_documents(nothing, items).count() == ranked_search.rank_documents(awkward, items.limit(0)).count() == 0


def test_tied_copies_go_by_id(spark):
    rows = [(k, "same words here") for k in range(300)] + [(1000, "same"), (1001, "other things")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    items = spark.createDataFrame([(7, "same words")], "item_id long, text string")
    same_rows([tuple(r) for r in ranked_search.rank_documents(docs, items).collect()], brute_ranks(rows, [(7, "same words")], 20))


# spelling variants

def brute_variants(rows):
    count = collections.Counter()
    lower = {i: i + 32 for i in range(65, 91)}
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(lower)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1:]
            count[w] += len(w) >= 5
    words = {w: n for w, n in count.items() if n >= 3}
    near = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            near[w[:k] + "\0" + w[k + 1:]].add(w)
    close = {w: {x for k in range(len(w)) for x in near[w[:k] + "\0" + w[k + 1:]]} - {w} for w in words}
    for w in words:
        for k in range(len(w)):
            x = w[:k] + w[k + 1:]
            if x in words:
                close[w].add(x)
                close[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return out


def test_variants_of_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    same_rows([tuple(r) for r in queries.QUERIES["op13_frequency_trie"](spark, FOLDER).collect()], brute_variants(rows))


def test_variants_of_made_up_words(spark, monkeypatch):
    rng = random.Random(13)
    texts = []
    for base in ("abcde", "señoría", "aaaaa", "zyxwvuts", "thesaurus", "éàüöñ"):
        for _ in range(60):
            word = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(word) + 1)
                word[at: at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "q"])
            texts.append(" ".join(["".join(word).title()] * rng.choice([1, 2, 3, 9])))
    rows = list(enumerate(texts)) + [(None, "thesaurus Étude×étude 3x3 Thesaurus"), (7, None), (8, ""), (9, "w" * 300), (9, "w" * 300), (9, "w" * 300),
                                     (10, " ".join(["w" * 301] * 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert max(len(r[0]) for r in want) == 301 and any(r[1] and r[1] != r[2] for r in want)
    for node in (spelling.NODE_WORDS, 3):
        monkeypatch.setattr(spelling, "NODE_WORDS", node)
        same_rows([tuple(r) for r in spelling.spelling_variants(docs).collect()], want)


def test_variants_of_awkward_rows(spark, awkward, nothing):
    same_rows([tuple(r) for r in spelling.spelling_variants(awkward).collect()], brute_variants(AWKWARD))
    assert spelling.spelling_variants(nothing).count() == 0


def test_reached_nodes_hold_each_pair_once():
    words = ["".join(w) for w in itertools.product("abc", repeat=5)]
    group = np.array([min(abs(c - 97), 3) for c in range(256)])
    members = spelling.Words(words, group, 4)
    trie = spelling.Trie(members.vectors)
    x, y = trie.reach(members.vectors, 1, 1)
    assert len(set(zip(x.tolist(), y.tolist()))) == len(x)
    for i, j in itertools.combinations(range(len(members.vectors)), 2):
        diff = members.vectors[j].astype(int) - members.vectors[i]
        reachable = sorted(diff[diff != 0].tolist()) == [-1, 1]
        assert reachable == (((i, j) in set(zip(x.tolist(), y.tolist()))) or ((j, i) in set(zip(x.tolist(), y.tolist()))))


def test_checksums_equal_library():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = np.array([0, 5, 6, 100, 900])
    stops = np.array([5, 6, 40, 400, 3000])
    begin = np.array([zlib.crc32(str(k).encode()) for k in range(5)], np.uint32)
    want = [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, stops, begin)]
    assert spelling.checksums(data, starts, stops, begin).tolist() == want


def test_packed_numbers():
    for values in ([], [0], [255, 0], [2**40, 1], [2**64 - 1, 3]):
        x = np.array(values, np.uint64)
        assert np.array_equal(window_dedup.widened(window_dedup.narrow(x)), x)
