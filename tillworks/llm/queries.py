"""The operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import (
    decontaminate,
    kneser_ney,
    language,
    order_minhash,
    quality,
    ranked_search,
    sentencepiece_bpe,
    spelling,
    suffix_dedup,
    token_files,
    toxicity,
    vafile,
    window_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies: the folder in TOKENIZER_DIR, else the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> bytes:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@query
def op1_vector_approximation(spark: SparkSession, folder: str) -> DataFrame:
    vectors = vafile.landed(vafile.quantised(table(spark, folder, "embeddings")), "va-vectors")
    return vafile.top_vectors(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


SQL["op1_vector_approximation"] = """
WITH fit AS (
  SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM fit q JOIN fit c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""


@query
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, folder, "documents"), piece_model())


@query
def op3_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def toxicity_machine(spark: SparkSession, docs: DataFrame, folder: str) -> toxicity.KernelMachine:
    sample = quality.labelled_sample(table(spark, folder, "labels"), "toxic", ~language.held_out("doc_id", 3, 1), toxicity.SAMPLE)
    return toxicity.train(docs, sample)


@query
def op4_string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity_machine(spark, docs, folder))
    return found.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language.held_out("doc_id", 10, 0)
    found = kneser_ney.score(docs, kneser_ney.train(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    sample = quality.labelled_sample(table(spark, folder, "labels"), "quality", ~language.held_out("doc_id", 3, 1), quality.SAMPLE)
    found = quality.score(docs, quality.train(docs, sample))
    return found.select("doc_id", language.held_out("doc_id", 3, 1).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_suffix_radix_sort(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, folder, "documents"), 200)


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        spec = file.read()
    written = token_files.write_token_files(table(spark, folder, "documents"), spec, 0)
    return token_files.token_file_digests(spark, written)


@query
def op9_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_rank_order_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language.held_out("doc_id", 5, 0)
    profiles = language.learn_profiles(docs.filter(~out))
    found = language.predict(docs, profiles)
    return found.select("doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query
def op11_count_min_windows(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.window_digests(table(spark, folder, "documents"))


SQL["op11_count_min_windows"] = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc, doc_id, pos, array_to_string(w[pos : pos + 12], ' ') AS win
  FROM (SELECT doc, doc_id, w, unnest(range(1, len(w) - 11)) AS pos FROM words WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc, pos + step AS pos
  FROM windows JOIN firsts USING (win), (SELECT unnest(range(13)) AS step)
  WHERE doc_id > first),
each_word AS (SELECT doc, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words),
kept AS (
  SELECT e.doc, count(*) AS n, string_agg(word, ' ' ORDER BY e.pos) AS text
  FROM each_word e ANTI JOIN gone g ON e.doc = g.doc AND e.pos = g.pos GROUP BY e.doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc)
"""


@query
def op12_interval_maxima(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL["op12_interval_maxima"] = """
WITH found AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
sizes AS (SELECT doc, doc_id, len(t) AS n FROM found WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM found) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (
  SELECT item_id, item, term, count(*) AS times
  FROM (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, item, term),
scored AS (
  SELECT item_id, item, doc_id, doc, sum(times * CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))))) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN sizes USING (doc), total
  GROUP BY item_id, item, doc_id, doc)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""


@query
def op13_frequency_trie(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))
