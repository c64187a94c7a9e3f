"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillworks.functions.vectors import cosine_similarity, embedder, hashed_trigrams
from tillworks.operators import knn
from tillworks.operators.dedup import dedup_items
from tillworks.plans import gold
from tillworks.registry.base import LINES, RECEIPTS, clean_items, clean_receipts, flat, query, ts
from tillworks.session import run_folder
from tillworks.sources import warehouse as wh

_QUERY = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
_SIMILAR = f"""{_QUERY},
scored AS (SELECT vec_id AS sku, label AS category, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS s FROM embeddings)
"""


def query_vector(spark, folder):
    """The vector searched for: that of the first product."""
    return list(wh.product_vectors(spark, folder).filter(F.col("sku") == 0).first()["embedding"])


def _rounded(df, name="similarity"):
    return df.withColumn(name, F.round(name, 6))


@query("cosine_similarity", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(list_reverse(a.embedding) AS DOUBLE[])), 6) AS similarity FROM embeddings a""")
def q_cosine_similarity(spark, folder):
    vectors = wh.table(spark, folder, "embeddings")
    return _rounded(vectors.select("vec_id", cosine_similarity("embedding", F.reverse("embedding")).alias("similarity")))


@query("semantic_search", f"WITH {_SIMILAR} SELECT sku, category, round(s, 6) AS similarity FROM scored WHERE s > 0.3 ORDER BY s DESC, sku LIMIT 10")
def q_semantic_search(spark, folder):
    return _rounded(knn.semantic_search(wh.product_vectors(spark, folder), query_vector(spark, folder)))


@query("semantic_search_ge", f"WITH {_SIMILAR} SELECT sku, category, round(s, 6) AS similarity FROM scored WHERE s >= 0.1 ORDER BY s DESC, sku LIMIT 5")
def q_semantic_search_ge(spark, folder):
    found = knn.semantic_search(wh.product_vectors(spark, folder), query_vector(spark, folder), 0.1, 5, inclusive=True)
    return _rounded(found)


@query("vector_topk", f"WITH {_SIMILAR} SELECT sku, category, round(1 - s, 6) AS distance FROM scored ORDER BY 1 - s, sku LIMIT 20")
def q_vector_topk(spark, folder):
    return _rounded(knn.vector_topk(wh.product_vectors(spark, folder), query_vector(spark, folder), 20), "distance")


@query("category_filtered_search", f"WITH {_SIMILAR} SELECT sku, category, round(s, 6) AS similarity FROM scored WHERE category = 3 AND s > 0.0 ORDER BY s DESC, sku LIMIT 10")
def q_category_filtered_search(spark, folder):
    found = knn.semantic_search(wh.product_vectors(spark, folder), query_vector(spark, folder), 0.0, 10, category=3)
    return _rounded(found)


@query("knn_join", """SELECT query_id, sku, position, round(round(s, 9), 6) AS similarity FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS sku, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 9) DESC, b.vec_id) AS position
  FROM embeddings a, embeddings b, LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s) WHERE s > 0.1)
WHERE position <= 5""")
def q_knn_join(spark, folder):
    corpus = wh.product_vectors(spark, folder)
    queries = corpus.select(F.col("sku").alias("query_id"), F.col("embedding").alias("vector"))
    found = knn.knn_join(queries, corpus, k=5, threshold=0.1)
    return _rounded(found.withColumn("position", F.col("position").cast("bigint")))


def indexed(spark, folder):
    corpus = wh.product_vectors(spark, folder)
    centres = knn.nearest_cells(corpus, cells=16)
    return knn.assign_cells(corpus, centres), centres


@query("cell_search", f"WITH {_SIMILAR} SELECT sku, category, round(s, 6) AS similarity FROM scored WHERE s > 0.3 ORDER BY s DESC, sku LIMIT 10")
def q_cell_search(spark, folder):
    cells, centres = indexed(spark, folder)
    return _rounded(knn.cell_search(cells, centres, query_vector(spark, folder)))


@query("ann_lsh", f"""WITH {_SIMILAR},
planes AS (SELECT p, list_transform(range(0, 64), lambda d: CASE WHEN (d + 1) * (p + 3) * 2654435761 % 4294967296 >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS signs FROM range(0, 80) t(p)),
sides AS (SELECT vec_id, p // 4 AS tab, sum(CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), signs) >= 0 THEN 1 << (p % 4)::INTEGER ELSE 0 END) AS bucket
          FROM embeddings, planes GROUP BY 1, 2),
met AS (SELECT DISTINCT s.vec_id FROM sides s JOIN sides q ON q.vec_id = 0 AND q.tab = s.tab AND q.bucket = s.bucket)
SELECT sku, category, round(s, 6) AS similarity FROM scored JOIN met ON vec_id = sku WHERE s > 0.3 ORDER BY s DESC, sku LIMIT 10""")
def q_ann(spark, folder):
    root = run_folder(spark, "lsh")
    query = query_vector(spark, folder)
    knn.write_lsh_index(wh.product_vectors(spark, folder), root, len(query))
    return _rounded(knn.ann_lsh(spark.read.parquet(root), query))


_PROBED = """planes AS (SELECT p, list_transform(range(0, 64), lambda d: CASE WHEN (d + 1) * (p + 3) * 2654435761 % 4294967296 >= 2147483648 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS signs FROM range(0, 320) t(p)),
dots AS (SELECT vec_id, p // 8 AS tab, p % 8 AS plane, list_inner_product(CAST(embedding AS DOUBLE[]), signs) AS d FROM embeddings, planes),
codes AS (SELECT vec_id, tab, sum(CASE WHEN d >= 0 THEN 1 << (7 - plane)::INTEGER ELSE 0 END)::BIGINT AS code FROM dots GROUP BY 1, 2),
nearest AS (SELECT vec_id, tab, plane FROM dots QUALIFY row_number() OVER (PARTITION BY vec_id, tab ORDER BY abs(d), plane) <= 3),
probes AS (SELECT * FROM codes UNION ALL SELECT vec_id, tab, xor(code, (1 << (7 - plane)::INTEGER)::BIGINT) FROM codes JOIN nearest USING (vec_id, tab)),
met AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS sku FROM probes q JOIN codes c ON c.tab = q.tab AND c.code = q.code),
compared AS (
  SELECT query_id, sku, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
  FROM met JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = sku)
"""


def joined(spark, folder, **options):
    corpus = wh.product_vectors(spark, folder)
    queries = corpus.select(F.col("sku").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.knn_join_lsh(queries, corpus, len(query_vector(spark, folder)), k=5, threshold=0.1, **options)


@query("knn_join_lsh", f"""WITH {_PROBED}
SELECT query_id, sku, position, round(s, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, sku) AS position FROM compared WHERE s > 0.1)
WHERE position <= 5""")
def q_knn_join_lsh(spark, folder):
    return _rounded(joined(spark, folder).withColumn("position", F.col("position").cast("bigint")))


_MATCHES = f"""{_SIMILAR}, {LINES}, {RECEIPTS},
matches AS (SELECT sku, s FROM scored WHERE s >= 0.1 ORDER BY s DESC, sku LIMIT 5),
held AS (SELECT DISTINCT m.sku, r.transaction_id, r.transaction_ts, r.store_name, r.customer_id, r.total_cents
         FROM matches m JOIN lines l ON l.sku = m.sku JOIN receipts r ON r.transaction_id = l.transaction_id)
"""


def matched(spark, folder):
    vectors = wh.product_vectors(spark, folder)
    return knn.semantic_search(vectors, query_vector(spark, folder), 0.1, 5, inclusive=True).drop("category")


def _lines(spark, folder):
    """Clean lines of the matched products: only lines that ever held one of them are deduplicated."""
    raw = wh.raw_items(spark, folder, with_product=False)
    keys = raw.join(matched(spark, folder).select("sku"), "sku", "left_semi").select("transaction_id", "item_seq").distinct()
    return dedup_items(raw.join(keys, ["transaction_id", "item_seq"], "left_semi").select(*raw.columns))


@query("semantic_receipts", f"""WITH {_MATCHES}
SELECT m.sku, round(m.s, 6) AS similarity, h.transaction_id, {ts('h.transaction_ts')} AS transaction_ts, h.store_name, h.total_cents
FROM matches m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY transaction_ts DESC, transaction_id) AS rn FROM held) h
  ON h.sku = m.sku AND rn <= 5""")
def q_semantic_receipts(spark, folder):
    rows = knn.semantic_receipts(matched(spark, folder), _lines(spark, folder), clean_receipts(spark, folder))
    return flat(_rounded(rows.select("sku", "similarity", "transaction_id", "transaction_ts", "store_name", "total_cents")))


@query("semantic_receipts_customer", f"""WITH {_MATCHES}
SELECT m.sku, h.transaction_id, h.total_cents
FROM matches m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY transaction_ts DESC, transaction_id) AS rn FROM held WHERE customer_id = 101) h
  ON h.sku = m.sku AND rn <= 3""")
def q_semantic_receipts_customer(spark, folder):
    rows = knn.semantic_receipts(matched(spark, folder), _lines(spark, folder), clean_receipts(spark, folder), customer_id=101)
    return rows.select("sku", "transaction_id", "total_cents")


@query("distinct_receipts", f"WITH {_MATCHES} SELECT sku, transaction_id, total_cents FROM held")
def q_distinct_receipts(spark, folder):
    held = knn.distinct_receipts(_lines(spark, folder), clean_receipts(spark, folder), matched(spark, folder))
    return held.select("sku", "transaction_id", "total_cents")


@query("embedding_join", f"WITH {_MATCHES} SELECT sku, transaction_id, store_name FROM held WHERE store_name ILIKE 'nation_1%' AND transaction_ts > TIMESTAMP '1997-01-01'")
def q_embedding_join(spark, folder):
    rows = knn.embedding_join(
        matched(spark, folder), _lines(spark, folder), clean_receipts(spark, folder), "nation_1", "1997-01-01"
    )
    return rows.select("sku", "transaction_id", "store_name")


@query("generate_embeddings", """SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, p_name || ' | ' || p_type AS search_text, 64 AS dims,
  CAST(greatest(length(p_name || ' | ' || p_type), 1) AS BIGINT) AS grams FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def q_generate_embeddings(spark, folder):
    catalog = gold.product_catalog_latest(gold.product_catalog(clean_items(spark, folder)))
    vectors = knn.generate_embeddings(catalog, hashed_trigrams)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double")).cast("bigint")
    return vectors.select("sku", "product_name", "search_text", F.size("embedding").alias("dims"), total.alias("grams"))


def _letter_counts(texts):
    return [[float(text.lower().count(letter)) for letter in "aeiou"] for text in texts]


@query("embed_udf", """SELECT p_partkey, list_aggregate(list_transform(['a', 'e', 'i', 'o', 'u'],
  lambda v: length(lower(p_name)) - length(replace(lower(p_name), v, ''))), 'string_agg', '|') AS vector FROM part""")
def q_embed_udf(spark, folder):
    parts = wh.table(spark, folder, "part").select("p_partkey", embedder(_letter_counts)(F.col("p_name")).alias("v"))
    return parts.select("p_partkey", F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), "|").alias("vector"))
