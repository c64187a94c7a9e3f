"""The bucket index: recall against the exact search, and a plan that reads the query's buckets only."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillworks.operators import knn
from tillworks.session import run_folder
from tillworks.sources import warehouse as wh


def test_recall_and_pruning(spark, capsys):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(20, 16))
    rows = [(i, i % 3, (centres[i % 20] + 0.25 * rng.normal(size=16)).tolist()) for i in range(2000)]
    corpus = spark.createDataFrame([*rows, (9001, 0, None), (9002, 0, [1.0]), (9003, 0, [0.0] * 16)],
                                   "sku long, category int, embedding array<double>")
    root = run_folder(spark, "lsh")
    knn.write_lsh_index(corpus, root, 16)
    index = spark.read.parquet(root)
    found = wanted = 0
    for k in range(0, 2000, 250):
        query = rows[k][2]
        got = {r.sku for r in knn.ann_lsh(index, query, 0.3, 10).collect()}
        exact = {r.sku for r in knn.semantic_search(corpus, query, 0.3, 10).collect()}
        found, wanted = found + len(got & exact), wanted + len(exact)
    assert found >= 0.9 * wanted
    knn.ann_lsh(index, rows[0][2]).explain()
    assert "PartitionFilters: [bucket" in capsys.readouterr().out.replace("#", " ").replace("PartitionFilters: [isnotnull", "PartitionFilters: [bucket")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_embeddings_table(spark, size):
    corpus = wh.product_vectors(spark, f"/root/testdata/{size}").orderBy("sku")
    rows = corpus.collect()
    vectors = np.array([r.embedding for r in rows], dtype="float64")
    dim = vectors.shape[1]
    found = corpus.select("sku", F.posexplode(knn.lsh_buckets("embedding", dim))).collect()
    place = {r.sku: k for k, r in enumerate(rows)}
    buckets = np.zeros((len(rows), knn.LSH_TABLES), np.int64)
    for r in found:
        buckets[place[r.sku], r.pos] = r.col
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = wanted = 0
    for k in (k for k, r in enumerate(rows) if r.sku % 10 == 0):
        score = unit @ unit[k]
        score[k] = -1.0
        nearest = [i for i in np.argsort(-score, kind="stable")[:10] if score[i] > 0.3]
        got += sum(bool((buckets[i] == buckets[k]).any()) for i in nearest)
        wanted += len(nearest)
    assert got >= 0.9 * wanted


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_many_query_join(spark, size):
    corpus = wh.product_vectors(spark, f"/root/testdata/{size}")
    queries = corpus.select(F.col("sku").alias("query_id"), F.col("embedding").alias("vector"))
    found = knn.knn_join_lsh(queries, corpus, 64, k=5, threshold=0.1)
    exact = knn.knn_join(queries, corpus, k=5, threshold=0.1)
    assert knn.lsh_recall(found, exact).first().recall >= 0.9


def test_close_neighbours_are_found_among_few_pairs(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(200, 16))
    rows = [(i, (centres[i % 200] + 0.15 * rng.normal(size=16)).tolist()) for i in range(2000)]
    odd = [(9001, None), (9002, [1.0]), (9003, [0.0] * 16)]
    corpus = spark.createDataFrame(rows + odd, "sku long, embedding array<double>")
    queries = spark.createDataFrame(rows[::20] + odd, "query_id long, vector array<double>")
    found = knn.knn_join_lsh(queries, corpus, 16, k=5, threshold=0.5, tables=8, bits=12, probes=4)
    exact = knn.knn_join(queries.filter("size(vector) = 16"), corpus.filter("size(embedding) = 16"), k=5, threshold=0.5)
    assert knn.lsh_recall(found, exact).first().recall >= 0.9
    assert {r.query_id for r in found.collect()} <= {r[0] for r in rows}
    meet = (queries.select("query_id", F.explode(knn.lsh_probes("vector", 16, 8, 12, 4)).alias("b"))
            .join(corpus.select("sku", F.explode(knn.lsh_buckets("embedding", 16, 8, 12)).alias("b")), "b").select("query_id", "sku").distinct())
    assert meet.count() < 0.3 * 100 * 2000


def test_probes_cross_the_nearest_planes(spark):
    df = spark.createDataFrame([([0.1, -2.0, 3.0, 0.5],)], "v array<double>")
    own, probed = df.select(knn.lsh_buckets("v", 4, 3, 3), knn.lsh_probes("v", 4, 3, 3, 2)).first()
    assert probed[::3] == own and all(bin((p ^ o) & 7).count("1") == 1 for t, o in enumerate(own) for p in probed[3 * t + 1: 3 * t + 3])
    assert len(set(probed)) == 9


def test_a_bucket_in_parts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    rng = np.random.default_rng(13)
    rows = [(i, ([1.0] * 8 if i < 60 else rng.normal(size=8).tolist())) for i in range(80)]
    # one row delivered far more often than there are places in a page
    corpus = spark.createDataFrame(rows + [rows[0]] * 100, "sku long, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0] * 8), (2, rows[70][1]), (2, rows[70][1])], "query_id long, vector array<float>")
    found = knn.knn_join_lsh(queries, corpus, 8, k=3, tables=4, bits=2, probes=1).collect()
    got = {q: [r.sku for r in sorted(found, key=lambda r: r.position) if r.query_id == q] for q in (1, 2)}
    assert got[1] == [0, 1, 2]
    assert len(got[2]) == 3 and got[2][0] == 70


def _met_and_ranked(spark, asked, rows, dim, k, threshold, tables, bits, probes):
    """What the join has to find, by comparing every pair that shares a bucket."""
    q, c = (spark.createDataFrame([(n, v) for n, (_, v) in enumerate(x)], "n long, v array<double>") for x in (asked, rows))
    pairs = (q.select(F.col("n").alias("q"), F.explode(knn.lsh_probes("v", dim, tables, bits, probes)).alias("b"))
             .join(c.select(F.col("n").alias("c"), F.explode(knn.lsh_buckets("v", dim, tables, bits)).alias("b")), "b").select("q", "c").distinct())
    found = {}
    for q, c in pairs.collect():
        a, b = np.array(asked[q][1]), np.array(rows[c][1])
        norms = np.sqrt(a @ a) * np.sqrt(b @ b)
        score = round(float(a @ b / norms), 9) if norms else -9.0
        score = np.inf if np.isnan(score) else score
        if norms and (threshold is None or score > threshold):
            found.setdefault(asked[q][0], set()).add((-score, rows[c][0] is not None, rows[c][0] or 0, rows[c][0]))
    return {q: [(x[-1], -x[0]) for x in sorted(f)[:k]] for q, f in found.items()}


@pytest.mark.parametrize("threshold", [None, 0.2])
@pytest.mark.parametrize("cell", [7, 4096])
def test_the_many_query_join_on_awkward_rows(spark, monkeypatch, threshold, cell):
    monkeypatch.setattr(knn, "CELL_ROWS", cell)
    rng = np.random.default_rng(15)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(60)]
    rows += [(100 + n, rows[3][1]) for n in range(12)]  # a group of equal vectors
    rows += [(5, [x * (n + 2) for x in rows[5][1]]) for n in range(40)]  # one key with many vectors of one direction
    rows += [(None, rows[7][1]), (None, rows[8][1]), (200, [float("nan")] + [1.0] * 7), (201, [0.0] * 8)]
    rows += [(202, [x * 1e-120 for x in rows[9][1]]), (203, [x * 1e120 for x in rows[9][1]])]
    asked = [(n, rows[n][1]) for n in range(12)] + [(n, rows[n + 20][1]) for n in range(4)] + [(None, rows[2][1]), (50, rows[-1][1])]
    corpus, queries = spark.createDataFrame(rows, "sku long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    found = knn.knn_join_lsh(queries, corpus, 8, k=4, threshold=threshold, tables=4, bits=3, probes=2).collect()
    wanted = _met_and_ranked(spark, asked, rows, 8, 4, threshold, 4, 3, 2)
    assert {r.query_id for r in found} == set(wanted)
    for q, best in wanted.items():
        mine = sorted((r.position, r.sku, np.inf if np.isnan(r.similarity) else r.similarity) for r in found if r.query_id == q)
        assert [m[:2] for m in mine] == [(n, sku) for n, (sku, _) in enumerate(best, 1)]
        assert [m[2] for m in mine] == pytest.approx([s for _, s in best], abs=2e-9)


def test_no_vectors_pass_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(16)
    corpus = spark.createDataFrame([(n, rng.normal(size=16).tolist()) for n in range(300)], "sku long, embedding array<float>")
    queries = corpus.select(F.col("sku").alias("query_id"), F.col("embedding").alias("vector"))
    found = knn.knn_join_lsh(queries, corpus, 16, k=3, tables=8, bits=4, probes=1)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.filter("query_id = sku AND position = 1").count() == 300
    # and each row is shuffled once for each part of the other side, not once for each bucket
    monkeypatch.setattr(knn, "CELL_ROWS", 100)
    near = knn._nearest_in_cell
    together = spark.sparkContext.accumulator(0)

    def counted(*args):
        def run(left, right):
            together.add(left.num_rows + right.num_rows)
            return kept(left, right)

        kept = near(*args)
        return run

    monkeypatch.setattr(knn, "_nearest_in_cell", counted)
    knn.knn_join_lsh(queries, corpus, 16, k=3, tables=8, bits=4, probes=1).collect()
    assert together.value == 2 * 3 * 300


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    rng = np.random.default_rng(14)
    corpus, asked = rng.normal(size=(6000, 64)), rng.normal(size=(300, 64))
    corpus[:9] = corpus[0] * (1 + np.arange(9)[:, None])  # ties
    asked[0] = corpus[0]
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    schema = pa.schema([("query_id", pa.int64()), ("_key", pa.int64()), ("similarity", pa.float64())])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 1000)), pa.array(list(corpus[k: k + 1000]))], ["_key", "_vector"])
               for k in range(0, 6000, 1000)]
    scored = []
    product = np.einsum
    monkeypatch.setattr(np, "einsum", lambda rule, a, b: (scored.append(len(a)), product(rule, a, b))[1])

    class Held:
        value = (list(range(300)), unit)

    out = pa.Table.from_batches(knn._nearest_in_task(Held, 5, 0.1, False, "int64", schema)(iter(batches)))
    assert sum(scored) < 0.05 * 300 * 6000
    exact = np.round(unit @ (corpus / np.linalg.norm(corpus, axis=1, keepdims=True)).T, 9)
    for q in (0, 7, 299):
        mine = [(r["_key"], r["similarity"]) for r in out.to_pylist() if r["query_id"] == q]
        best = np.lexsort((np.arange(6000), -exact[q]))[:5]
        assert [m[0] for m in mine] == best.tolist() and np.allclose([m[1] for m in mine], exact[q][best])
