"""Exact nearest vectors by inner product with a vector-approximation file.

Integer vectors are stored in blocks: coarse cells of CELL_BITS bits a component beside the exact values. A first scan reads the
cells only; a cell's corner and width bound each inner product from both sides, and the k-th largest lower bound over all
blocks is a floor for the k-th score. The second scan visits, best upper bound first, the exact vectors that can still reach
the floor and stops as soon as the next upper bound is below the k-th exact score.

Queries go in blocks too, so that a task sees a block of vectors against a block of queries: a stated query set against all
rows. Equal vectors are answered once, and of equal candidates only the k + 1 smallest ids can matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import landed

CELL_BITS = 4
VECTOR_BLOCK = 8192
QUERY_BLOCK = 512
CHUNK = 64
#: Bound of a scaled component, so that differences of two stay within 64 bits.
LARGEST = 2.0**61


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v array<long>: floor(scale * x) of each component; null vectors or components, non-finite ones, and empty vectors
    are left out. Of rows with the same id the greatest vector stands. A finite component whose scaled value reaches LARGEST
    fails the query, as no whole number of 64 bits would hold its products."""
    x = F.col(vector_col).cast("array<double>")
    large = F.raise_error(F.lit("a scaled vector component of 2**61 or more is beyond 64-bit whole numbers"))
    whole = F.transform(x, lambda c: F.when(F.abs(F.lit(float(scale)) * c) < F.lit(LARGEST), F.floor(F.lit(float(scale)) * c)).otherwise(large.cast("long")))
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
            .groupBy("id").agg(F.max("v").alias("v")))


def _blocks(rows: DataFrame, id_name: str, size: int) -> DataFrame:
    """(dim, block, ids, values): vectors of one length packed in blocks of about `size` rows, as little-endian 64-bit."""
    counts = rows.groupBy(F.size("v").cast("long").alias("dim")).agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    dealt = (rows.withColumn("dim", F.size("v").cast("long")).join(counts, "dim")
             .withColumn("block", F.pmod(F.xxhash64(id_name), F.col("blocks"))))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column(id_name).combine_chunks().to_numpy()
        flat = table.column("v").combine_chunks().flatten().to_numpy().astype("<i8")
        order = np.argsort(ids, kind="stable")
        dim = key[0].as_py()
        return pa.table({"dim": [dim], "block": [key[1].as_py()], "blocks": [table.column("blocks")[0].as_py()],
                         "ids": [ids[order].astype("<i8").tobytes()],
                         "exact": [flat.reshape(-1, dim)[order].tobytes()]})

    return (dealt.select("dim", "block", "blocks", id_name, "v").groupBy("dim", "block")
            .applyInArrow(packed, "dim long, block long, blocks long, ids binary, exact binary"))


def _as(value, dim: int = 1) -> np.ndarray:
    flat = np.frombuffer(value.as_buffer(), "<i8")
    return flat.reshape(-1, dim) if dim > 1 else flat


def top_vectors(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query with the other vectors.

    Both inputs are (id long, v array<long>) without nulls and with unique ids. A vector of a query's own id is no candidate;
    ties go to the smaller id; vectors of different length do not meet; fewer candidates give fewer rows; an empty input
    gives none. Scores are exact: where product sums can pass 2**53 the bounds are widened by what doubles may be off, and where
    they can pass 2**63 they are added up in numbers of any size. A score among the answers that 64 bits cannot hold fails the query.
    """
    keep = k + 1
    distinct = Window.partitionBy("v").orderBy("id")
    candidates = (vectors.withColumn("nth", F.row_number().over(distinct)).filter(F.col("nth") <= keep).drop("nth"))
    asked = landed(queries.select(F.col("id").alias("query_id"), "v"), "va-queries")
    forms = asked.groupBy("v").agg(F.min("query_id").alias("form"))

    limits = (candidates.select(F.size("v").cast("long").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at")
              .agg(F.min("x").alias("low"), F.max("x").alias("high")))
    # a row for each component, whatever the number of vectors
    grid: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in limits.orderBy("dim", "at").collect():
        low, width = grid.setdefault(r.dim, ([], []))
        low.append(r.low)
        width.append((r.high - r.low + (1 << CELL_BITS)) >> CELL_BITS)
    grid = {d: (np.array(low, np.int64), np.array(width, np.int64)) for d, (low, width) in grid.items()}
    # the greatest a sum of products can be, by length of the vectors
    reach: dict[int, int] = {}
    tops = (asked.select(F.size("v").cast("long").alias("dim"), F.posexplode("v").alias("at", "x")).groupBy("dim", "at")
            .agg(F.max(F.abs("x")).alias("q")).join(limits, ["dim", "at"]))
    for r in tops.collect():
        reach[r.dim] = reach.get(r.dim, 0) + r.q * max(abs(r.low), abs(r.high))
    off = {d: 0.0 if top < 2**53 else (d + 16) * 2.0**-51 * float(top) for d, top in reach.items()}

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, exact in zip(batch.column(0).to_pylist(), batch.column(4)):
                low, width = grid[dim]
                cell = ((_as(exact, dim).reshape(-1, dim) - low) // width).astype(np.uint8)
                if dim % 2:
                    cell = np.pad(cell, ((0, 0), (0, 1)))
                cells.append((cell[:, ::2] | cell[:, 1::2] << 4).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())],
                                             names=["dim", "block", "blocks", "ids", "exact", "cells"])

    small = "dim long, block long, blocks long, ids binary, exact binary"
    file = landed(_blocks(candidates, "id", VECTOR_BLOCK).repartition("dim", "block")
                  .mapInArrow(approximate, f"{small}, cells binary"), "va-file")
    blocks = file.groupBy("dim").agg(F.max("blocks").alias("blocks"))
    asking = landed(
        _blocks(forms.withColumnRenamed("form", "id"), "id", QUERY_BLOCK)
        .select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("exact").alias("queries"))
        .join(blocks, "dim").select("dim", "query_block", "query_ids", "queries",
                                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")), "va-asking")

    def bounds(dim: int, cells, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inner products of corners, by query, and how much they can grow or shrink within a cell."""
        low, width = grid[dim]
        two = np.frombuffer(cells.as_buffer(), np.uint8).reshape(-1, (dim + 1) // 2)
        cell = np.empty((len(two), 2 * two.shape[1]), np.float64)
        cell[:, ::2], cell[:, 1::2] = two & 15, two >> 4
        corner = low + cell[:, :dim] * width
        return queries @ corner.T, queries * (width - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 greatest lower bounds of each query in each block."""
        for batch in batches:
            for dim, block, ids, asked_v, cells in zip(*[c.to_pylist() for c in batch.columns[:2]], *batch.columns[2:]):
                q = _as(asked_v, dim).reshape(-1, dim).astype(np.float64)
                base, slack = bounds(dim, cells, q)
                base += np.minimum(slack, 0).sum(1)[:, None] - off[dim]
                n = min(keep, base.shape[1])
                best = -np.partition(-base, n - 1, axis=1)[:, :n]
                forms = np.repeat(_as(ids), n)
                same = [pa.array(np.full(len(forms), x, np.int64)) for x in (dim, block)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(forms), pa.array(best.ravel())],
                                                 names=["dim", "query_block", "form", "bound"])

    best = Window.partitionBy("form").orderBy(F.desc("bound"))
    bounded = (asking.join(file.select("dim", "block", "cells"), ["dim", "block"])
               .select("dim", "query_block", "query_ids", "queries", "cells")
               .mapInArrow(scan, "dim long, query_block long, form long, bound double")
               .withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= keep))
    floor = F.when(F.count("*") >= keep, F.min("bound")).otherwise(float("-inf"))
    floors = (bounded.groupBy("dim", "query_block", "form").agg(floor.alias("floor"))
              .groupBy("dim", "query_block").agg(F.collect_list(F.struct("form", "floor")).alias("floors")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 greatest exact scores of each query in each block, reading vectors by falling upper bound."""
        for batch in batches:
            for dim, query_ids, asked_v, cells, ids, exact, floors in zip(
                    batch.column(0).to_pylist(), *batch.columns[1:6], batch.column(6).to_pylist()):
                q, forms = _as(asked_v, dim).reshape(-1, dim), _as(query_ids)
                floors = {f["form"]: f["floor"] for f in floors}
                vectors, names = _as(exact, dim).reshape(-1, dim), _as(ids)
                base, slack = bounds(dim, cells, q.astype(np.float64))
                base += np.maximum(slack, 0).sum(1)[:, None] + off[dim]
                if reach[dim] >= 2**63:
                    q, vectors = q.astype(object), vectors.astype(object)
                out: list[tuple] = []
                for row, form in enumerate(forms.tolist()):
                    upper, floor = base[row], floors[form]
                    able = np.flatnonzero(upper >= floor)
                    able = able[np.argsort(-upper[able], kind="stable")]
                    got_score, got_id = np.zeros(0, vectors.dtype), np.zeros(0, np.int64)
                    for at in range(0, len(able), CHUNK):
                        if len(got_score) >= keep and upper[able[at]] < got_score[keep - 1]:
                            break
                        take = able[at: at + CHUNK]
                        score = np.concatenate([got_score, vectors[take] @ q[row]])
                        name = np.concatenate([got_id, names[take]])
                        order = np.array(sorted(range(len(name)), key=lambda j: (-score[j], name[j])) if score.dtype == object
                                         else np.lexsort((name, -score)), np.int64)[:keep]
                        got_score, got_id = score[order], name[order]
                    if reach[dim] >= 2**63:
                        # a query's product with itself is no answer; those of equal vectors are, and stand beside it
                        if any(not -2**63 < s < 2**63 and n != form for s, n in zip(got_score, got_id.tolist())):
                            raise ValueError("an inner product among the answers is beyond 64-bit whole numbers")
                        got_score = np.array([max(1 - 2**63, min(2**63 - 1, s)) for s in got_score], np.int64)
                    out += zip([form] * len(got_id), got_id.tolist(), got_score.tolist())
                cols = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["form", "vec_id", "score"])

    order = [F.desc("score"), F.asc("vec_id")]
    found = (asking.join(file, ["dim", "block"]).join(floors, ["dim", "query_block"])
             .select("dim", "query_ids", "queries", "cells", "ids", "exact", "floors")
             .mapInArrow(visit, "form long, vec_id long, score long")
             .withColumn("nth", F.row_number().over(Window.partitionBy("form").orderBy(*order)))
             .filter(F.col("nth") <= keep).drop("nth"))
    answers = found.groupBy("form").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")).alias("hits"))
    rows = (asked.join(forms, "v").select("query_id", "form").join(answers, "form")
            .select("query_id", F.slice(F.filter(F.array_sort("hits"), lambda h: h["vec_id"] != F.col("query_id")), 1, k)
                    .alias("hits"))
            .select("query_id", F.posexplode("hits").alias("at", "hit")))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                       (-F.col("hit.minus")).alias("score"))

