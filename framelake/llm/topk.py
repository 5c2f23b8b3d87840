"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Components are made whole numbers, ``floor(scale * x)``, so scores are exact. The Gram matrix of all
vectors, summed by Spark, gives a rotation whose first axes carry most of the length. Candidates are
ordered by descending length and cut into blocks; every block of queries meets every block of
candidates, and a block starts with what each query is sure of already: the k-th best score among the
first block, that of the longest vectors. Then, in a block,

* a query skips the block if its length times the longest candidate is below that bound;
* candidates are dropped whose partial product over the first axes plus the product of the two
  residual lengths (Cauchy-Schwarz) is below it; this is repeated with more axes;
* what is left is scored exactly in the unrotated whole numbers.

Bounds are computed in floating point and loosened by a relative 1e-9, so nothing is lost by rounding;
a candidate that ties with the bound stays. Each pair of blocks yields at most k rows a query, and the
k best of these are ranked by score, then smaller id.

The query set meets all rows in blocks: a task holds one block of either, and never all rows.

Nulls: vectors that are null, empty, or hold a null or non-finite component take no part, nor rows
with a null id. Vectors shorter than the longest are padded with zeros. A query doesn't meet rows with
its own id. Repeated rows are candidates one by one; a query that is repeated is asked once. Fewer than k candidates: all are
returned. Products beyond 2**53 are summed in 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import text as T

SCALE = 64
K = 20
BLOCK = 4_096
QUERIES = 1_024
STEPS = (0.25, 0.5)
SLACK = 1e-9


def whole(vector: str = "embedding", scale: int = SCALE) -> Column:
    """The vector in whole numbers, or null if it takes no part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when((F.size(x) > 0) & fine, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes by descending share of the squared lengths; a task emits one row per cell of the Gram matrix."""

    def run(batches):
        gram = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            gram += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram.ravel())], ["i", "j", "v"])

    cells = vectors.select("vector").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    gram = np.zeros((width, width))
    for row in cells.collect():
        gram[row.i, row.j] = row.v
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), _places(sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def best(queries, query_ids, bounds, candidates, ids, axes, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of up to k best per query that reach its bound."""
    rq, rc = queries @ axes, candidates @ axes
    lq, lc = np.sqrt((rq**2).sum(axis=1)), np.sqrt((rc**2).sum(axis=1))
    order = np.argsort(-lc, kind="stable")
    rc, lc = rc[order], lc[order]
    exact = float(lq.max(initial=0)) * float(lc.max(initial=0)) < 2**52
    cuts = sorted({max(1, int(axes.shape[0] * s)) for s in STEPS})
    left_q = [np.sqrt(np.maximum((rq[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    left_c = [np.sqrt(np.maximum((rc[:, c:] ** 2).sum(axis=1), 0)) for c in cuts]
    out = []
    for q in range(len(queries)):
        loose = bounds[q] - SLACK * (1 + lq[q] * lc[0]) if len(lc) else 0
        reach = int(np.searchsorted(-lc * lq[q], -loose, side="right")) if np.isfinite(loose) else len(lc)
        live, part, done = np.arange(reach), np.zeros(reach), 0
        for c, a, b in zip(cuts, left_q, left_c):
            part = part + rc[live, done:c] @ rq[q, done:c]
            stay = part + a[q] * b[live] >= loose
            live, part, done = live[stay], part[stay], c
        if len(live):
            rows = order[live]
            other = ids[rows] != query_ids[q]
            rows = rows[other]
            if exact:
                score = (candidates[rows].astype(np.float64) @ queries[q].astype(np.float64)).astype(np.int64)
            else:
                score = candidates[rows] @ queries[q]
            fit = score >= bounds[q]
            rows, score = rows[fit], score[fit]
            top = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(top), q), rows[top], score[top]))
    if not out:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def search(
    vectors: DataFrame, queries: Column, vector: str = "embedding", key: str = "vec_id", k: int = K, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that ``queries`` holds for, against all rows."""
    spark = vectors.sparkSession
    T.bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole(vector, scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where("id is not null and vector is not null")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = T.stored(rows.withColumn("length", F.sqrt(squares)), "topk")
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count_if("asks").alias("asks")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not about.asks:
        return spark.createDataFrame([], schema)
    width, axes = about.width, rotation(rows, about.width)
    blocks, query_blocks = math.ceil(about.n / BLOCK), math.ceil(about.asks / QUERIES)

    # Candidate blocks of falling length. The hash parts equal lengths, and the written table fixes the blocks.
    ranged = rows.repartitionByRange(blocks, F.desc("length"), F.xxhash64("id")).withColumn("block", F.spark_partition_id())
    blocked = T.stored(ranged.select("block", "id", "vector", "length"), "topk-blocks")

    # What each query is sure of: its k-th best among the longest vectors, which are the first block.
    first = blocked.where("block = 0").select("id", "vector").toArrow()
    head, head_ids = _matrix(first.column("vector"), width), first.column("id").to_numpy()

    def bound(batches):
        for batch in batches:
            ids, mine = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            q, _, score = best(mine, ids, np.full(len(ids), -np.inf), head, head_ids, axes, k)
            sure = np.full(len(ids), -np.inf)
            found = np.bincount(q, minlength=len(ids))
            ends = np.cumsum(found)
            sure[found == k] = score[ends[found == k] - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sure)], ["id", "vector", "length", "sure"])

    asks = rows.where("asks").select("id", "vector", "length").dropDuplicates(["id", "vector"])
    asks = asks.mapInArrow(bound, "id long, vector array<bigint>, length double, sure double")
    asks = T.stored(asks.withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks))), "topk-queries")

    # Which blocks meet: Cauchy-Schwarz for whole blocks, on one row per block.
    reach = asks.groupBy("query_block").agg(F.min(F.when(F.col("length") > 0, F.col("sure") / F.col("length")).otherwise(F.lit(float("-inf")))).alias("least"))
    heads = blocked.groupBy("block").agg(F.max("length").alias("longest"))
    pairs = reach.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).join(heads, "block")
    pairs = pairs.where(F.col("longest") * (1 + SLACK) + SLACK >= F.col("least")).select("query_block", "block")
    left = asks.join(pairs, "query_block").select("query_block", "block", "id", "vector", "sure")
    right = blocked.join(pairs, "block").select(F.col("query_block").alias("_q"), F.col("block").alias("_b"), "id", "vector")

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        q, c, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        ids, others, which = (np.empty(0, dtype=np.int64),) * 3
        if len(ask) and len(have):
            ids, others = ask.column("id").to_numpy(), have.column("id").to_numpy()
            mine = _matrix(ask.column("vector"), width)
            q, c, score = best(mine, ids, ask.column("sure").to_numpy(), _matrix(have.column("vector"), width), others, axes, k)
            which = T.hashed([v.tobytes() for v in mine]).astype(np.int64)
        return pa.table({"query_id": ids[q], "which": which[q], "vec_id": others[c], "score": score})

    met = left.groupBy("query_block", "block").cogroup(right.groupBy("_q", "_b"))
    met = met.applyInArrow(meet, "query_id long, which long, vec_id long, score long")
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
