"""Hard-negative mining: Strassen products of anchor and candidate tiles, merged into heaps.

Components are made whole numbers, ``floor(scale * x)``, so every score is an exact integer. A tile of
anchors is multiplied with a tile of candidates by Strassen's recursion: sides are padded with zeros to
an even length, halves are added and subtracted in 64-bit integers, seven products replace eight, down
to sides of ``LEAF``. Integer sums wrap around, so intermediate values may exceed 64 bits as long as the
scores don't. Scores go into two kinds of heaps, both merged by "the first few of the two together":

* an anchor's positives: the first rows of its own label, by falling score and then smaller id;
* per anchor and positive, its window: the first rows of other labels whose score lies between ``least``
  and ``most`` percent of the positive's.

Windows need the positives, so there are two passes. Rows are ordered by label and cut into blocks: the
first pass multiplies blocks that can share a label, the second those that can differ in it, so together
they come to about one product of all anchors with all rows.

Scale: blocks are ranges of (label, hash of the id), so a label that holds a third of all rows is many
blocks. A task holds one block of anchors and one of candidates and multiplies them tile by tile; per
anchor it returns the heap and not the scores. Heaps are ranked per anchor after a limit in each task.

Nulls: rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors
shorter than the longest are padded with zeros; an empty one scores 0. A row is no positive for an anchor
with the same id. Repeated rows are candidates one by one, so a repeated positive has its rows for each;
repeated anchors are asked once. Scores whose comparison wouldn't fit into 64 bits raise a ValueError. An
empty table gives an empty result. Other columns do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import text as T

SCALE = 256
POSITIVES = NEGATIVES = 5
LEAST, MOST = 80, 100
LEAF = 32
BLOCK, ANCHORS = 8_192, 1_024
TILE = (256, 2_048)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact wherever it fits into 64 bits."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return _product(a, b)
    a, b = _even(a), _even(b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _even(a: np.ndarray) -> np.ndarray:
    return np.pad(a, [(0, s % 2) for s in a.shape]) if a.shape[0] % 2 or a.shape[1] % 2 else a


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A leaf: in floating point where every partial sum is a whole number below 2**53, else in integers."""
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if a.shape[1] * top[0] * top[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def first(owner: np.ndarray, score: np.ndarray, number: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k first by falling score, then smaller number, in that order."""
    order = np.lexsort((number, -score, owner))
    kept = owner[order]
    new = np.flatnonzero(np.append(True, kept[1:] != kept[:-1])) if len(kept) else np.empty(0, dtype=np.int64)
    place = np.arange(len(kept)) - np.repeat(new, np.diff(np.append(new, len(kept))))
    return order[place < k]


class Heaps:
    """For each owner its k first (score, number); two heaps merge by concatenation."""

    def __init__(self, k: int):
        self.k, self.owner, self.score, self.number = k, *(np.empty(0, dtype=np.int64) for _ in range(3))

    def merge(self, owner: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        parts = [np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.number, number))]
        keep = first(*parts, self.k)
        self.owner, self.score, self.number = (x[keep] for x in parts)

    def add(self, owners: np.ndarray, scores: np.ndarray, fits: np.ndarray, numbers: np.ndarray) -> None:
        """Take in a tile of scores (owners by numbers); only those that ``fits`` marks."""
        live = np.flatnonzero(fits.any(axis=1))
        if not len(live):
            return
        scores, fits = scores[live], fits[live]
        if scores.shape[1] > self.k:
            held = np.where(fits, scores, np.iinfo(np.int64).min)
            bar = np.partition(held, scores.shape[1] - self.k, axis=1)[:, -self.k]
            fits = fits & (scores >= bar[:, None])
        row, column = np.nonzero(fits)
        self.merge(owners[live][row], scores[row, column], numbers[column])


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), places] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _tiles(asks: pa.Table, have: pa.Table, width: int):
    """(anchor positions, candidate positions, scores) of every pair of tiles."""
    left, right = _matrix(asks.column("vector"), width), _matrix(have.column("vector"), width).T
    for i in range(0, left.shape[0], TILE[0]):
        for j in range(0, right.shape[1], TILE[1]):
            rows, columns = slice(i, i + TILE[0]), slice(j, j + TILE[1])
            yield rows, columns, strassen(left[rows], right[:, columns])


def whole(vector: str = "embedding", scale: int = SCALE) -> Column:
    """The vector in whole numbers, or null if it takes no part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")))


def _blocks(rows: DataFrame, count: int, size: int, purpose: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a block, as a table, and one row per block with the labels it reaches from and to."""
    ranged = rows.repartitionByRange(max(1, math.ceil(count / size)), "label", F.xxhash64("id"))
    placed = T.stored(ranged.withColumn("block", F.spark_partition_id()), purpose)
    return placed, placed.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"))


def _pairs(heads: DataFrame, others: DataFrame, most: int, fits: Column) -> DataFrame:
    """(block, other) of the blocks that have to meet, from one row per block."""
    every = heads.select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("other"))
    named = others.select(F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    return every.join(named, "other").where(fits).select("block", "other")


def _met(asks: DataFrame, have: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    left = asks.join(pairs, "block")
    right = have.join(pairs.select(F.col("block").alias("_block"), F.col("other").alias("_other")), F.col("block") == F.col("_other"))
    right = right.select("_block", "_other", "id", "label", "vector")
    return left.groupBy("block", "other").cogroup(right.groupBy("_block", "_other")).applyInArrow(run, schema)


def mine(
    vectors: DataFrame, anchors: Column, label: Column | str = "label", vector: str = "embedding", key: str = "vec_id",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE,
) -> DataFrame:
    """``RESULT`` for every row that ``anchors`` holds for, against all rows."""
    spark = vectors.sparkSession
    T.bounded_batches(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole(vector, scale).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).where("id is not null and label is not null and vector is not null")
    largest = F.aggregate("vector", F.lit(0.0), lambda top, x: F.greatest(top, F.abs(x.cast("double"))))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.count_if("asks").alias("asks"), F.max(largest).alias("top")).first()
    if not about.asks:
        return spark.createDataFrame([], RESULT)
    width = max(about.width, 1)
    if width * about.top**2 * max(least, most, 100) >= 2**63:
        raise ValueError("scores of these vectors don't fit into 64 bits: lower the scale")
    have, heads = _blocks(rows, about.n, BLOCK, "negatives-rows")
    asked = rows.where("asks").select("id", "label", "vector").dropDuplicates()
    asks, ask_heads = _blocks(asked.withColumn("anchor", F.monotonically_increasing_id()), about.asks, ANCHORS, "negatives-anchors")
    blocks = max(1, math.ceil(about.n / BLOCK))

    def own(ask: pa.Table, other: pa.Table) -> pa.Table:
        heaps = Heaps(positives)
        if len(ask) and len(other):
            anchor, ids, others = ask.column("anchor").to_numpy(), ask.column("id").to_numpy(), other.column("id").to_numpy()
            mine, theirs = ask.column("label").to_numpy(), other.column("label").to_numpy()
            for r, c, scores in _tiles(ask, other, width):
                fits = (mine[r, None] == theirs[None, c]) & (ids[r, None] != others[None, c])
                heaps.add(anchor[r], scores, fits, others[c])
        return pa.table({"anchor": heaps.owner, "score": heaps.score, "id": heaps.number})

    share = _pairs(ask_heads, heads, blocks, (F.col("low") <= F.col("high2")) & (F.col("low2") <= F.col("high")))
    met = _met(asks.select("block", "anchor", "id", "label", "vector"), have, share, own, "anchor long, score long, id long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = met.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives)
    held = found.groupBy(F.col("anchor").alias("_anchor")).agg(F.array_sort(F.collect_list(F.struct("slot", "id", "score"))).alias("positives"))
    held = held.select("_anchor", F.col("positives.id").alias("positive_ids"), F.col("positives.score").alias("positive_scores"))
    asks = asks.join(T.stored(held, "negatives-positives"), F.col("anchor") == F.col("_anchor")).drop("_anchor")

    def others_near(ask: pa.Table, other: pa.Table) -> pa.Table:
        heaps = [Heaps(negatives) for _ in range(positives)]
        ids, given = np.empty((0, positives), dtype=np.int64), np.empty((0, positives), dtype=np.int64)
        if len(ask) and len(other):
            others, number = other.column("id").to_numpy(), np.arange(len(ask))
            mine, theirs = ask.column("label").to_numpy(), other.column("label").to_numpy()
            sizes = np.array([len(x) for x in ask.column("positive_ids").to_pylist()])
            ids, given = _matrix(ask.column("positive_ids"), positives), _matrix(ask.column("positive_scores"), positives)
            for r, c, scores in _tiles(ask, other, width):
                differ = mine[r, None] != theirs[None, c]
                for slot, heap in enumerate(heaps):
                    bar = given[r, slot][:, None]
                    fits = differ & (least * bar <= 100 * scores) & (100 * scores <= most * bar) & (sizes[r] > slot)[:, None]
                    heap.add(number[r], scores, fits, others[c])
        slots = np.repeat(np.arange(positives), [len(h.owner) for h in heaps])
        at = np.concatenate([h.owner for h in heaps])
        anchor, name = ask.column("anchor").to_numpy(), ask.column("id").to_numpy()
        return pa.table({
            "anchor": anchor[at], "slot": slots, "anchor_id": name[at], "positive_id": ids[at, slots], "positive_score": given[at, slots],
            "negative_score": np.concatenate([h.score for h in heaps]), "negative_id": np.concatenate([h.number for h in heaps]),
        })

    differ = _pairs(ask_heads, heads, blocks, (F.col("low") != F.col("high2")) | (F.col("low2") != F.col("high")))
    made = "anchor long, slot long, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long"
    shape = ["block", "anchor", "id", "label", "vector", "positive_ids", "positive_scores"]
    met = _met(asks.select(*shape), have, differ, others_near, made)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
