"""Mixing sources to target weights by weighted fair queueing.

``targets`` shares a budget (``share`` of all words) among the sources by weight; no source gets more
than ``most`` times its words, and what it can't take goes to the others by weight until none is
above. With r = most * size / weight this is a water level: in the order of r a source is full while
r is below (budget - what the earlier ones hold) / (weight of it and the later ones).

``plan`` queues the documents. Each source's documents are shuffled by a hash of the id and queued
``most`` times over; a copy's virtual finish time is the words its source has queued so far, divided
by the source's target. All copies are ordered by that time and cut where the budget ends; the copy that
crosses it is taken if that comes nearer, so the total is within half a document of the budget. Time only
rises along a source's queue, so what the cut takes of a source is a prefix of each pass: one key per
source and pass. Documents are then taken by comparing their key with their source's cuts.

Scale: running sums go by cells of (source, leading digits of the hash), so a source that holds a
third of all rows is summed in 16 ** CELL_DIGITS parts; the cut is searched in ever finer slices of the time axis.
Only ids, sources and sizes are shuffled, never texts.

Nulls and ties: a null text has size 0; a null source is a source of its own, last in the order; a
null id is shuffled as an empty text. Rows with the same id in a source are queued as one unit, taken
whole or not at all. Documents of size 0 are never taken. Repeated runs agree. Empty input gives an
empty result. An output name that the table already has is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import text as T

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
CELL_DIGITS = 3
SLICES = 1_024
LEVELS = 5
FEW = 20_000
WORD = r"[^\x20\x09-\x0D]+"
MADE = ("size", "source_size", "target", "copies", "taken")


def size() -> Column:
    """Words of the column ``text``."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def queue_key() -> Column:
    """Place of a document in its source's queue: digits of a hash of the id, then the id."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.concat(F.md5(name.cast("binary")), name)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_rank, source_size, target) from one row per source with its source_size."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("source_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_rank", F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("_w", weight).withColumn("_r", most * F.col("source_size") / F.col("_w"))
    upto = everything.orderBy("_r", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = everything.orderBy("_r", "source_rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    held = most * (F.sum("source_size").over(upto) - F.col("source_size"))
    level = (share * F.sum("source_size").over(everything) - held) / F.sum("_w").over(onward)
    ranked = ranked.withColumn("_level", level).withColumn("_full", F.col("_r") <= F.col("_level"))
    first_open = F.min(F.when(~F.col("_full"), F.struct("_r", "source_rank", "_level"))).over(everything)
    ranked = ranked.withColumn("_water", first_open["_level"])
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_water") * F.col("_w"))
    return ranked.select("source", "source_rank", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target and ``cuts``, the last key taken in each pass."""
    queued = T.stored(docs.select("source", queue_key().alias("key"), size().alias("size")), "mix")
    queued = queued.groupBy("source", "key").agg(F.sum("size").alias("size"))
    queued = queued.withColumn("cell", F.conv(F.substring("key", 1, CELL_DIGITS), 16, 10).cast("long"))
    cells = queued.groupBy("source", "cell").agg(F.sum("size").alias("_cell_size"))
    marks = targets(cells.groupBy("source").agg(F.sum("_cell_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cell_size").over(before), F.lit(0))).alias("c")
    marks = T.stored(marks, "mix-targets")
    cells = cells.join(marks.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source"))).drop(F.col("m.source"))
    inside = Window.partitionBy("source", "cell").orderBy("key")
    queued = queued.where("size > 0").withColumn("_inside", F.sum("size").over(inside)).alias("q")
    same = F.col("q.source").eqNullSafe(F.col("x.source")) & (F.col("q.cell") == F.col("x.cell"))
    timed = queued.join(cells.alias("x"), same).select("q.source", "key", "size", "source_rank", "source_size", "target", (F.col("_before") + F.col("_inside")).alias("_upto"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    timed = timed.select("*", passes.alias("pass")).withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("_upto")) / F.col("target"))
    timed = T.stored(timed.select("source", "key", "size", "source_rank", "pass", "finish"), "mix-queue")

    budget = share * (marks.agg(F.sum("source_size")).first()[0] or 0)
    taken = _before_cut(timed, budget)
    cut = [F.max(F.when(taken & (F.col("pass") == p), F.col("key"))) for p in range(most)]
    cuts = timed.groupBy("source").agg(F.array(*cut).alias("cuts")).alias("t")
    marks = marks.alias("m")
    return marks.join(cuts, F.col("m.source").eqNullSafe(F.col("t.source")), "left").select("m.source", "source_size", "target", "cuts")


def _before_cut(timed: DataFrame, budget: float) -> Column:
    """Whether a copy is taken: the order is by finish, then source; copies are taken if more than half of them fits the budget.

    The time axis is cut into slices, the slice in which the budget ends into slices again, until few
    copies are left in it; only those are put in order.
    """
    edge, low, width, used = timed, 0.0, 1 / SLICES, 0
    for _ in range(LEVELS):
        place = F.least(F.floor((F.col("finish") - low) / width), F.lit(8 * SLICES))
        slices = edge.groupBy(place.alias("slice")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = slices.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") + used > budget).orderBy("slice").first()
        if over is None:
            return F.lit(True)
        edge, used = edge.where(place == over.slice), used + over.upto - over.words
        if over.n <= FEW:
            break
        low, width = low + over.slice * width, width / SLICES
    running = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("finish", "source_rank", "pass", "key"))
    placed = edge.withColumn("_fits", 2 * (running + used) - F.col("size") < 2 * budget)
    last = placed.where("_fits").orderBy(F.desc("finish"), F.desc("source_rank")).first()
    if last is None:
        return F.col("finish") < edge.agg(F.min("finish")).first()[0]
    return (F.col("finish") < last.finish) | ((F.col("finish") == last.finish) & (F.col("source_rank") <= last.source_rank))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """All documents with size, source_size, target, copies (times the mix takes them) and taken (words)."""
    marks = T.stored(plan(docs, weights, share, most), "mix-plan").withColumnRenamed("source", "_source")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in MADE])
    sized = kept.withColumn("size", size()).withColumn("_key", queue_key())
    times = F.aggregate(F.coalesce("cuts", F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.when(F.col("_key") <= c, 1).otherwise(0))
    joined = sized.join(marks, F.col("source").eqNullSafe(F.col("_source")), "left")
    out = joined.withColumn("copies", F.when(F.col("size") > 0, times).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("_source", "_key", "cuts")


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mixed documents themselves, each as often as it is taken, with the columns of ``docs``."""
    mixed = mix(docs, weights, share, most).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
