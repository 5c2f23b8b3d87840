"""Running and neighbouring values over ordered groups of any size.

A plain ``Window.partitionBy(clip)`` sends a whole clip to one task. Here a group is split into
chunks of its order column, each chunk is scanned on its own, every chunk is summarised by one
partially aggregated row, and only those summaries are combined per group. A task therefore sees
at most ``width`` positions of a group, however many rows the group holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
SPARSE_CHUNK = 1_048_576
HOT_ROWS = 1_000_000
HOT_SPLITS = 64
MOST_HOT = 1_024

_BACKWARD = {"sum_before", "sum_upto", "max_before", "max_upto", "prev", "last_before", "position"}
_FORWARD = {"next", "first_after"}
_WHOLE = {"total", "highest", "lowest", "first", "last"}


@dataclass(frozen=True)
class Scan:
    """One derived column: its name, what it is (see ``ordered_scan``) and the value it reads."""

    name: str
    kind: str
    value: Column | None = None


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    width: int = CHUNK,
) -> DataFrame:
    """Add one column per scan. ``order[0]`` must be an integer column; ``keys`` must not be null.

    kinds: ``position`` rows before this one; ``sum_before``/``sum_upto``; ``max_before``/``max_upto``;
    ``prev``/``next`` value of the neighbouring row; ``last_before``/``first_after`` nearest non-null
    value; ``total``/``highest``/``lowest`` over the group; ``first``/``last`` non-null of the group.
    """
    keys, order = list(keys), list(order)
    rank = F.struct(*order)
    base = df.withColumn("_chunk", F.floor(F.col(order[0]) / F.lit(width)).cast("long"))
    for i, scan in enumerate(scans):
        base = base.withColumn(f"_v{i}", F.lit(1) if scan.value is None else scan.value)

    partials = []
    for i, scan in enumerate(scans):
        value = F.col(f"_v{i}")
        if scan.kind in ("sum_before", "sum_upto", "position", "total"):
            part = F.sum(value)
        elif scan.kind in ("max_before", "max_upto", "highest"):
            part = F.max(value)
        elif scan.kind == "lowest":
            part = F.min(value)
        elif scan.kind == "prev":
            part = F.max_by(F.struct(value), rank)
        elif scan.kind == "next":
            part = F.min_by(F.struct(value), rank)
        elif scan.kind in ("last_before", "last"):
            part = F.max_by(value, F.when(value.isNotNull(), rank))
        elif scan.kind in ("first_after", "first"):
            part = F.min_by(value, F.when(value.isNotNull(), rank))
        else:
            raise ValueError(f"unknown scan kind: {scan.kind}")
        partials.append(part.alias(f"_p{i}"))
    chunks = base.groupBy(*keys, "_chunk").agg(*partials)

    across = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    reverse = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc())
    later = reverse.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    carried = [*keys, "_chunk"]
    for i, scan in enumerate(scans):
        part = F.col(f"_p{i}")
        if scan.kind in ("sum_before", "sum_upto", "position"):
            carry = F.sum(part).over(earlier)
        elif scan.kind in ("max_before", "max_upto"):
            carry = F.max(part).over(earlier)
        elif scan.kind == "prev":
            carry = F.lag(part).over(across)
        elif scan.kind == "next":
            carry = F.lag(part).over(reverse)
        elif scan.kind == "last_before":
            carry = F.last(part, ignorenulls=True).over(earlier)
        elif scan.kind == "first_after":
            carry = F.last(part, ignorenulls=True).over(later)
        elif scan.kind == "total":
            carry = F.sum(part).over(whole)
        elif scan.kind == "highest":
            carry = F.max(part).over(whole)
        elif scan.kind == "lowest":
            carry = F.min(part).over(whole)
        elif scan.kind == "first":
            carry = F.first(part, ignorenulls=True).over(whole)
        else:
            carry = F.last(part, ignorenulls=True).over(whole)
        carried.append(carry.alias(f"_c{i}"))
    chunks = chunks.select(*carried)

    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    backwards = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    after = backwards.rowsBetween(Window.unboundedPreceding, -1)
    local = base
    for i, scan in enumerate(scans):
        value = F.col(f"_v{i}")
        here = None
        if scan.kind in ("sum_before", "position"):
            here = F.sum(value).over(before)
        elif scan.kind == "sum_upto":
            here = F.sum(value).over(upto)
        elif scan.kind == "max_before":
            here = F.max(value).over(before)
        elif scan.kind == "max_upto":
            here = F.max(value).over(upto)
        elif scan.kind == "prev":
            here = F.lag(F.struct(value)).over(inside)
        elif scan.kind == "next":
            here = F.lag(F.struct(value)).over(backwards)
        elif scan.kind == "last_before":
            here = F.last(value, ignorenulls=True).over(before)
        elif scan.kind == "first_after":
            here = F.last(value, ignorenulls=True).over(after)
        if here is not None:
            local = local.withColumn(f"_h{i}", here)

    joined = local.join(chunks, [*keys, "_chunk"], "left")
    out = [F.col(c) for c in df.columns]
    for i, scan in enumerate(scans):
        carry, here = F.col(f"_c{i}"), F.col(f"_h{i}")
        if scan.kind in ("sum_before", "sum_upto", "position"):
            result = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif scan.kind in ("max_before", "max_upto"):
            result = F.greatest(here, carry)
        elif scan.kind in ("prev", "next"):
            result = F.coalesce(here, carry).getField(f"_v{i}")
        elif scan.kind in ("last_before", "first_after"):
            result = F.coalesce(here, carry)
        else:
            result = carry
        out.append(result.alias(scan.name))
    return joined.select(*out)


def dense_index(df: DataFrame, keys: Sequence[str], order: str, name: str = "idx", width: int = SPARSE_CHUNK) -> DataFrame:
    """Zero-based position of each row in its group, by a sparse integer order column."""
    indexed = ordered_scan(df, keys, [order], [Scan(name, "position")], width)
    return indexed.withColumn(name, F.col(name).cast("long"))


def hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join to a lookup whose keys may be hot on the left.

    Keys above ``HOT_ROWS`` rows are found by a partially aggregated count. Of these the
    ``MOST_HOT`` with the most rows are treated apart, so the broadcast list has a fixed ceiling: their
    lookup rows are repeated, once per split, and a hot key is joined by ``HOT_SPLITS`` tasks. Every
    other key is joined exactly as usual. ``counted`` names a cheaper
    table with the same keys to count, such as the scan in front of a chain of joins.
    """
    keys = list(keys)
    counts = (left if counted is None else counted).groupBy(*keys).count()
    hot = counts.filter(F.col("count") > HOT_ROWS).na.drop(subset=keys).orderBy(F.desc("count"), *keys).limit(MOST_HOT)
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    split = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_SPLITS))).otherwise(F.lit(0))
    spread_left = left.join(hot.hint("broadcast"), keys, "left").withColumn("_split", split.cast("long")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SPLITS - 1))).otherwise(F.array(F.lit(0)))
    spread_right = (
        right.join(hot.hint("broadcast"), keys, "left")
        .withColumn("_split", F.explode(copies))
        .withColumn("_split", F.col("_split").cast("long"))
        .drop("_hot")
    )
    return spread_left.join(spread_right, [*keys, "_split"], how).drop("_split")
