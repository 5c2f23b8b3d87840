"""Root and planted-foot motion of a clip.

Frames carry ``translation`` and ``ground`` points, ``markers`` array<struct<id,kind,x,y>> and
``contacts`` array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import Scan, ordered_scan


def _marker(marker_id: Column, kind: str) -> Column:
    return F.get(F.filter("markers", lambda m: (m.id == marker_id) & (m.kind == kind)), F.lit(0))


def _world(point: Column, pivot: tuple[int, int]) -> list[Column]:
    return [
        (F.coalesce(point.getField(axis), F.lit(base)) + F.col(f"translation.{axis}") - F.col(f"ground.{axis}")).cast("long").alias(axis)
        for axis, base in zip(("x", "y"), pivot)
    ]


def root_path(frames: DataFrame, pivot: tuple[int, int]) -> DataFrame:
    """World position of the root per included frame; the project pivot stands in for a missing marker."""
    root = _marker(F.lit("root"), "root-pivot")
    return frames.filter("included").withColumn("mark", root).select(
        "clip_id", "idx", "frame_id", *_world(F.col("mark"), pivot),
        F.when(F.col("mark").isNull(), "missing-root").alias("issue"),
    )


def foot_points(frames: DataFrame, pivot: tuple[int, int]) -> DataFrame:
    """World position of each planted contact per included frame; no point when its marker is missing."""
    active = ordered_scan(frames.filter("included"), ["clip_id"], ["idx"], [Scan("active_idx", "position")])
    planted = active.withColumn("contact_id", F.explode(F.array_distinct("contacts")))
    placed = planted.withColumn("mark", _marker(F.col("contact_id"), "planted-foot"))
    point = F.when(F.col("mark").isNotNull(), F.struct(*_world(F.col("mark"), pivot)))
    return placed.select(
        "clip_id", "idx", "active_idx", "frame_id", "contact_id", point.alias("point"),
        F.when(F.col("mark").isNull(), "missing-contact-marker").alias("issue"),
    )


def foot_slides(points: DataFrame) -> DataFrame:
    """Contacts that moved since the previous included frame of the same unbroken planted interval."""
    before = ordered_scan(
        points, ["clip_id", "contact_id"], ["active_idx"], [Scan("prior", "prev", F.struct("active_idx", "point"))]
    )
    unbroken = F.col("prior.active_idx") == F.col("active_idx") - 1
    moved = (F.col("prior.point.x") != F.col("point.x")) | (F.col("prior.point.y") != F.col("point.y"))
    return before.filter(unbroken & moved).select(
        "clip_id", "contact_id", "idx", "frame_id",
        F.col("prior.point.x").alias("from_x"), F.col("prior.point.y").alias("from_y"),
        F.col("point.x").alias("to_x"), F.col("point.y").alias("to_y"),
    )


def unsupported_travel(frames: DataFrame) -> DataFrame:
    """Ground travel without a declared contact."""
    moving = (F.col("ground.x") != 0) | (F.col("ground.y") != 0)
    return frames.filter(moving & (F.size("contacts") == 0)).select(
        "clip_id", "idx", "frame_id", F.lit("GROUND_TRAVEL_CONTACT").alias("code")
    )
