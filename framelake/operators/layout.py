"""Sheet geometry and per-clip export documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import Scan, ordered_scan


def sheet_layout(frames: DataFrame, columns: int, width: int, height: int) -> DataFrame:
    """Atlas cell of every frame and the row count of its sheet."""
    sized = ordered_scan(frames, ["clip_id"], ["idx"], [Scan("frames", "total")])
    return sized.select(
        *frames.columns,
        (F.col("idx") % columns * width).cast("long").alias("x"),
        (F.floor(F.col("idx") / columns) * height).cast("long").alias("y"),
        F.ceil(F.col("frames") / columns).cast("long").alias("rows"),
    )


def contact_sheet_layout(frames: DataFrame, width: int, height: int, padding: int = 2) -> DataFrame:
    """Review sheet: at most four columns, padding around every cell."""
    sized = ordered_scan(frames, ["clip_id"], ["idx"], [Scan("frames", "total")])
    columns = F.least(F.lit(4), F.greatest(F.lit(1), F.col("frames")))
    rows = F.ceil(F.col("frames") / columns)
    return sized.select(
        "clip_id", "idx",
        (padding + F.col("idx") % columns * (width + padding)).cast("long").alias("x"),
        (padding + F.floor(F.col("idx") / columns) * (height + padding)).cast("long").alias("y"),
        (columns * width + (columns + 1) * padding).cast("long").alias("sheet_width"),
        (rows * height + (rows + 1) * padding).cast("long").alias("sheet_height"),
    )


def clip_documents(records: DataFrame, header: list[str]) -> DataFrame:
    """A clip's document as JSON lines: its header (idx -1) and one line per frame in order of idx.

    records(clip_id, idx, <header...>, record struct). The layout is the same for clips of every
    length, and no row grows with the clip.
    """
    heads = records.groupBy("clip_id", *header).agg(F.count(F.lit(1)).alias("frameCount"))
    heads = heads.select("clip_id", F.lit(-1).cast("long").alias("idx"), F.to_json(F.struct(*header, "frameCount")).alias("document"))
    lines = records.select("clip_id", F.col("idx").cast("long").alias("idx"), F.to_json("record").alias("document"))
    return heads.unionByName(lines)
