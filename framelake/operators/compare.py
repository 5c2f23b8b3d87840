"""Do derived rasters, sheets, previews and documents equal what they were derived from?

Packed frames are joined one row per frame and compared in place, so no pixel is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import buffers as B
from framelake.operators.ordered import hot_join
from framelake.operators.provenance import json_leaves


def _pairs(source: DataFrame, output: DataFrame) -> DataFrame:
    """Every source frame with its output, whose columns are null where there is none."""
    return source.select("frame_key", "clip_id", "width", "height", F.col("rgba").alias("src")).join(
        output.select("frame_key", F.col("width").alias("out_width"), F.col("height").alias("out_height"), F.col("rgba").alias("out")),
        "frame_key", "left",
    )


def block_match(source: DataFrame, output: DataFrame, scale: int) -> DataFrame:
    """Pixels of the scaled output that differ from their source pixel, per frame; null for a wrong size or no output."""
    wrong = B.scaled_mismatches("src", "width", "height", "out", "out_width", "out_height", F.lit(scale))
    counted = _pairs(source, output).select("frame_key", "clip_id", wrong.alias("mismatches"))
    return counted.withColumn("matches", F.coalesce(F.col("mismatches") == 0, F.lit(False)))


def translated_match(source: DataFrame, output: DataFrame, dx: Column, dy: Column, scale: int = 1) -> DataFrame:
    """Output pixels that are not the shifted (and scaled) source pixel, or not zero where none maps."""
    wrong = B.shifted_mismatches(
        "src", "width", "height", "out", "out_width", "out_height", dx.cast("int"), dy.cast("int"), F.lit(scale)
    )
    counted = _pairs(source, output).select("frame_key", "clip_id", wrong.alias("mismatches"))
    return counted.withColumn("matches", F.coalesce(F.col("mismatches") == 0, F.lit(False)))


def sheet_match(sheet: DataFrame, frame_pixels: DataFrame, columns: int, width: int, height: int) -> DataFrame:
    """Atlas pixels against frame pixels by cell; a pixel without a partner must be transparent."""
    cell = (F.floor(F.col("y") / height) * columns + F.floor(F.col("x") / width)).cast("long")
    cells = sheet.select(
        "clip_id", cell.alias("idx"),
        (F.col("x") % width).cast("int").alias("x"), (F.col("y") % height).cast("int").alias("y"),
        C.packed(C.channels()).alias("in_sheet"),
    )
    frames = frame_pixels.select("clip_id", "idx", "x", "y", C.packed(C.channels()).alias("in_frame"))
    both = cells.join(frames, ["clip_id", "idx", "x", "y"], "full_outer")
    unused = F.col("in_frame").isNull() & (F.col("in_sheet.a") > 0)
    differs = F.col("in_frame").isNotNull() & ~F.col("in_sheet").eqNullSafe(F.col("in_frame"))
    return (
        both.groupBy("clip_id", "idx")
        .agg(F.count(F.when(differs, 1)).alias("mismatches"), F.count(F.when(unused, 1)).alias("bleed"))
        .filter((F.col("mismatches") > 0) | (F.col("bleed") > 0))
    )


def preview_match(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Preview page against frame at the same position: missing, different pixels, different delay."""
    both = pages.select("clip_id", "idx", F.col("sha256").alias("page_sha"), F.col("delay_ms")).join(
        frames.select("clip_id", "idx", F.col("sha256").alias("frame_sha"), F.col("duration_ms")), ["clip_id", "idx"], "full_outer"
    )
    field = (
        F.when(F.col("page_sha").isNull() | F.col("frame_sha").isNull(), "pages")
        .when(F.col("page_sha") != F.col("frame_sha"), "pixels")
        .when(F.col("delay_ms") != F.col("duration_ms"), "delays")
    )
    return both.withColumn("field", field).filter(F.col("field").isNotNull()).select(
        "clip_id", "idx", F.lit("PREVIEW_MISMATCH").alias("code"), "field", "delay_ms", "duration_ms"
    )


def attachment_failures(outputs: DataFrame, tracks: DataFrame, sockets: DataFrame) -> DataFrame:
    """Prop and effect outputs need the contracted kind, socket and the frame's pixel shift.

    outputs(clip_id, frame_id, track_id, kind, attach_to, dx, dy, frame_dx, frame_dy);
    tracks(track_id, kind, attach_to); sockets(clip_id, socket_id).
    """
    contracted = tracks.select("track_id", F.col("kind").alias("want_kind"), F.col("attach_to").alias("want_socket"))
    owned = sockets.select("clip_id", F.col("socket_id").alias("attach_to")).distinct().withColumn("has_socket", F.lit(True))
    # Sockets are asked about only where the output has the contracted one, so its own is looked up, before the track is.
    moved = ((F.col("dx") != F.col("frame_dx")) | (F.col("dy") != F.col("frame_dy"))).alias("moved")
    slim = outputs.select("clip_id", "frame_id", "track_id", "kind", "attach_to", moved)
    joined = slim.join(owned, ["clip_id", "attach_to"], "left")
    joined = hot_join(joined, contracted, ["track_id"], ["clip_id", "frame_id"], "left", counted=outputs)
    code = (
        F.when(F.col("want_kind").isNull(), "SOURCE_HASH_MISMATCH")
        .when((F.col("kind") != F.col("want_kind")) | ~F.col("attach_to").eqNullSafe(F.col("want_socket")), "SOURCE_HASH_MISMATCH")
        .when(F.col("want_socket").isNotNull() & F.col("has_socket").isNull(), "SOCKET_ATTACHMENT")
        .when(
            F.col("moved"),
            F.when(F.col("want_socket").isNull(), "LANDMARK_DRIFT").otherwise("SOCKET_ATTACHMENT"),
        )
    )
    return joined.withColumn("code", code).filter(F.col("code").isNotNull()).select("clip_id", "frame_id", "track_id", "code")


def document_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Order-insensitive document comparison over flattened (path, value) leaves."""
    a = left.select(*keys, "path", F.col("value").alias("expected"), F.lit(True).alias("in_left"))
    b = right.select(*keys, "path", F.col("value").alias("actual"), F.lit(True).alias("in_right"))
    both = a.join(b, [*keys, "path"], "full_outer")
    state = (
        F.when(F.col("in_right").isNull(), "missing")
        .when(F.col("in_left").isNull(), "unexpected")
        .when(~F.col("expected").eqNullSafe(F.col("actual")), "changed")
    )
    return both.withColumn("state", state).filter(F.col("state").isNotNull()).select(*keys, "path", "expected", "actual", "state")


def pair_diff(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """What ``document_diff`` finds between two JSON texts of one row: (key, path, expected, actual, state).

    Both are flattened where the row is, so no leaf is shuffled.
    """
    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for at, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                sides: dict[str, tuple[list, list]] = {}
                for side, text in enumerate((a, b)):
                    for path, value in json_leaves(text):
                        sides.setdefault(path, ([], []))[side].append(value)
                for path, (expected, actual) in sides.items():
                    if not actual:
                        new = [(path, e, None, "missing") for e in expected]
                    elif not expected:
                        new = [(path, None, v, "unexpected") for v in actual]
                    else:
                        new = [(path, e, v, "changed") for e in expected for v in actual if e != v]
                    rows += [at] * len(new)
                    found += new
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [key, "path", "expected", "actual", "state"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, left, right).mapInArrow(differences, f"{key} {kind}, path string, expected string, actual string, state string")


def set_difference(expected: DataFrame, actual: DataFrame, columns: list[str]) -> DataFrame:
    """Rows listed on one side more often than on the other, with the surplus; one aggregation, no join."""
    tagged = expected.select(*columns, F.lit(1).alias("_w")).unionByName(actual.select(*columns, F.lit(-1).alias("_w")))
    net = tagged.groupBy(*columns).agg(F.sum("_w").alias("net")).filter(F.col("net") != 0)
    return net.select(*columns, F.when(F.col("net") > 0, "missing").otherwise("extra").alias("state"), F.abs("net").alias("copies"))


def palette_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Colours whose pixel counts differ between two frame_colours tables."""
    a = left.select(*keys, *C.CHANNELS, F.col("n").alias("left_n"), F.lit(0).cast("long").alias("right_n"))
    b = right.select(*keys, *C.CHANNELS, F.lit(0).cast("long").alias("left_n"), F.col("n").alias("right_n"))
    both = a.unionByName(b).groupBy(*keys, *C.CHANNELS).agg(F.sum("left_n").alias("left_n"), F.sum("right_n").alias("right_n"))
    return both.filter(F.col("left_n") != F.col("right_n"))
