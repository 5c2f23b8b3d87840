from conftest import as_frames, raster, rows
from pyspark.sql import functions as F

from framelake.operators import compare


def test_a_frame_without_output_does_not_match(spark):
    source = as_frames(spark, [raster(2, 2), raster(2, 2)])
    output = as_frames(spark, [raster(4, 4)])
    assert rows(compare.block_match(source, output, 2), "frame_key", "mismatches", "matches") == [(0, 0, True), (1, None, False)]
    moved = compare.translated_match(source, output, F.lit(0), F.lit(0), 2)
    assert rows(moved, "frame_key", "mismatches", "matches") == [(0, 0, True), (1, None, False)]


def test_attachments_are_judged_without_counting_sockets_per_clip(spark):
    output = "clip_id long, frame_id long, track_id string, kind string, attach_to string, dx int, dy int, frame_dx int, frame_dy int"
    outputs = spark.createDataFrame([
        (1, 0, "p", "prop", "hand", 0, 0, 0, 0), (1, 1, "p", "prop", "hand", 1, 0, 0, 0), (2, 0, "p", "prop", "hand", 0, 0, 0, 0), (1, 2, "p", "prop", None, 0, 0, 0, 0),
        (1, 3, "p", "effect", "hand", 0, 0, 0, 0), (1, 4, "x", "prop", "hand", 0, 0, 0, 0), (1, 5, "a", "actor", None, 0, 1, 0, 0), (1, 6, "p", "prop", "foot", 0, 0, 0, 0),
        (2, 7, "a", "actor", "hand", 0, 0, 0, 0), (2, 8, "a", "actor", None, 0, 0, 0, 0),
    ], output)
    tracks = spark.createDataFrame([("p", "prop", "hand"), ("a", "actor", None)], "track_id string, kind string, attach_to string")
    sockets = spark.createDataFrame([(1, "hand"), (1, "hand"), (1, "foot")], "clip_id long, socket_id string")
    found = compare.attachment_failures(outputs, tracks, sockets)
    assert rows(found, "clip_id", "frame_id", "code") == sorted([
        (1, 1, "SOCKET_ATTACHMENT"), (2, 0, "SOCKET_ATTACHMENT"), (1, 2, "SOURCE_HASH_MISMATCH"), (1, 3, "SOURCE_HASH_MISMATCH"), (1, 4, "SOURCE_HASH_MISMATCH"),
        (1, 5, "LANDMARK_DRIFT"), (1, 6, "SOURCE_HASH_MISMATCH"), (2, 7, "SOURCE_HASH_MISMATCH"),
    ], key=repr)
    counted = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "count" in line]
    assert counted and not any("clip_id" in line for line in counted)
