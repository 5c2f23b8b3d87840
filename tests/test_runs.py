import pytest
from conftest import as_frames, raster, rows
from pyspark.sql import functions as F

from framelake.operators import compare, runs, validate
from framelake.operators import pixels as P

FACTS = "run_id long, name string, width int, want int, hash string, kept string"
RULES = [
    runs.missing("FRAME_COUNT", "runtime", "width"),
    runs.differs("CANVAS_SIZE", "runtime", "width", "want"),
    runs.differs("SOURCE_HASH_MISMATCH", "metadata", "hash", "kept"),
    runs.Rule("LOOP_SEAM", "preview", "want > 9", "want", "'at most 9'", review=True),
]


@pytest.fixture
def graded(spark):
    facts = [(1, "a", 8, 8, "x", "x"), (1, "b", 7, 8, "x", "y"), (2, "a", None, 8, None, "x"), (3, "a", 10, 10, "x", "x"), (4, "a", 8, 8, "x", None), (None, "a", 1, 2, "x", "x")]
    return runs.judged(spark.createDataFrame(facts, FACTS), RULES)


def test_failures_say_what_was_measured(graded):
    assert rows(runs.failures(graded, ["run_id", "name"])) == sorted([
        (1, "b", "CANVAS_SIZE", "runtime", "7", "8", False), (1, "b", "SOURCE_HASH_MISMATCH", "metadata", "x", "y", False),
        (2, "a", "FRAME_COUNT", "runtime", "missing", "present", False), (3, "a", "LOOP_SEAM", "preview", "10", "at most 9", True),
        (None, "a", "CANVAS_SIZE", "runtime", "1", "2", False),
    ], key=repr)


def test_every_run_has_a_verdict(spark, graded):
    every = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (5,), (None,)], "run_id long")
    assert rows(runs.verdicts(graded, every), "run_id", "artifacts", "broken_artifacts", "failures", "reviews", "codes", "passed", "exit_class") == sorted([
        (1, 2, 1, 2, 0, "CANVAS_SIZE,SOURCE_HASH_MISMATCH", False, 3), (2, 1, 1, 1, 0, "FRAME_COUNT", False, 3), (3, 1, 0, 0, 1, "", True, 4),
        (4, 1, 0, 0, 0, "", True, 0), (5, 0, 0, 0, 0, "", True, 0), (None, 1, 1, 1, 0, "CANVAS_SIZE", False, 3),
    ], key=repr)
    assert rows(runs.verdicts(graded.limit(0), every.limit(1)), "run_id", "passed") == [(1, True)]


def test_frames_without_their_parts_are_reported(spark):
    palette, key = [(0, 0, 0, 0), (9, 9, 9, 255)], (1, 2, 3, 255)
    image = raster(8, 8, (0, 0, 0, 0))
    image[2:7, 2:5] = (9, 9, 9, 255)
    big = image.repeat(2, axis=0).repeat(2, axis=1)
    frames, scaled = as_frames(spark, [image, image]), as_frames(spark, [big])
    canonical, runtime = validate.frame_measures(frames, 8, 8, palette, key, 0), validate.frame_measures(scaled, 16, 16, palette, key, 0)
    record = canonical.where("frame_key = 0").select(
        "frame_key", F.col("left").alias("rec_left"), F.col("top").alias("rec_top"), F.col("width").alias("rec_width"), F.col("height").alias("rec_height"),
        F.col("sha256").alias("rec_sha256"), F.lit(50).alias("frame_duration"), F.lit(50).alias("duration"),
    )
    mixed = validate.intermediate_colours(P.frame_colours(P.explode_pixels(frames.where("frame_key = 0")), 8, 8), P.frame_colours(P.explode_pixels(scaled), 16, 16))
    blocks = compare.block_match(frames.where("frame_key = 0"), scaled, 2)
    landmarks = spark.createDataFrame([(0, 4, 7, 4, 7), (1, 3, 7, 4, 7)], "frame_key long, landmark_x int, landmark_y int, target_x int, target_y int")
    found = rows(validate.flat_frame_failures(canonical, runtime, record, mixed, blocks, (8, 8), 2, (4, 7), 0, landmarks), "frame_key", "code", "stage")
    assert found == sorted([
        (1, "FRAME_COUNT", "runtime-missing"), (1, "METADATA_MISMATCH", "record-missing"), (1, "INTERMEDIATE_COLORS", "source-missing"), (1, "LANDMARK_DRIFT", "canonical"),
    ], key=repr)
