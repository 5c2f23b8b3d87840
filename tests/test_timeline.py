import pytest
from conftest import rows
from pyspark.sql import functions as F

from framelake.operators import layout, motion
from framelake.operators import timeline as T

SCHEMA = "clip_id long, idx long, frame_id string, duration_ms long, included boolean"


def review(spark):
    return spark.createDataFrame([(1, 0, "contact-a", 80, True), (1, 1, "pass", 120, False), (1, 2, "contact-b", 200, True)], SCHEMA)


def test_starts_and_duplicates(spark):
    frames = spark.createDataFrame(
        [(1, 0, "step-contact", 80, True, "h1"), (1, 1, "step-pass", 120, True, "h2"), (1, 2, "step-hold", 200, True, "h1")], SCHEMA + ", sha256 string"
    )
    assert rows(T.cumulative_timestamps(frames), "idx", "start_ms") == [(0, 0), (1, 80), (2, 200)]
    assert rows(T.duplicate_of(frames), "idx", "duplicate_of") == [(0, None), (1, None), (2, "step-contact")]


def test_elapsed_lookup(spark):
    samples = spark.createDataFrame([(1, 1, 100), (1, 2, 280), (1, 3, -5), (9, 4, 10)], "clip_id long, sample_id long, elapsed_ms long")
    found = {r.sample_id: r for r in T.frame_at_elapsed(review(spark), samples, loop=False).collect()}
    assert (found[1].idx, found[1].frame_elapsed_ms, found[1].total_ms, found[1].complete) == (2, 20, 280, False)
    assert (found[2].idx, found[2].complete, found[2].frame_elapsed_ms) == (2, True, 200)
    assert (found[3].idx, found[3].elapsed_ms) == (0, 0)
    assert (found[4].idx, found[4].complete) == (None, True)
    looped = T.frame_at_elapsed(review(spark), spark.createDataFrame([(1, 1, 300)], samples.schema), loop=True).first()
    assert (looped.idx, looped.elapsed_ms) == (0, 20)


def test_elapsed_lookup_against_brute_force(spark):
    durations = [(i * 37) % 90 + 1 for i in range(60)]
    frames = spark.createDataFrame([(1, i, str(i), d, i % 5 != 2) for i, d in enumerate(durations)], SCHEMA)
    asked = list(range(0, 3000, 7))
    samples = spark.createDataFrame([(1, t, t) for t in asked], "clip_id long, sample_id long, elapsed_ms long")
    got = {r.sample_id: r.idx for r in T.frame_at_elapsed(frames, samples, loop=True).collect()}
    timeline = [i for i, d in enumerate(durations) if i % 5 != 2 for _ in range(d)]
    assert got == {t: timeline[t % len(timeline)] for t in asked}


def test_compare_timelines(spark):
    later = review(spark).withColumn("duration_ms", F.when(F.col("idx") == 0, 200).otherwise(F.col("duration_ms")))
    assert rows(T.compare_timelines(review(spark), later), "elapsed_ms", "left_idx", "right_idx") == [(0, 0, 0), (200, 2, 2), (80, 2, 0)]


def test_timestamp_rules(spark):
    good = spark.createDataFrame([(1, 0, 0, 40), (1, 1, 40, 100), (1, 2, 140, 40), (1, 3, 180, 80)], "clip_id long, idx long, start_ms long, duration_ms long")
    assert T.timestamp_failures(good).count() == 0
    bad = spark.createDataFrame([(1, 0, 5, 40), (1, 1, 5, 0)], good.schema)
    assert rows(T.timestamp_failures(bad), "idx", "code") == [
        (0, "DURATION_DISAGREES"), (0, "START_NOT_ZERO"), (1, "DURATION_RANGE"), (1, "NOT_INCREASING")
    ]


def test_neighbours_wrap_and_skip_excluded(spark):
    assert rows(T.neighbour_frames(review(spark)), "idx", "previous_idx", "next_idx") == [(0, 2, 2), (1, 0, 2), (2, 0, 0)]


def test_range_delay_and_shares(spark):
    assert [r.idx for r in T.playback_range(review(spark), F.lit(2), F.lit(1)).collect()] == [2]
    with pytest.raises(ValueError):
        T.review_delay(F.col("duration_ms"), 3)
    assert rows(T.timing_share(review(spark)), "idx", "share") == [(0, 0.4), (1, 0.0), (2, 1.0)]
    edited = review(spark).withColumn("edit_duration_ms", F.lit(None).cast("long"))
    assert T.sequence_duration(edited, F.lit(0), F.lit(2)).first().total_ms == 280


def motion_frame(i, included, root, foot, ground=(0, 0)):
    markers = ([("root", "root-pivot", *root)] if root else []) + ([("left-foot", "planted-foot", *foot)] if foot else [])
    return (1, i, f"f{i}", included, {"x": 0, "y": 0}, {"x": ground[0], "y": ground[1]}, markers, ["left-foot"])


MOTION = (
    "clip_id long, idx long, frame_id string, included boolean, translation struct<x:int,y:int>, ground struct<x:int,y:int>, "
    "markers array<struct<id:string,kind:string,x:int,y:int>>, contacts array<string>"
)


def test_motion_issues(spark):
    frames = spark.createDataFrame([motion_frame(0, True, None, (4, 10)), motion_frame(1, True, (6, 5), (6, 10)), motion_frame(2, True, (7, 5), None)], MOTION)
    roots, feet = motion.root_path(frames, (8, 12)), motion.foot_points(frames, (8, 12))
    assert rows(roots.filter("issue IS NOT NULL"), "idx", "x", "y") == [(0, 8, 12)]
    assert rows(feet.filter("issue IS NOT NULL"), "idx", "issue") == [(2, "missing-contact-marker")]
    assert rows(motion.foot_slides(feet), "idx", "from_x", "to_x") == [(1, 4, 6)]


def test_ground_travel_cancels_and_excluded_frames_do_not_break(spark):
    frames = spark.createDataFrame([motion_frame(0, True, (5, 5), (4, 10)), motion_frame(1, False, (90, 90), (90, 90)), motion_frame(2, True, (6, 5), (5, 10), (1, 0))], MOTION)
    feet = motion.foot_points(frames, (8, 12))
    assert rows(feet, "idx", "point.x", "point.y") == [(0, 4, 10), (2, 4, 10)]
    assert motion.foot_slides(feet).count() == 0
    assert rows(motion.root_path(frames, (8, 12)), "idx", "x") == [(0, 5), (2, 5)]


def test_missing_marker_breaks_the_interval(spark):
    frames = spark.createDataFrame([motion_frame(0, True, (5, 5), (4, 10)), motion_frame(1, True, (5, 5), None), motion_frame(2, True, (5, 5), (9, 10))], MOTION)
    assert motion.foot_slides(motion.foot_points(frames, (8, 12))).count() == 0


@pytest.mark.parametrize("count", [1, 1_025])
def test_documents_are_a_header_and_a_line_per_frame_at_every_length(spark, count):
    records = spark.range(count).select(F.lit(1).alias("clip_id"), F.col("id").alias("idx"), F.lit("walk").alias("name"), F.struct(F.col("id").alias("i")).alias("record"))
    lines = rows(layout.clip_documents(records, ["name"]), "idx", "document")
    assert sorted(lines) == [(-1, f'{{"name":"walk","frameCount":{count}}}')] + [(i, f'{{"i":{i}}}') for i in range(count)]
