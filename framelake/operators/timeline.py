"""Animation timelines: starts, lookups by elapsed time, neighbours, ranges and summaries.

Every position-dependent value goes through ``ordered_scan``, so a clip may be arbitrarily long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import Scan, hot_join, ordered_scan

# Allowed review speeds and duration limits in milliseconds.
SPEEDS = (0.25, 0.5, 1.0, 2.0)
MAX_DURATION = 65_535
MIN_EXPORT_DURATION = 11


def cumulative_timestamps(frames: DataFrame) -> DataFrame:
    """Start of each frame: the sum of all earlier durations of its clip."""
    return ordered_scan(frames, ["clip_id"], ["idx"], [Scan("start_ms", "sum_before", F.col("duration_ms"))])


def duplicate_of(frames: DataFrame) -> DataFrame:
    """First earlier frame of the clip with the same pixel hash; null for originals."""
    first = ordered_scan(frames, ["clip_id", "sha256"], ["idx"], [Scan("original", "first", F.col("frame_id"))])
    return first.withColumn("duplicate_of", F.when(F.col("original") != F.col("frame_id"), F.col("original"))).drop("original")


def timestamp_failures(frames: DataFrame) -> DataFrame:
    """Starts at zero, strictly increasing, each duration reaching exactly to the next start, 1..65535 ms."""
    around = ordered_scan(
        frames, ["clip_id"], ["idx"],
        [Scan("before_ms", "prev", F.col("start_ms")), Scan("after_ms", "next", F.col("start_ms"))],
    )
    codes = F.array_compact(F.array(
        F.when(F.col("before_ms").isNull() & (F.col("start_ms") != 0), "START_NOT_ZERO"),
        F.when(F.col("start_ms") <= F.col("before_ms"), "NOT_INCREASING"),
        F.when(F.col("after_ms") - F.col("start_ms") != F.col("duration_ms"), "DURATION_DISAGREES"),
        F.when(~F.col("duration_ms").between(1, MAX_DURATION), "DURATION_RANGE"),
    ))
    return around.select("clip_id", "idx", F.explode(codes).alias("code"))


def playback_range(frames: DataFrame, start: Column, end: Column) -> DataFrame:
    """Included frames between two positions, whichever comes first."""
    inside = F.col("idx").between(F.least(start, end), F.greatest(start, end))
    return frames.filter(F.col("included") & inside)


def review_delay(duration: Column, speed: float) -> Column:
    if speed not in SPEEDS:
        raise ValueError(f"review speed must be one of {SPEEDS}")
    return duration / F.lit(speed)


def sequence_duration(frames: DataFrame, start: Column, end: Column) -> DataFrame:
    """Authored milliseconds of the included frames in range; an edit replaces the source duration."""
    authored = F.coalesce("edit_duration_ms", "duration_ms")
    return playback_range(frames, start, end).groupBy("clip_id").agg(
        F.sum(authored).alias("total_ms"), F.count(F.lit(1)).alias("frames")
    )


def timing_share(frames: DataFrame) -> DataFrame:
    """Duration relative to the longest included frame of the clip; zero when excluded."""
    active = F.when(F.col("included"), F.col("duration_ms"))
    wide = ordered_scan(frames, ["clip_id"], ["idx"], [Scan("longest_ms", "highest", active)])
    share = F.when(F.col("included"), F.col("duration_ms") / F.greatest(F.lit(1), F.col("longest_ms"))).otherwise(F.lit(0.0))
    return wide.withColumn("share", share).drop("longest_ms")


def neighbour_frames(frames: DataFrame) -> DataFrame:
    """Nearest active frames around every frame, wrapping at the ends, and the active ends of the clip."""
    active = F.when(F.col("included"), F.col("idx"))
    around = ordered_scan(
        frames, ["clip_id"], ["idx"],
        [
            Scan("before", "last_before", active), Scan("after", "first_after", active),
            Scan("first_idx", "first", active), Scan("last_idx", "last", active),
        ],
    )
    return around.select(
        *frames.columns,
        F.coalesce("before", "last_idx").alias("previous_idx"),
        F.coalesce("after", "first_idx").alias("next_idx"),
        "first_idx", "last_idx",
    )


def frame_at_elapsed(frames: DataFrame, samples: DataFrame, loop: bool) -> DataFrame:
    """Frame showing at each sampled time.

    frames(clip_id, idx, duration_ms, included); samples(clip_id, sample_id, elapsed_ms).
    Frames and the distinct moments asked for are merged into one ordered scan per clip, so no pair
    of them is ever formed, and a moment asked a billion times is looked up once.
    """
    active = frames.filter("included")
    totals = active.groupBy("clip_id").agg(
        F.sum("duration_ms").alias("total_ms"), F.max_by(F.struct("idx", "duration_ms"), "idx").alias("final")
    )
    timed = hot_join(samples, totals, ["clip_id"], ["sample_id"], "left")
    asked = F.greatest(F.lit(0), F.coalesce("elapsed_ms", F.lit(0))).cast("long")
    moment = F.col("elapsed_ms") % F.nullif("total_ms", F.lit(0)) if loop else F.col("elapsed_ms")
    timed = timed.withColumn("elapsed_ms", asked).withColumn("moment", F.coalesce(moment, F.lit(0)).cast("long"))
    found = _frames_at(cumulative_timestamps(active), timed.select("clip_id", "moment").distinct())
    placed = hot_join(timed, found, ["clip_id", "moment"], ["sample_id"], "left")
    empty = F.coalesce(F.col("total_ms"), F.lit(0)) == 0
    past = F.lit(False) if loop else F.col("elapsed_ms") >= F.col("total_ms")
    return placed.select(
        "clip_id", "sample_id",
        F.when(~empty, F.when(past, F.col("final.idx")).otherwise(F.col("current.idx"))).alias("idx"),
        F.when(empty, F.lit(0)).otherwise(F.col("total_ms")).cast("long").alias("total_ms"),
        F.when(empty, F.lit(0)).when(past, F.col("total_ms")).otherwise(F.col("moment")).cast("long").alias("elapsed_ms"),
        F.when(empty, F.lit(0)).when(past, F.col("final.duration_ms"))
        .otherwise(F.col("moment") - F.col("current.start_ms")).cast("long").alias("frame_elapsed_ms"),
        (empty | past).alias("complete"),
    )


def _frames_at(shown: DataFrame, moments: DataFrame) -> DataFrame:
    """(clip_id, moment, current): the frame last started at each distinct moment."""
    starts = shown.select(
        "clip_id", F.col("start_ms").alias("moment"), F.lit(0).alias("asked"), F.struct("idx", "start_ms", "duration_ms").alias("frame")
    )
    wanted = moments.select(
        "clip_id", "moment", F.lit(1).alias("asked"), F.lit(None).cast(starts.schema["frame"].dataType).alias("frame")
    )
    found = ordered_scan(
        starts.unionByName(wanted), ["clip_id"], ["moment", "asked"], [Scan("current", "last_before", F.col("frame"))]
    )
    return found.filter(F.col("asked") == 1).select("clip_id", "moment", "current")


def compare_timelines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frames of two revisions at every moment either one changes frame."""
    a = cumulative_timestamps(left.filter("included")).select(
        "clip_id", F.col("start_ms").alias("elapsed_ms"), F.col("idx").alias("a"), F.lit(None).cast("long").alias("b")
    )
    b = cumulative_timestamps(right.filter("included")).select(
        "clip_id", F.col("start_ms").alias("elapsed_ms"), F.lit(None).cast("long").alias("a"), F.col("idx").alias("b")
    )
    moments = a.unionByName(b).groupBy("clip_id", "elapsed_ms").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    held = ordered_scan(
        moments, ["clip_id"], ["elapsed_ms"],
        [Scan("a_before", "last_before", F.col("a")), Scan("b_before", "last_before", F.col("b"))],
    )
    return held.select(
        "clip_id", "elapsed_ms", F.coalesce("a", "a_before").alias("left_idx"), F.coalesce("b", "b_before").alias("right_idx")
    )


def source_summary(frames: DataFrame) -> DataFrame:
    """Clip-level diagnostics. frames(clip_id, frame_id, sha256, duration_ms, width, height, alpha, empty)."""
    per_hash = frames.groupBy("clip_id", "sha256").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("alpha").alias("alpha"), F.count_if("empty").alias("empties"),
        F.min("duration_ms").alias("d_lo"), F.max("duration_ms").alias("d_hi"),
        F.min(F.struct("width", "height")).alias("c_lo"), F.max(F.struct("width", "height")).alias("c_hi"),
    )
    return per_hash.groupBy("clip_id").agg(
        F.sum("n").alias("frames"),
        F.bool_or("alpha").alias("alpha"),
        (F.min("d_lo") != F.max("d_hi")).alias("variable_frame_rate"),
        F.sum(F.col("n") - 1).alias("duplicate_frames"),
        F.sum("empties").alias("empty_frames"),
        (F.min("c_lo") == F.max("c_hi")).alias("stable_canvas"),
    )


def loop_transitions(frames: DataFrame, approvals: DataFrame) -> DataFrame:
    """Last-to-first transition of looping clips and whether both ends passed their checkpoint.

    frames(clip_id, idx, frame_id, loop_mode); approvals(frame_id, approved, approved_by, at_checkpoint).
    """
    ends = frames.filter("loop_mode='loop'").groupBy("clip_id").agg(
        F.max_by("frame_id", "idx").alias("from_frame"), F.min_by("frame_id", "idx").alias("to_frame")
    )
    legs = ends.select("clip_id", F.explode(F.array("from_frame", "to_frame")).alias("frame_id"))
    checked = legs.join(approvals, "frame_id", "left").groupBy("clip_id").agg(
        F.bool_and(F.coalesce(F.col("approved") & F.col("at_checkpoint"), F.lit(False))).alias("both_approved"),
        F.min("approved_by").alias("lo"), F.max("approved_by").alias("hi"),
    )
    ok = F.col("both_approved") & (F.col("lo") == F.col("hi"))
    return ends.join(checked, "clip_id").select(
        "clip_id", "from_frame", "to_frame",
        F.when(ok, F.lit(None)).otherwise(F.lit("HUMAN_REVIEW_REQUIRED")).alias("warning"),
    )


def ordered_coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Positions at which two ordered lists of a clip disagree; lists (clip_id, idx, frame_id)."""
    both = expected.select("clip_id", "idx", F.col("frame_id").alias("expected")).join(
        actual.select("clip_id", "idx", F.col("frame_id").alias("actual")), ["clip_id", "idx"], "full_outer"
    )
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))
