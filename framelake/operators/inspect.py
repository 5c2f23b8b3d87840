"""Pixel-grid inference and the per-frame inspection report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import pixels as P

# Fixed thresholds of the mixed-grid evidence.
MODE_MIN_COUNT = 4
MODE_MIN_SHARE = 0.15
MAX_LENGTHS = 32
MAX_MODES = 3
LARGE_PALETTE = 256


def run_histogram(runs: DataFrame) -> DataFrame:
    """Foreground runs per frame, axis and length, with the earliest place each length appears."""
    return runs.groupBy("frame_key", "axis", "length").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "start")).alias("first_seen")
    )


def _modes(axis: str) -> Column:
    on_axis = F.filter("hist", lambda h: h.axis == axis)
    runs = F.aggregate(on_axis, F.lit(0).cast("long"), lambda s, h: s + h.n)
    strong = F.filter(
        on_axis, lambda h: (h.length > 1) & (h.n >= MODE_MIN_COUNT) & (h.n / runs >= MODE_MIN_SHARE)
    )
    ranked = F.array_sort(
        F.transform(strong, lambda h: F.struct((-h.n).alias("neg"), h.first_seen.alias("seen"), h.length.alias("length"), h.n.alias("n")))
    )
    return F.when(F.size(ranked) >= 2, F.slice(ranked, 1, MAX_MODES))


def infer_grid(histogram: DataFrame) -> DataFrame:
    """Block size as the common divisor of run lengths, repeated modes per axis, and a confidence."""
    frame = histogram.groupBy("frame_key").agg(
        F.collect_list(F.struct("axis", "length", "n", "first_seen")).alias("hist")
    )
    useful = F.filter("hist", lambda h: h.length > 1)
    lengths = F.array_sort(F.array_distinct(F.transform(useful, lambda h: h.length)))
    frame = frame.withColumns({
        "lengths": lengths,
        "sample_count": F.aggregate(useful, F.lit(0).cast("long"), lambda s, h: s + h.n),
        "modes_horizontal": _modes("horizontal"),
        "modes_vertical": _modes("vertical"),
    })
    divisors = F.filter(
        F.sequence(F.lit(1), F.array_min("lengths")),
        lambda d: F.forall("lengths", lambda n: n % d == 0),
    )
    block = F.when(F.size("lengths") > 0, F.array_max(divisors))
    mixed = F.col("modes_horizontal").isNotNull().cast("int") + F.col("modes_vertical").isNotNull().cast("int")
    plain = (
        F.when(block == 1, F.lit(0.55))
        .when(block.isNotNull() & (F.col("sample_count") >= 4), F.least(F.lit(0.75), 0.35 + F.col("sample_count") / 100))
        .when(block.isNotNull(), F.lit(0.25))
        .otherwise(F.lit(0.0))
    )
    confidence = F.when(mixed > 0, F.least(F.lit(0.8), 0.55 + mixed * 0.1)).otherwise(plain)
    shown = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m.length, m.n)), ",")
    return frame.select(
        "frame_key",
        block.cast("int").alias("block_size"),
        F.array_join(F.slice("lengths", 1, MAX_LENGTHS), ",").alias("run_lengths"),
        "sample_count",
        shown("modes_horizontal").alias("horizontal_modes"),
        shown("modes_vertical").alias("vertical_modes"),
        (mixed > 0).alias("mixed_blocks"),
        F.round(confidence, 6).alias("confidence"),
    )


def top_modes(histogram: DataFrame) -> DataFrame:
    """The most frequent run lengths per frame and axis (ties to the first seen), at most three."""
    ranked = histogram.filter(F.col("length") > 1).groupBy("frame_key", "axis").agg(
        F.slice(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "first_seen", "length", "n"))), 1, MAX_MODES
        ).alias("top")
    )
    return ranked.select("frame_key", "axis", F.posexplode("top").alias("pos", "m")).select(
        "frame_key", "axis", (F.col("pos") + 1).alias("rank"), F.col("m.length").alias("length"), F.col("m.n").alias("runs")
    )


def foreground_runs(frames: DataFrame, backgrounds: DataFrame, tolerance: int) -> DataFrame:
    """Runs of each frame that are not its background colour."""
    keyed = frames.join(backgrounds, "frame_key")
    runs = P.axis_runs(keyed, keep=("frame_key", "background"))
    return runs.filter(~C.same_color(C.channels(), C.fields(F.col("background")), tolerance))


def inspect_frames(frames: DataFrame, tolerance: int = 0) -> DataFrame:
    """One report row per frame: background, palette size, box, margins, alpha counts, grid and diagnostics.

    Every frame is measured by its own width and height.
    """
    colours = P.own_colours(frames)
    own = C.channels()
    width, height = F.col("canvas_width"), F.col("canvas_height")
    stats = colours.groupBy("frame_key", width, height).agg(
        F.max_by(C.packed(own), F.when(F.col("border_n") > 0, F.struct("border_n", -F.col("visit_columns")))).alias("background"),
        F.count(F.lit(1)).alias("palette_size"),
        F.sum(F.when(F.col("a") == 255, F.col("n")).otherwise(0)).alias("opaque"),
        F.sum(F.when(F.col("a") == 0, F.col("n")).otherwise(0)).alias("transparent"),
        F.sum(F.when((F.col("a") > 0) & (F.col("a") < 255), F.col("n")).otherwise(0)).alias("partial"),
        F.collect_list(F.struct(*C.CHANNELS, "left", "top", "right", "bottom")).alias("parts"),
    )
    shown = F.filter("parts", lambda c: ~C.same_color(C.fields(c), C.fields(F.col("background")), tolerance))
    least = lambda f: F.array_min(F.transform(shown, lambda c: c.getField(f)))
    most = lambda f: F.array_max(F.transform(shown, lambda c: c.getField(f)))
    boxed = stats.withColumns({"left": least("left"), "top": least("top"), "right": most("right"), "bottom": most("bottom")}).drop("parts")
    grid = infer_grid(run_histogram(foreground_runs(frames, boxed.select("frame_key", "background"), tolerance)))
    report = boxed.join(grid, "frame_key", "left")
    clipped = (
        (F.col("left") == 0) | (F.col("top") == 0) | (F.col("right") == width - 1) | (F.col("bottom") == height - 1)
    )
    codes = F.array_compact(F.array(
        F.when(F.col("left").isNull(), "NO_FOREGROUND"),
        F.when(F.col("palette_size") > LARGE_PALETTE, "LARGE_PALETTE"),
        F.when(clipped, "EDGE_CLIPPING"),
        F.when(F.col("partial") > 0, "SMOOTHING_SUSPECTED"),
        F.when(F.col("mixed_blocks"), "MIXED_PIXEL_BLOCKS"),
    ))
    return report.select(
        "frame_key", C.text(C.fields(F.col("background"))).alias("background"), "palette_size",
        "left", "top", "right", "bottom", "opaque", "transparent", "partial",
        "block_size", "sample_count", "horizontal_modes", "vertical_modes", "confidence",
        F.array_join(codes, ",").alias("diagnostics"),
    )
