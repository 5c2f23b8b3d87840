"""Pixel arithmetic. Frames are rows with a byte buffer; pixels exist only inside operators.

``frame_colours`` condenses a frame to one row per colour (count, box, border visits) with map-side
aggregation, so that almost every per-frame question is answered from that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import buffers as B
from framelake.operators.ordered import Scan, ordered_scan


def explode_pixels(frames: DataFrame, keep: tuple[str, ...] = ("frame_key", "clip_id")) -> DataFrame:
    """Byte buffer to (x, y, r, g, b, a), one row per pixel."""
    return B.expand(frames, keep, "x int, y int, r int, g int, b int, a int", B.pixel_rows)


def own_colours(frames: DataFrame) -> DataFrame:
    """``frame_colours`` of frames of any sizes, each by its own, with canvas_width and canvas_height."""
    sized = frames.withColumns({"canvas_width": F.col("width"), "canvas_height": F.col("height")})
    keep = ("frame_key", "clip_id", "canvas_width", "canvas_height")
    return frame_colours(explode_pixels(sized, keep), F.col("canvas_width"), F.col("canvas_height"), keep)


def frame_colours(
    pixels: DataFrame, width: int | Column, height: int | Column, keep: tuple[str, ...] = ("frame_key", "clip_id")
) -> DataFrame:
    """One row per frame and colour: pixel count, bounding box, border count and earliest border visits.

    ``width`` and ``height`` are numbers, or columns of ``pixels`` where frames differ in size.
    """
    x, y = F.col("x"), F.col("y")
    border = (x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)
    by_columns = (
        F.when(y == 0, 2 * x)
        .when(y == height - 1, 2 * x + 1)
        .otherwise(2 * width + 2 * (y - 1) + F.when(x == 0, 0).otherwise(1))
    )
    return pixels.groupBy(*keep, *C.CHANNELS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        F.max("x").alias("right"),
        F.max("y").alias("bottom"),
        F.count(F.when(border, 1)).alias("border_n"),
        F.min(F.when(border, by_columns)).alias("visit_columns"),
        F.min(F.when(border, y * width + x)).alias("visit_raster"),
    )


def with_palettes(colours: DataFrame, palettes: DataFrame) -> DataFrame:
    """Colours with the palette of their clip's contract: palettes(clip_id, palette array<[r, g, b, a]>).

    A palette has at most seventeen entries, so the lookup is one short row per clip.
    """
    from framelake.operators.ordered import hot_join

    return hot_join(colours, palettes.select("clip_id", "palette"), ["clip_id"], ["frame_key"], "left")


def palette_drift(colours: DataFrame, palettes: DataFrame) -> DataFrame:
    """Colours of a frame that its own contract's palette lacks; NO_PALETTE where the contract has none."""
    own = with_palettes(colours, palettes).filter(~C.in_own_palette(C.channels(), F.col("palette")))
    code = F.when(F.col("palette").isNull(), "NO_PALETTE").otherwise("PALETTE_DRIFT")
    return own.select("frame_key", "clip_id", C.text(C.channels()).alias("colour"), F.col("n").alias("pixels"), code.alias("code"))


def nearest_palette(colours: DataFrame, palettes: DataFrame, most: int = C.MAX_OPAQUE) -> DataFrame:
    """Per frame and colour the nearest opaque entry of the contract's palette, and what rejects the frame.

    Transparent colours map to entry 0. A frame is rejected as a whole: PARTIAL_ALPHA if any of its colours
    is translucent, TOO_MANY_COLOURS if it has more than ``most`` opaque ones, NO_PALETTE without a palette.
    """
    frame = colours.groupBy("frame_key").agg(
        F.count_if(F.col("a") == 255).alias("_opaque"), F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("_partial")
    )
    own = with_palettes(colours, palettes).join(frame, "frame_key").withColumn("near", C.nearest_own_entry(C.channels(), F.col("palette")))
    opaque = F.col("a") == 255
    code = (
        F.when(F.col("palette").isNull(), "NO_PALETTE").when(F.col("_partial") > 0, "PARTIAL_ALPHA")
        .when(F.col("_opaque") > most, "TOO_MANY_COLOURS")
    )
    return own.select(
        "frame_key", "clip_id", *C.CHANNELS, F.col("n").alias("pixels"),
        F.when(F.col("a") == 0, 0).when(opaque, F.col("near.ord")).alias("ord"), F.when(opaque, F.col("near.dist")).alias("dist"), code.alias("code"),
    )


def clip_histogram(colours: DataFrame) -> DataFrame:
    """Palette of each clip with pixel counts, most used first; frames were already summed map-side."""
    from pyspark.sql import Window

    merged = colours.groupBy("clip_id", *C.CHANNELS).agg(F.sum("n").alias("pixels"))
    rank = Window.partitionBy("clip_id").orderBy(F.col("pixels").desc(), *C.CHANNELS)
    return merged.withColumn("position", F.row_number().over(rank))


def dominant_border(colours: DataFrame) -> DataFrame:
    """Most frequent border colour per frame for both visiting orders; ties go to the first visited."""
    pick = lambda visit: F.max_by(
        C.packed(C.channels()), F.when(F.col("border_n") > 0, F.struct("border_n", -F.col(visit)))
    )
    return colours.groupBy("frame_key").agg(
        pick("visit_columns").alias("by_columns"), pick("visit_raster").alias("by_raster")
    )


def bounds_where(condition: Column, prefix: str = "") -> list[Column]:
    """Aggregates giving the box of the colours that satisfy ``condition``; null when none does."""
    left, top = F.min(F.when(condition, F.col("left"))), F.min(F.when(condition, F.col("top")))
    right, bottom = F.max(F.when(condition, F.col("right"))), F.max(F.when(condition, F.col("bottom")))
    return [
        left.alias(f"{prefix}left"), top.alias(f"{prefix}top"),
        right.alias(f"{prefix}right"), bottom.alias(f"{prefix}bottom"),
        (right - left + 1).alias(f"{prefix}width"), (bottom - top + 1).alias(f"{prefix}height"),
    ]


def foreground_bounds(colours: DataFrame, background, tolerance: int = 0) -> DataFrame:
    """Box of the pixels that differ from the background, and of those with any alpha."""
    foreground = ~C.same_color(C.channels(), C.literal(background), tolerance)
    return colours.groupBy("frame_key").agg(*bounds_where(foreground), *bounds_where(F.col("a") > 0, "alpha_"))


def alpha_counts(colours: DataFrame, keys: tuple[str, ...] = ("frame_key",)) -> DataFrame:
    """Opaque, transparent and partial pixels; whether there is alpha at all; whether nothing shows."""
    kind = C.alpha_class(F.col("a"))
    count = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).cast("long")
    return colours.groupBy(*keys).agg(
        count("opaque").alias("opaque"),
        count("transparent").alias("transparent"),
        count("partial").alias("partial"),
        F.bool_or(F.col("a") < 255).alias("alpha"),
        F.bool_and(F.col("a") == 0).alias("empty"),
    )


def background_evidence(colours: DataFrame, key, tolerance: int) -> DataFrame:
    """Visible pixels on the border, and visible pixels still near the key colour (RGB only)."""
    visible = F.col("a") > 0
    near = F.greatest(*[F.abs(F.col(c) - F.lit(v)) for c, v in zip("rgb", key)]) <= tolerance
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0)).cast("long")
    return colours.groupBy("frame_key").agg(
        total(visible, "border_n").alias("opaque_border_pixels"),
        total(visible & near, "n").alias("configured_color_pixels"),
    )


def margins(bounds: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Distance of the box to each edge, and which edges it touches; sizes as in ``frame_colours``."""
    spaces = {
        "left": F.col("left"), "top": F.col("top"),
        "right": F.lit(width) - F.col("right") - 1, "bottom": F.lit(height) - F.col("bottom") - 1,
    }
    touching = {k: F.coalesce(v == 0, F.lit(False)) for k, v in spaces.items()}
    edges = F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in touching.items()])), ",")
    return bounds.select(
        "frame_key",
        *[v.alias(f"margin_{k}") for k, v in spaces.items()],
        edges.alias("clipped_edges"),
        (edges != "").alias("clipped"),
    )


def translate_pixels(pixels: DataFrame, dx: Column, dy: Column, width: int, height: int) -> DataFrame:
    """Shift visible pixels; those that leave the canvas stay in the result, marked as clipped."""
    tx, ty = F.col("x") + dx, F.col("y") + dy
    outside = (tx < 0) | (ty < 0) | (tx >= width) | (ty >= height)
    return (
        pixels.filter(F.col("a") > 0)
        .withColumn("tx", tx)
        .withColumn("ty", ty)
        .withColumn("clipped", outside)
    )


def translation_report(pixels: DataFrame, dx: Column, dy: Column, width: int, height: int, required: Column) -> DataFrame:
    """Retained and clipped pixel counts per frame and the failure, if any."""
    tx, ty = F.col("x") + dx, F.col("y") + dy
    inside = (tx >= 0) & (ty >= 0) & (tx < width) & (ty < height)
    visible = F.col("a") > 0
    report = pixels.groupBy("frame_key", "clip_id").agg(
        F.count(F.when(visible & inside, 1)).alias("retained"),
        F.count(F.when(visible & ~inside, 1)).alias("clipped"),
    )
    code = F.when(F.col("retained") == 0, "NO_VISIBLE_PIXELS").when(
        required & (F.col("clipped") > 0), "CLIPPED_FOREGROUND"
    )
    return report.withColumn("code", code)


def upscale_nearest(pixels: DataFrame, scale: int) -> DataFrame:
    """Every pixel becomes a scale x scale block."""
    steps = F.array(*[F.lit(i) for i in range(scale)])
    others = [c for c in pixels.columns if c not in ("x", "y")]
    return (
        pixels.withColumn("_dx", F.explode(steps))
        .withColumn("_dy", F.explode(steps))
        .select(*others, (F.col("x") * scale + F.col("_dx")).alias("x"), (F.col("y") * scale + F.col("_dy")).alias("y"))
    )


def collapse_grid(pixels: DataFrame, scale: int, palette) -> DataFrame:
    """Blocks of scale x scale to one pixel, with a verdict: ``mixed`` block, colour ``outside`` the palette, or null."""
    colour = C.packed(C.channels())
    blocks = pixels.groupBy(
        "frame_key", "clip_id",
        F.floor(F.col("x") / scale).cast("int").alias("x"),
        F.floor(F.col("y") / scale).cast("int").alias("y"),
    ).agg(F.min(colour).alias("lo"), F.max(colour).alias("hi"))
    outside = ~C.in_palette(C.fields(F.col("lo")), palette)
    return blocks.select(
        "frame_key", "clip_id", "x", "y", "lo.*",
        F.when(F.col("lo") != F.col("hi"), "mixed").when(outside, "outside").alias("verdict"),
    )


def crop_and_center(bounds: DataFrame, padding: int) -> DataFrame:
    """Padded crop of each frame's box, centred (floor) on the largest crop of its clip.

    A frame without a box has no crop and the code NO_FOREGROUND.
    """
    sized = bounds.select(
        "frame_key", "clip_id", "left", "top",
        (F.col("width") + 2 * padding).alias("crop_width"),
        (F.col("height") + 2 * padding).alias("crop_height"),
    )
    clip = ordered_scan(
        sized, ["clip_id"], ["frame_key"],
        [Scan("canvas_width", "highest", F.col("crop_width")), Scan("canvas_height", "highest", F.col("crop_height"))],
        width=1 << 20,
    )
    return clip.withColumns({
        "offset_x": F.floor((F.col("canvas_width") - F.col("crop_width")) / 2).cast("int"),
        "offset_y": F.floor((F.col("canvas_height") - F.col("crop_height")) / 2).cast("int"),
        "code": F.when(F.col("crop_width").isNull(), "NO_FOREGROUND"),
    })


def _drawn(frames: DataFrame, plan: DataFrame, box: list, at: list, scale: int, canvas: list) -> DataFrame:
    """(frame_key, clip_id, width, height, rgba, code): every frame's box drawn where the plan puts it."""
    both = frames.select("frame_key", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("rgba").alias("_src")).join(plan, "frame_key")
    buffer = B.placed("_src", "_w", "_h", *box, *at, F.lit(scale), *canvas)
    drawn = both.select("frame_key", "clip_id", *[c.cast("int").alias(n) for c, n in zip(canvas, ("width", "height"))], buffer.alias("rgba"), "code")
    return drawn.withColumns({n: F.when(F.col("rgba").isNotNull(), F.col(n)) for n in ("width", "height")})


def cropped_frames(frames: DataFrame, crops: DataFrame, padding: int) -> DataFrame:
    """The pixels of ``crop_and_center``: each crop on its clip's canvas, transparent around it."""
    box = [F.col("left"), F.col("top"), F.col("crop_width") - 2 * padding, F.col("crop_height") - 2 * padding]
    at = [F.col("offset_x") + padding, F.col("offset_y") + padding]
    return _drawn(frames, crops, box, at, 1, [F.col("canvas_width"), F.col("canvas_height")])


def canonical_frames(frames: DataFrame, bounds: DataFrame, places: DataFrame, width: int, height: int, scale: int = 1) -> DataFrame:
    """The pixels of ``place_on_canonical``; frames of a rejected clip have none."""
    own = bounds.select("frame_key", "left", "top", F.col("width").alias("_bw"), F.col("height").alias("_bh"))
    plan = places.join(own, "frame_key").withColumn("code", F.coalesce("code", F.when(F.col("clip_rejected"), "CLIP_REJECTED")))
    at = [F.when(~F.col("clip_rejected"), F.col(c)) for c in ("place_left", "place_top")]
    return _drawn(frames, plan, [F.col("left"), F.col("top"), F.col("_bw"), F.col("_bh")], at, scale, [F.lit(width), F.lit(height)])


def fitted_frames(frames: DataFrame, report: DataFrame, width: int, height: int) -> DataFrame:
    """The pixels of ``fit_canvas``; a frame that loses visible pixels has none."""
    plan = report.join(frames.select("frame_key", "clip_id", F.col("width").alias("_bw"), F.col("height").alias("_bh")), "frame_key")
    start = F.when(F.col("code").isNull(), F.lit(0))
    return _drawn(frames, plan, [F.lit(0), F.lit(0), F.col("_bw"), F.col("_bh")], [start, start], 1, [F.lit(width), F.lit(height)])


def fit_canvas(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Crop or extend at the top-left corner; visible pixels outside are a failure of the frame."""
    outside = (F.col("x") >= width) | (F.col("y") >= height)
    visible = F.col("a") > 0
    report = pixels.groupBy("frame_key").agg(
        F.count(F.when(visible & ~outside, 1)).alias("kept"),
        F.count(F.when(visible & outside, 1)).alias("lost"),
    )
    return report.withColumn("code", F.when(F.col("lost") > 0, "CANVAS_OVERFLOW"))


def trunc_half(value: Column) -> Column:
    """Half of an integer, rounded towards zero."""
    return (F.signum(value) * F.floor(F.abs(value) / 2)).cast("int")


def apply_edit(
    pixels: DataFrame, size: int | tuple, turns: Column, scale: Column, dx: Column, dy: Column, canvas: int | tuple[int, int]
) -> DataFrame:
    """Clockwise quarter turns, integer scale, centring with truncation, translation; off-canvas pixels dropped.

    ``size`` is the side of square source rasters or their (width, height), numbers or columns; ``canvas`` likewise, in numbers.
    """
    width, height = (F.lit(v) if isinstance(v, int) else v for v in (size if isinstance(size, tuple) else (size, size)))
    across, down = canvas if isinstance(canvas, tuple) else (canvas, canvas)
    x, y, turn = F.col("x"), F.col("y"), F.pmod(turns, F.lit(4))
    rx = F.when(turn == 1, height - 1 - y).when(turn == 2, width - 1 - x).when(turn == 3, y).otherwise(x)
    ry = F.when(turn == 1, x).when(turn == 2, height - 1 - y).when(turn == 3, width - 1 - x).otherwise(y)
    on_side = turn % 2 == 1
    left = trunc_half(F.lit(across) - F.when(on_side, height).otherwise(width) * scale)
    top = trunc_half(F.lit(down) - F.when(on_side, width).otherwise(height) * scale)
    placed = (
        pixels.withColumns({"_rx": rx, "_ry": ry, "_s": scale, "_left": left + dx, "_top": top + dy})
        .withColumn("_dx", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
        .withColumn("_dy", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    )
    tx = F.col("_left") + F.col("_rx") * F.col("_s") + F.col("_dx")
    ty = F.col("_top") + F.col("_ry") * F.col("_s") + F.col("_dy")
    others = [c for c in pixels.columns if c not in ("x", "y")]
    return placed.select(*others, tx.cast("int").alias("x"), ty.cast("int").alias("y")).filter(
        (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < across) & (F.col("y") < down)
    )


def place_on_canonical(
    bounds: DataFrame, pivot: tuple[int, int], width: int, height: int, scale: int = 1, landmark: tuple[Column, Column] | None = None
) -> DataFrame:
    """Position of each frame's box on the canonical cell; one overflow or empty frame rejects the whole clip."""
    w, h = F.col("width") * scale, F.col("height") * scale
    if landmark is None:
        left = F.lit(pivot[0]) - F.floor(w / 2)
        top = F.lit(pivot[1]) - h
    else:
        left = F.lit(pivot[0]) - (landmark[0] - F.col("left")) * scale
        top = F.lit(pivot[1]) - (landmark[1] - F.col("top")) * scale
    placed = bounds.select(
        "frame_key", "clip_id",
        left.cast("int").alias("place_left"), top.cast("int").alias("place_top"),
        w.cast("int").alias("place_width"), h.cast("int").alias("place_height"),
    )
    over = (
        (F.col("place_left") < 0) | (F.col("place_top") < 0)
        | (F.col("place_left") + F.col("place_width") > width)
        | (F.col("place_top") + F.col("place_height") > height)
    )
    code = F.when(F.col("place_width").isNull(), "NO_FOREGROUND").when(F.col("overflow"), "CANVAS_OVERFLOW")
    placed = placed.withColumn("overflow", F.coalesce(over, F.lit(False))).withColumn("code", code)
    return ordered_scan(
        placed, ["clip_id"], ["frame_key"], [Scan("clip_rejected", "highest", F.col("code").isNotNull())], width=1 << 20
    )


def prepare_anchor(
    frames_with_corner: DataFrame, pivot: tuple[int, int], cell: int, generation_scale: int, runtime_scale: int
) -> DataFrame:
    """Canonical placement, key colour and scaled pivots of an anchor keyed by its (0,0) pixel.

    Input: frame_key, ``background`` struct, ``colours`` array of colour rows of the frame.
    """
    keyed = frames_with_corner.withColumnRenamed("background", "key")
    key = C.fields(F.col("key"))
    clear = (key["r"] == 0) & (key["g"] == 0) & (key["b"] == 0) & (key["a"] == 0)
    fallback = C.literal(C.FALLBACK_CHROMA)
    chroma = {c: F.when(clear, fallback[c]).otherwise(key[c]) for c in "rgb"}
    chroma["a"] = F.lit(255)
    shown = F.filter("colours", lambda c: ~C.same_color(C.fields(c), key, 0))
    least = lambda f: F.array_min(F.transform(shown, lambda c: c.getField(f)))
    most = lambda f: F.array_max(F.transform(shown, lambda c: c.getField(f)))
    boxed = keyed.select(
        "frame_key",
        C.text(key).alias("background"),
        C.text(chroma).alias("chroma"),
        least("left").alias("left"), least("top").alias("top"),
        (most("right") - least("left") + 1).alias("width"), (most("bottom") - least("top") + 1).alias("height"),
        F.aggregate(shown, F.lit(0).cast("long"), lambda s, c: s + c.getField("n")).alias("foreground_pixels"),
    )
    left = F.lit(pivot[0]) - F.floor(F.col("width") / 2).cast("int")
    top = F.lit(pivot[1]) - F.col("height")
    misfit = (left < 0) | (top < 0) | (left + F.col("width") > cell) | (top + F.col("height") > cell)
    return boxed.select(
        "frame_key", "background", "chroma", "foreground_pixels",
        left.alias("canonical_left"), top.alias("canonical_top"),
        F.lit(cell * generation_scale).alias("plate_side"),
        F.lit(pivot[0] * runtime_scale).alias("runtime_pivot_x"),
        F.lit(pivot[1] * runtime_scale).alias("runtime_pivot_y"),
        F.when(F.col("width").isNull(), "NO_FOREGROUND").when(misfit, "CANVAS_SIZE").alias("code"),
    )


def frame_hash(frames: DataFrame) -> DataFrame:
    """sha256 of the decoded bytes."""
    return frames.withColumn("sha256", F.sha2("rgba", 256))


def axis_runs(frames: DataFrame, keep: tuple[str, ...] = ("frame_key", "clip_id")) -> DataFrame:
    """Maximal same-colour runs of every row and column: (axis, line, start, length, r, g, b, a), without a shuffle."""
    schema = "vertical boolean, line int, start int, length int, r int, g int, b int, a int"
    runs = B.expand(frames, keep, schema, B.run_rows)
    return runs.withColumn("axis", F.when(F.col("vertical"), "vertical").otherwise("horizontal")).drop("vertical")
