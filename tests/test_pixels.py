import numpy as np
import pyarrow as pa
import pytest
from conftest import as_frames, raster, rows
from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import compare, composite, inspect
from framelake.operators import pixels as P


def anchor():
    pixels = raster(13, 14)
    pixels[3:12, 5:8] = (20, 30, 60, 255)
    return pixels


def test_inspection_of_the_anchor(spark):
    report = inspect.inspect_frames(as_frames(spark, [anchor()])).first()
    assert (report.background, report.palette_size, report.opaque) == ("0,255,0,255", 2, 182)
    assert (report.left, report.top, report.right, report.bottom) == (5, 3, 7, 11)
    assert report.diagnostics == ""


def test_margins_of_the_anchor(spark):
    colours = P.frame_colours(P.explode_pixels(as_frames(spark, [anchor()])), 13, 14)
    bounds = P.foreground_bounds(colours, (0, 255, 0, 255))
    m = P.margins(bounds, 13, 14).first()
    assert (m.margin_left, m.margin_top, m.margin_right, m.margin_bottom) == (5, 3, 5, 2)
    assert not m.clipped


def test_partial_alpha_at_the_edge(spark):
    pixels = raster(8, 8)
    for x in range(3):
        pixels[0:4, x] = (20 + x, 30, 60, 128 if x == 1 else 255)
    report = inspect.inspect_frames(as_frames(spark, [pixels])).first()
    assert report.partial == 4
    assert report.diagnostics == "EDGE_CLIPPING,SMOOTHING_SUSPECTED"


def test_mixed_grid(spark):
    pixels = raster(40, 12)
    for x in range(1, 17, 4):
        pixels[1:11, x : x + 2] = (20, 30, 60, 255)
    for x in range(21, 39, 6):
        pixels[1:11, x : x + 3] = (20, 30, 60, 255)
    report = inspect.inspect_frames(as_frames(spark, [pixels])).first()
    assert report.horizontal_modes == "2:40,3:30"
    assert "MIXED_PIXEL_BLOCKS" in report.diagnostics


def test_empty_frame_has_no_bounds(spark):
    report = inspect.inspect_frames(as_frames(spark, [raster(4, 4)])).first()
    assert report.left is None
    assert report.diagnostics == "NO_FOREGROUND"


def test_explode_restores_bytes(spark):
    pixels = np.random.default_rng(3).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in P.explode_pixels(as_frames(spark, [pixels])).collect()}
    assert got == {(x, y): tuple(int(v) for v in pixels[y, x]) for y in range(5) for x in range(7)}


def test_visit_orders_decide_ties_differently(spark):
    pixels = raster(3, 3, (9, 9, 9, 255))
    pixels[0, 0] = pixels[0, 1] = (1, 0, 0, 255)
    pixels[2, 0] = pixels[2, 1] = (2, 0, 0, 255)
    pixels[0, 2], pixels[1, 0], pixels[1, 2], pixels[2, 2] = (3, 0, 0, 255), (4, 0, 0, 255), (5, 0, 0, 255), (6, 0, 0, 255)
    border = P.dominant_border(P.frame_colours(P.explode_pixels(as_frames(spark, [pixels])), 3, 3)).first()
    assert border.by_columns.r == 1 and border.by_raster.r == 1
    flipped = pixels[::-1].copy()
    flipped[0, 0], flipped[0, 1], flipped[1, 0] = (7, 0, 0, 255), (2, 0, 0, 255), (2, 0, 0, 255)
    border = P.dominant_border(P.frame_colours(P.explode_pixels(as_frames(spark, [flipped])), 3, 3)).first()
    assert (border.by_columns.r, border.by_raster.r) == (1, 2)


def test_spill_needs_a_dominant_channel(spark):
    one = spark.range(1)
    key = lambda c: C.literal(c)
    values = one.select(
        C.dominant_channel(key((0, 255, 0, 255))).alias("green"), C.dominant_channel(key((9, 9, 0, 255))).alias("none"),
        C.is_chroma_spill(key((0, 80, 0, 255)), key((0, 255, 0, 255)), 8, 24).alias("dark"),
        C.is_chroma_spill(key((70, 80, 0, 255)), key((0, 255, 0, 255)), 8, 24).alias("olive"),
        C.same_color(key((9, 9, 9, 0)), key((0, 0, 0, 0)), 0).alias("same"),
        C.matches_background(key((9, 9, 9, 0)), key((0, 0, 0, 0)), 0).alias("background"),
    ).first()
    assert tuple(values) == ("g", None, True, False, False, True)


def test_palette_rules():
    C.check_palette([(0, 0, 0, 0), (1, 2, 3, 255)])
    for bad in ([(0, 0, 0, 0)], [(0, 0, 0, 255), (1, 2, 3, 255)], [(0, 0, 0, 0), (1, 2, 3, 9)], [(0, 0, 0, 0)] + [(i, 0, 0, 255) for i in range(17)]):
        with pytest.raises(ValueError):
            C.check_palette(bad)


def test_nearest_entry_ties_go_to_the_lower_position(spark):
    near = spark.range(1).select(C.nearest_entry(C.literal((10, 0, 0, 255)), [(0, 0, 0, 0), (20, 0, 0, 255), (0, 0, 0, 255)]).alias("n")).first().n
    assert (near.ord, near.dist) == (1, 100)


def test_placement_on_the_canonical_cell(spark):
    bounds = spark.createDataFrame([(1, 1, 0, 0, 15, 30), (2, 1, 0, 0, 28, 18)], "frame_key long, clip_id long, left int, top int, width int, height int")
    placed = P.place_on_canonical(bounds, (64, 112), 128, 128).collect()
    assert {r.place_top + r.place_height - 1 for r in placed} == {111}
    assert not any(r.clip_rejected for r in placed)
    wide = bounds.unionByName(bounds.limit(1).withColumn("frame_key", F.lit(3).cast("long")).withColumn("width", F.lit(129)))
    assert all(r.clip_rejected for r in P.place_on_canonical(wide, (64, 112), 128, 128).collect())


def test_centering_rounds_towards_zero_for_edits(spark):
    assert [r[0] for r in spark.createDataFrame([(-3,), (-4,), (5,)], "v int").select(P.trunc_half(F.col("v"))).collect()] == [-1, -2, 2]


def test_quarter_turn_is_clockwise(spark):
    pixel = spark.createDataFrame([(1, 0, 0, 9, 9, 9, 255)], "frame_key long, x int, y int, r int, g int, b int, a int")
    turned = P.apply_edit(pixel, 4, F.lit(1), F.lit(1), F.lit(0), F.lit(0), 4).first()
    assert (turned.x, turned.y) == (3, 0)


def test_translation_failures(spark):
    pixels = P.explode_pixels(as_frames(spark, [anchor()]))
    gone = P.translation_report(pixels, F.lit(99), F.lit(0), 13, 14, F.lit(True)).first()
    cut = P.translation_report(pixels, F.lit(1), F.lit(0), 13, 14, F.lit(True)).first()
    assert gone.code == "NO_VISIBLE_PIXELS"
    assert (cut.code, cut.clipped) == ("CLIPPED_FOREGROUND", 14)


def test_scaled_output_matches_its_source(spark):
    small = anchor()
    big = small.repeat(2, axis=0).repeat(2, axis=1)
    forged = big.copy()
    forged[0, 0] = (1, 1, 1, 255)
    result = compare.block_match(as_frames(spark, [small, small]), as_frames(spark, [big, forged]), 2)
    assert rows(result, "frame_key", "mismatches", "matches") == [(0, 0, True), (1, 1, False)]
    wrong = compare.block_match(as_frames(spark, [small]), as_frames(spark, [small]), 2).first()
    assert wrong.matches is False


def test_shifted_output_matches_its_source(spark):
    source = np.zeros((4, 4, 4), dtype=np.uint8)
    source[1, 1] = (5, 6, 7, 255)
    source[3, 3] = (9, 9, 9, 0)
    output = np.zeros((4, 4, 4), dtype=np.uint8)
    output[0, 3] = (5, 6, 7, 255)
    result = compare.translated_match(as_frames(spark, [source]), as_frames(spark, [output]), F.lit(2), F.lit(-1)).first()
    assert result.matches


FRAMES = "anim long, step long, canvas_w int, canvas_h int, rect_x int, rect_y int, rect_w int, rect_h int, dispose string, blend string, rgba binary"


def pages_of(spark, frames, **sizes):
    pages = composite.whole_pages(composite.replay_disposal(spark.createDataFrame(frames, FRAMES), ["anim"], **sizes), ["anim"])
    return {(r.anim, r.step): (r.width, r.height, bytes(r.rgba)) for r in pages.collect()}


def test_disposal_previous_restores(spark):
    rects = [(0, 0, "none", "source"), (0, 0, "previous", "source"), (5, 5, "none", "over")]
    frames = [(1, s, 6, 6, x, y, 1, 1, d, b, bytearray([v, 0, 0, 255])) for s, (v, (x, y, d, b)) in enumerate(zip((10, 20, 30), rects))]
    pages = pages_of(spark, frames)
    assert [(s, page[2][0]) for (_, s), page in sorted(pages.items())] == [(0, 10), (1, 20), (2, 10)]
    assert all(page[:2] == (6, 6) and len(page[2]) == 144 for page in pages.values()) and pages[1, 2][2][-4] == 30


def replayed(frames):
    """Pages of one animation, a frame after the other on the whole canvas."""
    canvas, out = None, []
    for _, step, cw, ch, x, y, w, h, dispose, blend, rgba in frames:
        canvas = np.zeros((ch, cw, 4), dtype=np.uint8) if canvas is None else canvas
        page, patch = canvas.copy(), np.frombuffer(bytes(rgba), dtype=np.uint8).reshape(h, w, 4)
        for dy in range(max(0, -y), min(h, ch - y)):
            for dx in range(max(0, -x), min(w, cw - x)):
                t, u = patch[dy, dx].astype(int), canvas[y + dy, x + dx].astype(int)
                if blend == "source" or t[3] == 255:
                    page[y + dy, x + dx] = t
                elif t[3]:
                    weight = t[3] * 255 + u[3] * (255 - t[3])
                    page[y + dy, x + dx] = [*((2 * (t[:3] * t[3] * 255 + u[:3] * u[3] * (255 - t[3])) + weight) // (2 * weight)), (2 * weight + 255) // 510]
        out.append(page.tobytes())
        if dispose != "previous":
            canvas = page.copy()
            if dispose == "background":
                canvas[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = 0
    return out


def random_animation(rng, anim, steps, width, height):
    for step in range(steps):
        w, h = int(rng.integers(1, width + 1)), int(rng.integers(1, height + 1))
        x, y = int(rng.integers(-2, width)), int(rng.integers(-2, height))
        patch = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
        patch[:, :, 3] = rng.choice([0, 1, 100, 254, 255], (h, w))
        yield anim, step, width, height, x, y, w, h, str(rng.choice(["none", "background", "previous"])), str(rng.choice(["source", "over", "over"])), bytearray(patch.tobytes())


@pytest.mark.parametrize("tile, chunk", [(32, 128), (3, 4), (5, 1)])
def test_replay_in_tiles_and_chunks_equals_one_pass(spark, tile, chunk):
    rng = np.random.default_rng(tile)
    animations = [list(random_animation(rng, i, n, w, h)) for i, (n, w, h) in enumerate([(17, 7, 5), (1, 3, 3), (9, 1, 8)])]
    pages = pages_of(spark, [f for a in animations for f in a], tile=tile, chunk=chunk)
    assert pages == {(i, s): (a[0][2], a[0][3], page) for i, a in enumerate(animations) for s, page in enumerate(replayed(a))}


def test_programs_compose_in_any_grouping():
    rng = np.random.default_rng(5)
    for _ in range(60):
        some = []
        for _ in range(6):
            inside = rng.permutation(9)[: rng.integers(0, 9)]
            patch = rng.integers(0, 256, (len(inside), 4), dtype=np.uint8)
            patch[:, 3] = rng.choice([0, 7, 255], len(inside))
            some.append(composite.Program.step(9, inside, patch, str(rng.choice(["none", "none", "background", "previous"])), str(rng.choice(["source", "over"]))))
        canvas, cut = rng.integers(0, 256, (9, 4), dtype=np.uint8), int(rng.integers(1, 6))
        left, right = composite.Program.keep(9), composite.Program.keep(9)
        for one in some[:cut]:
            left = left.then(one)
        for one in some[cut:]:
            right = right.then(one)
        want = canvas
        for one in some:
            want = one.apply(want)
        assert (left.then(right).apply(canvas) == want).all() and (right.apply(left.apply(canvas)) == want).all()


def test_long_animation_needs_little_memory(spark):
    def make(batches):
        for batch in batches:
            for step in batch.column(0).to_pylist():
                patch = np.full((2, 1024, 4), (step % 251, 0, 0, 128 if step % 5 else 255), dtype=np.uint8)
                yield pa.RecordBatch.from_pydict({
                    "anim": pa.array([1]), "step": pa.array([step]), "canvas_w": pa.array([1024], pa.int32()), "canvas_h": pa.array([2], pa.int32()),
                    "rect_x": pa.array([0], pa.int32()), "rect_y": pa.array([0], pa.int32()), "rect_w": pa.array([1024], pa.int32()), "rect_h": pa.array([2], pa.int32()),
                    "dispose": ["none"], "blend": ["over"], "rgba": [patch.tobytes()],
                })

    frames = spark.range(0, composite.MAX_FRAMES, 1, 16).mapInArrow(make, FRAMES)
    tiles = composite.replay_disposal(frames, ["anim"], tile=128)
    last = tiles.groupBy("step").agg(F.sum(F.length("rgba")).alias("n"), F.min(F.substring(F.hex("rgba"), 1, 8)).alias("low"), F.max(F.substring(F.hex("rgba"), -8, 8)).alias("high"))
    about = last.agg(F.count("*").alias("steps"), F.min("n").alias("n"), F.count_if(F.col("low") != F.col("high")).alias("uneven")).first()
    assert (about.steps, about.n, about.uneven) == (composite.MAX_FRAMES, 1024 * 2 * 4, 0)
    assert composite.frame_limit(frames, ["anim"]).count() == 0
    assert [r.code for r in composite.frame_limit(frames.unionByName(frames.limit(1)), ["anim"]).collect()] == ["FRAME_LIMIT"]


def test_layers_fold_in_order(spark):
    rng = np.random.default_rng(9)
    stack = rng.integers(0, 256, (3, 4, 5, 4), dtype=np.uint8)
    rows_in = [(1, i, 5, 4, bytearray(layer.tobytes())) for i, layer in enumerate(stack)]
    got = composite.composite_layers(spark.createDataFrame(rows_in[::-1], "grp long, idx long, width int, height int, rgba binary"), ["grp"], "idx").first()
    want = np.zeros((20, 4), dtype=np.uint8)
    for layer in stack:
        want = composite.over(layer.reshape(-1, 4), want)
    assert bytes(got.rgba) == want.tobytes() and (got.width, got.height) == (5, 4)


def test_source_over_rounds_half_up(spark):
    def over(top, under):
        mixed = C.alpha_over(C.literal(top), C.literal(under))
        return tuple(spark.range(1).select(*[mixed[c] for c in "rgba"]).first())

    assert over((9, 9, 9, 255), (1, 2, 3, 255)) == (9, 9, 9, 255)
    assert over((9, 9, 9, 0), (1, 2, 3, 77)) == (1, 2, 3, 77)

    def reference(top, under):
        weight = top[3] * 255 + under[3] * (255 - top[3])
        half_up = lambda v: int(np.floor(v + 0.5))
        return tuple(half_up((t * top[3] * 255 + u * under[3] * (255 - top[3])) / weight) for t, u in zip(top[:3], under[:3])) + (half_up(weight / 255),)

    for top, under in [((200, 100, 50, 128), (0, 0, 0, 255)), ((1, 2, 3, 1), (250, 240, 230, 3)), ((255, 0, 7, 254), (3, 3, 3, 9))]:
        assert over(top, under) == reference(top, under)


def test_frames_of_different_sizes_are_measured_by_their_own(spark):
    rasters = []
    for width, height in ((5, 4), (9, 7), (3, 12)):
        pixels = raster(width, height)
        pixels[1, 1] = (9, 9, 9, 255)
        pixels[height - 1, width - 1] = (7, 7, 7, 255)
        rasters.append(pixels)
    frames = as_frames(spark, rasters)
    together = rows(inspect.inspect_frames(frames), "frame_key", "left", "right", "bottom", "diagnostics")
    alone = [rows(inspect.inspect_frames(frames.filter(f"frame_key={i}")), "frame_key", "left", "right", "bottom", "diagnostics")[0] for i in range(3)]
    assert together == alone and all("EDGE_CLIPPING" in r[4] for r in together)
    border = P.dominant_border(P.own_colours(frames)).select("frame_key", "by_columns.g").collect()
    assert {r.g for r in border} == {255}


def test_each_contract_has_its_own_palette(spark):
    pixels = raster(2, 2, (10, 0, 0, 255))
    pixels[0, 0] = (0, 0, 0, 0)
    pixels[1, 1] = (20, 0, 0, 255)
    frames = as_frames(spark, [pixels], 1).unionByName(as_frames(spark, [pixels], 2).withColumn("frame_key", F.lit(1).cast("long")))
    frames = frames.unionByName(as_frames(spark, [pixels], 3).withColumn("frame_key", F.lit(2).cast("long")))
    palettes = spark.createDataFrame(
        [(1, [[0, 0, 0, 0], [10, 0, 0, 255], [20, 0, 0, 255]]), (2, [[0, 0, 0, 0], [12, 0, 0, 255]])], "clip_id long, palette array<array<int>>"
    )
    colours = P.own_colours(frames)
    assert rows(P.palette_drift(colours, palettes), "clip_id", "colour", "code") == [
        (2, "10,0,0,255", "PALETTE_DRIFT"), (2, "20,0,0,255", "PALETTE_DRIFT"),
        (3, "0,0,0,0", "NO_PALETTE"), (3, "10,0,0,255", "NO_PALETTE"), (3, "20,0,0,255", "NO_PALETTE"),
    ]
    near = rows(P.nearest_palette(colours, palettes, most=2).filter("clip_id<3 AND a=255"), "clip_id", "r", "ord", "dist", "code")
    assert near == [(1, 10, 1, 0, None), (1, 20, 2, 0, None), (2, 10, 1, 4, None), (2, 20, 1, 64, None)]
    assert {r.code for r in P.nearest_palette(colours, palettes, most=1).filter("clip_id<3").collect()} == {"TOO_MANY_COLOURS"}


def test_placed_pixels_move_scale_and_stop_at_the_canvas(spark):
    pixels = raster(4, 3, (0, 0, 0, 0))
    pixels[1, 1], pixels[1, 2], pixels[2, 1] = (1, 2, 3, 255), (4, 5, 6, 255), (7, 8, 9, 128)
    pixels[0, 0] = (50, 50, 50, 0)
    frames = as_frames(spark, [pixels, raster(4, 3, (0, 0, 0, 0))])
    bounds = P.own_colours(frames).groupBy("frame_key", "clip_id").agg(*P.bounds_where(F.col("a") > 0))
    crops = P.crop_and_center(bounds, 1)
    drawn = {r.frame_key: r for r in P.cropped_frames(frames, crops, 1).collect()}
    want = np.zeros((4, 4, 4), dtype=np.uint8)
    want[1, 1], want[1, 2], want[2, 1] = pixels[1, 1], pixels[1, 2], pixels[2, 1]
    assert bytes(drawn[0].rgba) == want.tobytes() and (drawn[0].width, drawn[0].height) == (4, 4)
    assert (drawn[1].rgba, drawn[1].code) == (None, "NO_FOREGROUND")
    places = P.place_on_canonical(bounds.filter("frame_key=0"), (3, 5), 6, 6, scale=2)
    cell = P.canonical_frames(frames, bounds, places, 6, 6, 2).first()
    big = np.zeros((6, 6, 4), dtype=np.uint8)
    big[1:5, 1:5] = want[1:3, 1:3].repeat(2, axis=0).repeat(2, axis=1)
    assert bytes(cell.rgba) == big.tobytes()
    assert all(r.clip_rejected for r in P.place_on_canonical(bounds, (3, 5), 6, 6, scale=2).collect())
    fitted = P.fitted_frames(frames, P.fit_canvas(P.explode_pixels(frames), 3, 4), 3, 4)
    assert rows(fitted, "frame_key", "width", "height", "code") == [(0, 3, 4, None), (1, 3, 4, None)]
    lost = P.fitted_frames(frames, P.fit_canvas(P.explode_pixels(frames), 2, 2), 2, 2)
    assert rows(lost, "frame_key", "rgba", "code")[0] == (0, None, "CANVAS_OVERFLOW")


@pytest.mark.parametrize("turns", [0, 1, 2, 3, -1])
def test_edits_of_frames_that_are_not_square(spark, turns):
    rng = np.random.default_rng(turns + 9)
    source = rng.integers(0, 256, (3, 5, 4), dtype=np.uint8)
    pixels = P.explode_pixels(as_frames(spark, [source]).withColumns({"w": F.col("width"), "h": F.col("height")}), ("frame_key", "w", "h"))
    got = P.apply_edit(pixels, (F.col("w"), F.col("h")), F.lit(turns), F.lit(2), F.lit(1), F.lit(-2), (9, 12))
    turned = np.rot90(source, -turns).repeat(2, axis=0).repeat(2, axis=1)
    left, top = int((9 - turned.shape[1]) / 2) + 1, int((12 - turned.shape[0]) / 2) - 2
    want = [
        (left + x, top + y, *turned[y, x].tolist())
        for y in range(turned.shape[0]) for x in range(turned.shape[1]) if 0 <= left + x < 9 and 0 <= top + y < 12
    ]
    assert sorted(tuple(r) for r in got.select("x", "y", "r", "g", "b", "a").collect()) == sorted(want)
