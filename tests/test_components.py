import numpy as np
import pyarrow as pa
import pytest
from conftest import as_frames, raster, rows
from pyspark.sql import functions as F

from framelake.operators import components, tiles
from framelake.operators import components as K
from framelake.operators import pixels as P


def key(colour):
    return F.struct(*[F.lit(v).alias(c) for c, v in zip("rgba", colour)])


def board(dark_spill=False):
    pixels = raster(12, 8)
    for x, y in [(4, 1), (5, 1), (6, 1), (7, 1), (5, 2), (6, 2)]:
        pixels[y, x] = (214, 30, 42, 255)
    for x, y in [(0, 4), (1, 4), (2, 4), (1, 5)]:
        pixels[y, x] = (44, 77, 221, 255)
    for x, y in [(9, 5), (10, 5), (9, 6), (10, 6)]:
        pixels[y, x] = (248, 198, 34, 255)
    pixels[0, 0] = pixels[0, 11] = (255, 0, 255, 255)
    pixels[3, 3] = (0, 250, 4, 255)
    if dark_spill:
        pixels[3, 8] = (0, 80, 0, 255)
    return pixels


def stats(spark, pixels, **options):
    runs = K.component_runs(as_frames(spark, [pixels]), key((0, 255, 0, 255)), 8, clear_matches=False, **options)
    return K.component_stats(runs, minimum=4)


def test_pose_board_components(spark):
    found = stats(spark, board()).cache()
    real = found.filter("NOT noise").orderBy("component_id").collect()
    assert [r.component_id for r in real] == ["component-0001", "component-0002", "component-0003"]
    assert [r.pixel_count for r in real] == [6, 4, 4]
    assert (real[0].left, real[0].top, real[0].right, real[0].bottom) == (4, 1, 7, 2)
    assert found.filter("noise").count() == 2


def test_chroma_spill_is_removed_on_request(spark):
    assert stats(spark, board(True)).filter("noise").count() == 3
    cleaned = stats(spark, board(True), minimum_dominance=24)
    assert cleaned.filter("noise").count() == 2
    assert sorted(r.pixel_count for r in cleaned.filter("NOT noise").collect()) == [4, 4, 6]


def test_grouped_candidates_in_reading_order(spark):
    groups = spark.createDataFrame(
        [(0, "actor-and-prop", "component-0002"), (0, "actor-and-prop", "component-0003")], "frame_key long, group_id string, component_id string"
    )
    candidates = K.build_candidates(stats(spark, board()), groups, 1, 4)
    ordered = K.row_major_order(candidates).orderBy("position").collect()
    assert [(r.candidate_id, r.component_ids) for r in ordered] == [
        ("candidate-0001", "component-0001"), ("actor-and-prop", "component-0002,component-0003")
    ]
    assert all(r.count_in_range for r in ordered)
    assert not K.build_candidates(stats(spark, board()), groups, 3, 4).first().count_in_range


def test_automatic_ids_skip_taken_numbers(spark):
    groups = spark.createDataFrame([(0, "candidate-0001", "component-0003")], "frame_key long, group_id string, component_id string")
    ids = rows(K.build_candidates(stats(spark, board()), groups, 1, 4), "candidate_id", "component_ids")
    assert ids == [("candidate-0001", "component-0003"), ("candidate-0002", "component-0001"), ("candidate-0003", "component-0002")]


def test_diagonal_pixels_do_not_touch(spark):
    pixels = np.zeros((2, 2, 4), dtype=np.uint8)
    pixels[0, 0] = pixels[1, 1] = (1, 1, 1, 255)
    runs = K.component_runs(as_frames(spark, [pixels]), key((0, 0, 0, 0)))
    assert rows(K.component_stats(runs), "pixel_count") == [(1,), (1,)]


def ring():
    pixels = np.zeros((7, 7, 4), dtype=np.uint8)
    pixels[1:6, 1:6] = (26, 32, 63, 255)
    pixels[2:5, 2:5] = 0
    pixels[3, 3] = pixels[0, 6] = (255, 0, 0, 255)
    return pixels


def test_retention_policies(spark):
    runs = K.component_runs(as_frames(spark, [ring()]), key((0, 0, 0, 0)))
    found = K.component_stats(runs)
    largest = K.retain_components(found, "largest").first()
    assert (largest.component_count, largest.retained_pixels) == (3, 16)
    assert (largest.left, largest.top, largest.right, largest.bottom) == (1, 1, 5, 5)
    assert K.retain_components(found, "reject-multiple").first().code == "MULTIPLE_COMPONENTS"
    assert K.retain_components(found, "reject-multiple", 2).first().code is None
    assert K.retain_components(found, "all", 99).first().code == "NO_COMPONENT"
    with pytest.raises(ValueError):
        K.retain_components(found, "some")


def test_detached_blocks_share_union_bounds(spark):
    pixels = np.zeros((5, 12, 4), dtype=np.uint8)
    pixels[1:3, 1:3] = (26, 32, 63, 255)
    pixels[1:3, 9:11] = (220, 60, 40, 255)
    kept = K.retain_components(K.component_stats(K.component_runs(as_frames(spark, [pixels]), key((0, 0, 0, 0)))), "all").first()
    assert (kept.right - kept.left + 1, kept.bottom - kept.top + 1, kept.retained_count, kept.retained_pixels) == (10, 2, 2, 8)


def flood(mask):
    seen, sizes = set(), {}
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        todo, size = [(y, x)], 0
        seen.add((y, x))
        while todo:
            cy, cx = todo.pop()
            size += 1
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and (ny, nx) not in seen:
                    seen.add((ny, nx))
                    todo.append((ny, nx))
        sizes[int(y * mask.shape[1] + x)] = size
    return sizes


def test_labels_equal_flood_fill_on_noise_and_snakes(spark):
    rng = np.random.default_rng(7)
    masks = [rng.random((17, 23)) < p for p in (0.3, 0.55, 0.7)]
    snake = np.zeros((21, 21), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    masks.append(snake)
    rasters = [np.where(m[:, :, None], np.array([5, 5, 5, 255]), 0).astype(np.uint8) for m in masks]
    runs = K.component_runs(as_frames(spark, rasters), key((0, 0, 0, 0)))
    got = {}
    for r in K.component_stats(runs).collect():
        got.setdefault(r.frame_key, {})[r.label] = r.pixel_count
    assert got == {i: flood(m) for i, m in enumerate(masks)}


def test_component_hash_binds_pixels(spark):
    frames = as_frames(spark, [ring()])
    import hashlib

    hashes = {r.label: r.pixel_sha256 for r in K.component_hash(frames, key((0, 0, 0, 0))).collect()}
    assert hashes[6] == hashlib.sha256(b'[{"rgba":[255,0,0,255],"x":6,"y":0}]').hexdigest()


def test_more_components_than_four_digits_keep_their_own_names(spark):
    pixels = raster(220, 220)
    ys, xs = np.nonzero(np.add.outer(np.arange(220), np.arange(220)) % 2)
    pixels[ys, xs] = (200, 10, 10, 255)
    found = K.component_stats(K.component_runs(as_frames(spark, [pixels]), key((0, 255, 0, 255))))
    assert (found.count(), found.select("component_id").distinct().count()) == (24_200, 24_200)
    groups = spark.createDataFrame([(0, "candidate-0002", "component-0001")], "frame_key long, group_id string, component_id string")
    made = K.build_candidates(found, groups, 1, 4)
    assert made.select("candidate_id").distinct().count() == 24_200
    assert made.filter("candidate_id='candidate-0002'").first().component_ids == "component-0001"
    assert made.filter("candidate_id IN ('candidate-0001','candidate-0003','candidate-24200')").count() == 3


def test_frames_without_foreground_are_reported(spark):
    frames = as_frames(spark, [board(), raster(12, 8)])
    found = K.component_stats(K.component_runs(frames, key((0, 255, 0, 255)), 8))
    kept = rows(K.retain_components(found, "largest", 1, frames), "frame_key", "retained_count", "code")
    assert kept == [(0, 1, None), (1, 0, "NO_COMPONENT")]
    none = spark.createDataFrame([], "frame_key long, group_id string, component_id string")
    judged = K.build_candidates(found, none, 1, 9, frames).filter("frame_key=1")
    assert rows(judged, "candidate_id", "count_in_range") == [(None, False)]


def test_labels_of_noise_equal_a_flood_fill(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((40, 37)) < 0.55
    y, x0, x1, label = K._label_runs(mask)
    got = np.full(mask.shape, -1)
    for row, a, b, name in zip(y, x0, x1, label):
        got[row, a : b + 1] = name
    want = np.full(mask.shape, -1)
    for start in map(tuple, np.argwhere(mask)):
        if want[start] < 0:
            todo, want[start] = [start], start[0] * 37 + start[1]
            while todo:
                r, c = todo.pop()
                for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                    if 0 <= near[0] < 40 and 0 <= near[1] < 37 and mask[near] and want[near] < 0:
                        want[near] = want[start]
                        todo.append(near)
    assert (got == want).all()


def test_an_ambiguous_key_is_a_failure_row_and_not_an_exception(spark):
    frames = as_frames(spark, [board(), board()])
    colour = F.when(F.col("frame_key") == 0, key((0, 255, 0, 255))).otherwise(key((9, 9, 0, 255)))
    assert {r.frame_key for r in K.component_runs(frames, colour, 8, minimum_dominance=24).collect()} == {0}
    assert rows(K.ambiguous_keys(frames, colour), "frame_key", "code") == [(1, "KEY_AMBIGUOUS")]


def board_runs(spark, pixels, side, key, **options):
    frames = as_frames(spark, pixels)
    got = tiles.tiled_runs(tiles.cut_tiles(frames, side), key, side=side, **options)
    return rows(got, "frame_key", "label", "y", "x0", "x1"), rows(components.component_runs(frames, key, **options), "frame_key", "label", "y", "x0", "x1")


@pytest.mark.parametrize("side", [1, 7, 64])
def test_tiles_are_labelled_as_in_one_pass(spark, side):
    rng = np.random.default_rng(side)
    boards = []
    for width, height, share in ((23, 17, 0.6), (64, 3, 0.7), (9, 40, 0.5)):
        board = raster(width, height, (0, 0, 0, 0))
        board[rng.random((height, width)) < share] = (9, 9, 9, 255)
        boards.append(board)
    spiral = raster(15, 15, (0, 0, 0, 0))
    for ring in range(0, 7, 2):
        spiral[ring : 15 - ring, ring] = spiral[ring : 15 - ring, 14 - ring] = spiral[14 - ring, ring : 15 - ring] = (5, 5, 5, 255)
        spiral[ring, ring : 14 - ring] = (5, 5, 5, 255)
    key = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    tiled, whole = board_runs(spark, [*boards, spiral, raster(4, 4, (0, 0, 0, 0))], side, key)
    assert tiled == whole and len({r[1] for r in whole}) > 20
    green = F.struct(F.lit(0).alias("r"), F.lit(255).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    spilled = raster(10, 10)
    spilled[2:9, 3] = (20, 90, 30, 255)
    spilled[4, 1:9] = (200, 10, 10, 255)
    tiled, whole = board_runs(spark, [spilled], side, green, tolerance=8, clear_matches=False, minimum_dominance=24)
    assert tiled == whole and whole


def test_a_large_board_is_labelled_tile_by_tile(spark):
    """A board of 64 MiB that no task holds: a comb whose teeth meet in the last line, and single pixels between them."""
    side, count = 512, 8

    def draw(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                x, y = number % count * side, number // count * side
                columns = np.arange(x, x + side)
                tile = np.zeros((side, side, 4), dtype=np.uint8)
                tile[:, columns % 8 == 0] = 255
                tile[::16, columns % 8 == 4] = 255
                if y == (count - 1) * side:
                    tile[-1] = 255
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1]), pa.array([2]), *[pa.array([v], pa.int32()) for v in (side * count, side * count, x, y, side, side)], pa.array([tile.tobytes()], pa.binary())],
                    [p.split()[0] for p in tiles.TILES.split(", ")],
                )

    board = spark.range(0, count * count, 1, 8).mapInArrow(draw, tiles.TILES)
    key = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    stats = components.component_stats(tiles.tiled_runs(board, key, whole=False))
    across = side * count
    big = stats.orderBy(F.desc("pixel_count")).first()
    assert (big.label, big.pixel_count, big.left, big.top, big.right, big.bottom) == (0, across // 8 * (across - 1) + across, 0, 0, across - 1, across - 1)
    assert stats.count() == 1 + (across // 8) * (across // 16)


@pytest.mark.parametrize("policy, size, code", [("all", (6, 3), None), ("largest", (2, 2), None), ("reject-multiple", None, "MULTIPLE_COMPONENTS")])
def test_retained_pixels_are_cropped_and_the_rest_is_clear(spark, policy, size, code):
    board = raster(8, 5, (0, 0, 0, 0))
    board[1:3, 1:3] = (7, 8, 9, 255)
    board[2, 5:7] = (1, 2, 3, 128)
    board[3, 6] = (4, 4, 4, 255)
    board[4, 0] = (6, 6, 6, 255)
    key = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    got = components.retained_pixels(as_frames(spark, [board]), key, policy, 2).first()
    assert got.code == code and (None if size is None else (got.width, got.height)) == size
    if size:
        want = np.zeros((size[1], size[0], 4), dtype=np.uint8)
        want[0:2, 0:2] = (7, 8, 9, 255)
        if policy == "all":
            want[1, 4:6], want[2, 5] = (1, 2, 3, 128), (4, 4, 4, 255)
        assert bytes(got.rgba) == want.tobytes() and (got.left, got.top) == (1, 1)
    assert components.retained_pixels(as_frames(spark, [raster(2, 2, (0, 0, 0, 0))]), key, policy).first().code == "NO_COMPONENT"


def test_many_small_boards_are_united_together(spark, monkeypatch):
    monkeypatch.setattr(tiles, "UNITED", 40)
    monkeypatch.setattr(tiles, "SENT", 700)
    key = F.struct(*[F.lit(0).alias(c) for c in "rgba"])
    rng = np.random.default_rng(5)
    boards = []
    for n in range(60):
        board = raster(7 + n % 6, 9 + n % 4, (0, 0, 0, 0))
        board[rng.random(board.shape[:2]) < 0.6] = (9, 9, 9, 255)
        boards.append(board)
    tiled, whole = board_runs(spark, boards, 4, key)
    assert tiled == whole and len({r[0] for r in whole}) == 60
    # No call of Python for each tile, nor for each board.
    found = tiles.tiled_runs(tiles.cut_tiles(as_frames(spark, boards), 4), key, side=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "pmod(xxhash64(frame_key" in plan
