"""Components of boards larger than a task: tiles are labelled on their own, borders tell which labels are one.

A board is a table of tiles. Every tile is labelled in its task; a label is the raster index, on the whole
board, of the first pixel of its part of a component. Tiles that touch compare one line of labels, which gives
pairs of labels that mean the same component. Union-find over a board's pairs gives each label its root, the
smallest of its component, and the tiles take over the roots. Small boards are united many at a time, as many as have some
``UNITED`` tiles. So a task holds some tiles, or the border pairs of such boards or of one board: the contract's board of
1 GiB in tiles of 512 lines and columns has at most some two million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.components import RUNS_SCHEMA, _foreground, _label_runs
from framelake.session import scratch_folder

TILE = 512
UNITED = 1_024
#: Bytes of rasters that a task sends on at a time.
SENT = 32 << 20
TILES = "frame_key long, clip_id long, board_width int, board_height int, x int, y int, width int, height int, rgba binary"
_PLACE = ["frame_key", "clip_id", "board_width", "x", "y", "width", "height"]
_LABELLED = "frame_key long, clip_id long, board_width int, x int, y int, width int, height int, runs binary, top binary, bottom binary, left binary, right binary"


def cut_tiles(frames: DataFrame, side: int = TILE) -> DataFrame:
    """``TILES`` of frames (frame_key, clip_id, width, height, rgba); tiles begin at multiples of ``side``."""

    names = [p.split()[0] for p in TILES.split(", ")]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 6 + [pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for frame, clip, width, height, rgba in zip(*(batch.column(c).to_pylist() for c in ("frame_key", "clip_id", "width", "height", "rgba"))):
                raster = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)
                for y in range(0, height, side):
                    for x in range(0, width, side):
                        tile = raster[y : y + side, x : x + side]
                        held.append((frame, clip, width, height, x, y, tile.shape[1], tile.shape[0], tile.tobytes()))
                        size += tile.size
                    if size > SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names)

    return frames.select("frame_key", "clip_id", "width", "height", "rgba").mapInArrow(cut, TILES)


def _labelled(tiles: DataFrame, background: Column, tolerance: int, clear_matches: bool, dominance: int | None) -> DataFrame:
    """Runs (y, x0, x1, label) of each tile and the labels along its four borders, -1 where there is background."""
    key = F.array(*[background.getField(c).cast("int") for c in ("r", "g", "b", "a")])

    def sent(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        at, *bodies = zip(*held)
        own = [batch.column(c).take(pa.array(at, pa.int64())) for c in _PLACE]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(b, pa.binary()) for b in bodies]], [p.split()[0] for p in _LABELLED.split(", ")])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            values = zip(*(batch.column(c).to_pylist() for c in ("board_width", "x", "y", "width", "height", "key", "rgba")))
            for row, (across, left, top, width, height, own, rgba) in enumerate(values):
                raster = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)
                mask = _foreground(raster.astype(np.int16), np.array(own, dtype=np.int16), tolerance, clear_matches, dominance)
                if mask is None:
                    continue
                y, x0, x1, local = (v.astype(np.int64) for v in _label_runs(mask))
                board = (local // width + top) * across + local % width + left
                marks = np.full((height, width), -1, dtype=np.int64)
                long = x1 - x0 + 1
                at = np.repeat(y * width + x0, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
                marks.ravel()[at] = np.repeat(board, long)
                body = [np.stack([y + top, x0 + left, x1 + left, board]), marks[0], marks[-1], marks[:, 0], marks[:, -1]]
                held.append((row, *[b.tobytes() for b in body]))
                size += sum(b.nbytes for b in body)
                if size > SENT:
                    yield sent(batch, held)
                    held, size = [], 0
            if held:
                yield sent(batch, held)

    return tiles.select(*_PLACE, "rgba", key.alias("key")).mapInArrow(label, _LABELLED)


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with some ``SENT`` bytes of ``column`` each."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SENT, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _border_pairs(labelled: DataFrame) -> DataFrame:
    """(frame_key, board_width, a, b): labels of two tiles that touch across a border."""
    first = labelled.select("frame_key", "board_width", F.col("x").alias("at_x"), (F.col("y") + F.col("height")).alias("at_y"), F.lit(False).alias("beside"), F.col("bottom").alias("one"))
    first = first.unionAll(labelled.select("frame_key", "board_width", F.col("x") + F.col("width"), "y", F.lit(True), "right"))
    second = labelled.select("frame_key", F.col("x").alias("at_x"), F.col("y").alias("at_y"), F.lit(False).alias("beside"), F.col("top").alias("two"))
    second = second.unionAll(labelled.select("frame_key", "x", "y", F.lit(True), "left"))

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "one"):
            one, two = batch.column("one").to_pylist(), batch.column("two").to_pylist()
            a, b = (np.frombuffer(b"".join(side), dtype=np.int64) for side in (one, two))
            row = np.repeat(np.arange(len(one)), [len(v) // 8 for v in one])
            both = (a >= 0) & (b >= 0)
            row, a, b = row[both], a[both], b[both]
            again = np.zeros(len(a), dtype=bool)  # runs that touch along several pixels
            again[1:] = (row[1:] == row[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            row, a, b = row[~again], a[~again], b[~again]
            own = [batch.column(c).take(pa.array(row)) for c in ("frame_key", "board_width")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(a), pa.array(b)], ["frame_key", "board_width", "a", "b"])

    met = first.join(second, ["frame_key", "at_x", "at_y", "beside"]).select("frame_key", "board_width", "one", "two")
    return met.mapInArrow(touch, "frame_key long, board_width int, a long, b long")


def _roots(pairs: pa.Table) -> pa.Table:
    """(frame_key, board_width, label, root) of the labels of some boards that have a smaller one in their component."""
    n = len(pairs)
    frame, across = (np.concatenate([pairs.column(c).to_numpy()] * 2) for c in ("frame_key", "board_width"))
    label = np.concatenate([pairs.column("a").to_numpy(), pairs.column("b").to_numpy()])
    order = np.lexsort((label, frame))
    opens = np.ones(2 * n, dtype=bool)
    opens[1:] = (np.diff(frame[order]) != 0) | (np.diff(label[order]) != 0)
    flat = np.empty(2 * n, dtype=np.int64)
    flat[order] = np.cumsum(opens) - 1
    frame, across, label = (v[order][opens] for v in (frame, across, label))
    a, b = flat[:n], flat[n:]
    root = np.arange(len(label))
    while True:  # hook the larger root below the smaller one, then halve the paths
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"frame_key": frame[moved], "board_width": across[moved], "label": label[moved], "root": label[root[moved]]})


def tiled_runs(
    tiles: DataFrame, background: Column, tolerance: int = 0, clear_matches: bool = True, minimum_dominance: int | None = None,
    side: int = TILE, whole: bool = True,
) -> DataFrame:
    """What ``component_runs`` gives for the boards that ``tiles`` (``TILES``, cut at multiples of ``side``) make up.

    ``whole``: runs that a border cuts are joined again, line by line; sums over runs don't need that.
    """
    spark = tiles.sparkSession
    folder = scratch_folder(spark, "tiles")
    _labelled(tiles, background, tolerance, clear_matches, minimum_dominance).write.parquet(folder)
    labelled = spark.read.parquet(folder)
    groups = labelled.count() // UNITED + 1
    pairs = _border_pairs(labelled).groupBy(F.pmod(F.xxhash64("frame_key"), F.lit(groups)))
    roots = pairs.applyInArrow(_roots, "frame_key long, board_width int, label long, root long")
    home = lambda n: (F.floor(n / side) * side).cast("int")
    known = roots.groupBy(
        F.col("frame_key").alias("_frame"), home(F.col("label") % F.col("board_width")).alias("_x"), home(F.floor(F.col("label") / F.col("board_width"))).alias("_y")
    ).agg(F.collect_list(F.struct("label", "root")).alias("known"))
    names = [p.split()[0] for p in RUNS_SCHEMA.split(", ")]

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, "runs"):
            bodies = [np.frombuffer(r, dtype=np.int64).reshape(4, -1) for r in batch.column("runs").to_pylist()]
            row = np.repeat(np.arange(len(bodies)), [b.shape[1] for b in bodies])
            y, x0, x1, label = np.concatenate(bodies, axis=1)
            lists = batch.column("known")
            pairs = lists.flatten()
            if len(pairs):
                held = np.repeat(np.arange(len(bodies)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                old, new = (pc.struct_field(pairs, c).to_numpy() for c in ("label", "root"))
                # One search over the tiles of the batch: first by tile, then by label.
                every = np.concatenate([np.stack([held, old]), np.stack([row, label])], axis=1)
                order = np.lexsort((every[1], every[0]))
                opens = np.ones(len(order), dtype=bool)
                opens[1:] = (np.diff(every[:, order], axis=1) != 0).any(axis=0)
                number = np.empty(len(order), dtype=np.int64)
                number[order] = np.cumsum(opens) - 1
                named = np.full(len(order), -1, dtype=np.int64)
                named[number[: len(old)]] = new
                found = named[number[len(old) :]]
                label = np.where(found >= 0, found, label)
            own = [batch.column(c).take(pa.array(row)) for c in ("frame_key", "clip_id")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(label), *[pa.array(v.astype(np.int32)) for v in (y, x0, x1)]], names)

    same = (F.col("frame_key") == F.col("_frame")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    runs = labelled.join(known, same, "left").select("frame_key", "clip_id", "runs", "known").mapInArrow(rename, RUNS_SCHEMA)
    if not whole:
        return runs
    line = Window.partitionBy("frame_key", "y").orderBy("x0")
    opens = F.when(F.lag("x1").over(line) + 1 == F.col("x0"), 0).otherwise(1)
    numbered = runs.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(line))
    return numbered.groupBy("frame_key", "clip_id", "label", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")
