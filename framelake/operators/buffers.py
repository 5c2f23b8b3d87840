"""Frame buffers inside tasks: one pass of numpy per frame, Arrow batches in and out.

SQL slices copy or rescan the whole buffer for every cell, which is quadratic in the frame size.
These helpers read a buffer once; partitioning, joins and aggregation stay with Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType

ROWS_PER_BATCH = 262_144

Columns = dict[str, np.ndarray]


def _raster(buffer, width: int, height: int) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.uint8).reshape(height, width, 4)


def expand(frames: DataFrame, keep: tuple[str, ...], schema: str, unfold: Callable[[np.ndarray], Iterator[Columns]]) -> DataFrame:
    """Rows that ``unfold`` makes of each frame's raster, next to the kept columns.

    Pieces of small frames share an output batch; ``unfold`` yields pieces of bounded size, so a
    large frame never becomes one batch.
    """
    kept = [f"{name} {frames.schema[name].dataType.simpleString()}" for name in keep]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rgba, widths, heights = batch.column("rgba"), batch.column("width"), batch.column("height")
            owners: list[np.ndarray] = []
            pieces: list[Columns] = []
            waiting = 0

            def flush() -> pa.RecordBatch:
                owner = pa.array(np.concatenate(owners))
                own = [batch.column(name).take(owner) for name in keep]
                made = [np.concatenate([p[name] for p in pieces]) for name in names]
                return pa.RecordBatch.from_arrays([*own, *[pa.array(m) for m in made]], names=[*keep, *names])

            for row in range(batch.num_rows):
                raster = _raster(rgba[row].as_buffer(), widths[row].as_py(), heights[row].as_py())
                for piece in unfold(raster):
                    size = len(piece[names[0]])
                    owners.append(np.full(size, row, dtype=np.int64))
                    pieces.append(piece)
                    waiting += size
                    if waiting >= ROWS_PER_BATCH:
                        yield flush()
                        owners, pieces, waiting = [], [], 0
            if waiting:
                yield flush()

    extra = [c for c in ("width", "height", "rgba") if c not in keep]
    return frames.select(*keep, *extra).mapInArrow(run, ", ".join([*kept, schema]))


def pixel_rows(raster: np.ndarray) -> Iterator[Columns]:
    """(x, y, r, g, b, a) of every pixel, some lines at a time."""
    height, width = raster.shape[:2]
    step = max(1, ROWS_PER_BATCH // width)
    for top in range(0, height, step):
        block = raster[top : top + step].reshape(-1, 4).astype(np.int32)
        at = np.arange(len(block), dtype=np.int32)
        yield {
            "x": at % width, "y": at // width + np.int32(top),
            "r": block[:, 0], "g": block[:, 1], "b": block[:, 2], "a": block[:, 3],
        }


def run_rows(raster: np.ndarray) -> Iterator[Columns]:
    """(vertical, line, start, length, r, g, b, a) of the maximal same-colour runs of every row and column."""
    for vertical in (False, True):
        lines = np.ascontiguousarray(raster.transpose(1, 0, 2)) if vertical else raster
        count, size = lines.shape[:2]
        step = max(1, ROWS_PER_BATCH // size)
        for top in range(0, count, step):
            block = np.ascontiguousarray(lines[top : top + step])
            words = block.view(np.uint32).reshape(len(block), size)
            opens = np.ones(words.shape, dtype=bool)
            opens[:, 1:] = words[:, 1:] != words[:, :-1]
            at = np.flatnonzero(opens)
            colour = block.reshape(-1, 4)[at].astype(np.int32)
            yield {
                "vertical": np.full(len(at), vertical), "line": (at // size + top).astype(np.int32),
                "start": (at % size).astype(np.int32), "length": np.diff(np.append(at, words.size)).astype(np.int32),
                "r": colour[:, 0], "g": colour[:, 1], "b": colour[:, 2], "a": colour[:, 3],
            }


def cell_rows(cell_width: int, cell_height: int) -> Callable[[np.ndarray], Iterator[Columns]]:
    """(cell, pixels) of a sheet cut into equal cells in reading order; partial cells are left out."""

    def cut(raster: np.ndarray) -> Iterator[Columns]:
        columns, rows = raster.shape[1] // cell_width, raster.shape[0] // cell_height
        for row in range(rows):
            band = raster[row * cell_height : (row + 1) * cell_height, : columns * cell_width]
            cells = band.reshape(cell_height, columns, cell_width, 4).swapaxes(0, 1)
            content = np.empty(columns, dtype=object)
            content[:] = [c.tobytes() for c in cells]
            yield {"cell": np.arange(columns, dtype=np.int32) + np.int32(row * columns), "pixels": content}

    return cut


@F.pandas_udf(IntegerType())
def scaled_mismatches(
    source: pd.Series, width: pd.Series, height: pd.Series, output: pd.Series, out_width: pd.Series, out_height: pd.Series, scale: pd.Series
) -> pd.Series:
    """Output pixels that differ from their source pixel; null when the size is not the scaled size."""

    def count(src, w, h, out, ow, oh, k):
        if out is None or (ow, oh) != (w * k, h * k):
            return None
        ow, oh = int(ow), int(oh)
        expected = _raster(src, w, h).repeat(k, axis=0).repeat(k, axis=1)
        return int((expected != _raster(out, ow, oh)).any(axis=2).sum())

    return pd.Series([count(*row) for row in zip(source, width, height, output, out_width, out_height, scale)], dtype="Int32")


@F.pandas_udf(IntegerType())
def shifted_mismatches(
    source: pd.Series, width: pd.Series, height: pd.Series, output: pd.Series, out_width: pd.Series, out_height: pd.Series,
    dx: pd.Series, dy: pd.Series, scale: pd.Series,
) -> pd.Series:
    """Output pixels that are not the shifted, scaled, visible source pixel, or not zero where none maps."""

    def count(src, w, h, out, ow, oh, x, y, k):
        if out is None:
            return None
        ow, oh = int(ow), int(oh)
        visible = _raster(src, w, h) * (_raster(src, w, h)[:, :, 3:4] > 0)
        image = visible.repeat(k, axis=0).repeat(k, axis=1)
        expected = np.zeros((oh, ow, 4), dtype=np.uint8)
        left, top = x * k, y * k
        x0, y0 = max(left, 0), max(top, 0)
        x1, y1 = min(left + w * k, ow), min(top + h * k, oh)
        if x1 > x0 and y1 > y0:
            expected[y0:y1, x0:x1] = image[y0 - top : y1 - top, x0 - left : x1 - left]
        return int((expected != _raster(out, ow, oh)).any(axis=2).sum())

    return pd.Series(
        [count(*row) for row in zip(source, width, height, output, out_width, out_height, dx, dy, scale)], dtype="Int32"
    )


@F.pandas_udf(BinaryType())
def placed(
    source: pd.Series, width: pd.Series, height: pd.Series, left: pd.Series, top: pd.Series, box_width: pd.Series, box_height: pd.Series,
    x: pd.Series, y: pd.Series, scale: pd.Series, canvas_width: pd.Series, canvas_height: pd.Series,
) -> pd.Series:
    """The box of a frame, scaled, at (x, y) of a transparent canvas; what lies outside either is left out."""

    def draw(src, *numbers):
        if src is None or any(pd.isna(n) for n in numbers):
            return None
        w, h, l, t, bw, bh, tx, ty, k, cw, ch = map(int, numbers)
        tx, ty = tx + (max(l, 0) - l) * k, ty + (max(t, 0) - t) * k
        raster = _raster(src, w, h)
        image = raster[max(t, 0) : max(t + bh, 0), max(l, 0) : max(l + bw, 0)]
        image = (image * (image[:, :, 3:4] > 0)).repeat(k, axis=0).repeat(k, axis=1)
        out = np.zeros((ch, cw, 4), dtype=np.uint8)
        x0, y0, x1, y1 = max(tx, 0), max(ty, 0), min(tx + image.shape[1], cw), min(ty + image.shape[0], ch)
        if x1 > x0 and y1 > y0:
            out[y0:y1, x0:x1] = image[y0 - ty : y1 - ty, x0 - tx : x1 - tx]
        return out.tobytes()

    return pd.Series([draw(*row) for row in zip(source, width, height, left, top, box_width, box_height, x, y, scale, canvas_width, canvas_height)], dtype=object)
