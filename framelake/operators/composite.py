"""Source-over stacks and disposal replay on byte buffers.

Pixels never influence each other, so a canvas is cut into tiles. For one pixel a step of an animation is
a function of what the canvas holds: keep it, set it, or blend over it; *restore* (disposal "previous") keeps
it for the steps after its own. Functions compose, and composition is associative, so ``Program`` is a monoid:
per pixel either a value, from the last set on, or the blends still to be laid over whatever comes before. Long
animations are cut into chunks of steps whose programs are built side by side; one pass over the programs of a tile
gives the canvas each chunk starts from, and the chunks then paint their pages, side by side again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from framelake.session import scratch_folder

# Fixed value: container limit on frames per animation.
MAX_FRAMES = 10_000

TILE, CHUNK = 32, 128


def over(top: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Source-over on rows of four bytes with half-up rounding."""
    out = np.where(top[:, 3:] == 255, top, under)
    soft = np.flatnonzero((top[:, 3] > 0) & (top[:, 3] < 255))
    if len(soft):
        a, b = top[soft].astype(np.int64), under[soft].astype(np.int64)
        hidden = b[:, 3:] * (255 - a[:, 3:])
        weight = a[:, 3:] * 255 + hidden
        colour = (2 * (a[:, :3] * a[:, 3:] * 255 + b[:, :3] * hidden) + weight) // (2 * weight)
        out[soft] = np.hstack([colour, (2 * weight + 255) // 510])
    return out


@F.pandas_udf(BinaryType())
def _over_buffers(top: pd.Series, under: pd.Series) -> pd.Series:
    read = lambda b: np.frombuffer(b, dtype=np.uint8).reshape(-1, 4)
    return pd.Series([None if t is None or u is None else over(read(t), read(u)).tobytes() for t, u in zip(top, under)], dtype=object)


def alpha_over_frames(pairs: DataFrame, top: str = "rgba", under: str = "under") -> DataFrame:
    """``pairs`` with ``top`` laid over ``under``; buffers of one size. A missing buffer gives null."""
    return pairs.withColumn(top, _over_buffers(top, under))


def composite_layers(layers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, width, height, rgba): the ordered layers of each stack in one buffer.

    layers(keys, ``order``, width, height, rgba): one row per track. A stack's layers have one size: the
    first one's counts, and others are laid on from the top left corner.
    """
    types = {f.name: f.dataType.simpleString() for f in layers.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", width int, height int, rgba binary"

    def fold(stack: pa.Table) -> pa.Table:
        stack = stack.sort_by(order)
        width, height = stack.column("width")[0].as_py(), stack.column("height")[0].as_py()
        canvas = np.zeros((height, width, 4), dtype=np.uint8)
        for w, h, rgba in zip(*(stack.column(c).to_pylist() for c in ("width", "height", "rgba"))):
            h2, w2 = min(h, height), min(w, width)
            layer = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)[:h2, :w2]
            canvas[:h2, :w2] = over(layer.reshape(-1, 4), canvas[:h2, :w2].reshape(-1, 4)).reshape(h2, w2, 4)
        own = [stack.column(k)[:1] for k in keys]
        return pa.Table.from_arrays([*own, pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([canvas.tobytes()], pa.binary())], [*keys, "width", "height", "rgba"])

    return layers.select(*keys, order, "width", "height", "rgba").groupBy(*keys).applyInArrow(fold, schema)


@dataclass
class Program:
    """What some steps do to the pixels of a tile: ``fixed`` ones get ``value``, over the others go the blends.

    ``at`` and ``paint`` are the blends in the order of their steps; fixed pixels have none.
    """

    value: np.ndarray
    fixed: np.ndarray
    at: np.ndarray
    paint: np.ndarray

    @classmethod
    def keep(cls, size: int) -> Program:
        return cls(np.zeros((size, 4), dtype=np.uint8), np.zeros(size, dtype=bool), np.empty(0, dtype=np.int32), np.empty((0, 4), dtype=np.uint8))

    @classmethod
    def step(cls, size: int, inside: np.ndarray, patch: np.ndarray, dispose: str, blend: str) -> Program:
        """One frame as the frames after it see it: ``patch`` on the pixels ``inside``."""
        made = cls.keep(size)
        if dispose == "previous":
            return made
        whole = np.ones(len(inside), dtype=bool) if dispose == "background" or blend == "source" else patch[:, 3] == 255
        made.fixed[inside[whole]] = True
        if dispose != "background":
            made.value[inside[whole]] = patch[whole]
            soft = ~whole & (patch[:, 3] > 0)
            made.at, made.paint = inside[soft].astype(np.int32), patch[soft]
        return made

    def then(self, later: Program) -> Program:
        """Both in turn."""
        value, fixed = self.value.copy(), self.fixed | later.fixed
        on = self.fixed[later.at]
        _lay(value, later.at[on], later.paint[on])
        value[later.fixed] = later.value[later.fixed]
        open_now = ~later.fixed[self.at]
        return Program(value, fixed, np.concatenate([self.at[open_now], later.at[~on]]), np.concatenate([self.paint[open_now], later.paint[~on]]))

    def apply(self, canvas: np.ndarray) -> np.ndarray:
        out = np.where(self.fixed[:, None], self.value, canvas)
        _lay(out, self.at, self.paint)
        return out


def _lay(canvas: np.ndarray, at: np.ndarray, paint: np.ndarray) -> None:
    """Blend onto the canvas in order; the first blends of all pixels at once, then the second ones."""
    order = np.argsort(at, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(at[order]) != 0)) if len(at) else order
    rank = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
    for turn in range(int(rank.max(initial=-1)) + 1):
        now = order[rank == turn]
        canvas[at[now]] = over(paint[now], canvas[at[now]])


def frame_limit(frames: DataFrame, keys: list[str], most: int = MAX_FRAMES) -> DataFrame:
    """(keys, frames, code) of the animations that have more frames than a container may hold."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames")).where(F.col("frames") > most).withColumn("code", F.lit("FRAME_LIMIT"))


def _parts(frames: DataFrame, keys: list[str], tile: int, chunk: int) -> DataFrame:
    """Each frame by tile of its canvas: the piece of its patch that lies there, or null."""
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    named = [*keys, "step"]
    schema = ", ".join(f"{k} {types[k]}" for k in named) + (
        ", tile_x int, tile_y int, tile_w int, tile_h int, chunk long, x0 int, y0 int, w int, h int, dispose string, blend string, rgba binary"
    )
    made = StructType.fromDDL(schema).names[len(named) :]

    def cut(batches):
        for batch in batches:
            owner, rows = [], []
            for i in range(batch.num_rows):
                cw, ch, rx, ry, rw, rh = (batch.column(c)[i].as_py() for c in ("canvas_w", "canvas_h", "rect_x", "rect_y", "rect_w", "rect_h"))
                raster = np.frombuffer(batch.column("rgba")[i].as_buffer(), dtype=np.uint8).reshape(rh, rw, 4)
                number, dispose, blend = batch.column("step")[i].as_py() // chunk, batch.column("dispose")[i].as_py(), batch.column("blend")[i].as_py()
                for ty in range(0, ch, tile):
                    for tx in range(0, cw, tile):
                        tw, th = min(tile, cw - tx), min(tile, ch - ty)
                        x0, y0, x1, y1 = max(rx, tx), max(ry, ty), min(rx + rw, tx + tw), min(ry + rh, ty + th)
                        piece = raster[y0 - ry : y1 - ry, x0 - rx : x1 - rx].tobytes() if x1 > x0 and y1 > y0 else None
                        owner.append(i)
                        rows.append((tx, ty, tw, th, number, x0 - tx, y0 - ty, x1 - x0, y1 - y0, dispose, blend, piece))
                if len(rows) >= 4_096 or i == batch.num_rows - 1:
                    at, columns = pa.array(owner, pa.int64()), list(zip(*rows)) or [[]] * len(made)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in named], *[pa.array(c, t) for c, t in zip(columns, kinds)]], [*named, *made])
                    owner, rows = [], []

    kinds = [*[pa.int32()] * 4, pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.binary()]
    own = ["canvas_w", "canvas_h", "rect_x", "rect_y", "rect_w", "rect_h", "dispose", "blend", "rgba"]
    return frames.select(*named, *own).mapInArrow(cut, schema)


def _steps(rows: pa.Table):
    """(step, inside, patch, dispose, blend) of a tile's rows in order; steps that don't touch it have no patch."""
    rows = rows.sort_by("step")
    tw = rows.column("tile_w")[0].as_py()
    names = ("step", "x0", "y0", "w", "h", "rgba", "dispose", "blend")
    for step, x, y, w, h, rgba, dispose, blend in zip(*(rows.column(c).to_pylist() for c in names)):
        if rgba is None:
            yield step, None, None, dispose, blend
        else:
            yield step, ((np.arange(h)[:, None] + y) * tw + np.arange(w) + x).ravel(), np.frombuffer(rgba, dtype=np.uint8).reshape(-1, 4), dispose, blend


def replay_disposal(frames: DataFrame, keys: list[str], tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """Full pages from partial frames: (keys, step, x, y, width, height, rgba), the tiles of every page.

    frames(keys, step, canvas_w, canvas_h, rect_x, rect_y, rect_w, rect_h, dispose, blend, rgba): one row per
    frame with the bytes of its rectangle; what lies outside the canvas is left out. Every page comes back whole, whether
    a frame touches a tile or not.

    A task holds one tile for one chunk of steps, or, in between, one program per chunk of one tile, so memory is
    bounded by ``tile`` and ``chunk`` and not by the length of the animation or the size of its canvas.
    """
    spark = frames.sparkSession
    folder = scratch_folder(spark, "replay")
    _parts(frames, keys, tile, chunk).write.parquet(folder)
    parts = spark.read.parquet(folder)
    place, types = [*keys, "tile_x", "tile_y"], {f.name: f.dataType.simpleString() for f in parts.schema}
    typed = ", ".join(f"{k} {types[k]}" for k in place)

    def own(rows: pa.Table, n: int = 1, names=place):
        return [pa.concat_arrays([rows.column(k).combine_chunks()[:1]] * n) if n != 1 else rows.column(k)[:1] for k in names]

    def build(rows: pa.Table) -> pa.Table:
        size = rows.column("tile_w")[0].as_py() * rows.column("tile_h")[0].as_py()
        program = Program.keep(size)
        for _, inside, patch, dispose, blend in _steps(rows):
            if inside is not None:
                program = program.then(Program.step(size, inside, patch, dispose, blend))
        body = [program.value, np.packbits(program.fixed), program.at, program.paint]
        return pa.Table.from_arrays([*own(rows), rows.column("chunk")[:1], *[pa.array([x.tobytes()], pa.binary()) for x in body]], [*place, "chunk", "value", "fixed", "at", "paint"])

    def start(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        canvas, held = None, []
        for value, fixed, at, paint in zip(*(rows.column(c).to_pylist() for c in ("value", "fixed", "at", "paint"))):
            value = np.frombuffer(value, dtype=np.uint8).reshape(-1, 4)
            canvas = np.zeros_like(value) if canvas is None else canvas
            held.append(canvas.tobytes())
            fixed = np.unpackbits(np.frombuffer(fixed, dtype=np.uint8))[: len(value)].astype(bool)
            canvas = Program(value, fixed, np.frombuffer(at, dtype=np.int32), np.frombuffer(paint, dtype=np.uint8).reshape(-1, 4)).apply(canvas)
        return pa.Table.from_arrays([*own(rows, len(held)), rows.column("chunk").combine_chunks(), pa.array(held, pa.binary())], [*[f"_{k}" for k in place], "_chunk", "canvas"])

    def paint(rows: pa.Table, starts: pa.Table) -> pa.Table:
        tw, th = rows.column("tile_w")[0].as_py(), rows.column("tile_h")[0].as_py()
        canvas = np.frombuffer(starts.column("canvas")[0].as_py(), dtype=np.uint8).reshape(-1, 4)
        order, pages = [], []
        for step, inside, patch, dispose, blend in _steps(rows):
            page = canvas
            if inside is not None:
                page = canvas.copy()
                page[inside] = patch if blend == "source" else over(patch, canvas[inside])
            order.append(step), pages.append(page.tobytes())
            if inside is not None and dispose != "previous":
                canvas = page
                if dispose == "background":
                    canvas = page.copy()
                    canvas[inside] = 0
        n = len(order)
        whole = own(rows, n)
        size = [pa.array(np.full(n, v, dtype=np.int32)) for v in (tw, th)]
        return pa.Table.from_arrays([*whole[:-2], pa.array(order, pa.int64()), *whole[-2:], *size, pa.array(pages, pa.binary())], [*keys, "step", "x", "y", "width", "height", "rgba"])

    programs = parts.groupBy(*place, "chunk").applyInArrow(build, f"{typed}, chunk long, value binary, fixed binary, at binary, paint binary")
    starts = programs.groupBy(*place).applyInArrow(start, ", ".join(f"_{p.strip()}" for p in typed.split(",")) + ", _chunk long, canvas binary")
    together = parts.groupBy(*place, "chunk").cogroup(starts.groupBy(*[f"_{k}" for k in place], "_chunk"))
    result = ", ".join(f"{k} {types[k]}" for k in keys) + ", step long, x int, y int, width int, height int, rgba binary"
    return together.applyInArrow(paint, result)


def whole_pages(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, width, height, rgba): the tiles of each page in one buffer."""
    types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", step long, width int, height int, rgba binary"

    def join(rows: pa.Table) -> pa.Table:
        places = list(zip(*(rows.column(c).to_pylist() for c in ("x", "y", "width", "height", "rgba"))))
        width, height = max(x + w for x, _, w, _, _ in places), max(y + h for _, y, _, h, _ in places)
        page = np.zeros((height, width, 4), dtype=np.uint8)
        for x, y, w, h, rgba in places:
            page[y : y + h, x : x + w] = np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)
        own = [rows.column(k)[:1] for k in (*keys, "step")]
        return pa.Table.from_arrays([*own, pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([page.tobytes()], pa.binary())], [*keys, "step", "width", "height", "rgba"])

    return tiles.groupBy(*keys, "step").applyInArrow(join, schema)
