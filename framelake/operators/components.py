"""4-neighbour components of frames: runs are labelled inside each frame, everything else is grouped sums.

A frame is one row with its byte buffer, so labelling needs no shuffle; the helper returns runs, and
sizes, boxes, centroids, ranks and candidates are Spark aggregates over those runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import color as C


def numbered(prefix: Column, number: Column) -> Column:
    """The prefix and the number in at least four digits."""
    text = number.cast("string")
    return F.concat(prefix, F.lpad(text, F.greatest(F.length(text), F.lit(4)), "0"))


RUNS_SCHEMA = "frame_key long, clip_id long, label long, y int, x0 int, x1 int"
POLICIES = ("all", "largest", "reject-multiple")


def _foreground(pixels: np.ndarray, key: np.ndarray, tolerance: int, clear_matches: bool, dominance: int | None) -> np.ndarray | None:
    """Mask of the foreground; None if spill is asked for and the key has no single strongest channel."""
    near = (np.abs(pixels - key) <= tolerance).all(axis=2)
    if clear_matches:
        near |= (pixels[:, :, 3] == 0) & (key[3] == 0)
    if dominance is None:
        return ~near
    rgb = key[:3]
    if (rgb == rgb.max()).sum() != 1:
        return None
    lead = int(rgb.argmax())
    rest = np.delete(pixels[:, :, :3], lead, axis=2).max(axis=2)
    spill = (np.abs(pixels[:, :, 3] - key[3]) <= tolerance) & (pixels[:, :, lead] - rest >= dominance)
    return ~(near | spill)


def _label_runs(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (y, x0, x1) of a mask with the raster index of the first pixel of their component."""
    height, width = mask.shape
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edges == 1)
    x1 = np.nonzero(edges == -1)[1] - 1
    label = y * width + x0
    # Runs lie in raster order, so the runs above that touch one are a range: two searches per run.
    stride = width + 2
    low = np.searchsorted(y * stride + x1, (y - 1) * stride + x0)
    touching = np.maximum(np.searchsorted(y * stride + x0, (y - 1) * stride + x1, side="right") - low, 0)
    right = np.repeat(np.arange(len(y)), touching)
    left = np.arange(len(right)) - np.repeat(np.cumsum(touching) - touching, touching) + low[right]
    if left.size:
        while True:
            best = np.minimum(label[left], label[right])
            before = label.copy()
            np.minimum.at(label, left, best)
            np.minimum.at(label, right, best)
            jump = np.searchsorted(y * width + x0, label)
            label = np.minimum(label, label[jump])
            if np.array_equal(before, label):
                break
    return y, x0, x1, label


def component_runs(
    frames: DataFrame,
    background: Column,
    tolerance: int = 0,
    clear_matches: bool = True,
    minimum_dominance: int | None = None,
) -> DataFrame:
    """(frame_key, clip_id, label, y, x0, x1); ``label`` is the raster index where the component starts.

    ``clear_matches``: a transparent pixel matches a transparent background whatever its RGB, as for
    single frames; pose boards compare all four channels and may also remove chroma spill. A frame whose
    key is too ambiguous for that has no runs; ``ambiguous_keys`` reports it.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = dict(zip(batch.column("frame_key").to_pylist(), batch.column("clip_id").to_pylist()))
            for frame_key, _, (y, x0, x1, labels) in _labelled(batch, tolerance, clear_matches, minimum_dominance):
                own = lambda v, n=len(y): pa.array([v] * n, pa.int64())
                columns = [pa.array(labels.astype(np.int64)), *[pa.array(v.astype(np.int32)) for v in (y, x0, x1)]]
                yield pa.RecordBatch.from_arrays([own(frame_key), own(clips[frame_key]), *columns], ["frame_key", "clip_id", "label", "y", "x0", "x1"])

    return _keyed(frames, background).mapInArrow(label, RUNS_SCHEMA)


def _keyed(frames: DataFrame, background: Column) -> DataFrame:
    key = F.array(*[background.getField(c).cast("int") for c in ("r", "g", "b", "a")])
    return frames.select("frame_key", "clip_id", "width", "height", "rgba", key.alias("key"))


def _labelled(batch: pa.RecordBatch, tolerance: int, clear_matches: bool, dominance: int | None) -> Iterator[tuple]:
    """(frame_key, raster, runs) of every frame whose key can be used."""
    for row in range(batch.num_rows):
        frame_key, width, height, key = (batch.column(c)[row].as_py() for c in ("frame_key", "width", "height", "key"))
        raster = np.frombuffer(batch.column("rgba")[row].as_buffer(), dtype=np.uint8).reshape(height, width, 4)
        mask = _foreground(raster.astype(np.int16), np.array(key, dtype=np.int16), tolerance, clear_matches, dominance)
        if mask is not None:
            yield frame_key, raster, _label_runs(mask)


def ambiguous_keys(frames: DataFrame, background: Column) -> DataFrame:
    """Frames whose key colour has no single strongest channel, so that chroma spill can't be told."""
    key = {c: background.getField(c) for c in ("r", "g", "b", "a")}
    return frames.filter(C.dominant_channel(key).isNull()).select("frame_key", "clip_id", F.lit("KEY_AMBIGUOUS").alias("code"))


def component_stats(runs: DataFrame, minimum: int = 1) -> DataFrame:
    """Size, box and centroid per component, numbered in raster order apart from the noise."""
    length = (F.col("x1") - F.col("x0") + 1).cast("long")
    stats = runs.groupBy("frame_key", "clip_id", "label").agg(
        F.sum(length).alias("pixel_count"),
        F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"),
        F.sum((F.col("x0") + F.col("x1")) * length / 2).alias("sum_x"),
        F.sum(F.col("y") * length).alias("sum_y"),
    )
    noise = F.col("pixel_count") < minimum
    number = F.row_number().over(Window.partitionBy("frame_key", noise).orderBy("label"))
    name = numbered(F.when(noise, "noise-").otherwise("component-"), number)
    return stats.select(
        "frame_key", "clip_id", "label", name.alias("component_id"), "pixel_count",
        "left", "top", "right", "bottom",
        (F.col("sum_x") / F.col("pixel_count")).alias("centroid_x"),
        (F.col("sum_y") / F.col("pixel_count")).alias("centroid_y"),
        noise.alias("noise"),
    )


def component_hash(
    frames: DataFrame, background: Column, tolerance: int = 0, clear_matches: bool = True, minimum_dominance: int | None = None
) -> DataFrame:
    """(frame_key, label, pixel_sha256): the canonical JSON list of a component's pixels in raster order.

    Labelled and hashed from the frame's buffer in one pass, so no pixel becomes a row.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame_key, raster, runs in _labelled(batch, tolerance, clear_matches, minimum_dominance):
                y, x0, x1, labels = runs
                order = np.argsort(labels, kind="stable")
                cut = np.flatnonzero(np.diff(labels[order], prepend=-1)) if len(order) else order
                hashes = []
                for part in np.split(order, cut[1:]) if len(order) else []:
                    value, lead = hashlib.sha256(b"["), ""
                    for i in part.tolist():
                        pixels = raster[y[i], x0[i] : x1[i] + 1].tolist()
                        text = ",".join(f'{{"rgba":[{r},{g},{b},{a}],"x":{x},"y":{y[i]}}}' for x, (r, g, b, a) in enumerate(pixels, int(x0[i])))
                        value.update((lead + text).encode())
                        lead = ","
                    value.update(b"]")
                    hashes.append(value.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hashes), frame_key)), pa.array(labels[order][cut].astype(np.int64)), pa.array(hashes, pa.string())],
                    ["frame_key", "label", "pixel_sha256"],
                )

    return _keyed(frames, background).mapInArrow(digests, "frame_key long, label long, pixel_sha256 string")


def ranked_components(stats: DataFrame) -> DataFrame:
    """Largest first, ties in raster order. Components of one frame only, so the window is frame-sized."""
    order = Window.partitionBy("frame_key").orderBy(F.col("pixel_count").desc(), "label")
    return stats.withColumn("size_rank", F.row_number().over(order))


def retain_components(stats: DataFrame, policy: str, minimum: int = 1, frames: DataFrame | None = None) -> DataFrame:
    """What survives the policy per frame: counts, union box and the failure when nothing may pass.

    ``frames`` (frame_key) names all frames, so that one without any foreground is reported too.
    """
    if policy not in POLICIES:
        raise ValueError(f"retention policy must be one of {POLICIES}")
    eligible = F.col("pixel_count") >= minimum
    kept = eligible & (F.col("size_rank") == 1) if policy == "largest" else eligible
    pick = lambda agg, c: agg(F.when(kept, F.col(c)))
    report = ranked_components(stats).groupBy("frame_key").agg(
        F.count(F.lit(1)).alias("component_count"),
        F.count(F.when(eligible, 1)).alias("eligible_count"),
        F.count(F.when(kept, 1)).alias("retained_count"),
        F.coalesce(F.sum(F.when(kept, F.col("pixel_count"))), F.lit(0)).cast("long").alias("retained_pixels"),
        pick(F.min, "left").alias("left"), pick(F.min, "top").alias("top"),
        pick(F.max, "right").alias("right"), pick(F.max, "bottom").alias("bottom"),
    )
    if frames is not None:
        counts = ["component_count", "eligible_count", "retained_count", "retained_pixels"]
        report = frames.select("frame_key").distinct().join(report, "frame_key", "left").fillna(0, counts)
    code = F.when(F.col("eligible_count") == 0, "NO_COMPONENT")
    if policy == "reject-multiple":
        code = code.when(F.col("eligible_count") > 1, "MULTIPLE_COMPONENTS")
    return report.withColumn("code", code)


RETAINED = "frame_key long, clip_id long, left int, top int, width int, height int, rgba binary, code string"


def retained_pixels(
    frames: DataFrame, background: Column, policy: str, minimum: int = 1, tolerance: int = 0, clear_matches: bool = True
) -> DataFrame:
    """``RETAINED``: what survives the policy, cropped to its box, all else transparent; a code instead where nothing may pass."""
    if policy not in POLICIES:
        raise ValueError(f"retention policy must be one of {POLICIES}")

    def crop(raster, runs):
        y, x0, x1, labels = runs
        sizes = np.bincount(np.unique(labels, return_inverse=True)[1], weights=x1 - x0 + 1).astype(np.int64) if len(y) else np.empty(0, dtype=np.int64)
        names = np.unique(labels)
        eligible = sizes >= minimum
        if not eligible.any():
            return (None,) * 5 + ("NO_COMPONENT",)
        if policy == "reject-multiple" and eligible.sum() > 1:
            return (None,) * 5 + ("MULTIPLE_COMPONENTS",)
        kept = names[[int(np.argmax(sizes))]] if policy == "largest" else names[eligible]
        mine = np.isin(labels, kept)
        y, x0, x1 = y[mine], x0[mine], x1[mine]
        mask = np.zeros((raster.shape[0], raster.shape[1] + 1), dtype=np.int8)
        np.add.at(mask, (y, x0), 1), np.add.at(mask, (y, x1 + 1), -1)
        left, top, right, bottom = int(x0.min()), int(y.min()), int(x1.max()), int(y.max())
        inside = np.cumsum(mask, axis=1)[top : bottom + 1, left : right + 1] > 0
        return left, top, right - left + 1, bottom - top + 1, (raster[top : bottom + 1, left : right + 1] * inside[:, :, None]).tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = dict(zip(batch.column("frame_key").to_pylist(), batch.column("clip_id").to_pylist()))
            for frame_key, raster, runs in _labelled(batch, tolerance, clear_matches, None):
                row = (frame_key, clips[frame_key], *crop(raster, runs))
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [p.split()[0] for p in RETAINED.split(", ")])

    return _keyed(frames, background).mapInArrow(run, RETAINED)


def build_candidates(stats: DataFrame, groups: DataFrame, low: int, high: int, frames: DataFrame | None = None) -> DataFrame:
    """Grouped and single components as candidates with weighted centroids, and the count-in-range verdict.

    groups(frame_key, group_id, component_id). Automatic ids skip numbers taken by groups. ``frames``
    (frame_key) names all frames: one without a component gets a row without candidate, out of range.
    """
    real = stats.filter(~F.col("noise"))
    tagged = real.join(groups, ["frame_key", "component_id"], "left")
    taken = groups.groupBy("frame_key").agg(F.collect_set("group_id").alias("taken"))
    single = Window.partitionBy("frame_key", F.col("group_id").isNull()).orderBy("label")
    tagged = tagged.withColumn("nth", F.row_number().over(single)).join(taken, "frame_key", "left")
    # The n-th free number is n plus the taken numbers below it; the j-th taken one is below it if it exceeds j by less than n.
    used = F.transform(F.coalesce("taken", F.array().cast("array<string>")), lambda g: F.regexp_extract(g, r"^candidate-(\d{4,18})$", 1).try_cast("long"))
    used = F.array_sort(F.filter(used, lambda i: (i > 0) & F.array_contains("taken", numbered(F.lit("candidate-"), i))))
    below = F.size(F.filter(F.transform(used, lambda i, j: i - j), lambda gap: gap <= F.col("nth")))
    named = tagged.withColumn("candidate_id", F.coalesce("group_id", numbered(F.lit("candidate-"), F.col("nth") + below)))
    n = F.col("pixel_count")
    candidates = named.groupBy("frame_key", "candidate_id").agg(
        F.array_join(F.array_sort(F.collect_list("component_id")), ",").alias("component_ids"),
        F.sum(n).alias("pixel_count"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"),
        (F.sum(F.col("centroid_x") * n) / F.sum(n)).alias("centroid_x"),
        (F.sum(F.col("centroid_y") * n) / F.sum(n)).alias("centroid_y"),
    )
    count = F.count(F.lit(1)).over(Window.partitionBy("frame_key"))
    judged = candidates.withColumn("count_in_range", (count >= low) & (count <= high))
    if frames is None:
        return judged
    every = frames.select("frame_key").distinct().join(judged, "frame_key", "left")
    return every.withColumn("count_in_range", F.coalesce("count_in_range", F.lit(low <= 0)))


def row_major_order(candidates: DataFrame) -> DataFrame:
    """Reading order: rows are islands over the running lowest edge; inside a row by centroid, then id."""
    top_order = Window.partitionBy("frame_key").orderBy("top", "centroid_y", "candidate_id")
    reach = F.max("bottom").over(top_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = candidates.withColumn("opens", F.when(F.coalesce(F.col("top") > reach, F.lit(True)), 1).otherwise(0))
    banded = opened.withColumn("band", F.sum("opens").over(top_order.rowsBetween(Window.unboundedPreceding, 0)))
    reading = Window.partitionBy("frame_key").orderBy("band", "centroid_x", "centroid_y", "candidate_id")
    return banded.withColumn("position", F.row_number().over(reading)).drop("opens")
