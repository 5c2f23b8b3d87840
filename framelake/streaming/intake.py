"""Incremental frame intake: continuity between neighbouring frames and repeated pixel hashes.

Continuity is a property of each pair of neighbours, so frames are joined on (clip, position): a
clip of any length is spread over all tasks, rows may arrive in any order, and the watermark only
cleans up state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framelake.streaming.edits import ROCKSDB, interval_ms


def continuity_failures(frames: DataFrame, lateness: str) -> DataFrame:
    """Frames that do not start where their predecessor ended, or have none; first frames that do not start at zero.

    frames(clip_id, idx, frame_id, start_ms, duration_ms, ts): a stream, or a batch of the same shape.
    ``code`` is DISCONTINUOUS or PREDECESSOR_MISSING. A stream reports a missing predecessor, one that
    did not come within ``lateness`` of the frame, once the watermark has passed that time; state older
    than that is dropped, so ``lateness`` bounds it.
    """
    marked = frames.withWatermark("ts", lateness) if frames.isStreaming else frames
    here = marked.select(
        F.col("clip_id").alias("clip"), "idx", "frame_id", "start_ms", F.col("ts").alias("seen")
    )
    before = marked.select(
        "clip_id", (F.col("idx") + 1).alias("next_idx"), (F.col("start_ms") + F.col("duration_ms")).alias("expected_ms"),
        F.col("ts").alias("before_seen"),
    )
    near = (
        (F.col("seen") >= F.col("before_seen") - F.expr(f"INTERVAL {lateness}"))
        & (F.col("seen") <= F.col("before_seen") + F.expr(f"INTERVAL {lateness}"))
    )
    same = (F.col("clip") == F.col("clip_id")) & (F.col("idx") == F.col("next_idx")) & near
    pairs = here.filter("idx > 0").join(before, same, "left")
    code = F.when(F.col("clip_id").isNull(), "PREDECESSOR_MISSING").when(F.col("start_ms") != F.col("expected_ms"), "DISCONTINUOUS")
    broken = pairs.withColumn("code", code).filter(F.col("code").isNotNull()).select(
        F.col("clip").alias("clip_id"), "idx", "frame_id", "start_ms", "expected_ms", "code"
    )
    late_start = marked.filter((F.col("idx") == 0) & (F.col("start_ms") != 0)).select(
        "clip_id", "idx", "frame_id", "start_ms", F.lit(0).cast("long").alias("expected_ms"), F.lit("DISCONTINUOUS").alias("code")
    )
    return broken.unionByName(late_start)


class Originals(StatefulProcessor):
    """The first frame of one clip and hash, and how many came in; an event-time timer forgets them ``expire_ms`` after the last."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "idx long, original long, copies long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        idx, original, copies, last = self.kept.get() if self.kept.exists() else (None, None, 0, -1)
        before = last
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            for i, first, n, t in zip(frame["idx"], frame["original"], frame["copies"], at):
                copies, last = copies + int(n), max(last, int(t))
                if idx is None or int(i) < idx:
                    idx, original = int(i), int(first)
        self.kept.update((idx, original, copies, last))
        if last != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.expire_ms)
            self.handle.registerTimer(last + self.expire_ms)
        yield pd.DataFrame({"clip_id": [key[0]], "sha256": [key[1]], "original": [original], "copies": [copies]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per clip and hash of a task's batch: the first frame, the number and the last time."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).sort_by("idx")
            wanted = [("idx", "min"), ("frame_id", "first"), ("frame_id", "count"), ("ts", "max")]
            merged = table.group_by(["clip_id", "sha256"], use_threads=False).aggregate(wanted)
            columns = [merged.column(c).combine_chunks() for c in ("clip_id", "sha256", "idx_min", "frame_id_first", "frame_id_count", "ts_max")]
            yield pa.RecordBatch.from_arrays(columns, ["clip_id", "sha256", "idx", "original", "copies", "ts"])


def pixel_originals(frames: DataFrame, expire: str | None = None) -> DataFrame:
    """Running table of distinct pixel hashes per clip: the original frame and how many copies came in.

    frames(clip_id, idx, frame_id, sha256[, ts]), without nulls. Copies are merged in their task before they reach the state, so
    a hash shared by a third of all frames arrives as one row per batch of a task. Without ``expire`` this is a streaming
    aggregation, whose state grows with the distinct hashes. With it, as in "30 days", a hash is forgotten once the watermark
    of ``ts`` has passed its last frame by that much, and the next frame with it is a new original; every hash of a micro-batch
    is then a call of Python, some 2 ms.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if expire is None:
        first = F.min(F.struct("idx", F.col("frame_id").alias("original"))).alias("first")
        kept = frames.groupBy("clip_id", "sha256").agg(first, F.count(F.lit(1)).alias("copies"))
        return kept.select("clip_id", "sha256", "first.original", "copies")
    typed = frames.select("clip_id", "idx", "frame_id", "sha256", "ts")
    merged = typed.mapInArrow(_merged, "clip_id long, sha256 string, idx long, original long, copies long, ts timestamp")
    out = "clip_id long, sha256 string, original long, copies long"
    keyed = merged.withWatermark("ts", "0 seconds").groupBy("clip_id", "sha256")
    return keyed.transformWithStateInPandas(Originals(interval_ms(frames.sparkSession, expire)), out, "update", "EventTime")
