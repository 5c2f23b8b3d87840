"""Production contracts from approved edits, and the export index built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.layout import clip_documents
from framelake.operators.ordered import Scan, hot_join, ordered_scan


def contract_status(edits: DataFrame, approvals: DataFrame, projects: DataFrame, actions: DataFrame) -> DataFrame:
    """Per clip: may a production contract be built, and if not, why.

    edits(clip_id, idx, frame_id, included, tracks, derivative_sha); approvals(clip_id, approval_sha,
    verified, decision, project_id, action_id, selected_frames); projects(project_id, anchor_sha);
    actions(action_id, semantic, loop_mode, tracks).
    """
    actor_only = lambda tracks: (F.size(tracks) == 1) & (F.get(tracks, F.lit(0)) == "actor")
    chosen = edits.groupBy("clip_id").agg(
        F.count_if("included").alias("frames"),
        F.bool_and(~F.col("included") | actor_only(F.col("tracks"))).alias("frames_single_track"),
    )
    joined = chosen.join(approvals, "clip_id", "left")
    joined = hot_join(joined, projects.select("project_id", "anchor_sha"), ["project_id"], ["clip_id"], "left", counted=approvals)
    joined = hot_join(
        joined, actions.select("action_id", "semantic", "loop_mode", F.col("tracks").alias("action_tracks")), ["action_id"], ["clip_id"], "left", counted=approvals
    )
    granted = F.coalesce(F.col("verified") & (F.col("decision") == "approved"), F.lit(False))
    code = (
        F.when(~granted, "OWNER_APPROVAL_REQUIRED")
        .when(F.col("semantic").isNull(), "ACTION_UNKNOWN")
        .when(~actor_only(F.col("action_tracks")), "MULTI_TRACK_ACTION")
        .when(F.col("frames") == 0, "NO_SELECTED_FRAMES")
        .when(F.col("frames") != F.col("selected_frames"), "APPROVAL_MEMBERSHIP")
        .when(~F.col("frames_single_track"), "MULTI_TRACK_FRAME")
        .when(F.col("anchor_sha").isNull(), "NO_CANONICAL_ANCHOR")
    )
    return joined.withColumn("code", code)


def contract_documents(edits: DataFrame, status: DataFrame) -> DataFrame:
    """Contract JSON of the clips whose status is clean; the label falls back to the action's meaning.

    edits also carries label, duration_ms and contacts.
    """
    clean = status.filter(F.col("code").isNull()).select(
        "clip_id", "approval_sha", "anchor_sha", "loop_mode", "semantic"
    )
    frames = hot_join(edits.filter("included"), clean, ["clip_id"], ["idx"], "inner", counted=edits)
    label = F.trim("label")
    record = F.struct(
        F.col("frame_id").alias("id"),
        F.when(label != "", label).otherwise(F.col("semantic")).alias("semantic"),
        F.col("duration_ms").alias("duration"),
        F.array(F.lit("actor")).alias("tracks"),
        F.col("contacts").alias("contacts"),
        F.col("derivative_sha").alias("sha256"),
    )
    prepared = frames.select(
        "clip_id", "idx",
        F.lit(2).alias("version"), F.col("approval_sha").alias("selectionApprovalSha256"),
        F.col("anchor_sha").alias("anchorSha256"), F.col("loop_mode").alias("loopMode"), record.alias("record"),
    )
    return clip_documents(prepared, ["version", "selectionApprovalSha256", "anchorSha256", "loopMode"])


def clip_metadata(frames: DataFrame, columns: int, width: int, height: int) -> DataFrame:
    """Export metadata JSON per clip: sheet geometry and one record per frame.

    frames(clip_id, idx, file, duration_ms, sha256)
    """
    sized = ordered_scan(frames, ["clip_id"], ["idx"], [Scan("frames", "total")])
    record = F.struct(
        F.col("idx").alias("index"), F.col("file"),
        (F.col("idx") % columns * width).alias("x"), F.expr(f"idx div {columns} * {height}").alias("y"),
        F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.col("duration_ms").alias("duration"), F.col("sha256"),
    )
    prepared = sized.select(
        "clip_id", "idx",
        F.concat(F.lit("clip-"), F.col("clip_id").cast("string")).alias("name"),
        F.struct(F.lit(width).alias("width"), F.lit(height).alias("height")).alias("frameSize"),
        F.lit(columns).alias("columns"), F.ceil(F.col("frames") / columns).cast("long").alias("rows"), record.alias("record"),
    )
    return clip_documents(prepared, ["name", "frameSize", "columns", "rows"])


def engine_index(frames: DataFrame, outputs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Engine index JSON per clip with per-frame track outputs, landmarks and the restart mode.

    frames(clip_id, idx, frame_id, duration_ms, loop_mode); outputs(clip_id, frame_id, ord, track_id,
    kind, sha256), at most one per contracted track; landmarks(clip_id, frame_id, root_x, root_y, baseline).
    """
    listed = outputs.groupBy("clip_id", "frame_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "track_id", "kind", "sha256"))),
            lambda o: F.struct(o.track_id.alias("trackId"), o.kind.alias("kind"), o.sha256.alias("sha256")),
        ).alias("outputs")
    )
    joined = frames.join(listed, ["clip_id", "frame_id"], "left").join(landmarks, ["clip_id", "frame_id"], "left")
    record = F.struct(
        F.col("frame_id").alias("id"), F.col("duration_ms").alias("duration"),
        F.struct(F.col("root_x").alias("x"), F.col("root_y").alias("y")).alias("root"), F.col("baseline"), F.col("outputs"),
    )
    prepared = joined.select(
        "clip_id", "idx", F.col("clip_id").alias("id"), F.col("loop_mode").alias("loopMode"),
        F.when(F.col("loop_mode") == "loop", "loop").otherwise("stop").alias("restart"), record.alias("record"),
    )
    return clip_documents(prepared, ["id", "loopMode", "restart"])
