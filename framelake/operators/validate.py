"""Rule sets over frames and runs. Every rule set returns a table of failures, never an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.runs import Rule, differs, failures, judged, missing


def scale_consistency(pairs: DataFrame) -> DataFrame:
    """Every frame of a clip must come out at one and the same whole-number scale.

    pairs(clip_id, src_width, src_height, out_width, out_height); a frame without a size, being empty, is broken.
    """
    whole = (F.col("out_width") % F.col("src_width") == 0) & (F.col("out_height") % F.col("src_height") == 0)
    sx = F.floor(F.col("out_width") / F.col("src_width"))
    sy = F.floor(F.col("out_height") / F.col("src_height"))
    graded = pairs.withColumn("scale", F.when(whole & (sx >= 1) & (sx == sy), sx))
    report = graded.groupBy("clip_id").agg(
        F.count_if(F.col("scale").isNull()).alias("broken_frames"), F.count_distinct("scale").alias("scales")
    )
    drift = (F.col("broken_frames") > 0) | (F.col("scales") > 1)
    return report.withColumn("code", F.when(drift, "GLOBAL_SCALE_DRIFT"))


def frame_measures(frames: DataFrame, width: int, height: int, palette, key, tolerance: int) -> DataFrame:
    """Everything the frame rules read, one row per frame: size, hash, box, drift and background evidence."""
    from framelake.functions import color as C
    from framelake.operators import pixels as P

    visible = F.col("a") > 0
    near = F.greatest(*[F.abs(F.col(c) - F.lit(v)) for c, v in zip("rgb", key)]) <= tolerance
    colours = P.frame_colours(P.explode_pixels(frames), width, height)
    measured = colours.groupBy("frame_key", "clip_id").agg(
        *P.bounds_where(visible),
        F.count_if(~C.in_palette(C.channels(), palette)).alias("drift_colours"),
        F.coalesce(F.sum(F.when(visible, F.col("border_n"))), F.lit(0)).alias("border_pixels"),
        F.coalesce(F.sum(F.when(visible & near, F.col("n"))), F.lit(0)).alias("key_pixels"),
    )
    facts = frames.select("frame_key", F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.sha2("rgba", 256).alias("sha256"))
    return measured.join(facts, "frame_key")


def intermediate_colours(source: DataFrame, output: DataFrame) -> DataFrame:
    """Colours of the output frame that its source does not have; inputs are frame_colours tables."""
    tagged = source.select("frame_key", "r", "g", "b", "a", F.lit(0).alias("fresh")).unionByName(
        output.select("frame_key", "r", "g", "b", "a", F.lit(1).alias("fresh"))
    )
    merged = tagged.groupBy("frame_key", "r", "g", "b", "a").agg(F.min("fresh").alias("fresh"))
    return merged.groupBy("frame_key").agg(F.sum("fresh").alias("intermediate"))


def flat_rules(size: tuple[int, int], scale: int, pivot: tuple[int, int], margin: int = 1) -> list[Rule]:
    """The per-frame rules of a flat run over the rows of ``flat_frame_facts``."""
    w, h = size

    def clipped(p: str, width: int, height: int, m: int, stage: str) -> Rule:
        box = ", ".join(f"{p}_{n}" for n in ("left", "top", "right", "bottom"))
        broken = f"{p}_left < {m} or {p}_top < {m} or {p}_right >= {width - m} or {p}_bottom >= {height - m}"
        return Rule("CLIPPED_FOREGROUND", stage, broken, f"concat_ws(',', {box})", f"'{m},{m},{width - m - 1},{height - m - 1}'")

    def sized(p: str, width: int, height: int, stage: str) -> Rule:
        return Rule("CANVAS_SIZE", stage, f"{p}_image_width <> {width} or {p}_image_height <> {height}", f"concat_ws('x', {p}_image_width, {p}_image_height)", f"'{width}x{height}'")

    recorded, measured = (f"concat_ws(',', {', '.join(f'{p}_{n}' for n in ('left', 'top', 'width', 'height'))})" for p in ("rec", "c"))
    return [
        missing("FRAME_COUNT", "runtime-missing", "r_sha256"),
        missing("METADATA_MISMATCH", "record-missing", "recorded"),
        missing("INTERMEDIATE_COLORS", "source-missing", "intermediate"),
        sized("c", w, h, "canonical"),
        differs("BASELINE_DRIFT", "canonical", "c_bottom", str(pivot[1] - 1)),
        clipped("c", w, h, margin, "canonical"),
        Rule("METADATA_MISMATCH", "normalization", "rec_left <> c_left or rec_top <> c_top or rec_width <> c_width or rec_height <> c_height", recorded, measured),
        Rule("PALETTE_DRIFT", "canonical", "c_drift_colours > 0", "c_drift_colours", "0"),
        sized("r", w * scale, h * scale, "runtime"),
        Rule("NON_INTEGER_SCALE", "runtime", f"r_image_width % {w} <> 0 or r_image_height % {h} <> 0 or r_image_width * {h} <> r_image_height * {w}",
             "concat_ws('x', r_image_width, r_image_height)", f"'a multiple of {w}x{h}'"),
        differs("BASELINE_DRIFT", "runtime", "r_bottom", str(pivot[1] * scale - 1)),
        clipped("r", w * scale, h * scale, margin * scale, "runtime"),
        Rule("BACKGROUND_REMAINS", "runtime", "r_border_pixels > 0 or r_key_pixels > 0", "r_border_pixels + r_key_pixels", "0"),
        Rule("INTERMEDIATE_COLORS", "runtime", "intermediate > 0 or not matches", "intermediate", "0"),
        Rule("PALETTE_DRIFT", "runtime", "r_drift_colours > 0", "r_drift_colours", "0"),
        differs("SOURCE_HASH_MISMATCH", "metadata", "rec_sha256", "c_sha256"),
        differs("TIMING_MISMATCH", "metadata", "frame_duration", "duration"),
        Rule("LANDMARK_DRIFT", "canonical", "abs(landmark_x - target_x) > 0 or abs(landmark_y - target_y) > 0",
             "concat_ws(',', landmark_x, landmark_y)", "concat_ws(',', target_x, target_y)"),
    ]


def flat_frame_facts(
    canonical: DataFrame, runtime: DataFrame, records: DataFrame, intermediate: DataFrame, blocks: DataFrame, landmarks: DataFrame | None = None
) -> DataFrame:
    """One row per canonical frame with everything the rules read; parts that a frame lacks are null, and no frame is lost.

    canonical, runtime: frame_measures; records(frame_key, rec_left, rec_top, rec_width, rec_height,
    rec_sha256, frame_duration, duration); intermediate(frame_key, intermediate);
    blocks(frame_key, mismatches, matches); landmarks(frame_key, landmark_x, landmark_y, target_x, target_y), where the frame's landmark lies
    after placement and where the contract wants it.
    """
    c = canonical.select("frame_key", "clip_id", *[F.col(n).alias(f"c_{n}") for n in canonical.columns if n not in ("frame_key", "clip_id")])
    r = runtime.select("frame_key", *[F.col(n).alias(f"r_{n}") for n in runtime.columns if n not in ("frame_key", "clip_id")])
    wide = c.join(r, "frame_key", "left").join(records.withColumn("recorded", F.lit(True)), "frame_key", "left")
    wide = wide.join(intermediate, "frame_key", "left").join(blocks.select("frame_key", "matches"), "frame_key", "left")
    if landmarks is None:
        return wide.withColumns({n: F.lit(None).cast("int") for n in ("landmark_x", "landmark_y", "target_x", "target_y")})
    return wide.join(landmarks, "frame_key", "left")


def flat_frame_failures(
    canonical: DataFrame, runtime: DataFrame, records: DataFrame, intermediate: DataFrame, blocks: DataFrame,
    size: tuple[int, int], scale: int, pivot: tuple[int, int], margin: int = 1, landmarks: DataFrame | None = None,
) -> DataFrame:
    """(clip_id, frame_key, code, stage) of the per-frame rules of a flat run; ``runs.failures`` also has what was measured."""
    facts = flat_frame_facts(canonical, runtime, records, intermediate, blocks, landmarks)
    found = failures(judged(facts, flat_rules(size, scale, pivot, margin)), ["clip_id", "frame_key"])
    return found.select("clip_id", "frame_key", "code", "stage")


def flat_clip_failures(clips: DataFrame, size: tuple[int, int], scale: int, pivot: tuple[int, int]) -> DataFrame:
    """Per-clip rules of a flat run over one summary row per clip.

    clips(clip_id, normalized_frames, runtime_frames, contract_frames, metadata_frames, canonical_pivot_x,
    canonical_pivot_y, meta_pivot_x, meta_pivot_y, meta_width, meta_height, columns, rows, bad_durations,
    anchor_expected, anchor_actual, sheet_name, meta_sheet, palette_matches, config_matches,
    sheet_mismatches, preview_pages, scales).
    """
    c = F.col
    rows = F.ceil(c("runtime_frames") / c("columns"))
    rules = {
        ("FRAME_COUNT", "runtime"): c("normalized_frames") != c("runtime_frames"),
        ("FRAME_COUNT", "normalization-contract"): c("normalized_frames") != c("contract_frames"),
        ("FRAME_COUNT", "metadata"): c("metadata_frames") != c("runtime_frames"),
        ("PIVOT_DRIFT", "canonical"): (c("canonical_pivot_x") != pivot[0]) | (c("canonical_pivot_y") != pivot[1]),
        ("PIVOT_DRIFT", "metadata"): (c("meta_pivot_x") != pivot[0] * scale) | (c("meta_pivot_y") != pivot[1] * scale),
        ("SOURCE_HASH_MISMATCH", "anchor"): c("anchor_expected") != c("anchor_actual"),
        ("METADATA_MISMATCH", "frameSize"): (c("meta_width") != size[0] * scale) | (c("meta_height") != size[1] * scale),
        ("METADATA_MISMATCH", "artifactNames"): c("sheet_name") != c("meta_sheet"),
        ("METADATA_MISMATCH", "palette"): ~c("palette_matches"),
        ("METADATA_MISMATCH", "config"): ~c("config_matches"),
        ("METADATA_MISMATCH", "sheetGeometry"): (c("columns") < 1) | (c("rows") != rows),
        ("TIMING_MISMATCH", "durations"): c("bad_durations") > 0,
        ("FRAME_BLEED", "sheet"): c("sheet_mismatches") > 0,
        ("PREVIEW_MISMATCH", "pages"): c("preview_pages") != c("runtime_frames"),
        ("GLOBAL_SCALE_DRIFT", "normalization-artifacts"): c("scales") > 1,
    }
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(stage).alias("stage"))) for (code, stage), broken in rules.items()
    ]))
    return clips.select("clip_id", F.explode(found).alias("f")).select("clip_id", "f.*")


def semantic_outcomes(clips: DataFrame, evidence: DataFrame) -> DataFrame:
    """Artistic codes fail only with explicit evidence; without it they ask for a human review.

    evidence(clip_id, code); one result row per clip and semantic code.
    """
    codes = F.array(*[F.lit(c) for c in ("IDENTITY_DRIFT", "DUPLICATE_POSE", "LOOP_SEAM")])
    asked = clips.select("clip_id", F.explode(codes).alias("code"))
    known = evidence.select("clip_id", "code", F.lit(True).alias("proven")).distinct()
    joined = asked.join(known, ["clip_id", "code"], "left")
    return joined.select(
        "clip_id", "code", F.when(F.col("proven"), "failure").otherwise("HUMAN_REVIEW_REQUIRED").alias("outcome")
    )


def engine_index_failures(frames: DataFrame, contract: DataFrame) -> DataFrame:
    """Exported index against its contract, frame by frame.

    frames(clip_id, idx, frame_id, duration_ms, restart, loop_mode, root_x, root_y, baseline, ground,
    contacts array); contract(clip_id, idx, frame_id, duration_ms, loop_mode, pivot_x, pivot_y,
    baseline, ground).
    """
    want = contract.select("clip_id", "idx", *[F.col(c).alias(f"want_{c}") for c in contract.columns if c not in ("clip_id", "idx")])
    both = frames.withColumn("exported", F.lit(True)).join(want, ["clip_id", "idx"], "full_outer")
    c = F.col
    present = c("exported") & c("want_frame_id").isNotNull()
    rules = {
        "FRAME_COUNT": c("exported").isNull() | c("want_frame_id").isNull(),
        "NONCYCLIC_RESTART": present & (c("restart") != F.when(c("want_loop_mode") == "loop", "loop").otherwise("stop")),
        "TIMING_MISMATCH": present & ((c("frame_id") != c("want_frame_id")) | (c("duration_ms") < 11) | (c("duration_ms") != c("want_duration_ms"))),
        "LANDMARK_DRIFT": present & ((c("root_x") != c("want_pivot_x")) | (c("root_y") != c("want_pivot_y")) | (c("baseline") != c("want_baseline"))),
        "METADATA_MISMATCH": present & (c("ground") != c("want_ground")),
        "GROUND_TRAVEL_CONTACT": present & ((c("ground.x") != 0) | (c("ground.y") != 0)) & (F.size("contacts") == 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items()]))
    return both.select("clip_id", "idx", F.explode(found).alias("code"))


def all_failures(parts: dict[str, DataFrame]) -> DataFrame:
    """Rule outputs of one validation as one table; columns a rule does not have stay null."""
    union = None
    for rule, part in parts.items():
        named = part.withColumn("rule_set", F.lit(rule))
        union = named if union is None else union.unionByName(named, allowMissingColumns=True)
    return union
