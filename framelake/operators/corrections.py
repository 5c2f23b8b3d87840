"""From failures to corrections: classification, retry budgets, shared work, plans and evidence."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import SPARSE_CHUNK, Scan, hot_join, ordered_scan
from framelake.operators.rules import failing, unless

# Which correction each failure code asks for.
CORRECTIONS = {
    "CANVAS_SIZE": "repad",
    "NON_INTEGER_SCALE": "nearest-rescale",
    "INTERMEDIATE_COLORS": "nearest-rescale",
    "BACKGROUND_REMAINS": "rekey",
    "PIVOT_DRIFT": "realign",
    "BASELINE_DRIFT": "realign",
    "LANDMARK_DRIFT": "realign",
    "SOCKET_ATTACHMENT": "realign",
    "GROUND_TRAVEL_CONTACT": "realign",
    "GLOBAL_SCALE_DRIFT": "nearest-rescale",
    "PALETTE_DRIFT": "palette-remap-review",
    "CLIPPED_FOREGROUND": "stop-for-regeneration",
    "FRAME_BLEED": "repad",
    "TIMING_MISMATCH": "reexport-metadata",
    "METADATA_MISMATCH": "reexport-metadata",
    "PREVIEW_MISMATCH": "reexport-preview",
    "IDENTITY_DRIFT": "stop-for-regeneration",
    "DUPLICATE_POSE": "stop-for-regeneration",
    "LOOP_SEAM": "timing-or-transition-review",
    "NONCYCLIC_RESTART": "reexport-metadata",
}
AUTOMATIC = ("repad", "nearest-rescale", "rekey", "realign", "reexport-metadata", "reexport-preview", "reexport-sheet")
GENERATIVE = ("stop-for-regeneration",)
REVIEW = ("palette-remap-review", "timing-or-transition-review", "stop-for-review")


def correction_for(code: Column, stage: Column, trusted: Column) -> Column:
    """Correction class of a failure; drift follows its stage, counts and hashes need a trusted artifact."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(CORRECTIONS.items())])
    place = F.lower(F.coalesce(stage, F.lit("")))
    by_stage = (
        F.when(F.contains(place, F.lit("metadata")), "reexport-metadata")
        .when(F.contains(place, F.lit("preview")), "reexport-preview")
        .when(F.contains(place, F.lit("sheet")), "reexport-sheet")
        .otherwise("realign")
    )
    restorable = (stage == "metadata") & F.coalesce(trusted, F.lit(False))
    return (
        F.when(code.isin("PIVOT_DRIFT", "BASELINE_DRIFT"), by_stage)
        .when(code.isin("FRAME_COUNT", "SOURCE_HASH_MISMATCH"), F.when(restorable, "reexport-metadata").otherwise("stop-for-review"))
        .otherwise(F.coalesce(F.try_element_at(table, code), F.lit("stop-for-review")))
    )


def classify_failures(failures: DataFrame) -> DataFrame:
    """failures(code, stage, trusted, ...) with their correction."""
    return failures.withColumn("correction", correction_for(F.col("code"), F.col("stage"), F.col("trusted")))


# Which artifact a failure is repaired in: (priority, artifact, failure code or "", stage pattern for LIKE).
OWNERS = (
    (1, "sheet", "", "%sheet%"),
    (1, "sheet", "FRAME_BLEED", "%"),
    (2, "preview", "", "%preview%"),
    (2, "preview", "PREVIEW_MISMATCH", "%"),
    (3, "metadata", "FRAME_COUNT", "metadata"),
    (4, "preview", "FRAME_COUNT", "%"),
    (5, "metadata", "", "metadata%"),
    (5, "metadata", "METADATA_MISMATCH", "%"),
    (5, "metadata", "TIMING_MISMATCH", "%"),
    (5, "metadata", "SOURCE_HASH_MISMATCH", "%"),
    (6, "runtime-frame", "", "runtime"),
    (6, "runtime-frame", "BACKGROUND_REMAINS", "%"),
    (6, "runtime-frame", "INTERMEDIATE_COLORS", "%"),
    (7, "normalized-frame", "", "%"),
)


def owner_artifact(code: Column, stage: Column) -> Column:
    """The artifact of the first row of ``OWNERS`` that fits the failure."""
    place = F.coalesce(stage, F.lit(""))
    fits = lambda want, pattern: place.like(pattern) & (F.lit(True) if not want else F.coalesce(code == want, F.lit(False)))
    rows = [F.when(fits(want, pattern), F.struct(F.lit(rank).alias("rank"), F.lit(artifact).alias("artifact"))) for rank, artifact, want, pattern in OWNERS]
    return F.array_min(F.array_compact(F.array(*rows)))["artifact"]


def retry_budget(classified: DataFrame, attempts: DataFrame, limit: int) -> DataFrame:
    """Regeneration attempts left per run and frame. attempts(run_id, frame, used)."""
    frames = classified.filter(F.col("correction").isin(*GENERATIVE) & F.col("frame").isNotNull()).select("run_id", "frame").distinct()
    left = F.least(F.lit(limit), F.greatest(F.lit(0), F.lit(limit) - F.coalesce("used", F.lit(0))))
    return frames.join(attempts, ["run_id", "frame"], "left").select("run_id", "frame", left.cast("long").alias("remaining"))


def dedupe_corrections(classified: DataFrame) -> DataFrame:
    """Automatic corrections of one target run once: the first failure executes, the others share it.

    Work is shared only for the same artifact of the same target and, where the failures carry
    ``before_sha``, the same bytes: drift of one frame in two artifacts is two repairs.
    """
    automatic = classified.filter(F.col("correction").isin(*AUTOMATIC)).withColumn(
        "target", F.coalesce(F.col("frame").cast("string"), F.col("stage"), F.lit(""))
    ).withColumn("artifact", owner_artifact(F.col("code"), F.col("stage")))
    bytes_before = F.coalesce("before_sha", F.lit("")) if "before_sha" in classified.columns else F.lit("")
    automatic = automatic.withColumn("_before", bytes_before)
    shared = ordered_scan(
        automatic, ["run_id", "correction", "target", "artifact", "_before"], ["idx"], [Scan("primary_idx", "first", F.col("idx"))], SPARSE_CHUNK
    )
    return shared.select(
        "run_id", "idx", "correction", "target", "artifact", "primary_idx",
        F.when(F.col("idx") == F.col("primary_idx"), "applied").otherwise("deduplicated").alias("status"),
    )


def repair_plan(classified: DataFrame, attempts: DataFrame, limit: int) -> DataFrame:
    """Per failure: the artifact it owns and what happens next."""
    budget = retry_budget(classified, attempts, limit)
    shared = dedupe_corrections(classified).select("run_id", "idx", "primary_idx", F.col("status").alias("shared_status"))
    joined = hot_join(classified, budget, ["run_id", "frame"], ["idx"], "left").join(shared, ["run_id", "idx"], "left")
    generative = F.col("correction").isin(*GENERATIVE)
    left = F.when(F.col("frame").isNull(), F.lit(limit)).otherwise(F.col("remaining"))
    return joined.select(
        "run_id", "idx", "code", "correction", owner_artifact(F.col("code"), F.col("stage")).alias("artifact"),
        F.when(generative, F.when(left > 0, "generative-retry").otherwise("generative-retry-exhausted"))
        .when(F.col("correction").isin(*REVIEW), "user-review")
        .otherwise(F.col("shared_status")).alias("action"),
        F.when(generative, left).cast("long").alias("attempts_remaining"),
        F.when(F.col("shared_status") == "deduplicated", F.col("primary_idx")).alias("duplicate_of"),
    )


def correction_evidence_failures(evidence: DataFrame) -> DataFrame:
    """Why a correction's before/after evidence does not hold.

    evidence(correction_id, code, before_passed, after_passed, after_review_only, target_before,
    target_after, before_sha, after_sha, before_width, before_height, after_width, after_height,
    expected_width, expected_height, actual_width, actual_height, opaque_border, key_pixels,
    intermediate_colors, scale_integer, scale_uniform, scale_global, nearest, pivot_ok, baseline_ok).
    """
    code = F.col("code")
    sized = (
        (F.col("before_width") == F.col("actual_width")) & (F.col("before_height") == F.col("actual_height"))
        & (F.col("after_width") == F.col("expected_width")) & (F.col("after_height") == F.col("expected_height"))
    )
    rules = {
        "before-passed": unless(~F.col("before_passed")),
        "after-failed": unless(F.col("after_passed") | F.col("after_review_only")),
        "target-not-before": unless(F.col("target_before")),
        "target-remains": unless(~F.col("target_after")),
        "bytes-unchanged": unless(F.col("before_sha") != F.col("after_sha")),
        "canvas-size": (code == "CANVAS_SIZE") & unless(sized),
        "pivot": (code == "PIVOT_DRIFT") & unless(F.col("pivot_ok")),
        "baseline": (code == "BASELINE_DRIFT") & unless(F.col("baseline_ok")),
        "background": (code == "BACKGROUND_REMAINS") & unless((F.col("opaque_border") == 0) & (F.col("key_pixels") == 0)),
        "intermediate-colors": (code == "INTERMEDIATE_COLORS") & unless(F.col("nearest") & (F.col("intermediate_colors") == 0)),
        "integer-scale": (code == "NON_INTEGER_SCALE") & unless(F.col("scale_integer") & F.col("scale_uniform")),
        "global-scale": (code == "GLOBAL_SCALE_DRIFT")
        & unless(F.col("scale_integer") & F.col("scale_uniform") & F.col("scale_global")),
    }
    return failing(evidence, ["correction_id"], rules)


def correction_revision_failures(revisions: DataFrame, approved: DataFrame, inputs: DataFrame, replacements: DataFrame) -> DataFrame:
    """Corrected revisions must take a new number, start from the approved frames and replace all of them in order.

    revisions(clip_id, revision, approval_version, original_version); approved(clip_id, idx, frame_id,
    sha256); inputs(clip_id, idx, sha256); replacements(clip_id, idx, frame_id).
    """
    numbering = failing(
        revisions, ["clip_id"],
        {
            "approval-number": unless(F.col("approval_version") == F.col("revision")),
            "approval-not-newer": unless(F.col("approval_version") > F.col("original_version")),
        },
    )
    sides = [
        approved.select("clip_id", "idx", F.col("sha256").alias("want_sha"), F.col("frame_id").cast("string").alias("want_id"), F.lit(None).cast("string").alias("got_sha"), F.lit(None).cast("string").alias("got_id")),
        inputs.select("clip_id", "idx", F.lit(None).cast("string"), F.lit(None).cast("string"), "sha256", F.lit(None).cast("string")),
        replacements.select("clip_id", "idx", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("frame_id").cast("string")),
    ]
    rows = sides[0].union(sides[1]).union(sides[2]).groupBy("clip_id", "idx").agg(
        *[F.max(c).alias(c) for c in ("want_sha", "want_id", "got_sha", "got_id")]
    )
    wrong = rows.groupBy("clip_id").agg(
        F.count_if(~F.col("want_sha").eqNullSafe(F.col("got_sha"))).alias("inputs"),
        F.count_if(~F.col("want_id").eqNullSafe(F.col("got_id"))).alias("replacements"),
    )
    coverage = failing(
        wrong, ["clip_id"],
        {"inputs-not-approved": F.col("inputs") > 0, "replacements-incomplete": F.col("replacements") > 0},
    )
    return numbering.unionByName(coverage)
