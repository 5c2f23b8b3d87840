"""Lessons and what they prove."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import text as S
from framelake.operators.ordered import hot_join
from framelake.operators.rules import unless


def evidence_count(lessons: DataFrame, threshold: int) -> DataFrame:
    """Independent verified runs per proposed rule against the threshold in force, and the rejected records.

    lessons(rule, run_id, valid). Runs are merged per rule first, so a rule's records never meet in one task.
    """
    per_run = lessons.groupBy("rule", "run_id").agg(
        F.bool_or("valid").alias("verified"), F.count_if(~F.col("valid")).alias("rejected")
    )
    counted = per_run.groupBy("rule").agg(
        F.count_if("verified").alias("evidence_count"), F.sum("rejected").alias("rejected_count")
    )
    enough = F.col("evidence_count") >= threshold
    return counted.select(
        "rule", "evidence_count", "rejected_count", F.lit(threshold).cast("long").alias("threshold"),
        enough.alias("eligible"), F.when(enough, "PROPOSAL").otherwise("MORE_RUNS_NEEDED").alias("code"),
    )


def lesson_failures(lessons: DataFrame, runs: DataFrame, reports: DataFrame, actions: DataFrame) -> DataFrame:
    """Lesson rows whose chain row -> run manifest -> report -> correction action does not hold.

    lessons(row_no, run_id, code, correction, manifest_sha, report_sha, correction_sha, action_index,
    before_sha, after_sha); runs(run_id, manifest_sha); reports(run_id, report_sha, report_passed);
    actions(run_id, action_index, correction_sha, code, correction, approved, status, before_passed,
    after_passed, before_sha, after_sha).
    """
    run = runs.select("run_id", F.col("manifest_sha").alias("r_manifest"))
    report = reports.select("run_id", F.col("report_sha").alias("r_report"), "report_passed")
    action = actions.select("run_id", "action_index", *[F.col(c).alias(f"a_{c}") for c in (
        "correction_sha", "code", "correction", "approved", "status", "before_passed", "after_passed", "before_sha", "after_sha")])
    # Manifest and report are both one row per run, so the lessons meet them in a single join.
    chained = hot_join(lessons, run.join(report, "run_id", "full_outer"), ["run_id"], ["row_no"], "left")
    chained = hot_join(chained, action, ["run_id", "action_index"], ["row_no"], "left", counted=lessons)
    hashes = F.lit(True)
    for name in ("manifest_sha", "report_sha", "correction_sha", "before_sha", "after_sha"):
        hashes = hashes & F.col(name).rlike(S.SHA256)
    rules = {
        "hash-format": unless(hashes),
        "run-manifest": unless(F.col("manifest_sha") == F.col("r_manifest")),
        "report-hash": unless(F.col("report_sha") == F.col("r_report")),
        "report-failed": unless(F.col("report_passed")),
        "correction-manifest": unless(F.col("correction_sha") == F.col("a_correction_sha")),
        "action-identity": unless((F.col("code") == F.col("a_code")) & (F.col("correction") == F.col("a_correction"))),
        "action-approved": unless(F.col("a_approved") & F.col("a_status").isin("applied", "deduplicated")),
        "evidence": unless(~F.col("a_before_passed") & F.col("a_after_passed") & (F.col("a_before_sha") != F.col("a_after_sha"))),
        "evidence-hashes": unless((F.col("before_sha") == F.col("a_before_sha")) & (F.col("after_sha") == F.col("a_after_sha"))),
    }
    codes = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])), ",")
    return chained.select("row_no", codes.alias("codes")).filter(F.col("codes") != "")


def promotion_eligible(reports: DataFrame, warnings: DataFrame) -> DataFrame:
    """Runs whose settings may become the profile: passed, tool provenance verified, no review outstanding.

    reports(run_id, passed, provenance_verified, receipt_sha); warnings(run_id, code, requires_review).
    """
    open_review = warnings.groupBy("run_id").agg(
        F.bool_or((F.col("code") == "HUMAN_REVIEW_REQUIRED") | F.col("requires_review")).alias("outstanding")
    )
    joined = reports.join(open_review, "run_id", "left")
    outstanding = F.coalesce("outstanding", F.lit(False))
    proven = F.coalesce(F.col("provenance_verified") & F.col("receipt_sha").rlike(S.SHA256), F.lit(False))
    return joined.select(
        "run_id", outstanding.alias("review_required"), (F.col("passed") & proven & ~outstanding).alias("eligible")
    )


def exit_class(failures: DataFrame, warnings: DataFrame, runs: DataFrame) -> DataFrame:
    """0 passed, 3 objective failure, 4 only human review left; one aggregated row per run.

    failures(run_id, correction, requires_review); warnings(run_id, code, requires_review).
    """
    from framelake.operators.corrections import REVIEW

    objective = ~F.col("requires_review") & ~F.col("correction").isin(*REVIEW)
    marks = (
        failures.select("run_id", F.when(objective, 3).otherwise(2).alias("mark"))
        .unionByName(warnings.select(
            "run_id", F.when((F.col("code") == "HUMAN_REVIEW_REQUIRED") | F.col("requires_review"), 1).otherwise(0).alias("mark")))
        .unionByName(runs.select("run_id", F.lit(0).alias("mark")))
    )
    worst = marks.groupBy("run_id").agg(F.max("mark").alias("mark"))
    return worst.select("run_id", F.when(F.col("mark") == 3, 3).when(F.col("mark") > 0, 4).otherwise(0).alias("exit_class"))
