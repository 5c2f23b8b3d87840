"""Queries over whole runs: rule sets, corrections, lessons, contracts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import compare, corrections, learning, production, runs, validate
from framelake.operators import pixels as P
from framelake.operators.runs import Rule
from framelake.plans import fixtures as X
from framelake.plans import raster, records, timelines
from framelake.plans.catalog import ORACLES, query
from framelake.plans.raster import IN_PALETTE, KEY, PALETTE, near

CODE_SQL = """CASE WHEN code IN ('PIVOT_DRIFT','BASELINE_DRIFT') THEN CASE WHEN contains(stage,'metadata') THEN 'reexport-metadata' WHEN contains(stage,'preview') THEN 'reexport-preview'
    WHEN contains(stage,'sheet') THEN 'reexport-sheet' ELSE 'realign' END
  WHEN code IN ('FRAME_COUNT','SOURCE_HASH_MISMATCH') THEN CASE WHEN stage='metadata' AND trusted THEN 'reexport-metadata' ELSE 'stop-for-review' END
  WHEN code='PALETTE_DRIFT' THEN 'palette-remap-review' WHEN code='CLIPPED_FOREGROUND' THEN 'stop-for-regeneration' WHEN code='CANVAS_SIZE' THEN 'repad' ELSE 'stop-for-review' END"""
CLASSIFIED = f"classified AS (SELECT *, {CODE_SQL} AS correction FROM failures)"
AUTO_SQL = "('repad','nearest-rescale','rekey','realign','reexport-metadata','reexport-preview','reexport-sheet')"
REVIEW_SQL = "('palette-remap-review','timing-or-transition-review','stop-for-review')"
BUDGET = f"""att AS (SELECT user_id AS run_id, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS frame, count(*) AS used FROM events WHERE value>25 GROUP BY 1,2),
  budget AS (SELECT run_id, frame, least(2, greatest(0, 2-coalesce(used,0))) AS remaining FROM (SELECT DISTINCT run_id, frame FROM classified WHERE correction='stop-for-regeneration') LEFT JOIN att USING (run_id, frame))"""
ARTIFACT_SQL = """CASE WHEN contains(stage,'sheet') THEN 'sheet' WHEN contains(stage,'preview') OR (code='FRAME_COUNT' AND stage<>'metadata') THEN 'preview' WHEN starts_with(stage,'metadata') OR code='SOURCE_HASH_MISMATCH' THEN 'metadata'
     WHEN stage='runtime' THEN 'runtime-frame' ELSE 'normalized-frame' END"""
SHARED = f"""auto AS (SELECT *, CAST(frame AS VARCHAR) AS target, {ARTIFACT_SQL} AS artifact FROM classified WHERE correction IN {AUTO_SQL}),
  shared AS (SELECT run_id, idx, correction, target, artifact, min(idx) OVER (PARTITION BY run_id, correction, target, artifact) AS primary_idx FROM auto)"""


def classified(spark, sf_dir):
    return corrections.classify_failures(X.view(spark, sf_dir, "failures"))


def attempts(spark, sf_dir):
    tried = X.view(spark, sf_dir, "failures").filter("value>25")
    return tried.groupBy("run_id", "frame").agg(F.count(F.lit(1)).alias("used"))


@query("v15_classify_failures", "failures", f"WITH {CLASSIFIED} SELECT run_id, idx, code, stage, correction FROM classified")
def v15(spark, sf_dir):
    return classified(spark, sf_dir).select("run_id", "idx", "code", "stage", "correction")


@query("a18_retry_budget", "failures", f"WITH {CLASSIFIED}, {BUDGET} SELECT * FROM budget")
def a18(spark, sf_dir):
    return corrections.retry_budget(classified(spark, sf_dir), attempts(spark, sf_dir), 2)


@query("w13_dedupe_corrections", "failures", f"""WITH {CLASSIFIED}, {SHARED} SELECT run_id, idx, correction, target, artifact, primary_idx, CASE WHEN idx=primary_idx THEN 'applied' ELSE 'deduplicated' END AS status FROM shared""")
def w13(spark, sf_dir):
    return corrections.dedupe_corrections(classified(spark, sf_dir))


@query("v21_repair_plan", "failures", f"""WITH {CLASSIFIED}, {BUDGET}, {SHARED} SELECT c.run_id, c.idx, code, c.correction,
   {ARTIFACT_SQL} AS artifact,
   CASE WHEN c.correction='stop-for-regeneration' THEN CASE WHEN remaining>0 THEN 'generative-retry' ELSE 'generative-retry-exhausted' END
     WHEN c.correction IN {REVIEW_SQL} THEN 'user-review' WHEN c.idx=primary_idx THEN 'applied' ELSE 'deduplicated' END AS action,
   CASE WHEN c.correction='stop-for-regeneration' THEN remaining END AS attempts_remaining, CASE WHEN c.idx<>primary_idx THEN primary_idx END AS duplicate_of
  FROM classified c LEFT JOIN budget b ON b.run_id=c.run_id AND b.frame=c.frame LEFT JOIN shared s ON s.run_id=c.run_id AND s.idx=c.idx""")
def v21(spark, sf_dir):
    return corrections.repair_plan(classified(spark, sf_dir), attempts(spark, sf_dir), 2)


def run_warnings(spark, sf_dir):
    """One warning per event: those awaiting review, and plain notices."""
    return X.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.when(F.col("value") > 150, "HUMAN_REVIEW_REQUIRED").otherwise("NOTICE").alias("code"),
        (F.col("value") > 180).alias("requires_review"),
    )


@query("a20_exit_class", "failures", f"""WITH {CLASSIFIED}, f AS (SELECT run_id, max(CASE WHEN value<80 AND correction NOT IN {REVIEW_SQL} THEN 3 ELSE 2 END) AS m FROM classified GROUP BY run_id),
  w AS (SELECT user_id AS run_id, max(CASE WHEN value>150 THEN 1 ELSE 0 END) AS m FROM events GROUP BY 1)
  SELECT run_id, CASE WHEN greatest(coalesce(f.m,0), coalesce(w.m,0))=3 THEN 3 WHEN greatest(coalesce(f.m,0), coalesce(w.m,0))>0 THEN 4 ELSE 0 END AS exit_class
  FROM (SELECT DISTINCT user_id AS run_id FROM events) LEFT JOIN f USING (run_id) LEFT JOIN w USING (run_id)""")
def a20(spark, sf_dir):
    failed = classified(spark, sf_dir).withColumn("requires_review", F.col("value") >= 80)
    runs = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"))
    return learning.exit_class(failed, run_warnings(spark, sf_dir), runs)


@query("v18_promotion_eligible", "", """WITH r AS (SELECT user_id AS run_id, max(value)<200 AS passed, count(*)>40 AS proven FROM events GROUP BY 1),
  w AS (SELECT user_id AS run_id, bool_or(value>150) AS o FROM events GROUP BY 1)
  SELECT run_id, coalesce(o,false) AS review_required, passed AND proven AND NOT coalesce(o,false) AS eligible FROM r LEFT JOIN w USING (run_id)""")
def v18(spark, sf_dir):
    reports = X.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        (F.max("value") < 200).alias("passed"), (F.count(F.lit(1)) > 40).alias("provenance_verified")
    ).withColumn("receipt_sha", F.sha2(F.col("run_id").cast("string"), 256))
    return learning.promotion_eligible(reports, run_warnings(spark, sf_dir))


@query("a17_evidence_count", "lessons", """WITH r AS (SELECT failure_code||'/'||action_index AS rule, run_id, bool_or(valid) AS v, count(*) FILTER (NOT valid) AS x FROM lessons GROUP BY 1,2),
  c AS (SELECT rule, count(*) FILTER (v) AS n, CAST(sum(x) AS BIGINT) AS x FROM r GROUP BY rule)
  SELECT rule, n AS evidence_count, x AS rejected_count, CAST(120 AS BIGINT) AS threshold, n>=120 AS eligible, CASE WHEN n>=120 THEN 'PROPOSAL' ELSE 'MORE_RUNS_NEEDED' END AS code FROM c""")
def a17(spark, sf_dir):
    lessons = X.view(spark, sf_dir, "lessons")
    rules = lessons.withColumn("rule", F.concat_ws("/", "failure_code", F.col("action_index").cast("string")))
    return learning.evidence_count(rules, 120)


@query("v16_verify_correction", "", """WITH e AS (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INT) AS k FROM events)
  SELECT event_id AS correction_id, 'before-passed' AS code FROM e WHERE value>50
  UNION ALL SELECT event_id, 'after-failed' FROM e WHERE k<10 AND value<5
  UNION ALL SELECT event_id, 'target-remains' FROM e WHERE k%7=0
  UNION ALL SELECT event_id, 'bytes-unchanged' FROM e WHERE k%9=0
  UNION ALL SELECT event_id, 'canvas-size' FROM e WHERE event_type='click' AND k>60
  UNION ALL SELECT event_id, 'background' FROM e WHERE event_type='error' AND k>80
  UNION ALL SELECT event_id, 'global-scale' FROM e WHERE event_type='view' AND k%2=0""")
def v16(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    lit = F.lit
    evidence = X.table(spark, sf_dir, "events").withColumn("k", k).select(
        F.col("event_id").alias("correction_id"),
        F.when(F.col("event_type") == "click", "CANVAS_SIZE").when(F.col("event_type") == "error", "BACKGROUND_REMAINS")
        .when(F.col("event_type") == "view", "GLOBAL_SCALE_DRIFT").otherwise("PIVOT_DRIFT").alias("code"),
        (F.col("value") > 50).alias("before_passed"), (F.col("k") >= 10).alias("after_passed"), (F.col("value") >= 5).alias("after_review_only"),
        lit(True).alias("target_before"), (F.col("k") % 7 == 0).alias("target_after"),
        F.sha2(F.col("k").cast("string"), 256).alias("before_sha"),
        F.sha2(F.when(F.col("k") % 9 == 0, F.col("k")).otherwise(-1 - F.col("k")).cast("string"), 256).alias("after_sha"),
        lit(64).alias("before_width"), lit(64).alias("before_height"), lit(64).alias("actual_width"), lit(64).alias("actual_height"),
        lit(128).alias("expected_width"), lit(128).alias("expected_height"), lit(128).alias("after_width"),
        F.when(F.col("k") > 60, 127).otherwise(128).alias("after_height"),
        lit(0).alias("opaque_border"), F.when(F.col("k") > 80, 1).otherwise(0).alias("key_pixels"),
        lit(0).alias("intermediate_colors"), lit(True).alias("nearest"), lit(True).alias("scale_integer"), lit(True).alias("scale_uniform"),
        (F.col("k") % 2 == 1).alias("scale_global"), lit(True).alias("pivot_ok"), lit(True).alias("baseline_ok"),
    )
    return corrections.correction_evidence_failures(evidence)


@query("v17_verify_lessons", "lessons", """SELECT row_no, concat_ws(',', CASE WHEN value>60 THEN 'run-manifest' END, CASE WHEN run_id%10=3 THEN 'report-failed' END, CASE WHEN action_index=2 THEN 'action-approved' END,
   CASE WHEN failure_code='view' THEN 'evidence-hashes' END) AS codes FROM lessons WHERE value>60 OR run_id%10=3 OR action_index=2 OR failure_code='view'""")
def v17(spark, sf_dir):
    sha = lambda *parts: F.sha2(F.concat_ws("-", *[p if not isinstance(p, str) else F.lit(p) for p in parts]), 256)
    run = F.col("run_id").cast("string")
    act = F.col("action_index").cast("string")
    lessons = X.view(spark, sf_dir, "lessons").select(
        "row_no", "run_id", "action_index", F.lit("CANVAS_SIZE").alias("code"), F.lit("repad").alias("correction"),
        F.when(F.col("value") > 60, sha("old")).otherwise(sha("manifest", run)).alias("manifest_sha"),
        sha("report", run).alias("report_sha"), sha("correction", run).alias("correction_sha"),
        sha("before", run, act).alias("before_sha"),
        F.when(F.col("failure_code") == "view", sha("other")).otherwise(sha("after", run, act)).alias("after_sha"),
    )
    base = X.view(spark, sf_dir, "lessons").select("run_id", "action_index").distinct()
    runs = base.select("run_id").distinct().select("run_id", sha("manifest", run).alias("manifest_sha"))
    reports = base.select("run_id").distinct().select(
        "run_id", sha("report", run).alias("report_sha"), (F.col("run_id") % 10 != 3).alias("report_passed")
    )
    actions = base.select(
        "run_id", "action_index", sha("correction", run).alias("correction_sha"), F.lit("CANVAS_SIZE").alias("code"), F.lit("repad").alias("correction"),
        (F.col("action_index") != 2).alias("approved"), F.lit("applied").alias("status"),
        F.lit(False).alias("before_passed"), F.lit(True).alias("after_passed"),
        sha("before", run, act).alias("before_sha"), sha("after", run, act).alias("after_sha"),
    )
    return learning.lesson_failures(lessons, runs, reports, actions)


@query("v22_validate_correction_revision", "timeline", """WITH r AS (SELECT clip_id, max(k) AS mk, min(k) AS nk FROM timeline GROUP BY clip_id)
  SELECT clip_id, 'approval-number' AS code FROM r WHERE nk=0
  UNION ALL SELECT clip_id, 'approval-not-newer' FROM r WHERE mk<99
  UNION ALL SELECT clip_id, 'inputs-not-approved' FROM timeline GROUP BY clip_id HAVING bool_or(value>75)
  UNION ALL SELECT clip_id, 'replacements-incomplete' FROM timeline GROUP BY clip_id HAVING bool_or(event_type='signup' AND value>30)""")
def v22(spark, sf_dir):
    frames = X.timeline(spark, sf_dir).withColumn("sha256", F.sha2(F.col("frame_id").cast("string"), 256))
    revisions = frames.groupBy("clip_id").agg(F.max("k").alias("mk"), F.min("k").alias("nk")).select(
        "clip_id", F.lit(2).alias("revision"), F.when(F.col("nk") == 0, 3).otherwise(2).alias("approval_version"),
        F.when(F.col("mk") < 99, 3).otherwise(1).alias("original_version"),
    )
    inputs = frames.select("clip_id", "idx", F.when(F.col("value") > 75, F.sha2(F.lit("redrawn"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    replaced = frames.filter("NOT (event_type='signup' AND value>30)")
    return corrections.correction_revision_failures(revisions, frames, inputs, replaced)


DURATION = "CAST(20+(frame_key*37)%180 AS BIGINT)"
MEASURES = f"""cm AS (SELECT frame_key, clip_id, min(x) FILTER (a>0) AS l, min(y) FILTER (a>0) AS t, max(x) FILTER (a>0) AS r, max(y) FILTER (a>0) AS b, bool_or(NOT {IN_PALETTE}) AS drift FROM pixels GROUP BY frame_key, clip_id),
  rm AS (SELECT frame_key, min(x) FILTER (a>0) AS l, min(y) FILTER (a>0) AS t, max(x) FILTER (a>0) AS r, max(y) FILTER (a>0) AS b, bool_or(NOT {IN_PALETTE}) AS drift, bool_or(b=100) AS blended,
    bool_or(a>0 AND (x IN (0,15) OR y IN (0,15))) OR bool_or(a>0 AND {near(KEY, 8, 'rgb')}) AS bg FROM runtime_pixels GROUP BY frame_key)"""
FLAT = f"""{MEASURES}, flat AS (SELECT clip_id, frame_key, 'BASELINE_DRIFT' AS code, 'canonical' AS stage FROM cm WHERE b<>7
  UNION ALL SELECT clip_id, frame_key, 'CLIPPED_FOREGROUND', 'canonical' FROM cm WHERE l<1 OR t<1 OR r>=7 OR b>=7
  UNION ALL SELECT clip_id, frame_key, 'METADATA_MISMATCH', 'normalization' FROM cm WHERE frame_key%13=0 AND l IS NOT NULL
  UNION ALL SELECT clip_id, frame_key, 'PALETTE_DRIFT', 'canonical' FROM cm WHERE drift
  UNION ALL SELECT clip_id, frame_key, 'BASELINE_DRIFT', 'runtime' FROM rm JOIN (SELECT frame_key, clip_id FROM cm) USING (frame_key) WHERE b<>15
  UNION ALL SELECT clip_id, frame_key, 'CLIPPED_FOREGROUND', 'runtime' FROM rm JOIN (SELECT frame_key, clip_id FROM cm) USING (frame_key) WHERE l<2 OR t<2 OR r>=14 OR b>=14
  UNION ALL SELECT clip_id, frame_key, 'BACKGROUND_REMAINS', 'runtime' FROM rm JOIN (SELECT frame_key, clip_id FROM cm) USING (frame_key) WHERE bg
  UNION ALL SELECT clip_id, frame_key, 'INTERMEDIATE_COLORS', 'runtime' FROM rm JOIN (SELECT frame_key, clip_id FROM cm) USING (frame_key) WHERE blended
  UNION ALL SELECT clip_id, frame_key, 'PALETTE_DRIFT', 'runtime' FROM rm JOIN (SELECT frame_key, clip_id FROM cm) USING (frame_key) WHERE rm.drift
  UNION ALL SELECT clip_id, frame_key, 'SOURCE_HASH_MISMATCH', 'metadata' FROM cm WHERE frame_key%11=0
  UNION ALL SELECT clip_id, frame_key, 'TIMING_MISMATCH', 'metadata' FROM cm WHERE frame_key%17=0)"""


def flat_failures(spark, sf_dir):
    canonical, runtime = X.packed_frames(spark, sf_dir), X.runtime_frames(spark, sf_dir)
    cm = validate.frame_measures(canonical, 8, 8, PALETTE, KEY, 8)
    rm = validate.frame_measures(runtime, 16, 16, PALETTE, KEY, 8)
    key = F.col("frame_key")
    stale = F.when(key % 11 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.col("sha256"))
    duration = (20 + (key * 37) % 180).cast("long")
    recorded = cm.select(
        "frame_key", (F.col("left") + F.when(key % 13 == 0, 1).otherwise(0)).alias("rec_left"), F.col("top").alias("rec_top"),
        F.col("width").alias("rec_width"), F.col("height").alias("rec_height"), stale.alias("rec_sha256"),
        duration.alias("duration"), (duration + F.when(key % 17 == 0, 5).otherwise(0)).alias("frame_duration"),
    )
    mixed = validate.intermediate_colours(
        P.frame_colours(P.explode_pixels(canonical), 8, 8), P.frame_colours(P.explode_pixels(runtime), 16, 16)
    )
    blocks = compare.block_match(canonical, runtime, 2)
    return validate.flat_frame_failures(cm, rm, recorded, mixed, blocks, (8, 8), 2, (4, 8))


@query("v8_flat_frame_rules", "pixels runtime_pixels", f"WITH {FLAT} SELECT * FROM flat")
def v8(spark, sf_dir):
    return flat_failures(spark, sf_dir)


CLIPS_SQL = """SELECT l_suppkey AS clip_id, count(*) AS n, count(*) FILTER (l_returnflag='N') AS nn, max(l_linenumber) AS ml, min(l_quantity) AS mq, count(*) FILTER (l_quantity*10 NOT BETWEEN 11 AND 65535) AS bad FROM lineitem GROUP BY l_suppkey"""


@query("v8_flat_clip_rules", "", f"""WITH c AS ({CLIPS_SQL}), f AS (SELECT clip_id, 'FRAME_COUNT' AS code, 'runtime' AS stage FROM c WHERE nn%2=0
  UNION ALL SELECT clip_id, 'FRAME_COUNT', 'normalization-contract' FROM c WHERE nn%3=0
  UNION ALL SELECT clip_id, 'FRAME_COUNT', 'metadata' FROM c WHERE nn%2=0
  UNION ALL SELECT clip_id, 'PIVOT_DRIFT', 'metadata' FROM c WHERE nn%5=0
  UNION ALL SELECT clip_id, 'SOURCE_HASH_MISMATCH', 'anchor' FROM c WHERE nn%7=0
  UNION ALL SELECT clip_id, 'METADATA_MISMATCH', 'sheetGeometry' FROM c WHERE nn%2=0 AND ceil((n-1)/6.0)<>ceil(n/6.0)
  UNION ALL SELECT clip_id, 'TIMING_MISMATCH', 'durations' FROM c WHERE bad>0
  UNION ALL SELECT clip_id, 'PREVIEW_MISMATCH', 'pages' FROM c WHERE nn%2=0
  UNION ALL SELECT clip_id, 'GLOBAL_SCALE_DRIFT', 'normalization-artifacts' FROM c WHERE ml>6) SELECT * FROM f""")
def v8_clip(spark, sf_dir):
    lines = X.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("clip_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("nn"), F.max("l_linenumber").alias("ml"),
        F.count_if(~(F.col("l_quantity") * 10).between(11, 65_535)).alias("bad_durations"),
    )
    n, nn = F.col("n"), F.col("nn")
    clips = lines.select(
        "clip_id", "bad_durations", n.alias("normalized_frames"), F.when(nn % 2 == 0, n - 1).otherwise(n).alias("runtime_frames"),
        F.when(nn % 3 == 0, n + 1).otherwise(n).alias("contract_frames"), n.alias("metadata_frames"),
        F.lit(64).alias("canonical_pivot_x"), F.lit(112).alias("canonical_pivot_y"),
        F.when(nn % 5 == 0, 127).otherwise(128).alias("meta_pivot_x"), F.lit(224).alias("meta_pivot_y"),
        F.lit(256).alias("meta_width"), F.lit(256).alias("meta_height"), F.lit(6).alias("columns"), F.ceil(n / 6).alias("rows"),
        F.lit("a").alias("anchor_expected"), F.when(nn % 7 == 0, "b").otherwise("a").alias("anchor_actual"),
        F.lit("walk-sheet.png").alias("sheet_name"), F.lit("walk-sheet.png").alias("meta_sheet"),
        F.lit(True).alias("palette_matches"), F.lit(True).alias("config_matches"), F.lit(0).alias("sheet_mismatches"),
        n.alias("preview_pages"), F.when(F.col("ml") > 6, 2).otherwise(1).alias("scales"),
    )
    return validate.flat_clip_failures(clips, (128, 128), 2, (64, 112))


@query("v8_semantic_review", "", """WITH e AS (SELECT DISTINCT user_id AS clip_id, CASE event_type WHEN 'error' THEN 'IDENTITY_DRIFT' WHEN 'view' THEN 'DUPLICATE_POSE' ELSE 'LOOP_SEAM' END AS code FROM events WHERE value>50)
  SELECT c.clip_id, s.code, CASE WHEN e.code IS NOT NULL THEN 'failure' ELSE 'HUMAN_REVIEW_REQUIRED' END AS outcome FROM (SELECT DISTINCT user_id AS clip_id FROM events) c
  CROSS JOIN (VALUES ('IDENTITY_DRIFT'),('DUPLICATE_POSE'),('LOOP_SEAM')) s(code) LEFT JOIN e ON e.clip_id=c.clip_id AND e.code=s.code""")
def v8_semantic(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").withColumnRenamed("user_id", "clip_id")
    code = F.when(F.col("event_type") == "error", "IDENTITY_DRIFT").when(F.col("event_type") == "view", "DUPLICATE_POSE").otherwise("LOOP_SEAM")
    return validate.semantic_outcomes(
        events.select("clip_id").distinct(), events.filter("value>50").select("clip_id", code.alias("code"))
    )


def report(parts):
    """Failures per rule set and code."""
    union = validate.all_failures({k: v.select(F.col("code")) for k, v in parts.items()})
    return union.groupBy("rule_set", "code").agg(F.count(F.lit(1)).alias("failures"))


def report_sql(parts):
    unions = " UNION ALL ".join(f"SELECT '{k}' AS rule_set, {code} AS code FROM ({sql})" for k, (code, sql) in parts.items())
    return f"SELECT rule_set, code, count(*) AS failures FROM ({unions}) GROUP BY rule_set, code"


def coded(df, code):
    return df.select(code.alias("code"))


@query("u4_all_failures", "failures", f"""WITH {CLASSIFIED} SELECT 'classified' AS rule_set, run_id, idx, code, correction, CAST(NULL AS BIGINT) AS revision FROM classified
  UNION ALL SELECT 'chain', run_id, NULL, 'BROKEN_CHAIN', NULL, revision FROM ({ORACLES['w6_verify_revision_chain']}) WHERE NOT valid""")
def u4(spark, sf_dir):
    broken = records.w6(spark, sf_dir).filter("NOT valid").select("run_id", F.lit("BROKEN_CHAIN").alias("code"), "revision")
    found = classified(spark, sf_dir).select("run_id", "idx", "code", "correction")
    return validate.all_failures({"classified": found, "chain": broken})


#: A run is an order, its artifacts are the order's lines; parts may be missing.
RUN_FACTS = """SELECT row_number() OVER () AS n, o_orderkey AS run_id, l_partkey AS clip_id, l_linenumber AS ord, CAST(l_quantity*10 AS BIGINT) AS duration_ms, CAST(round(l_discount*100) AS BIGINT) AS drift,
  CAST(round(l_tax*100) AS BIGINT) AS tax, p_size AS canvas, s_suppkey AS socket_id, l_suppkey AS wanted_socket FROM lineitem JOIN orders ON o_orderkey=l_orderkey
  LEFT JOIN part ON p_partkey=l_partkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON s_suppkey=l_suppkey"""
RUN_RULES = [
    Rule("SOCKET_MISSING", "contract", "socket_id is null", "'missing'", "wanted_socket"),
    Rule("TIMING_MISMATCH", "metadata", "duration_ms not between 30 and 480", "duration_ms", "'30..480'"),
    Rule("CANVAS_SIZE", "canonical", "canvas > 48", "canvas", "'at most 48'"),
    Rule("PALETTE_DRIFT", "canonical", "drift > 9", "drift", "'at most 9'"),
    Rule("LOOP_SEAM", "preview", "tax > 6", "tax", "'at most 6'", review=True),
]
RUN_FOUND = " UNION ALL ".join(
    f"SELECT n, run_id, clip_id, ord, '{r.code}' AS code, '{r.stage}' AS stage, CAST({r.actual} AS VARCHAR) AS actual, CAST({r.expected} AS VARCHAR) AS expected, {str(r.review).lower()} AS review FROM facts WHERE {r.broken}"
    for r in RUN_RULES
)


def run_ledger(spark, sf_dir):
    lines, orders, parts, suppliers = (X.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier"))
    sockets = suppliers.where("s_acctbal >= 0").select(F.col("s_suppkey").alias("socket_id"))
    wide = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    wide = wide.join(sockets, F.col("l_suppkey") == F.col("socket_id"), "left")
    facts = wide.select(
        F.col("o_orderkey").alias("run_id"), F.col("l_partkey").alias("clip_id"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") * 10).cast("long").alias("duration_ms"),
        F.round(F.col("l_discount") * 100).cast("long").alias("drift"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"), F.col("p_size").alias("canvas"),
        "socket_id", F.col("l_suppkey").alias("wanted_socket"),
    )
    return runs.judged(facts, RUN_RULES)


@query("v9_run_failures", "", f"WITH facts AS ({RUN_FACTS}) SELECT * EXCLUDE (n) FROM ({RUN_FOUND})")
def v9_failures(spark, sf_dir):
    return runs.failures(run_ledger(spark, sf_dir), ["run_id", "clip_id", "ord"])


@query("v9_run_verdicts", "", f"""WITH facts AS ({RUN_FACTS}), found AS ({RUN_FOUND}),
  n AS (SELECT run_id, count(*) AS artifacts FROM facts GROUP BY run_id),
  f AS (SELECT run_id, count(*) FILTER (NOT review) AS failures, count(*) FILTER (review) AS reviews, count(DISTINCT n) FILTER (NOT review) AS broken,
    string_agg(DISTINCT code, ',' ORDER BY code) FILTER (NOT review) AS codes FROM found GROUP BY run_id)
  SELECT o_orderkey AS run_id, coalesce(artifacts,0) AS artifacts, coalesce(broken,0) AS broken_artifacts, coalesce(failures,0) AS failures, coalesce(reviews,0) AS reviews, coalesce(codes,'') AS codes,
    coalesce(failures,0)=0 AS passed, CASE WHEN coalesce(failures,0)>0 THEN 3 WHEN coalesce(reviews,0)>0 THEN 4 ELSE 0 END AS exit_class
  FROM orders LEFT JOIN n ON n.run_id=o_orderkey LEFT JOIN f ON f.run_id=o_orderkey""")
def v9_verdicts(spark, sf_dir):
    return runs.verdicts(run_ledger(spark, sf_dir), X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")))


@query("v9_contract_run_v1", "pixels runtime_pixels", report_sql({
    "flat": ("code", ORACLES["v8_flat_frame_rules"]),
    "coverage": ("'METADATA_MISMATCH'", ORACLES["j5_ordered_coverage"]),
    "artifacts": ("'SOURCE_HASH_MISMATCH'", ORACLES["j10_verify_artifacts"]),
    "ancestry": ("'SOURCE_HASH_MISMATCH'", ORACLES["j14_verify_ancestry"]),
    "artifact-set": ("'FRAME_COUNT'", ORACLES["u1_artifact_set_diff"]),
    "loop": ("warning", f"SELECT * FROM ({ORACLES['w11_loop_transition']}) WHERE warning IS NOT NULL"),
}))
def v9(spark, sf_dir):
    return report({
        "flat": flat_failures(spark, sf_dir),
        "coverage": coded(timelines.j5(spark, sf_dir), F.lit("METADATA_MISMATCH")),
        "artifacts": coded(records.j10(spark, sf_dir), F.lit("SOURCE_HASH_MISMATCH")),
        "ancestry": coded(records.j14(spark, sf_dir), F.lit("SOURCE_HASH_MISMATCH")),
        "artifact-set": coded(records.u1(spark, sf_dir), F.lit("FRAME_COUNT")),
        "loop": coded(timelines.w11(spark, sf_dir).filter("warning IS NOT NULL"), F.col("warning")),
    })


FLAGS = """flags AS (SELECT l_orderkey AS clip_id, l_linenumber AS frame_id, l_returnflag AS track_id,
   CASE WHEN l_returnflag='A' THEN 'actor' WHEN l_returnflag='N' AND l_discount=0.1 THEN 'effect' WHEN l_returnflag='N' THEN 'prop' ELSE 'effect' END AS kind,
   CASE l_returnflag WHEN 'N' THEN 'hand' WHEN 'R' THEN 'aura' END AS attach_to, CASE WHEN l_tax=0.08 THEN 1 ELSE 0 END AS dx, l_linestatus FROM lineitem),
  socks AS (SELECT DISTINCT l_orderkey AS clip_id, CASE WHEN l_linestatus='O' THEN 'hand' ELSE 'aura' END AS socket_id FROM lineitem)"""


@query("j18_attach_track_to_socket", "", f"""WITH {FLAGS} SELECT clip_id, frame_id, track_id, code FROM (SELECT f.*, CASE WHEN track_id='N' AND kind<>'prop' THEN 'SOURCE_HASH_MISMATCH'
   WHEN attach_to IS NOT NULL AND s.socket_id IS NULL THEN 'SOCKET_ATTACHMENT' WHEN dx<>0 THEN CASE WHEN attach_to IS NULL THEN 'LANDMARK_DRIFT' ELSE 'SOCKET_ATTACHMENT' END END AS code
  FROM flags f LEFT JOIN socks s ON s.clip_id=f.clip_id AND s.socket_id=f.attach_to) WHERE code IS NOT NULL""")
def j18(spark, sf_dir):
    lines = X.table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "actor").when((flag == "N") & (F.col("l_discount") == 0.1), "effect").when(flag == "N", "prop").otherwise("effect")
    socket = F.when(flag == "N", "hand").when(flag == "R", "aura")
    outputs = lines.select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").alias("frame_id"), flag.alias("track_id"), kind.alias("kind"),
        socket.alias("attach_to"), F.when(F.col("l_tax") == 0.08, 1).otherwise(0).alias("dx"), F.lit(0).alias("dy"),
        F.lit(0).alias("frame_dx"), F.lit(0).alias("frame_dy"),
    )
    tracks = lines.select(
        flag.alias("track_id"), F.when(flag == "A", "actor").when(flag == "N", "prop").otherwise("effect").alias("kind"), socket.alias("attach_to")
    ).distinct()
    sockets = lines.select(
        F.col("l_orderkey").alias("clip_id"), F.when(F.col("l_linestatus") == "O", "hand").otherwise("aura").alias("socket_id")
    )
    return compare.attachment_failures(outputs, tracks, sockets)


@query("v10_contract_run_v2", "", report_sql({
    "blocks": ("'INTERMEDIATE_COLORS'", f"SELECT * FROM ({ORACLES['j6_block_match']}) WHERE NOT matches"),
    "shift": ("'LANDMARK_DRIFT'", f"SELECT * FROM ({ORACLES['j7_translated_match']}) WHERE NOT matches"),
    "sheet": ("'FRAME_BLEED'", ORACLES["j8_sheet_match"]),
    "preview": ("code", ORACLES["j9_preview_match"]),
    "artifacts": ("'SOURCE_HASH_MISMATCH'", ORACLES["j10_verify_artifacts"]),
    "attachment": ("code", ORACLES["j18_attach_track_to_socket"]),
    "contacts": ("code", ORACLES["a22_contact_presence"]),
}))
def v10(spark, sf_dir):
    return report({
        "blocks": coded(raster.j6(spark, sf_dir).filter("NOT matches"), F.lit("INTERMEDIATE_COLORS")),
        "shift": coded(raster.j7(spark, sf_dir).filter("NOT matches"), F.lit("LANDMARK_DRIFT")),
        "sheet": coded(raster.j8(spark, sf_dir), F.lit("FRAME_BLEED")),
        "preview": raster.j9(spark, sf_dir),
        "artifacts": coded(records.j10(spark, sf_dir), F.lit("SOURCE_HASH_MISMATCH")),
        "attachment": j18(spark, sf_dir),
        "contacts": timelines.a22(spark, sf_dir),
    })


@query("v11_engine_index_rules", "timeline", """WITH t AS (SELECT *, CASE WHEN clip_id%2=0 THEN 'loop' ELSE 'once' END AS lm FROM timeline)
  SELECT clip_id, idx, 'FRAME_COUNT' AS code FROM t WHERE value>100
  UNION ALL SELECT clip_id, idx, 'NONCYCLIC_RESTART' FROM t WHERE value<=100 AND clip_id%5=0
  UNION ALL SELECT clip_id, idx, 'TIMING_MISMATCH' FROM t WHERE value<=100 AND value>60
  UNION ALL SELECT clip_id, idx, 'LANDMARK_DRIFT' FROM t WHERE value<=100 AND k=7
  UNION ALL SELECT clip_id, idx, 'METADATA_MISMATCH' FROM t WHERE value<=100 AND k=9
  UNION ALL SELECT clip_id, idx, 'GROUND_TRAVEL_CONTACT' FROM t WHERE value<=100 AND k IN (9,11)""")
def v11_index(spark, sf_dir):
    base = X.timeline(spark, sf_dir).withColumn("loop_mode", F.when(F.col("clip_id") % 2 == 0, "loop").otherwise("once"))
    k = F.col("k")
    point = lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"))
    contract = base.select(
        "clip_id", "idx", "frame_id", "duration_ms", "loop_mode", F.lit(64).alias("pivot_x"), F.lit(112).alias("pivot_y"),
        F.lit(111).alias("baseline"), point(F.when(k == 11, 2).otherwise(0)).alias("ground"),
    )
    restart = F.when(F.col("loop_mode") == "loop", "loop").otherwise("stop")
    wrong = F.when(F.col("loop_mode") == "loop", "stop").otherwise("loop")
    exported = base.filter("value<=100").select(
        "clip_id", "idx", "frame_id", F.when(F.col("value") > 60, F.col("duration_ms") + 1).otherwise(F.col("duration_ms")).alias("duration_ms"),
        "loop_mode", F.when(F.col("clip_id") % 5 == 0, wrong).otherwise(restart).alias("restart"),
        F.when(k == 7, 63).otherwise(64).alias("root_x"), F.lit(112).alias("root_y"), F.lit(111).alias("baseline"),
        point(F.when(k.isin(9, 11), 2).otherwise(0)).alias("ground"), F.array().cast("array<string>").alias("contacts"),
    )
    return validate.engine_index_failures(exported, contract)


@query("v11_audit_run", "", report_sql({
    "binding": ("'BROKEN_ARTIFACT_HASH'", f"SELECT * FROM ({ORACLES['j10_verify_artifacts']}) WHERE state='changed'"),
    "missing": ("'ARTIFACT_READ_FAILURE'", f"SELECT * FROM ({ORACLES['j10_verify_artifacts']}) WHERE state='missing'"),
    "index": ("code", ORACLES["v11_engine_index_rules"]),
    "interpolation": ("'INTERMEDIATE_COLORS'", f"SELECT * FROM ({ORACLES['j6_block_match']}) WHERE NOT matches"),
    "attachment": ("code", ORACLES["j18_attach_track_to_socket"]),
}))
def v11(spark, sf_dir):
    artifacts = records.j10(spark, sf_dir)
    return report({
        "binding": coded(artifacts.filter("state='changed'"), F.lit("BROKEN_ARTIFACT_HASH")),
        "missing": coded(artifacts.filter("state='missing'"), F.lit("ARTIFACT_READ_FAILURE")),
        "index": v11_index(spark, sf_dir),
        "interpolation": coded(raster.j6(spark, sf_dir).filter("NOT matches"), F.lit("INTERMEDIATE_COLORS")),
        "attachment": j18(spark, sf_dir),
    })


def edits(spark, sf_dir):
    """Lines of an order as edited frames; returned lines were cut, taxed-out ones keep a second track."""
    lines = X.table(spark, sf_dir, "lineitem")
    strings = lambda *v: F.array(*[F.lit(s) for s in v])
    return lines.select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("idx"),
        F.concat_ws("-", F.lit("f"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("frame_id"),
        (F.col("l_returnflag") != "R").alias("included"),
        F.when(F.col("l_tax") == 0.0, strings("actor", "prop")).otherwise(strings("actor")).alias("tracks"),
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("derivative_sha"),
        F.when(F.col("l_linestatus") == "O", "step ").otherwise("  ").alias("label"),
        (F.col("l_quantity") * 10).cast("long").alias("duration_ms"), strings("left-foot").alias("contacts"),
    )


def contract_inputs(spark, sf_dir):
    frames = edits(spark, sf_dir)
    counts = frames.groupBy("clip_id").agg(F.count_if("included").alias("n"))
    orders = X.table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "clip_id").join(counts, "clip_id")
    approvals = orders.select(
        "clip_id", F.sha2(F.col("clip_id").cast("string"), 256).alias("approval_sha"), F.lit(True).alias("verified"),
        F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("approved").alias("decision"),
        F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("action_id"),
        F.when(F.col("o_totalprice") > 450000, F.col("n") + 1).otherwise(F.col("n")).alias("selected_frames"),
    )
    customers = X.table(spark, sf_dir, "customer")
    projects = customers.filter("c_acctbal>=-900").select(F.col("c_custkey").alias("project_id"), F.sha2("c_name", 256).alias("anchor_sha"))
    strings = lambda *v: F.array(*[F.lit(s) for s in v])
    actions = X.table(spark, sf_dir, "orders").filter("o_orderpriority<>'5-LOW'").select(F.col("o_orderpriority").alias("action_id")).distinct().select(
        "action_id", F.lower("action_id").alias("semantic"), F.lit("loop").alias("loop_mode"),
        F.when(F.col("action_id") == "1-URGENT", strings("actor", "prop")).otherwise(strings("actor")).alias("tracks"),
    )
    return frames, production.contract_status(frames, approvals, projects, actions)


STATUS = """ed AS (SELECT l_orderkey AS clip_id, count(*) FILTER (l_returnflag<>'R') AS frames, bool_and(l_returnflag='R' OR l_tax<>0) AS single FROM lineitem GROUP BY 1),
  st AS (SELECT ed.clip_id, frames, CASE WHEN o_orderstatus='P' THEN 'OWNER_APPROVAL_REQUIRED' WHEN o_orderpriority='5-LOW' THEN 'ACTION_UNKNOWN' WHEN o_orderpriority='1-URGENT' THEN 'MULTI_TRACK_ACTION'
    WHEN frames=0 THEN 'NO_SELECTED_FRAMES' WHEN o_totalprice>450000 THEN 'APPROVAL_MEMBERSHIP' WHEN NOT single THEN 'MULTI_TRACK_FRAME' WHEN c_acctbal<-900 THEN 'NO_CANONICAL_ANCHOR' END AS code, o_orderpriority, c_name
    FROM ed JOIN orders ON o_orderkey=ed.clip_id LEFT JOIN customer ON c_custkey=o_custkey)"""


@query("j17_production_contract_status", "", f"WITH {STATUS} SELECT clip_id, frames, code FROM st")
def j17(spark, sf_dir):
    return contract_inputs(spark, sf_dir)[1].select("clip_id", "frames", "code")


@query("j17_production_contract_documents", "", f"""WITH {STATUS}, fr AS (SELECT l_orderkey AS clip_id, l_linenumber AS idx, 'f-'||l_linenumber||'-'||l_partkey AS id, CASE WHEN l_linestatus='O' THEN 'step' ELSE lower(o_orderpriority) END AS sem,
    CAST(l_quantity*10 AS BIGINT) AS d, sha256(CAST(l_partkey AS VARCHAR)) AS h, o_orderpriority, c_name FROM lineitem JOIN st ON st.clip_id=l_orderkey WHERE code IS NULL AND l_returnflag<>'R')
  SELECT clip_id, CAST(-1 AS BIGINT) AS idx, '{{"version":2,"selectionApprovalSha256":"'||sha256(CAST(clip_id AS VARCHAR))||'","anchorSha256":"'||sha256(c_name)||'","loopMode":"loop","frameCount":'||count(*)||'}}' AS document FROM fr GROUP BY clip_id, c_name
  UNION ALL SELECT clip_id, CAST(idx AS BIGINT), '{{"id":"'||id||'","semantic":"'||sem||'","duration":'||d||',"tracks":["actor"],"contacts":["left-foot"],"sha256":"'||h||'"}}' FROM fr""")
def j17_documents(spark, sf_dir):
    return production.contract_documents(*contract_inputs(spark, sf_dir))


@query("s8_write_clip_metadata", "timeline", """SELECT clip_id, CAST(-1 AS BIGINT) AS idx, '{"name":"clip-'||clip_id||'","frameSize":{"width":256,"height":256},"columns":6,"rows":'||CAST(ceil(count(*)/6.0) AS BIGINT)||',"frameCount":'||count(*)||'}' AS document FROM timeline GROUP BY clip_id
  UNION ALL SELECT clip_id, idx, '{"index":'||idx||',"file":"f'||frame_id||'.png","x":'||idx%6*256||',"y":'||idx//6*256||',"width":256,"height":256,"duration":'||duration_ms||',"sha256":"'||sha256(CAST(k AS VARCHAR))||'"}' FROM timeline""")
def s8(spark, sf_dir):
    frames = X.timeline(spark, sf_dir).select(
        "clip_id", "idx", F.concat(F.lit("f"), F.col("frame_id").cast("string"), F.lit(".png")).alias("file"), "duration_ms",
        F.sha2(F.col("k").cast("string"), 256).alias("sha256"),
    )
    return production.clip_metadata(frames, 6, 256, 256)


@query("s10_engine_index", "timeline", """SELECT clip_id, CAST(-1 AS BIGINT) AS idx, '{"id":'||clip_id||',"loopMode":"'||CASE WHEN clip_id%2=0 THEN 'loop' ELSE 'hold-last' END||'","restart":"'||CASE WHEN clip_id%2=0 THEN 'loop' ELSE 'stop' END||'","frameCount":'||count(*)||'}' AS document FROM timeline GROUP BY clip_id
  UNION ALL SELECT clip_id, idx, '{"id":'||frame_id||',"duration":'||duration_ms||',"root":{"x":'||marker_x||',"y":112},"baseline":111,"outputs":[{"trackId":"actor","kind":"actor","sha256":"'||sha256('a'||k)||'"}'||CASE WHEN event_type='click' THEN ',{"trackId":"lamp","kind":"prop","sha256":"'||sha256('p'||k)||'"}' ELSE '' END||']}' FROM timeline""")
def s10(spark, sf_dir):
    base = X.timeline(spark, sf_dir)
    k = F.col("k").cast("string")
    frames = base.select("clip_id", "idx", "frame_id", "duration_ms", F.when(F.col("clip_id") % 2 == 0, "loop").otherwise("hold-last").alias("loop_mode"))
    raw = X.view(spark, sf_dir, "timeline_raw")
    out = lambda ord_, track, kind, lead: raw.select(
        "clip_id", "frame_id", "event_type", F.lit(ord_).alias("ord"), F.lit(track).alias("track_id"), F.lit(kind).alias("kind"),
        F.sha2(F.concat(F.lit(lead), k), 256).alias("sha256"),
    )
    outputs = out(0, "actor", "actor", "a").unionByName(out(1, "lamp", "prop", "p").filter("event_type='click'")).drop("event_type")
    landmarks = raw.select("clip_id", "frame_id", F.col("marker_x").alias("root_x"), F.lit(112).alias("root_y"), F.lit(111).alias("baseline"))
    return production.engine_index(frames, outputs, landmarks)
