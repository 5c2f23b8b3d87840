import hashlib
import hmac

import pytest
from conftest import rows
from pyspark.sql import functions as F

from framelake.functions import hashing as H
from framelake.functions import text as S
from framelake.operators import compare, corrections, learning, paths, production, provenance, settings, validate


def flags(spark, values, **tests):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: {k: getattr(r, k) for k in tests} for r in df.select("v", *[t(F.col("v")).alias(k) for k, t in tests.items()]).collect()}


def test_identifier_predicates(spark):
    got = flags(
        spark, ["hero", "hero-", "Hero", "con", "con.x", "a.", "a", "", "lpt1", "COM7.txt"],
        contract=S.is_contract_id, schema=S.is_schema_id, run=S.is_safe_run_id, stem=S.is_safe_clip_stem,
    )
    assert got["hero-"] == {"contract": False, "schema": True, "run": True, "stem": False}
    assert got["Hero"] == {"contract": False, "schema": False, "run": True, "stem": True}
    assert got["con"] == {"contract": True, "schema": False, "run": False, "stem": False}
    assert got["COM7.txt"]["run"] is False and got["con.x"]["schema"] is False
    assert not any(got["a."].values()) and not any(got[""].values())


def test_portable_paths(spark):
    good = ["a/b.png", "frames/001.png"]
    bad = ["", "/a", "a//b", "../a", "a/../b", "./a", "a/", "C:/x", "a\\b", "a/con/b", "a/nul.txt", "a/b ", "a./b", "a/b?c"]
    got = flags(spark, good + bad, ok=S.is_portable_path)
    assert [v for v in good if not got[v]["ok"]] == [] and [v for v in bad if got[v]["ok"]] == []


def test_portability_key_folds_compatibility_forms(spark):
    names = spark.createDataFrame([("s", "Ｗalk"), ("s", "walk"), ("s", "ﬁn"), ("t", "FIN")], "scope string, name string")
    assert rows(paths.portability_collisions(names, ["scope"], "name")) == [("s", "walk", 2)]


def test_path_policies(spark):
    leaves = spark.createDataFrame([(1, "a.file", "/runs/r1/x.png"), (1, "a.other", "C:\\secret\\k.txt"), (1, "auth.apiKey", "k")], "id long, path string, value string")
    assert rows(paths.leaf_policies(leaves, "/runs/r1")) == [
        (1, "a.file", "<absolute>/x.png", "x.png", True, False),
        (1, "a.other", "<absolute>/k.txt", "<external-path-redacted>", True, False),
        (1, "auth.apiKey", "k", "k", False, True),
    ]


def test_forbidden_roots_match_whole_components(spark):
    candidates = spark.createDataFrame([(1, "/srv/game/a.png"), (2, "/srv/gamepad/a.png"), (3, "/srv/game")], "id long, path string")
    roots = spark.createDataFrame([("/srv/game",)], "root string")
    assert rows(paths.forbidden_path_hits(candidates, roots), "id") == [(1,), (3,)]


def test_canonical_json_and_signature(spark):
    doc = spark.createDataFrame([('{"b":1, "a":{"d":null,"c":[1,{"z":2,"y":"é"}]}}',)], "d string")
    canonical = '{"a":{"c":[1,{"y":"é","z":2}],"d":null},"b":1}'
    row = doc.select(
        H.canonical_json(F.col("d")).alias("c"), H.stable_hash(F.col("d")).alias("h"), H.signer(b"key", "frame-approval")(F.col("d")).alias("s")
    ).first()
    assert row.c == canonical
    assert row.h == hashlib.sha256(canonical.encode()).hexdigest()
    assert row.s == hmac.new(b"key", b"frame-approval\0" + canonical.encode(), hashlib.sha256).hexdigest()


def test_signing_key_stays_out_of_the_plan(spark):
    plan = spark.range(1).select(H.signer(b"very-secret", "d")(F.lit("{}")))._jdf.queryExecution().toString()
    assert "very-secret" not in plan and b"very-secret".hex() not in plan.lower()


def test_provenance_keys_vanish_at_any_depth(spark):
    doc = spark.createDataFrame([('{"a":[{"snapReceiptSha256":"x","k":1}],"frameApprovalSha256":"y"}',)], "d string")
    assert doc.select(H.strip_provenance("d")).first()[0] == '{"a":[{"k":1}]}'


def test_revision_chain_breaks_stay_broken(spark):
    chain = spark.createDataFrame(
        [(1, 1, "a", "root"), (1, 2, "b", "a"), (1, 3, "c", "x"), (1, 4, "d", "c"), (2, 2, "a", "root")],
        "run_id long, revision long, sha256 string, previous_sha256 string",
    )
    got = rows(provenance.verify_revision_chain(chain, F.lit("root")), "run_id", "revision", "valid")
    assert got == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (2, 2, False)]


def inventory_by_hand(files):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = {}
    for path, value in sorted(files):
        leaves.setdefault(sha(path)[:4], []).append(f'{{"path":"{path}","sha256":"{value}"}}')
    middle = {}
    for part in sorted(leaves):
        middle.setdefault(part[:2], []).append(sha("[" + ",".join(leaves[part]) + "]"))
    return sha(",".join(sha(",".join(middle[part])) for part in sorted(middle)))


@pytest.mark.parametrize("count", [1, 5, 16_385])
def test_inventory_hash_means_the_same_at_every_size(spark, count):
    files = [(f"p{i}", f"h{i}") for i in range(count)]
    table = spark.createDataFrame([("r", *f) for f in files], "run_id string, path string, sha256 string")
    got = provenance.inventory_hash(table).first()
    assert (got.artifacts, got.inventory_sha256) == (count, inventory_by_hand(files))
    assert provenance.inventory_hash(table.repartition(3)).first().inventory_sha256 == got.inventory_sha256


def test_a_missing_link_breaks_the_chain(spark):
    chain = spark.createDataFrame(
        [(1, 1, "a", "root"), (1, 2, "b", None), (2, 1, "a", None)], "run_id long, revision long, sha256 string, previous_sha256 string"
    )
    assert rows(provenance.verify_revision_chain(chain, F.lit("root")), "run_id", "revision", "valid") == [(1, 1, True), (1, 2, False), (2, 1, False)]


def test_malformed_json_gives_null_and_not_an_exception(spark):
    texts = spark.createDataFrame([(1, "{bad"), (2, None), (3, '{"b":1,"a":2}')], "k long, t string")
    assert rows(texts.select("k", H.canonical_json("t"))) == [(1, None), (2, None), (3, '{"a":2,"b":1}')]
    assert rows(texts.select("k", H.strip_provenance("t")))[:2] == [(1, None), (2, None)]
    assert rows(provenance.flatten_documents(texts, "k", "t")) == [(1, "!", None), (2, "!", None), (3, "a", "2"), (3, "b", "1")]


def test_drift_of_one_frame_in_two_artifacts_is_two_repairs(spark):
    failures = spark.createDataFrame(
        [("r", 0, 7, "PIVOT_DRIFT", "canonical"), ("r", 1, 7, "PIVOT_DRIFT", "runtime"), ("r", 2, 7, "BASELINE_DRIFT", "runtime")],
        "run_id string, idx long, frame long, code string, stage string",
    ).withColumn("trusted", F.lit(False))
    got = corrections.dedupe_corrections(corrections.classify_failures(failures))
    assert rows(got, "idx", "artifact", "status") == [
        (0, "normalized-frame", "applied"), (1, "runtime-frame", "applied"), (2, "runtime-frame", "deduplicated")
    ]
    bytes_differ = corrections.classify_failures(failures.withColumn("before_sha", F.col("idx").cast("string")))
    assert {r.status for r in corrections.dedupe_corrections(bytes_differ).collect()} == {"applied"}


def test_same_run_twice_differs_only_in_its_envelope(spark):
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "run_id string, path string, sha256 string")
    envelope = lambda v: spark.createDataFrame([("r", "createdAt", v, True)], "run_id string, field string, value string, passed boolean")
    assert rows(provenance.compare_runs(files, files, envelope("1"), envelope("2"))) == [("r", 0, 1, True)]
    changed = files.withColumn("sha256", F.lit("1"))
    assert rows(provenance.compare_runs(files, changed, envelope("1"), envelope("1"))) == [("r", 1, 0, False)]


def test_artifact_states(spark):
    schema = "run_id string, path string, sha256 string"
    left = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], schema)
    right = spark.createDataFrame([("r", "a", "1"), ("r", "b", "9"), ("r", "d", "4")], schema)
    assert rows(provenance.verify_artifacts(left, right), "path", "state") == [("b", "changed"), ("c", "missing"), ("d", "extra")]


def test_document_diff_ignores_order(spark):
    docs = spark.createDataFrame([(1, '{"b":[1,2],"a":{"x":"1"}}', '{"a":{"x":"1"},"b":[1,3]}')], "id long, l string, r string")
    flat = lambda c: provenance.flatten_documents(docs, "id", c)
    assert rows(compare.document_diff(flat("l"), flat("r"), ["id"])) == [(1, "b[1]", "2", "3", "changed")]


def test_settings_merge_field_by_field(spark):
    runs = spark.createDataFrame([(1, 7)], "run_id long, project_id long")
    profiles = spark.createDataFrame([(7, 512, None)], "project_id long, runtime_width int, snapper_executable string")
    overrides = spark.createDataFrame([(1, 300)], "run_id long, background_tolerance int")
    effective = settings.effective_settings(runs, profiles, overrides)
    row = effective.first()
    assert (row.runtime_width, row.runtime_height, row.background_tolerance, row.executable_source) == (512, 256, 300, "default")
    assert rows(settings.settings_failures(effective), "rule") == [("background-tolerance",), ("runtime-uniform-scale",)]


CLASSES = [
    ("PALETTE_DRIFT", "canonical", None, "palette-remap-review"), ("PIVOT_DRIFT", "metadata-canonical", None, "reexport-metadata"),
    ("PIVOT_DRIFT", None, None, "realign"), ("BASELINE_DRIFT", "sheet", None, "reexport-sheet"), ("FRAME_COUNT", "metadata", True, "reexport-metadata"),
    ("FRAME_COUNT", "metadata", False, "stop-for-review"), ("SOURCE_HASH_MISMATCH", "anchor", True, "stop-for-review"), ("UNHEARD_OF", None, None, "stop-for-review"),
    ("CLIPPED_FOREGROUND", "runtime", None, "stop-for-regeneration"),
]


def test_correction_classes(spark):
    df = spark.createDataFrame(CLASSES, "code string, stage string, trusted boolean, want string")
    assert corrections.classify_failures(df).filter("correction<>want").count() == 0


def test_repair_plan_shares_and_limits_work(spark):
    failures = spark.createDataFrame(
        [(1, 0, "CANVAS_SIZE", "runtime", None, 3), (1, 1, "CANVAS_SIZE", "runtime", None, 3), (1, 2, "CLIPPED_FOREGROUND", "runtime", None, 4),
         (1, 3, "CLIPPED_FOREGROUND", "runtime", None, 5), (1, 4, "PALETTE_DRIFT", "canonical", None, 1)],
        "run_id long, idx long, code string, stage string, trusted boolean, frame int",
    )
    attempts = spark.createDataFrame([(1, 4, 1), (1, 5, 9)], "run_id long, frame int, used long")
    plan = corrections.repair_plan(corrections.classify_failures(failures), attempts, 2)
    assert rows(plan, "idx", "action", "attempts_remaining", "duplicate_of") == [
        (0, "applied", None, None), (1, "deduplicated", None, 0), (2, "generative-retry", 1, None),
        (3, "generative-retry-exhausted", 0, None), (4, "user-review", None, None),
    ]


def test_evidence_counts_runs_once(spark):
    lessons = spark.createDataFrame([("r", 1, True), ("r", 1, True), ("r", 2, True), ("r", 3, False)], "rule string, run_id long, valid boolean")
    row = learning.evidence_count(lessons, 3).first()
    assert (row.evidence_count, row.rejected_count, row.eligible) == (2, 1, False)
    assert learning.evidence_count(lessons, 2).first().eligible


def test_exit_classes(spark):
    runs = spark.createDataFrame([(i,) for i in range(5)], "run_id long")
    failures = spark.createDataFrame([(1, "repad", False), (2, "palette-remap-review", False), (4, "repad", True)], "run_id long, correction string, requires_review boolean")
    warnings = spark.createDataFrame([(3, "HUMAN_REVIEW_REQUIRED", False), (0, "NOTICE", False)], "run_id long, code string, requires_review boolean")
    assert rows(learning.exit_class(failures, warnings, runs)) == [(0, 0), (1, 3), (2, 4), (3, 4), (4, 4)]


def test_promotion_needs_everything(spark):
    reports = spark.createDataFrame([(1, True, True, "a" * 64), (2, True, True, "a" * 64), (3, True, False, "a" * 64)], "run_id long, passed boolean, provenance_verified boolean, receipt_sha string")
    warnings = spark.createDataFrame([(2, "HUMAN_REVIEW_REQUIRED", False)], "run_id long, code string, requires_review boolean")
    assert rows(learning.promotion_eligible(reports, warnings), "run_id", "eligible") == [(1, True), (2, False), (3, False)]


def test_union_of_rule_sets_keeps_columns(spark):
    a = spark.createDataFrame([("A", 1)], "code string, frame long")
    b = spark.createDataFrame([("B", "x")], "code string, field string")
    assert rows(validate.all_failures({"one": a, "two": b}), "rule_set", "code", "frame", "field") == [("one", "A", 1, None), ("two", "B", None, "x")]


@pytest.mark.parametrize("change, code", [
    (("verified", False), "OWNER_APPROVAL_REQUIRED"), (("selected_frames", 9), "APPROVAL_MEMBERSHIP"), (("action_id", "dance"), "ACTION_UNKNOWN"),
    (("project_id", 8), "NO_CANONICAL_ANCHOR"), (None, None),
])
def test_production_contract_status(spark, change, code):
    edits = spark.createDataFrame([(1, 0, "f1", True, ["actor"], "h"), (1, 1, "f2", False, ["actor", "prop"], "h")], "clip_id long, idx long, frame_id string, included boolean, tracks array<string>, derivative_sha string")
    approval = {"clip_id": 1, "approval_sha": "s", "verified": True, "decision": "approved", "project_id": 7, "action_id": "walk", "selected_frames": 1}
    if change:
        approval[change[0]] = change[1]
    approvals = spark.createDataFrame([tuple(approval.values())], "clip_id long, approval_sha string, verified boolean, decision string, project_id long, action_id string, selected_frames long")
    projects = spark.createDataFrame([(7, "anchor")], "project_id long, anchor_sha string")
    actions = spark.createDataFrame([("walk", "walks", "loop", ["actor"])], "action_id string, semantic string, loop_mode string, tracks array<string>")
    assert production.contract_status(edits, approvals, projects, actions).first().code == code


def test_ancestry_compares_any_text_and_sends_each_hash_once(spark):
    import hashlib

    sha = lambda n: hashlib.sha256(str(n).encode()).hexdigest()
    recorded = [sha(1), sha(1).upper(), None, "", sha(2), sha(1)[:32]]
    approvals = spark.createDataFrame(
        [(i, 1, 1, None if i == 3 else 1, r, r, sha(1)) for i, r in enumerate(recorded)],
        "approval_id long, edit_id long, source_id long, project_id long, edit_sha string, source_sha string, project_sha string",
    )
    side = lambda name, now: spark.createDataFrame([(1, now)], f"{name} long, sha256 string")
    found = provenance.verify_ancestry(approvals, side("edit_id", sha(1)), side("source_id", None), side("project_id", sha(1)))
    both = "SOURCE_HASH_MISMATCH,EDIT_HASH_MISMATCH"
    want = [(0, "SOURCE_HASH_MISMATCH"), (1, both), (2, "EDIT_HASH_MISMATCH"), (3, f"PROJECT_HASH_MISMATCH,{both}"), (4, both), (5, both)]
    assert rows(found) == want
    # One read of the approvals, not one more for the counts of each parent.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("project_sha") and plan.count("Aggregate") == 0


def test_parents_are_compared_where_they_meet(spark):
    rows_ = spark.createDataFrame([(1, 7, "a"), (2, 7, None), (3, 8, "a"), (4, 9, "a"), (5, None, None)], "n long, edit_id long, sha string")
    parents = spark.createDataFrame([(7, "a"), (8, None)], "edit_id long, kept string")
    found = provenance.parent_differs(rows_, "edit", parents, F.col("sha"), F.col("kept"))
    assert rows(found, "n", "edit_wrong") == [(1, False), (2, True), (3, True), (4, True), (5, False)]
    assert rows(provenance.parent_differs(rows_, "edit", parents, F.col("sha"), F.col("kept"), "inner"), "n") == [(1,), (2,), (3,)]


def test_ancestry_reads_each_table_once_and_sends_no_hash(spark):
    import re

    from framelake.plans.records import j14

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = j14(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("FileScan parquet") == 4
    made = re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*Project \[([^\n]*)\]", plan)
    assert made and not any(re.search(r"sha2\((?:(?! AS ).)*\) AS \w*(?:sha|now|sha256)#", p) for p in made)


def test_pairs_of_documents_are_compared_in_place(spark):
    texts = [
        ('{"a":1,"b":[1,{"c":null}],"e":{}}', '{"b":[1,{"c":2},3],"a":1.0}'), ('{"a.b":1,"a":{"b":2}}', '{"a":{"b":2}}'),
        ("{broken", "{}"), (None, "[]"), ('{"x":true}', '{"x":1}'), ('{"x":"é"}', '{"x":"é"}'),
    ]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, l string, r string")
    flat = lambda c: provenance.flatten_documents(docs, "id", c)
    found = compare.pair_diff(docs, "id", "l", "r")
    columns = ("id", "path", "expected", "actual", "state")
    assert rows(found, *columns) == rows(compare.document_diff(flat("l"), flat("r"), ["id"]), *columns)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
