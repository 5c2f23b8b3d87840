"""One negative case per rule: start from a sound document, break one thing, expect one code."""

import copy
import hashlib
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from framelake import schemas
from framelake.operators import contracts as R
from framelake.sources import contracts as read

RGBA = [[0, 0, 0, 0], [20, 30, 60, 255]]
SHA = hashlib.sha256(b"x").hexdigest()
PALETTE_SHA = hashlib.sha256(json.dumps(RGBA, separators=(",", ":")).encode()).hexdigest()


def v2():
    return {
        "version": 2, "selectionApprovalSha256": SHA, "character": {"id": "hero", "anchorSha256": SHA},
        "canvas": {"width": 32, "height": 32, "pivot": {"x": 16, "y": 28}, "baseline": 27},
        "scale": {"integer": 2, "runtime": {"width": 64, "height": 64}},
        "palette": {"rgba": RGBA, "sha256": PALETTE_SHA, "snapperPaletteHex": ["141e3c"]},
        "tracks": [{"id": "actor", "kind": "actor", "required": True, "attachTo": None}, {"id": "lamp", "kind": "prop", "required": False, "attachTo": "hand"}],
        "sockets": [{"id": "hand", "trackId": "actor", "required": True}],
        "contacts": [{"id": "left-foot", "trackId": "actor", "kind": "planted-foot", "required": True}],
        "clips": [{"id": "walk", "loopMode": "loop", "frames": [
            {"id": "f1", "semantic": "step", "duration": 80, "tracks": ["actor", "lamp"], "sockets": ["hand"], "contacts": ["left-foot"], "groundTravel": {"x": 0, "y": 0}},
            {"id": "f2", "semantic": "pass", "duration": 80, "tracks": ["actor"], "sockets": [], "contacts": [], "groundTravel": {"x": 0, "y": 0}}]}],
        "review": {"checkpoints": ["final-preview"], "approvers": ["owner"]},
    }


def put(path, value):
    def change(document):
        target = document
        for key in path[:-1]:
            target = target[key]
        target[path[-1]] = value
    return change


FRAME = ("clips", 0, "frames", 0)
V2_CASES = {
    "version": put(("version",), 3),
    "selection-approval-hash": put(("selectionApprovalSha256",), "no"),
    "character-id": put(("character", "id"), "Hero"),
    "character-anchor-hash": put(("character", "anchorSha256"), "no"),
    "canvas-size": put(("canvas", "width"), 16385),
    "canvas-pivot": put(("canvas", "pivot", "x"), 32),
    "canvas-baseline": put(("canvas", "baseline"), 32),
    "scale-range": put(("scale", "integer"), 65),
    "scale-runtime": put(("scale", "runtime", "width"), 65),
    "palette-distinct": put(("palette", "rgba"), [[0, 0, 0, 0], [1, 1, 1, 255], [1, 1, 1, 255]]),
    "palette-alpha": put(("palette", "rgba"), [[0, 0, 0, 1], [20, 30, 60, 255]]),
    "palette-size": put(("palette", "rgba"), [[0, 0, 0, 0]] + [[i, 0, 0, 255] for i in range(17)]),
    "palette-hash": put(("palette", "sha256"), SHA),
    "palette-hex": put(("palette", "snapperPaletteHex"), ["ffffff"]),
    "track-ids": put(("tracks", 1, "id"), "Lamp"),
    "track-kind": put(("tracks", 1, "kind"), "sound"),
    "track-attachment": put(("tracks", 1, "attachTo"), None),
    "one-actor": put(("tracks", 0, "kind"), "prop"),
    "socket-track": put(("sockets", 0, "trackId"), "nobody"),
    "socket-actor": put(("sockets", 0, "trackId"), "lamp"),
    "track-socket": put(("tracks", 1, "attachTo"), "back"),
    "contact-kind": put(("contacts", 0, "kind"), "hoof"),
    "contact-track": put(("contacts", 0, "trackId"), "nobody"),
    "contact-actor": put(("contacts", 0, "trackId"), "lamp"),
    "clips-empty": put(("clips",), []),
    "clip-loop-mode": put(("clips", 0, "loopMode"), "bounce"),
    "frame-ids": put((*FRAME, "id"), "f2"),
    "frame-semantic": put((*FRAME, "semantic"), " "),
    "frame-duration": put((*FRAME, "duration"), 10),
    "frame-lists": put((*FRAME, "sockets"), ["hand", "hand"]),
    "frame-track": put((*FRAME, "tracks"), ["actor", "cape"]),
    "frame-actor": put((*FRAME, "tracks"), ["lamp"]),
    "frame-required-track": put((*FRAME, "tracks"), ["lamp"]),
    "frame-socket": put((*FRAME, "sockets"), ["hand", "tail"]),
    "frame-contact": put((*FRAME, "contacts"), ["tail"]),
    "frame-attachment": put((*FRAME, "sockets"), []),
    "review-checkpoints": put(("review", "checkpoints"), []),
    "review-approvers": put(("review", "approvers"), ["a", "a"]),
}


def documents(spark, named):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in named.items()], "contract_id string, document string")


def broken(base, cases):
    out = {"sound": base()}
    for code, change in cases.items():
        document = copy.deepcopy(base())
        change(document)
        out[code] = document
    return out


def test_contract_v2_rules(spark):
    found = R.contract_v2_failures(read.parse_contracts(documents(spark, broken(v2, V2_CASES)))).collect()
    codes = {}
    for r in found:
        codes.setdefault(r.contract_id, set()).add(r.code)
    assert "sound" not in codes
    missed = [code for code in V2_CASES if code not in codes.get(code, set())]
    assert missed == []


def v1():
    return {
        "version": 1, "anchor": {"sha256": SHA, "traitReferenceSha256": [SHA]},
        "sizes": {"canonical": [128, 128], "generation": [1024, 1024], "runtime": [256, 256], "pixelSize": 8},
        "pivot": {"x": 64, "y": 112}, "baseline": 111,
        "palette": {"rgba": RGBA, "sha256": PALETTE_SHA, "snapperPaletteHex": ["141e3c"]},
        "clips": [{"id": "idle", "loopMode": "loop", "loopTransition": {"fromFrameId": "f2", "toFrameId": "f1", "reviewCheckpoint": "final-preview"},
                   "frames": [{"id": f"f{i}", "pose": f"p{i}", "duration": 80, "landmarkSemantic": {"name": "root", "target": {"x": 64, "y": 112}}} for i in (1, 2)]}],
        "review": {"checkpoints": ["final-preview"], "approvers": ["owner"]},
    }


V1_CASES = {
    "version": put(("version",), 2),
    "sizes": put(("sizes", "pixelSize"), 4),
    "pivot": put(("pivot", "x"), 63),
    "baseline": put(("baseline",), 112),
    "anchor-hash": put(("anchor", "sha256"), "no"),
    "anchor-traits": put(("anchor", "traitReferenceSha256"), []),
    "clips-empty": put(("clips", 0, "frames"), []),
    "clip-loop-mode": put(("clips", 0, "loopMode"), "bounce"),
    "frame-ids": put((*FRAME, "id"), "f2"),
    "frame-poses": put((*FRAME, "pose"), "p2"),
    "frame-duration": put((*FRAME, "duration"), 65536),
    "frame-landmark": put((*FRAME, "landmarkSemantic", "name"), ""),
    "loop-transition": put(("clips", 0, "loopTransition", "toFrameId"), "f2"),
}


def test_contract_v1_rules(spark):
    contracts = read.parse_contracts(documents(spark, broken(v1, V1_CASES)), schemas.CONTRACT_V1)
    codes = {}
    for r in R.contract_v1_failures(contracts).collect():
        codes.setdefault(r.contract_id, set()).add(r.code)
    assert "sound" not in codes
    assert [c for c in V1_CASES if c not in codes.get(c, set())] == []


def test_once_clips_have_no_transition(spark):
    document = v1()
    document["clips"][0]["loopMode"] = "once"
    contracts = read.parse_contracts(documents(spark, {"once": document}), schemas.CONTRACT_V1)
    assert rows(R.contract_v1_failures(contracts)) == [("once", "loop-transition")]


def project():
    base = v2()
    return {
        "schemaVersion": 1, "id": "courier",
        "character": {"name": "C", "identity": "courier", "logicalHeight": 30, "anchors": [{"id": "front", "role": "canonical", "path": "anchors/front.png", "sha256": SHA}]},
        "canvas": base["canvas"], "scale": base["scale"], "palette": {"rgba": RGBA, "sha256": PALETTE_SHA},
        "tracks": base["tracks"], "sockets": base["sockets"], "contacts": base["contacts"],
        "sources": {"allowedKinds": ["generated-still", "png-sequence"], "defaultStillKind": "generated-still"},
        "actions": [{"id": "walk", "semantic": "walks", "loopMode": "loop", "poses": ["a", "b"], "tracks": ["actor", "lamp"], "sockets": ["hand"], "contacts": ["left-foot"],
                     "sources": {"preferred": "png-sequence", "fallbacks": ["generated-still"]}}],
        "engineTargets": [{"id": "game", "kind": "godot", "version": "4.3"}],
        "approvals": {"status": "draft", "identities": ["owner"], "requiredGates": ["canonical-anchor", "annotated-animation", "final-preview"]},
    }


PROJECT_CASES = {
    "schema-version": put(("schemaVersion",), 2),
    "project-id": put(("id",), "con"),
    "character-text": put(("character", "name"), " "),
    "logical-height": put(("character", "logicalHeight"), 33),
    "anchor-fields": put(("character", "anchors", 0, "path"), "../a.png"),
    "canonical-anchor": put(("character", "anchors", 0, "role"), "trait"),
    "source-kinds": put(("sources", "allowedKinds"), ["generated-still"]),
    "default-still-kind": put(("sources", "defaultStillKind"), "png-sequence"),
    "action-ids": put(("actions", 0, "id"), "Walk"),
    "action-semantic": put(("actions", 0, "semantic"), ""),
    "action-loop-mode": put(("actions", 0, "loopMode"), "bounce"),
    "action-poses": put(("actions", 0, "poses"), ["a", "a"]),
    "action-track": put(("actions", 0, "tracks"), ["actor", "cape"]),
    "action-actor": put(("actions", 0, "tracks"), ["lamp"]),
    "action-socket": put(("actions", 0, "sockets"), ["hand", "tail"]),
    "action-contact": put(("actions", 0, "contacts"), ["tail"]),
    "action-attachment": put(("actions", 0, "sockets"), []),
    "action-source": put(("actions", 0, "sources", "fallbacks"), ["gif"]),
    "engine-target": put(("engineTargets", 0, "version"), None),
    "approval-status": put(("approvals", "status"), "done"),
    "approval-identities": put(("approvals", "identities"), []),
    "approval-gates": put(("approvals", "requiredGates"), ["final-preview"]),
}


def test_project_rules(spark):
    parsed = documents(spark, broken(project, PROJECT_CASES)).select(
        F.col("contract_id").alias("project_id"), F.from_json("document", schemas.PROJECT).alias("project")
    )
    codes = {}
    for r in R.project_failures(parsed).collect():
        codes.setdefault(r.project_id, set()).add(r.code)
    assert "sound" not in codes
    assert [c for c in PROJECT_CASES if c not in codes.get(c, set())] == []


def recovery():
    return {
        "schemaVersion": 1, "background": {"mode": "color", "rgba": [0, 255, 0, 255], "tolerance": 8, "spill": {"minimumDominance": 24}},
        "connectivity": 4, "minimumComponentPixels": 4, "maxDecodedRgbaBytes": 384, "padding": 1,
        "expectedCandidates": {"min": 1, "max": 4}, "allowUnassigned": True, "groups": [{"id": "pair", "componentIds": ["component-0001", "component-0002"]}],
    }


RECOVERY_CASES = {
    "schema-version": put(("schemaVersion",), 2),
    "background-mode": put(("background", "mode"), "sky"),
    "background-colour": put(("background", "rgba"), [0, 255, 0]),
    "background-tolerance": put(("background", "tolerance"), 256),
    "spill-dominance": put(("background", "spill", "minimumDominance"), 0),
    "connectivity": put(("connectivity",), 8),
    "minimum-component-pixels": put(("minimumComponentPixels",), 0),
    "decoded-bytes": put(("maxDecodedRgbaBytes",), 3),
    "padding": put(("padding",), 257),
    "candidate-range": put(("expectedCandidates", "min"), 5),
    "group-ids": put(("groups", 0, "id"), "Pair"),
    "group-components": put(("groups", 0, "componentIds"), []),
    "group-membership": put(("groups", 0, "componentIds"), ["component-0001", "component-0001"]),
}


def test_recovery_contract_rules(spark):
    codes = {}
    for r in R.recovery_contract_failures(read.parse_contracts(documents(spark, broken(recovery, RECOVERY_CASES)), schemas.RECOVERY)).collect():
        codes.setdefault(r.contract_id, set()).add(r.code)
    assert "sound" not in codes
    assert [c for c in RECOVERY_CASES if c not in codes.get(c, set())] == []


def test_normalised_tables(spark):
    contracts = read.parse_contracts(documents(spark, {"c": v2()}))
    assert rows(read.clip_frames(contracts), "idx", "frame_id", "duration_ms") == [(0, "f1", 80), (1, "f2", 80)]
    assert rows(read.frame_members(read.clip_frames(contracts), "tracks"), "idx", "ord", "member") == [(0, 0, "actor"), (0, 1, "lamp"), (1, 0, "actor")]
    assert rows(read.definitions(contracts, "sockets"), "id", "trackId") == [("hand", "actor")]


def test_closed_schema(spark):
    texts = spark.createDataFrame([(1, '{"a":1,"b":2}'), (2, '{"a":1,"z":2}'), (3, "[1]"), (4, "oops")], "id long, text string")
    assert rows(R.closed_schema_failures(texts, "id", "text", ["a", "b"])) == [
        (2, "missing", "b"), (2, "unknown", "z"), (3, "not-an-object", ""), (4, "not-an-object", "")
    ]


def test_selection_disposition(spark):
    schema = "board long, candidate_id string, component_id string"
    candidates = spark.createDataFrame([(1, "a", "c1"), (1, "a", "c2"), (1, "b", "c3"), (2, "a", "c1")], schema)
    whole = spark.createDataFrame([(1, "a", "c1"), (1, "a", "c2"), (2, "a", "c1"), (2, "x", "c1")], schema)
    got = {r.board: r for r in R.selection_disposition(candidates, whole).collect()}
    assert (got[1].valid, got[1].complete, got[1].left_over) == (True, False, 1)
    assert (got[2].unknown_candidates, got[2].shared_components, got[2].valid) == (1, 1, False)


def test_dangling_and_missing(spark):
    used = spark.createDataFrame([("socket", "hand", 1), ("socket", "tail", 4), ("socket", "tail", 2)], "kind string, ref string, clip_id long")
    known = spark.createDataFrame([("socket", "hand")], "kind string, ref string")
    assert rows(R.dangling_references(used, known)) == [("socket", "tail", 2, 2, 4)]
    members = spark.createDataFrame([(1, "f1", "actor"), (1, "f2", "lamp")], "clip_id long, frame_id string, track_id string")
    assert rows(R.missing_required(members, ["actor", "lamp"])) == [(1, "f1", "lamp"), (1, "f2", "actor")]


@pytest.mark.parametrize("notes, codes", [("fine", []), (" ", ["notes-required"]), ("n" * 4097, ["notes-length"])])
def test_rejections_need_notes(spark, notes, codes):
    decision = spark.createDataFrame([(1, "owner", "rejected", notes)], "decision_id long, approver string, decision string, notes string")
    assert [r.code for r in R.decision_failures(decision, ["owner"]).collect()] == codes


def test_a_translucent_entry_beyond_the_seventeenth_is_still_seen(spark):
    entries = [[0, 0, 0, 0]] + [[i, 0, 0, 255] for i in range(18)] + [[99, 0, 0, 7]]
    frame = spark.createDataFrame([(entries,)], "rgba array<array<int>>").select(F.struct("rgba", F.lit("x").alias("sha256")).alias("p"))
    rules = R.palette_rules(F.col("p"), with_hex=False)
    got = frame.select(*[c.alias(k) for k, c in rules.items()]).first()
    assert got["palette-alpha"] and got["palette-size"]


def test_a_frame_without_members_lacks_every_required_track(spark):
    members = spark.createDataFrame([(1, "a", "actor")], "clip_id long, frame_id string, track_id string")
    frames = spark.createDataFrame([(1, "a"), (1, "b")], "clip_id long, frame_id string")
    missing = R.missing_required(members, ["actor", "lamp"], frames)
    assert rows(missing, "frame_id", "missing_track") == [("a", "lamp"), ("b", "actor"), ("b", "lamp")]


def test_heavy_rows_are_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    from framelake import session

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    spark.range(5_000).coalesce(8).write.parquet(str(tmp_path / "t"))
    dealt = session.use_all_cores(spark.read.parquet(str(tmp_path / "t")), "id")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 5_000 and max(sizes) < 200
