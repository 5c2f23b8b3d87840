"""Rules over contracts, projects, edits, sources, selections and approvals.

A document is one nested row, so its own rules run in place without any shuffle; only references
between tables are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import text as S
from framelake.operators.ordered import Scan, hot_join, ordered_scan
from framelake.operators.rules import all_in, any_of, failing, pluck, repeated, unless

# Enumerations and geometry of the document formats.
LOOP_MODES = ("loop", "once", "hold-last")
TRACK_KINDS = ("actor", "prop", "effect")
CONTACT_KINDS = ("planted-foot", "custom")
MARKER_KINDS = ("root-pivot", "baseline", "planted-foot", "socket", "prop-grip")
SOURCE_KINDS = ("generated-still", "png-sequence", "pose-board", "gif", "apng", "webp", "mp4", "webm")
ENGINE_KINDS = ("generic", "godot")
APPROVAL_STATUSES = ("draft", "anchor-approved")
REQUIRED_GATES = ("canonical-anchor", "annotated-animation", "final-preview")
V1_SIZES = {"canonical": (128, 128), "generation": (1024, 1024), "runtime": (256, 256)}
V1_PIXEL_SIZE = 8
V1_TARGET = (64, 112)
V1_BASELINE = 111
MAX_SIDE = 16_384
MAX_SCALE = 64
MAX_OPAQUE = 16


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _point_is(point: Column, x: int, y: int) -> Column:
    return (point.x == x) & (point.y == y)


def palette_rules(palette: Column, with_hex: bool) -> dict[str, Column]:
    """Leading transparent entry, at most sixteen opaque distinct ones, bound by hash and hex list."""
    rgba = palette.rgba
    opaque = F.slice(rgba, F.lit(2), F.greatest(F.size(rgba), F.lit(1)))
    bad_entry = any_of(rgba, lambda e: (F.size(e) != 4) | any_of(e, lambda v: ~v.between(0, 255)))
    rules = {
        "palette-entries": unless((F.size(rgba) >= 2) & ~bad_entry),
        "palette-distinct": repeated(rgba),
        "palette-alpha": unless((F.get(F.get(rgba, F.lit(0)), F.lit(3)) == 0) & ~any_of(opaque, lambda e: F.get(e, F.lit(3)) != 255)),
        "palette-size": F.size(rgba) - 1 > MAX_OPAQUE,
        "palette-hash": unless(palette.sha256 == F.sha2(F.to_json(rgba), 256)),
    }
    if with_hex:
        byte = lambda e, i: F.lpad(F.lower(F.hex(F.get(e, F.lit(i)).cast("long"))), 2, "0")
        hexes = F.transform(opaque, lambda e: F.concat(byte(e, 0), byte(e, 1), byte(e, 2)))
        rules["palette-hex"] = unless(palette.snapperPaletteHex == hexes)
    return rules


def review_rules(review: Column) -> dict[str, Column]:
    listed = lambda c: (F.size(c) > 0) & ~repeated(c) & ~any_of(c, lambda v: v == "")
    return {
        "review-checkpoints": unless(listed(review.checkpoints)),
        "review-approvers": unless(listed(review.approvers)),
    }


def contract_v1_failures(contracts: DataFrame) -> DataFrame:
    """contracts(contract_id, contract: CONTRACT_V1)."""
    c = F.col("contract")
    frames = F.col("_frames")
    anchors = c.anchor.traitReferenceSha256

    def transition_broken(clip: Column) -> Column:
        t, ids = clip.loopTransition, pluck(clip.frames, "id")
        bound = (
            (t.fromFrameId == F.get(ids, F.size(ids) - 1)) & (t.toFrameId == F.get(ids, F.lit(0)))
            & F.array_contains(c.review.checkpoints, t.reviewCheckpoint)
        )
        return F.when(clip.loopMode == "loop", unless(bound)).otherwise(t.isNotNull())

    rules = {
        "version": unless(c.version == 1),
        "sizes": unless(
            (c.sizes.pixelSize == V1_PIXEL_SIZE)
            & (c.sizes.canonical == F.array(*map(F.lit, V1_SIZES["canonical"])))
            & (c.sizes.generation == F.array(*map(F.lit, V1_SIZES["generation"])))
            & (c.sizes.runtime == F.array(*map(F.lit, V1_SIZES["runtime"])))
        ),
        "pivot": unless(_point_is(c.pivot, *V1_TARGET)),
        "baseline": unless(c.baseline == V1_BASELINE),
        "anchor-hash": unless(c.anchor.sha256.rlike(S.SHA256)),
        "anchor-traits": unless((F.size(anchors) > 0) & ~repeated(anchors) & ~any_of(anchors, lambda h: ~h.rlike(S.SHA256))),
        **review_rules(c.review),
        **palette_rules(c.palette, with_hex=True),
        "clips-empty": unless((F.size(c.clips) > 0) & ~any_of(c.clips, lambda k: F.size(k.frames) == 0)),
        "clip-ids": repeated(pluck(c.clips, "id")) | any_of(c.clips, lambda k: k.id == ""),
        "clip-loop-mode": any_of(c.clips, lambda k: ~k.loopMode.isin(*LOOP_MODES)),
        "frame-ids": repeated(pluck(frames, "id")) | any_of(frames, lambda f: f.id == ""),
        "frame-poses": any_of(c.clips, lambda k: repeated(pluck(k.frames, "pose"))) | any_of(frames, lambda f: f.pose == ""),
        "frame-duration": any_of(frames, lambda f: unless(f.duration.between(11, 65_535))),
        "frame-landmark": any_of(frames, lambda f: unless((f.landmarkSemantic["name"] != "") & _point_is(f.landmarkSemantic.target, *V1_TARGET))),
        "loop-transition": any_of(c.clips, transition_broken),
    }
    return failing(contracts.withColumn("_frames", F.flatten(pluck(c.clips, "frames"))), ["contract_id"], rules)


def _shared_geometry(c: Column) -> dict[str, Column]:
    canvas, scale = c.canvas, c.scale
    return {
        "canvas-size": unless(canvas.width.between(1, MAX_SIDE) & canvas.height.between(1, MAX_SIDE)),
        "canvas-pivot": unless(
            (canvas.pivot.x >= 0) & (canvas.pivot.y >= 0) & (canvas.pivot.x < canvas.width) & (canvas.pivot.y < canvas.height)
        ),
        "canvas-baseline": unless((canvas.baseline >= 0) & (canvas.baseline < canvas.height)),
        "scale-range": unless(scale.integer.between(1, MAX_SCALE)),
        "scale-runtime": unless(
            (scale.runtime.width == canvas.width * scale.integer) & (scale.runtime.height == canvas.height * scale.integer)
        ),
    }


def _with_lists(df: DataFrame, document: str) -> DataFrame:
    """The id lists that many rules read, computed once per document instead of once per element."""
    c = F.col(document)
    return df.withColumns({
        "_tracks": pluck(c.tracks, "id"), "_sockets": pluck(c.sockets, "id"), "_contacts": pluck(c.contacts, "id"),
        "_actors": pluck(F.filter(c.tracks, lambda t: t.kind == "actor"), "id"),
        "_required": pluck(F.filter(c.tracks, lambda t: t.required), "id"),
        "_attached": F.filter(c.tracks, lambda t: t.attachTo.isNotNull()),
    })


def _shared_parts(c: Column, is_id) -> dict[str, Column]:
    tracks, sockets, contacts = c.tracks, c.sockets, c.contacts
    track_ids, socket_ids, actors = F.col("_tracks"), F.col("_sockets"), F.col("_actors")
    bad_id = lambda items: any_of(items, lambda i: unless(is_id(i.id)))
    return {
        "track-ids": unless(F.size(tracks) > 0) | bad_id(tracks) | repeated(track_ids),
        "track-kind": any_of(tracks, lambda t: ~t.kind.isin(*TRACK_KINDS)),
        "track-attachment": any_of(tracks, lambda t: (t.kind == "actor") != t.attachTo.isNull()),
        "one-actor": F.size(actors) != 1,
        "socket-ids": bad_id(sockets) | repeated(socket_ids),
        "socket-track": any_of(sockets, lambda s: ~F.array_contains(track_ids, s.trackId)),
        "socket-actor": any_of(sockets, lambda s: F.array_contains(track_ids, s.trackId) & ~F.array_contains(actors, s.trackId)),
        "track-socket": any_of(tracks, lambda t: t.attachTo.isNotNull() & ~F.array_contains(socket_ids, t.attachTo)),
        "contact-ids": bad_id(contacts) | repeated(pluck(contacts, "id")),
        "contact-kind": any_of(contacts, lambda k: ~k.kind.isin(*CONTACT_KINDS)),
        "contact-track": any_of(contacts, lambda k: ~F.array_contains(track_ids, k.trackId)),
        "contact-actor": any_of(
            contacts,
            lambda k: (k.kind == "planted-foot") & F.array_contains(track_ids, k.trackId) & ~F.array_contains(actors, k.trackId),
        ),
    }


def contract_v2_failures(contracts: DataFrame) -> DataFrame:
    """contracts(contract_id, contract: CONTRACT_V2)."""
    c, frames = F.col("contract"), F.col("_frames")
    track_ids, socket_ids, contact_ids = F.col("_tracks"), F.col("_sockets"), F.col("_contacts")
    actors, required, attached = F.col("_actors"), F.col("_required"), F.col("_attached")

    def omits_socket(frame: Column) -> Column:
        return any_of(attached, lambda t: F.array_contains(frame.tracks, t.id) & ~F.array_contains(frame.sockets, t.attachTo))

    rules = {
        "version": unless(c.version == 2),
        "selection-approval-hash": unless(c.selectionApprovalSha256.rlike(S.SHA256)),
        "character-id": unless(S.is_contract_id(c.character.id)),
        "character-anchor-hash": unless(c.character.anchorSha256.rlike(S.SHA256)),
        **_shared_geometry(c),
        **palette_rules(c.palette, with_hex=True),
        **_shared_parts(c, S.is_contract_id),
        "clips-empty": unless((F.size(c.clips) > 0) & ~any_of(c.clips, lambda k: F.size(k.frames) == 0)),
        "clip-ids": any_of(c.clips, lambda k: unless(S.is_contract_id(k.id))) | repeated(pluck(c.clips, "id")),
        "clip-loop-mode": any_of(c.clips, lambda k: ~k.loopMode.isin(*LOOP_MODES)),
        "frame-ids": any_of(frames, lambda f: unless(S.is_contract_id(f.id))) | repeated(pluck(frames, "id")),
        "frame-semantic": any_of(frames, lambda f: unless(F.trim(f.semantic) != "")),
        "frame-duration": any_of(frames, lambda f: unless(f.duration.between(11, 65_535))),
        "frame-lists": any_of(frames, lambda f: (F.size(f.tracks) == 0) | repeated(f.tracks) | repeated(f.sockets) | repeated(f.contacts)),
        "frame-track": any_of(frames, lambda f: ~all_in(f.tracks, track_ids)),
        "frame-actor": any_of(frames, lambda f: ~F.arrays_overlap(f.tracks, actors)),
        "frame-required-track": any_of(frames, lambda f: ~all_in(required, f.tracks)),
        "frame-socket": any_of(frames, lambda f: ~all_in(f.sockets, socket_ids)),
        "frame-contact": any_of(frames, lambda f: ~all_in(f.contacts, contact_ids)),
        "frame-attachment": any_of(frames, omits_socket),
        "frame-travel": any_of(frames, lambda f: f.groundTravel.x.isNull() | f.groundTravel.y.isNull()),
        **review_rules(c.review),
    }
    prepared = _with_lists(contracts, "contract").withColumn("_frames", F.flatten(pluck(c.clips, "frames")))
    return failing(prepared, ["contract_id"], rules)


def project_failures(projects: DataFrame) -> DataFrame:
    """projects(project_id, project: PROJECT)."""
    p = F.col("project")
    anchors, actions, sources = p.character.anchors, p.actions, p.sources
    track_ids, socket_ids, contact_ids = F.col("_tracks"), F.col("_sockets"), F.col("_contacts")
    actors = F.col("_actors")
    chosen = lambda a: F.concat(F.array(a.sources.preferred), a.sources.fallbacks)

    def omits_socket(action: Column) -> Column:
        return any_of(
            F.col("_attached"), lambda t: F.array_contains(action.tracks, t.id) & ~F.array_contains(action.sockets, t.attachTo)
        )

    rules = {
        "schema-version": unless(p.schemaVersion == 1),
        "project-id": unless(S.is_schema_id(p.id)),
        "character-text": unless((F.trim(p.character["name"]) != "") & (F.trim(p.character.identity) != "")),
        "logical-height": unless(p.character.logicalHeight.between(1, MAX_SIDE) & (p.character.logicalHeight <= p.canvas.height)),
        "anchor-fields": any_of(
            anchors,
            lambda a: unless(S.is_schema_id(a.id) & a.role.isin("canonical", "trait") & S.is_portable_path(a.path) & a.sha256.rlike(S.SHA256)),
        ) | repeated(pluck(anchors, "id")),
        "canonical-anchor": F.size(F.filter(anchors, lambda a: a.role == "canonical")) != 1,
        **_shared_geometry(p),
        **palette_rules(p.palette, with_hex=False),
        **_shared_parts(p, S.is_schema_id),
        "source-kinds": unless(
            all_in(sources.allowedKinds, _strings(SOURCE_KINDS)) & ~repeated(sources.allowedKinds)
            & F.array_contains(sources.allowedKinds, "png-sequence")
        ),
        "default-still-kind": unless(
            (sources.defaultStillKind == "generated-still") & F.array_contains(sources.allowedKinds, sources.defaultStillKind)
        ),
        "action-ids": unless(F.size(actions) > 0) | any_of(actions, lambda a: unless(S.is_schema_id(a.id))) | repeated(pluck(actions, "id")),
        "action-semantic": any_of(actions, lambda a: unless(F.trim(a.semantic) != "")),
        "action-loop-mode": any_of(actions, lambda a: ~a.loopMode.isin(*LOOP_MODES)),
        "action-poses": any_of(actions, lambda a: (F.size(a.poses) == 0) | repeated(a.poses) | any_of(a.poses, lambda v: F.trim(v) == "")),
        "action-track": any_of(actions, lambda a: ~all_in(a.tracks, track_ids)),
        "action-actor": any_of(actions, lambda a: ~F.arrays_overlap(a.tracks, actors)),
        "action-socket": any_of(actions, lambda a: ~all_in(a.sockets, socket_ids)),
        "action-contact": any_of(actions, lambda a: ~all_in(a.contacts, contact_ids)),
        "action-attachment": any_of(actions, omits_socket),
        "action-source": any_of(actions, lambda a: repeated(chosen(a)) | ~all_in(chosen(a), sources.allowedKinds)),
        "engine-target": unless(F.size(p.engineTargets) > 0) | repeated(pluck(p.engineTargets, "id")) | any_of(
            p.engineTargets,
            lambda t: unless(S.is_schema_id(t.id) & t.kind.isin(*ENGINE_KINDS)) | ((t.kind == "generic") != t.version.isNull()),
        ),
        "approval-status": unless(p.approvals.status.isin(*APPROVAL_STATUSES)),
        "approval-identities": unless(F.size(p.approvals.identities) > 0) | repeated(p.approvals.identities)
        | any_of(p.approvals.identities, lambda i: ~S.is_schema_id(i)),
        "approval-gates": unless(p.approvals.requiredGates == _strings(REQUIRED_GATES)),
    }
    return failing(_with_lists(projects, "project"), ["project_id"], rules)


def recovery_contract_failures(contracts: DataFrame) -> DataFrame:
    """contracts(contract_id, contract: RECOVERY)."""
    c = F.col("contract")
    background, groups = c.background, c.groups
    members = F.flatten(pluck(groups, "componentIds"))
    colour = (F.size(background.rgba) == 4) & ~any_of(background.rgba, lambda v: ~v.between(0, 255))
    rules = {
        "schema-version": unless(c.schemaVersion == 1),
        "background-mode": unless(background.mode.isin("color", "border")),
        "background-colour": F.when(background.mode == "color", unless(colour)).otherwise(background.rgba.isNotNull()),
        "background-tolerance": unless(background.tolerance.between(0, 255)),
        "spill-dominance": background.spill.isNotNull() & unless(background.spill.minimumDominance.between(1, 255)),
        "connectivity": unless(c.connectivity == 4),
        "minimum-component-pixels": unless(c.minimumComponentPixels.between(1, 268_435_456)),
        "decoded-bytes": unless(c.maxDecodedRgbaBytes.between(4, 1_073_741_824)),
        "padding": unless(c.padding.between(0, 256)),
        "candidate-range": unless(
            c.expectedCandidates.min.between(1, 4096) & c.expectedCandidates.max.between(1, 4096)
            & (c.expectedCandidates.min <= c.expectedCandidates.max)
        ),
        "group-ids": repeated(pluck(groups, "id")) | any_of(groups, lambda g: unless(S.is_schema_id(g.id))),
        "group-components": any_of(groups, lambda g: F.size(g.componentIds) == 0) | any_of(members, lambda m: ~m.rlike(r"^component-\d{4}$")),
        "group-membership": repeated(members),
    }
    return failing(contracts, ["contract_id"], rules)


def closed_schema_failures(documents: DataFrame, key: str, text: str, allowed: list[str]) -> DataFrame:
    """Unknown and missing top-level keys of JSON documents; text that is no object is reported as such."""
    keys, want = F.json_object_keys(text), _strings(allowed)
    problem = lambda items, kind: F.transform(items, lambda k: F.struct(F.lit(kind).alias("problem"), k.alias("field")))
    found = F.when(
        keys.isNull(), F.array(F.struct(F.lit("not-an-object").alias("problem"), F.lit("").alias("field")))
    ).otherwise(
        F.concat(problem(F.array_except(keys, want), "unknown"), problem(F.array_except(want, keys), "missing"))
    )
    return documents.select(key, F.explode(found).alias("found")).select(key, "found.*")


def dangling_references(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References (kind, ref, clip_id) that resolve to nothing in definitions (kind, ref).

    References are counted per target before the join, so a target used by a third of all rows
    reaches the join as one row.
    """
    used = references.groupBy("kind", "ref").agg(
        F.count(F.lit(1)).alias("uses"), F.min("clip_id").alias("first_clip"), F.max("clip_id").alias("last_clip")
    )
    return used.join(definitions.select("kind", "ref").distinct(), ["kind", "ref"], "left_anti")


def missing_required(members: DataFrame, required: list[str], frames: DataFrame | None = None) -> DataFrame:
    """Required tracks a frame does not list; members(clip_id, frame_id, track_id).

    ``required`` comes from one contract and is at most as long as its track list. ``frames``
    (clip_id, frame_id) names all frames, so that one without any member lacks them all.
    """
    if frames is not None:
        listed = frames.select("clip_id", "frame_id", F.lit(None).cast(members.schema["track_id"].dataType).alias("track_id"))
        members = members.select("clip_id", "frame_id", "track_id").unionByName(listed)
    flags = [F.bool_or(F.col("track_id").eqNullSafe(t)).alias(f"_has_{i}") for i, t in enumerate(required)]
    seen = members.groupBy("clip_id", "frame_id").agg(*flags)
    absent = F.array_compact(F.array(*[F.when(~F.col(f"_has_{i}"), F.lit(t)) for i, t in enumerate(required)]))
    return seen.select("clip_id", "frame_id", F.explode(absent).alias("missing_track"))


def selection_disposition(candidates: DataFrame, selection: DataFrame) -> DataFrame:
    """Do selected candidates use each of their components exactly once, and is anything left over?

    candidates(board, candidate_id, component_id); selection(board, candidate_id, component_id).
    """
    both = candidates.select("board", "candidate_id", "component_id", F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(
        selection.select("board", "candidate_id", "component_id", F.lit(0).alias("c"), F.lit(1).alias("s"))
    )
    member = both.groupBy("board", "candidate_id", "component_id").agg(F.max("c").alias("c"), F.sum("s").alias("s"))
    per_candidate = member.groupBy("board", "candidate_id").agg(
        F.max("c").alias("known"), F.sum("s").alias("picked"),
        F.count_if((F.col("c") == 1) & (F.col("s") == 0)).alias("unused"),
        F.count_if((F.col("c") == 0) & (F.col("s") > 0)).alias("foreign"),
    )
    shares = member.groupBy("board", "component_id").agg(F.sum("s").alias("s"))
    per_board = shares.groupBy("board").agg(
        F.count_if(F.col("s") > 1).alias("shared"), F.count_if(F.col("s") == 0).alias("left_over")
    )
    chosen = F.col("picked") > 0
    summary = per_candidate.groupBy("board").agg(
        F.count_if(chosen & (F.col("known") == 0)).alias("unknown_candidates"),
        F.count_if(chosen & (F.col("known") == 1) & ((F.col("unused") > 0) | (F.col("foreign") > 0))).alias("partial_candidates"),
    )
    return summary.join(per_board, "board").select(
        "board", "unknown_candidates", "partial_candidates", F.col("shared").alias("shared_components"), "left_over",
        ((F.col("unknown_candidates") == 0) & (F.col("partial_candidates") == 0) & (F.col("shared") == 0)).alias("valid"),
        ((F.col("unknown_candidates") == 0) & (F.col("partial_candidates") == 0) & (F.col("shared") == 0) & (F.col("left_over") == 0)).alias("complete"),
    )


def edit_failures(edits: DataFrame, allow_transform: bool = False) -> DataFrame:
    """Frame rules of edit manifests, and one transform per clip, which needs an explicit opt-in.

    edits(clip_id, idx, duration_ms, translation, ground, transform struct<scale,rotationQuarterTurns>,
    markers array<struct<id,kind,x,y>>, contacts array, tracks array, canvas_width, canvas_height,
    action_sockets array, action_contacts array, action_tracks array).
    """
    markers, contacts, tracks = F.col("markers"), F.col("contacts"), F.col("tracks")
    wide = lambda v: ~v.between(-MAX_SIDE, MAX_SIDE)
    fixed_ids = {"root-pivot": "root", "baseline": "baseline", "prop-grip": "prop-grip"}
    misnamed = F.lit(False)
    per_frame = {
        "duration": unless(F.col("duration_ms").between(1, 65_535)),
        "translation": wide(F.col("translation.x")) | wide(F.col("translation.y")),
        "ground-range": wide(F.col("ground.x")) | wide(F.col("ground.y")),
        "transform-range": F.col("transform").isNotNull()
        & unless(F.col("transform.scale").between(1, 8) & F.col("transform.rotationQuarterTurns").between(-3, 3)),
        "transform-opt-in": F.lit(not allow_transform) & F.col("transform").isNotNull(),
        "marker-unique": repeated(F.transform(markers, lambda m: F.struct(m.kind, m.id))),
        "marker-kind": any_of(markers, lambda m: ~m.kind.isin(*MARKER_KINDS)),
        "marker-canvas": any_of(
            markers, lambda m: ~(m.x.between(0, F.col("canvas_width") - 1) & m.y.between(0, F.col("canvas_height") - 1))
        ),
        "marker-name": any_of(
            markers,
            lambda m: _any([(m.kind == kind) & (m.id != name) for kind, name in fixed_ids.items()], misnamed),
        ),
        "marker-socket": any_of(markers, lambda m: (m.kind == "socket") & ~F.array_contains("action_sockets", m.id)),
        "marker-contact": any_of(markers, lambda m: (m.kind == "planted-foot") & ~F.array_contains("action_contacts", m.id)),
        "contact-unique": repeated(contacts),
        "contact-reference": ~all_in(contacts, F.col("action_contacts")),
        "ground-without-contact": ((F.col("ground.x") != 0) | (F.col("ground.y") != 0)) & (F.size(contacts) == 0),
        "track-reference": ~all_in(tracks, F.col("action_tracks")) | repeated(tracks),
        "track-actor": ~F.array_contains(tracks, "actor"),
    }
    rows = failing(edits, ["clip_id", "idx"], per_frame)
    mixed = edits.groupBy("clip_id").agg(
        F.min(F.coalesce(F.to_json("transform"), F.lit("null"))).alias("lo"),
        F.max(F.coalesce(F.to_json("transform"), F.lit("null"))).alias("hi"),
    ).filter("lo<>hi")
    return rows.unionByName(mixed.select("clip_id", F.lit(None).cast("long").alias("idx"), F.lit("transform-mixed").alias("code")))


def _any(conditions: list[Column], start: Column) -> Column:
    for condition in conditions:
        start = start | condition
    return start


def source_failures(frames: DataFrame) -> DataFrame:
    """Closed motion-source frames: dense positions, running starts, canvas, rectangle and duplicate references.

    frames(clip_id, idx, frame_id, path, sha256, width, height, canvas_width, canvas_height,
    timestamp_ms, duration_ms, rect_x, rect_y, rect_w, rect_h, duplicate_of).
    """
    scanned = ordered_scan(
        frames, ["clip_id"], ["idx"],
        [Scan("place", "position"), Scan("expected_ms", "sum_before", F.col("duration_ms"))],
    )
    own = frames.select("clip_id", F.col("frame_id").alias("duplicate_of"), F.col("idx").alias("original_idx"))
    linked = hot_join(scanned, own, ["clip_id", "duplicate_of"], ["idx"], "left", counted=frames)
    rules = {
        "frame-index": F.col("idx") != F.col("place"),
        "frame-id": unless(S.is_schema_id(F.col("frame_id"))),
        "frame-path": unless(S.is_portable_path(F.col("path"))),
        "frame-hash": unless(F.col("sha256").rlike(S.SHA256)),
        "frame-canvas": (F.col("width") != F.col("canvas_width")) | (F.col("height") != F.col("canvas_height")),
        "frame-timestamp": F.col("timestamp_ms") != F.col("expected_ms"),
        "frame-duration": unless(F.col("duration_ms").between(1, 65_535)),
        "frame-rect": unless(
            (F.col("rect_x") >= 0) & (F.col("rect_y") >= 0) & (F.col("rect_w") >= 1) & (F.col("rect_h") >= 1)
            & (F.col("rect_x") + F.col("rect_w") <= F.col("canvas_width"))
            & (F.col("rect_y") + F.col("rect_h") <= F.col("canvas_height"))
        ),
        "duplicate-of": F.col("duplicate_of").isNotNull() & unless(F.col("original_idx") < F.col("idx")),
    }
    return failing(linked, ["clip_id", "idx"], rules)


def decision_failures(decisions: DataFrame, identities: list[str]) -> DataFrame:
    """Owner decisions: known approver, known verdict, bounded notes, and notes on every rejection.

    decisions(decision_id, approver, decision, notes); ``identities`` is the project's approver list.
    """
    rules = {
        "approver-unknown": ~F.col("approver").isin(*identities),
        "decision-value": ~F.col("decision").isin("approved", "rejected"),
        "notes-length": F.length("notes") > 4096,
        "notes-required": (F.col("decision") == "rejected") & (F.trim(F.coalesce("notes", F.lit(""))) == ""),
    }
    return failing(decisions, ["decision_id"], rules)


def frame_approval_failures(approvals: DataFrame) -> DataFrame:
    """Frame approvals against their contract; a revision must have one approver identity throughout.

    approvals(clip_id, idx, frame_id, contract_frame_id, approved, approved_by, approvers array,
    checkpoints array, contract_checkpoints array, x, y).
    """
    scanned = ordered_scan(
        approvals, ["clip_id"], ["idx"],
        [Scan("lo", "lowest", F.col("approved_by")), Scan("hi", "highest", F.col("approved_by"))],
    )
    rules = {
        "frame": unless((F.col("frame_id") == F.col("contract_frame_id")) & F.col("approved")),
        "landmark": unless((F.col("x") >= 0) & (F.col("y") >= 0)),
        "approver": unless(F.array_contains("approvers", F.col("approved_by"))),
        "checkpoints": unless(F.col("checkpoints") == F.col("contract_checkpoints")),
        "identity": F.col("lo") != F.col("hi"),
    }
    return failing(scanned, ["clip_id", "idx"], rules)


def landmark_failures(landmarks: DataFrame) -> DataFrame:
    """Approved landmarks of a frame after the shift of its root onto the pivot.

    landmarks(clip_id, idx, root_x, root_y, baseline, sockets array<struct<id,x,y>>, contacts
    array<struct<id,kind,x,y>>, want_sockets array, want_contacts array, ground, want_ground,
    pivot_x, pivot_y, canvas_width, canvas_height, canvas_baseline).
    """
    dx, dy = F.col("pivot_x") - F.col("root_x"), F.col("pivot_y") - F.col("root_y")
    inside = lambda p: (p.x >= 0) & (p.y >= 0) & (p.x < F.col("canvas_width")) & (p.y < F.col("canvas_height"))
    stays = lambda p: (
        (p.x + dx >= 0) & (p.y + dy >= 0) & (p.x + dx < F.col("canvas_width")) & (p.y + dy < F.col("canvas_height"))
    )
    root = F.struct(F.col("root_x").alias("x"), F.col("root_y").alias("y"))
    rules = {
        "root-inside": unless(inside(root)),
        "sockets-cover": unless(pluck(F.col("sockets"), "id") == F.col("want_sockets")),
        "contacts-cover": unless(pluck(F.col("contacts"), "id") == F.col("want_contacts")),
        "named-inside": any_of(F.col("sockets"), lambda p: ~inside(p)) | any_of(F.col("contacts"), lambda p: ~inside(p)),
        "baseline-drift": F.col("baseline") + dy != F.col("canvas_baseline"),
        "named-leaves-canvas": any_of(F.col("sockets"), lambda p: ~stays(p)) | any_of(F.col("contacts"), lambda p: ~stays(p)),
        "planted-off-baseline": any_of(F.col("contacts"), lambda p: (p.kind == "planted-foot") & (p.y + dy != F.col("canvas_baseline"))),
        "ground-travel": unless(F.col("ground") == F.col("want_ground")),
    }
    return failing(landmarks, ["clip_id", "idx"], rules)


def generation_request_failures(requests: DataFrame, runs: DataFrame, actions: DataFrame) -> DataFrame:
    """Requests for stills must agree with their run, and name an action and pose of the project.

    requests(request_id, run_id, project_sha, action_id, pose_id); runs(run_id, project_sha,
    action_id, kind); actions(action_id, poses array).
    """
    run = runs.select("run_id", F.col("project_sha").alias("run_project"), F.col("action_id").alias("run_action"), "kind")
    joined = hot_join(requests, run, ["run_id"], ["request_id"], "left")
    joined = hot_join(joined, actions.select("action_id", "poses"), ["action_id"], ["request_id"], "left", counted=requests)
    rules = {
        "project-hash": unless(F.col("run_project") == F.col("project_sha")),
        "run-request": unless((F.col("run_action") == F.col("action_id")) & (F.col("kind") == "generated-still")),
        "action-unknown": F.col("poses").isNull(),
        "pose-unknown": F.col("poses").isNotNull() & unless(F.array_contains("poses", F.col("pose_id"))),
    }
    return failing(joined, ["request_id"], rules)
