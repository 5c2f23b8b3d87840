"""Artifact inventories, hash chains and ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.hashing import packed_hash
from framelake.operators.ordered import Scan, ordered_scan


def verify_artifacts(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed; inputs (run_id, path, sha256)."""
    both = manifest.select("run_id", "path", F.col("sha256").alias("expected")).join(
        inventory.select("run_id", "path", F.col("sha256").alias("actual")), ["run_id", "path"], "full_outer"
    )
    state = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("expected").isNull(), "extra")
        .when(F.col("actual") != F.col("expected"), "changed")
    )
    return both.withColumn("state", state).filter(F.col("state").isNotNull())


def compare_runs(left: DataFrame, right: DataFrame, left_envelope: DataFrame, right_envelope: DataFrame) -> DataFrame:
    """Per run: changed deterministic hashes, tolerated envelope differences and the verdict.

    artifacts (run_id, path, sha256); envelopes (run_id, field, value, passed). One aggregation:
    each side contributes its value, and equal values cancel out.
    """
    sides = [
        left.select("run_id", F.lit("artifact").alias("part"), F.col("path").alias("name"), F.col("sha256").alias("l"), F.lit(None).cast("string").alias("r")),
        right.select("run_id", F.lit("artifact"), "path", F.lit(None).cast("string"), "sha256"),
        left_envelope.select("run_id", F.lit("envelope"), "field", "value", F.lit(None).cast("string")),
        right_envelope.select("run_id", F.lit("envelope"), "field", F.lit(None).cast("string"), "value"),
    ]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.union(side)
    named = rows.groupBy("run_id", "part", "name").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    differs = ~F.col("l").eqNullSafe(F.col("r"))
    counted = named.groupBy("run_id").agg(
        F.count_if(differs & (F.col("part") == "artifact")).alias("changed_artifacts"),
        F.count_if(differs & (F.col("part") == "envelope")).alias("envelope_differences"),
    )
    passed = (
        left_envelope.select("run_id", "passed").unionByName(right_envelope.select("run_id", "passed"))
        .groupBy("run_id").agg(F.bool_and("passed").alias("both_passed"), F.count(F.lit(1)).alias("sides"))
    )
    ok = F.coalesce(F.col("both_passed") & (F.col("sides") == 2), F.lit(False)) & (F.col("changed_artifacts") == 0)
    return counted.join(passed, "run_id", "left").select("run_id", "changed_artifacts", "envelope_differences", ok.alias("passed"))


def verify_revision_chain(revisions: DataFrame, root: Column) -> DataFrame:
    """Each revision must follow its predecessor's number and hash; a break invalidates all later ones.

    revisions(run_id, revision, sha256, previous_sha256); ``root`` is the hash the first one must carry.
    """
    linked = ordered_scan(
        revisions, ["run_id"], ["revision"],
        [Scan("before", "prev", F.struct("revision", "sha256"))],
    )
    first = F.col("before").isNull()
    gap = F.when(first, F.col("revision") != 1).otherwise(F.col("revision") != F.col("before.revision") + 1)
    # A missing link is a wrong one, also where both sides lack it.
    must = F.when(first, root).otherwise(F.col("before.sha256"))
    wrong = ~F.coalesce(F.col("previous_sha256") == must, F.lit(False))
    flagged = linked.select("run_id", "revision", gap.alias("gap"), wrong.alias("wrong_link"))
    spread = ordered_scan(
        flagged, ["run_id"], ["revision"], [Scan("broken", "max_upto", F.col("gap") | F.col("wrong_link"))]
    )
    return spread.select("run_id", "revision", "gap", "wrong_link", (~F.col("broken")).alias("valid"))


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """Newest revision per run and the number the next one takes; gaps do not matter."""
    return revisions.groupBy("run_id").agg(
        F.max("revision").alias("latest"),
        F.max_by("sha256", "revision").alias("latest_sha256"),
        (F.max("revision") + 1).alias("next_revision"),
    )


def inventory_hash(artifacts: DataFrame) -> DataFrame:
    """One hash per run over its artifacts, defined alike for runs of every size.

    An artifact belongs to the part named by the first four hex digits of its path's sha256. A part's
    hash is that of the JSON list of its artifacts by path and hash; parts of the same first two digits
    are bound by the hash of their comma-joined hashes in order, and these once more by the run. No list
    holds more than a small share of a long run.
    """
    place = F.sha2("path", 256)
    leaf = artifacts.groupBy("run_id", F.substring(place, 1, 4).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("items"), F.count(F.lit(1)).alias("n")
    )
    leaf = leaf.select("run_id", "part", "n", F.sha2(F.to_json("items"), 256).alias("h"))

    def bind(df: DataFrame, *keys) -> DataFrame:
        listed = df.groupBy("run_id", *keys).agg(F.array_sort(F.collect_list(F.struct("part", "h"))).alias("hs"), F.sum("n").alias("n"))
        return listed.withColumn("h", F.sha2(F.array_join(F.transform("hs", lambda e: e.h), ","), 256)).drop("hs")

    middle = bind(leaf, F.substring("part", 1, 2).alias("_part")).withColumnRenamed("_part", "part")
    return bind(middle).select("run_id", F.col("n").alias("artifacts"), F.col("h").alias("inventory_sha256"))


def verify_ancestry(approvals: DataFrame, edits: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Approvals whose recorded hashes disagree with the chain project -> source -> edit.

    approvals(approval_id, edit_id, source_id, project_id, edit_sha, source_sha, project_sha);
    edits(edit_id, sha256), sources(source_id, sha256), projects(project_id, sha256).

    The hashes travel as 32 bytes, and each only until it has been compared. A parent that many approvals share is split by
    AQE's skew join.
    """
    parts = {"source": sources, "project": projects, "edit": edits}
    ids = [f"{p}_id" for p in parts]
    checked = approvals.select("approval_id", *ids, *[packed_hash(F.col(f"{p}_sha")).alias(f"{p}_sha") for p in parts])
    for part, side in parts.items():
        key, recorded = f"{part}_id", F.col(f"{part}_sha")
        checked = checked.join(side.select(key, packed_hash(F.col("sha256")).alias("_now")), key, "left")
        checked = checked.withColumn(f"{part}_wrong", ~recorded.eqNullSafe(F.col("_now"))).drop(key, f"{part}_sha", "_now")
    return ancestry_codes(checked)


def parent_differs(rows: DataFrame, part: str, parents: DataFrame, recorded: Column, now: Column, how: str = "left") -> DataFrame:
    """``rows`` with ``{part}_wrong``: whether ``recorded`` disagrees with ``now`` of the parent that ``{part}_id`` names.

    ``now`` reads columns of ``parents``, whose key goes by the name of ``parent``. Both are computed where row and parent have
    met, so hashes that follow from other columns are not sent with them. A parent that is missing has no hash.
    """
    met = rows.join(parents.withColumnRenamed(f"{part}_id", "parent"), F.col(f"{part}_id") == F.col("parent"), how)
    found = F.when(F.col("parent").isNotNull(), now)
    return met.withColumn(f"{part}_wrong", ~recorded.eqNullSafe(found)).drop("parent")


def ancestry_codes(checked: DataFrame) -> DataFrame:
    """(approval_id, codes) of the approvals with a wrong project, source or edit."""
    codes = F.array_compact(F.array(*[
        F.when(F.col(f"{p}_wrong"), f"{p.upper()}_HASH_MISMATCH") for p in ("project", "source", "edit")
    ]))
    return checked.filter("project_wrong OR source_wrong OR edit_wrong").select("approval_id", F.array_join(codes, ",").alias("codes"))


def eligible_for_production(selections: DataFrame, approvals: DataFrame) -> DataFrame:
    """Verified selections whose owner approved them."""
    granted = approvals.filter("decision='approved' AND verified").select("frame_key")
    return selections.join(granted, "frame_key", "left_semi")


def json_leaves(text: str | None) -> list[tuple[str, str | None]]:
    """(path, value) per leaf of a JSON text; ``!`` without a value for text that is no JSON."""
    import json

    out: list[tuple[str, str | None]] = []

    def walk(value, path):
        if isinstance(value, dict) and value:
            for k in value:
                walk(value[k], f"{path}.{k}" if path else k)
        elif isinstance(value, list) and value:
            for i, item in enumerate(value):
                walk(item, f"{path}[{i}]")
        else:
            out.append((path, json.dumps(value, ensure_ascii=False, separators=(",", ":"))))

    try:
        walk(json.loads(text), "")
    except (TypeError, ValueError):
        return [("!", None)]
    return out


def flatten_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) per JSON leaf; a small recursive walk per document.

    Text that is no JSON (or null) gives one row with the path ``!`` and no value.
    """
    import pandas as pd

    def leaves(batches):
        for batch in batches:
            rows = [(k, p, v) for k, t in zip(batch[key], batch[text]) for p, v in json_leaves(t)]
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return documents.select(key, text).mapInPandas(leaves, f"{key} {documents.schema[key].dataType.simpleString()}, path string, value string")
