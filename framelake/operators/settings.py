"""Effective settings of runs and the rules they must satisfy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators.ordered import hot_join

# The default profile.
DEFAULTS = {
    "canonical_width": 128,
    "canonical_height": 128,
    "generation_width": 1024,
    "generation_height": 1024,
    "runtime_width": 256,
    "runtime_height": 256,
    "pivot_x": 64,
    "pivot_y": 112,
    "palette_mode": "preserve-anchor",
    "background_mode": "border",
    "background_tolerance": 0,
    "retention_policy": "all",
    "minimum_component_pixels": 1,
    "snapper_executable": "spritefusion-pixel-snapper",
    "generative_attempts": 2,
    "skill_proposal_evidence": 3,
}
RETENTION_POLICIES = ("all", "largest", "reject-multiple")


def effective_settings(runs: DataFrame, profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults, overlaid by the project's profile, overlaid by the run's overrides, field by field.

    runs(run_id, project_id); profiles(project_id, <fields>); overrides(run_id, <fields>). A null
    field means "not set". ``executable_source`` tells which layer chose the executable.
    """
    fields = list(DEFAULTS)
    profile = profiles.select("project_id", *[F.col(f).alias(f"p_{f}") for f in fields if f in profiles.columns])
    override = overrides.select("run_id", *[F.col(f).alias(f"o_{f}") for f in fields if f in overrides.columns])
    layered = hot_join(runs, profile, ["project_id"], ["run_id"], "left").join(override, "run_id", "left")

    def layers(field: str) -> list:
        return [F.col(f"{p}_{field}") for p in ("o", "p") if f"{p}_{field}" in layered.columns]

    chosen = [F.coalesce(*layers(f), F.lit(DEFAULTS[f])).alias(f) for f in fields]
    source = F.lit("default")
    if "p_snapper_executable" in layered.columns:
        source = F.when(F.col("p_snapper_executable").isNotNull(), "profile").otherwise(source)
    if "o_snapper_executable" in layered.columns:
        source = F.when(F.col("o_snapper_executable").isNotNull(), "override").otherwise(source)
    return layered.select("run_id", "project_id", *chosen, source.alias("executable_source"))


def settings_failures(settings: DataFrame) -> DataFrame:
    """Rules over effective settings, one row per broken rule."""
    c = F.col
    rules = {}
    for size in ("canonical", "generation", "runtime"):
        for side in ("width", "height"):
            rules[f"{size}-{side}-positive"] = c(f"{size}_{side}") <= 0
    for size in ("generation", "runtime"):
        for side in ("width", "height"):
            rules[f"{size}-{side}-multiple"] = c(f"{size}_{side}") % c(f"canonical_{side}") != 0
        rules[f"{size}-uniform-scale"] = (
            c(f"{size}_width") * c("canonical_height") != c(f"{size}_height") * c("canonical_width")
        )
    rules["pivot-inside"] = ~(
        c("pivot_x").between(0, c("canonical_width") - 1) & c("pivot_y").between(0, c("canonical_height") - 1)
    )
    rules["palette-mode"] = c("palette_mode") != "preserve-anchor"
    rules["background-mode"] = ~c("background_mode").isin("border", "configured")
    rules["background-tolerance"] = ~c("background_tolerance").between(0, 255)
    rules["retention-policy"] = ~c("retention_policy").isin(*RETENTION_POLICIES)
    rules["minimum-component-pixels"] = c("minimum_component_pixels") < 1
    rules["snapper-executable"] = F.trim(c("snapper_executable")) == ""
    rules["generative-attempts"] = c("generative_attempts") < 0
    rules["skill-proposal-evidence"] = c("skill_proposal_evidence") < 1
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return settings.select("run_id", F.explode(codes).alias("rule"))
