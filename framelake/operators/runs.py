"""A ledger of runs: one fact row per run and artifact, rules held as data, and a verdict per run.

Every rule is read in the same pass over the facts, so a validation is one scan however many rules it has. A
failure carries what was measured and what was expected. Verdicts come from sums that add up map-side, so a run
that holds a third of all artifacts is no hot key, and runs without a failure, or without any artifact, are listed too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` in SQL over a fact row, null meaning that it can't be told and so isn't; ``actual`` and ``expected`` are
    shown as text. A ``review`` asks a person and fails nothing."""

    code: str
    stage: str
    broken: str
    actual: str = "null"
    expected: str = "null"
    review: bool = False


def differs(code: str, stage: str, actual: str, expected: str, review: bool = False) -> Rule:
    """Broken where both are known and not equal."""
    return Rule(code, stage, f"{actual} <> {expected}", actual, expected, review)


def missing(code: str, stage: str, column: str) -> Rule:
    """Broken where a part of the run has no row."""
    return Rule(code, stage, f"{column} is null", "'missing'", "'present'")


def judged(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``facts`` with ``found``: the broken rules of each row, in the order of ``rules``."""
    text = lambda sql: F.expr(f"cast({sql} as string)")
    made = [
        F.when(
            F.coalesce(F.expr(r.broken), F.lit(False)),
            F.struct(
                F.lit(r.code).alias("code"), F.lit(r.stage).alias("stage"), text(r.actual).alias("actual"),
                text(r.expected).alias("expected"), F.lit(r.review).alias("review"),
            ),
        )
        for r in rules
    ]
    return facts.withColumn("found", F.array_compact(F.array(*made)))


def failures(graded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, code, stage, actual, expected, review): a row per broken rule."""
    return graded.select(*keys, F.explode("found").alias("f")).select(*keys, "f.*")


def verdicts(graded: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, artifacts, broken_artifacts, failures, reviews, codes, passed, exit_class) of every row of ``runs``.

    ``codes`` are the distinct codes of failures in order; ``exit_class`` is 3 with a failure, 4 with reviews only, else 0.
    """
    hard = F.filter("found", lambda f: ~f["review"])
    reviews = F.size("found") - F.size(hard)
    counts = graded.groupBy(F.col(run).alias("_run")).agg(
        F.count("*").alias("artifacts"), F.count_if(F.size(hard) > 0).alias("broken_artifacts"), F.sum(F.size(hard)).alias("failures"),
        F.sum(reviews).alias("reviews"),
    )
    named = graded.select(F.col(run).alias("_of"), F.explode(F.transform(hard, lambda f: f["code"])).alias("code")).distinct()
    named = named.groupBy("_of").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    per_run = counts.join(named, F.col("_run").eqNullSafe(F.col("_of")), "left").drop("_of")
    every = runs.select(run).distinct().join(per_run, F.col(run).eqNullSafe(F.col("_run")), "left").drop("_run")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    counted = every.select(run, *[number(c) for c in ("artifacts", "broken_artifacts", "failures", "reviews")], F.coalesce("codes", F.lit("")).alias("codes"))
    kind = F.when(F.col("failures") > 0, 3).when(F.col("reviews") > 0, 4).otherwise(0)
    return counted.withColumn("passed", F.col("failures") == 0).withColumn("exit_class", kind)
