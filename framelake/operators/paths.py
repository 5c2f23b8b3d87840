"""Path questions over tables: collisions, forbidden roots, private or secret leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import text as S
from framelake.operators.ordered import hot_join


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys listed more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def portability_collisions(df: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Different names of one scope that some platform would store as the same file."""
    keyed = df.select(*scope, name).distinct().withColumn("portability_key", S.portability_key(F.col(name)))
    return duplicate_keys(keyed, [*scope, "portability_key"])


def forbidden_path_hits(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (id, path) inside any forbidden root (root), by equality on their ancestors."""
    above = candidates.withColumn("root", F.explode(S.ancestors(F.col("path"))))
    hits = hot_join(above, roots.select("root").distinct(), ["root"], ["id"], "inner")
    return hits.groupBy("id", "path").agg(F.count(F.lit(1)).alias("roots"), F.min(F.length("root")).alias("shortest"))


def leaf_policies(leaves: DataFrame, run_root: str) -> DataFrame:
    """Private and secret content of (id, path, value) leaves under the three persistence policies."""
    value, root = F.col("value"), F.lit(run_root)
    return leaves.select(
        "id", "path",
        S.hide_absolute(value).alias("exported"),
        S.durable_path(root, value).alias("durable"),
        S.is_absolute(value).alias("private_path"),
        F.col("path").rlike(S.SECRET_KEY).alias("secret_key"),
    )
