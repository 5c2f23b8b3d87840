"""Documents of any depth: walked level by level as variants, then checked, redacted and compared as rows.

A document becomes one row per node, with the place of the node (``clips[0].frames[2].id``) and its shape, the same
without positions (``clips[].frames[].id``). The shapes of a closed schema are a trie in a set: an object's member
is allowed if its shape is, and what an object of some shape must hold are the allowed shapes right below it. Texts are
written once to the shared folder, where every level reads them; a level is parsed and exploded in one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framelake.functions import text as S
from framelake.session import scratch_folder

DEEPEST = 64
STRINGS = r'"(?:[^"\\]|\\.)*+"'


def _depth(text: Column) -> Column:
    """Levels of brackets outside strings."""
    marks = F.regexp_replace(F.regexp_replace(text, STRINGS, ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        at = state["at"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(state["most"], at).alias("most"))

    return F.when(marks == "", 0).otherwise(F.aggregate(F.split(marks, "(?<=.)(?=.)"), start, step, lambda state: state["most"]))


def walk(documents: DataFrame, keys: list[str], text: str, deepest: int = DEEPEST) -> DataFrame:
    """(keys, place, shape, parent, name, kind, value, node) of every node below the roots, and of the roots with an empty place.

    ``kind`` is object, array, string, boolean, number, null, or malformed for text that is no JSON; ``value`` is
    the text of leaves, ``node`` the node itself. ``parent`` is the shape of what holds the node and ``name`` its key, null in
    arrays. A document deeper than ``deepest`` levels raises a ValueError.
    """
    spark = documents.sparkSession
    folder, seen = scratch_folder(spark, "documents"), Observation()
    depth = F.when(F.try_parse_json(F.col(text)).isNotNull(), _depth(F.col(text)))
    documents.select(*keys, text).observe(seen, F.max(depth).alias("levels")).write.parquet(folder)
    steps = seen.get["levels"] or 0
    if steps > deepest:
        raise ValueError(f"documents are deeper than {deepest} levels")
    level = spark.read.parquet(folder).select(
        *keys, F.lit("").alias("place"), F.lit("").alias("shape"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"),
        F.try_parse_json(F.col(text)).alias("node"),
    )
    levels = [level]
    for _ in range(steps):
        below = level.select(*keys, F.col("place").alias("_place"), F.col("shape").alias("_shape"), F.col("node").alias("_node"))
        below = below.lateralJoin(spark.tvf.variant_explode(F.col("_node").outer()))
        dot = F.when(F.col("_place") == "", F.lit("")).otherwise(F.lit("."))
        in_array = F.col("key").isNull()
        level = below.select(
            *keys,
            F.when(in_array, F.concat("_place", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("_place", dot, "key")).alias("place"),
            F.when(in_array, F.concat("_shape", F.lit("[]"))).otherwise(F.concat("_shape", dot, "key")).alias("shape"),
            F.col("_shape").alias("parent"), F.col("key").alias("name"), F.col("value").alias("node"),
        )
        levels.append(level)
    # What a leaf is costs little to tell; the schema of an object would be put together from all below it.
    type_ = F.schema_of_variant("node")
    kind = (
        F.when(F.col("node").isNull(), "malformed").when(F.col("node").try_cast("map<string,variant>").isNotNull(), "object")
        .when(F.col("node").try_cast("array<variant>").isNotNull(), "array")
        .when(type_ == "STRING", "string").when(type_ == "BOOLEAN", "boolean").when(type_ == "VOID", "null").otherwise("number")
    )
    value = F.when(~kind.isin("object", "array"), F.col("node").cast("string"))
    return reduce(DataFrame.unionAll, levels).select(*keys, "place", "shape", "parent", "name", kind.alias("kind"), value.alias("value"), "node")


def closed_schema(nodes: DataFrame, keys: list[str], shapes: list[str]) -> DataFrame:
    """(keys, place, problem): unknown and missing keys at any depth of ``walk``'s nodes, and text that is no object.

    ``shapes`` are the allowed members, as in ["id", "clips", "clips[].id"]. What lies below an unknown key is not judged.
    Every node is judged by itself, in one pass.
    """
    held: dict[str, list[str]] = {}
    for shape in shapes:
        parent, _, name = shape.rpartition(".")
        held.setdefault(parent, []).append(name)
    dot = F.when(F.col("place") == "", F.lit("")).otherwise(F.lit("."))
    problem = lambda condition, place, code: F.when(condition, F.struct(place.alias("place"), F.lit(code).alias("problem")))
    place, is_object = F.col("place"), F.col("kind") == "object"
    unknown = F.col("name").isNotNull() & F.col("parent").isin(list(held)) & ~F.col("shape").isin(list(shapes))
    found = [problem((place == "") & ~is_object, place, "not-an-object"), problem(unknown, place, "unknown")]
    for parent, names in held.items():
        here = (F.col("shape") == parent) & is_object  # the shape first, as it is cheaper to compare
        for name in dict.fromkeys(names):
            absent = F.try_variant_get("node", f'$["{name}"]' if "[" in name else f"$.{name}", "variant").isNull()
            found.append(problem(here & absent, F.concat("place", dot, F.lit(name)), "missing"))
    judged = (place == "") | unknown | F.col("shape").isin(list(held))
    return nodes.where(judged).select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_p")).select(*keys, "_p.*")


def private_content(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, problem): keys that name a secret, whatever they hold, and strings that are absolute paths."""
    problem = F.when(F.col("name").rlike(S.SECRET_KEY), "secret-key").when((F.col("kind") == "string") & S.is_absolute(F.col("value")), "private-path")
    return nodes.withColumn("problem", problem).where("problem is not null").select(*keys, "place", "problem")


def redacted(nodes: DataFrame, run_root: str) -> DataFrame:
    """``nodes`` with absolute paths in strings made relative to the run, or hidden where they lie elsewhere."""
    inside = S.durable_path(F.lit(run_root), F.col("value"))
    return nodes.withColumn("value", F.when(F.col("kind") == "string", inside).otherwise(F.col("value")))


def leaves(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, value) of what a comparison reads: leaves, and objects and arrays as their kind, so empty ones count."""
    return nodes.select(*keys, F.col("place").alias("path"), F.concat_ws(":", "kind", "value").alias("value"))
