"""Connected components of a graph whose edges are a table, and links searched inside its clusters."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import text as T


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is its smallest node.

    Large-star and small-star steps: each pass links neighbours to the smallest one nearby, so that a
    component becomes a star around its smallest node after a number of passes that is logarithmic in
    practice. Minima are aggregated map-side and joined back; each pass is written to the shared folder.
    Edges with a null end, loops and repeated edges are left out. No edges: an empty result.
    """
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = T.stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = _print(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "_a")
        large = both.where("b > a").join(lowest, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "_a")
        small = large.join(lowest, F.col("a") == F.col("_a")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a").alias("a"), F.col("low").alias("b")))).alias("e"))
        now = T.stored(small.select("e.a", "e.b").where("a <> b").distinct(), "components")
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} passes")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a sum that tells two sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def forest(pairs, n: int) -> list[tuple[int, int]]:
    """Those of the pairs of numbers below ``n`` that join two trees, by union-find."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def clustered(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (column node) that are in a cluster of ``candidates`` (a, b), with cluster and members."""
    cluster = connected_components(candidates).select(F.col("node").alias("_node"), F.col("component").alias("cluster"))
    sized = cluster.groupBy(F.col("cluster").alias("_cluster")).agg(F.count("*").alias("members"))
    placed = cluster.join(sized, F.col("cluster") == F.col("_cluster")).drop("_cluster")
    return nodes.join(placed, F.col("node") == F.col("_node")).drop("_node")


def _components_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, node, component) of ``rows`` under ``edges``; a node without an edge is its own component."""
    joined = connected_components(edges).select(F.col("node").alias("_node"), "component")
    state = rows.select("cluster", "node").join(joined, F.col("node") == F.col("_node"), "left")
    return state.select("cluster", "node", F.coalesce("component", "node").alias("component"))


def cluster_links(
    placed: DataFrame, payload: list[str], own: Column, run: Callable[[pa.Table], pa.Table], block: int, pivots: int,
    known: DataFrame | None = None,
) -> DataFrame:
    """Edges (a, b) that leave no link inside a cluster undecided, without forming all pairs of a cluster.

    ``placed`` are the rows of ``clustered``; ``run`` gets rows (node, payload, asks) and gives a spanning
    forest of their links, or, where asks is not null, of those between rows that ask and rows that don't.
    Clusters of up to ``block`` rows go whole, several to a task. Larger ones are cut into blocks; each also
    gets the ``pivots`` rows with the least ``own``, so groups around a common original join through them.
    The rows that are then outside their cluster's main component ask all other blocks. ``known`` are links
    (a, b) that have been verified: clusters that they join are left out, and they replace the pivots.
    """
    if known is not None:
        state = _components_of(placed, known)
        split = state.groupBy("cluster").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high")
        split = T.stored(split.select(F.col("cluster").alias("_open")), "open-clusters")
        placed = placed.join(split, F.col("cluster") == F.col("_open")).drop("_open")
    edge, shape = "a long, b long", ["node", *payload]
    placed = T.stored(
        placed.withColumn("_own", own).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / block))), "clusters"
    )
    none = F.lit(None).cast("boolean").alias("asks")
    small, large = placed.where(F.col("members") <= block), placed.where(F.col("members") > block)
    bins = max(1, math.ceil(small.count() / (2 * block)))
    edges = small.select(*shape, none, F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(run, edge)
    edges = edges if known is None else edges.unionAll(known.select("a", "b"))
    if large.isEmpty():
        return edges
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("members") / block) - 1).cast("long"))).alias("block")
    if known is None:
        best = large.groupBy("cluster", "members", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(pivots)).alias("_deal"))
        best = best.agg(F.min(F.struct("_own", *shape)).alias("p"))
        best = best.select("cluster", *[F.col(f"p.{c}").alias(c) for c in shape], blocks)
        met = large.select("cluster", *shape, "block").unionByName(best).dropDuplicates(["cluster", "block", "node"])
        edges = edges.unionAll(met.select("*", none).groupBy("cluster", "block").applyInArrow(run, edge))
    edges = T.stored(edges, "cluster-edges")
    state = _components_of(large, edges)
    main = state.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy(F.col("cluster").alias("_cluster"))
    main = main.agg(F.max(F.struct("n", "component"))["component"].alias("_main"))
    rest = state.join(main, F.col("cluster") == F.col("_cluster")).where("component <> _main")
    rest = T.stored(rest.select(F.col("cluster").alias("_cluster"), F.col("node").alias("_rest")), "cluster-rest")
    counts = rest.groupBy(F.col("_cluster").alias("_of")).agg(F.ceil(F.count("*") / block).alias("_parts"))
    asking = large.join(rest, F.col("node") == F.col("_rest")).join(counts, F.col("cluster") == F.col("_of"))
    asking = asking.select("cluster", *shape, F.pmod(F.xxhash64("node", F.lit(3)), F.col("_parts")).alias("part"), F.lit(True).alias("asks"), blocks)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_parts") - 1).cast("long"))).alias("part")
    given = large.join(counts, F.col("cluster") == F.col("_of")).select("cluster", *shape, parts, F.lit(False).alias("asks"), "block")
    across = asking.unionByName(given).groupBy("cluster", "part", "block").applyInArrow(run, edge)
    return edges.unionAll(across)
