"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are documents, columns their distinct word n-grams. Two documents link when their
sets' intersection is at least ``least`` percent of their union. Overlap counts are accumulated by
multiplying blocks of rows; size-derived bounds discard what can't link before it is multiplied:

* a document of s n-grams needs an overlap of at least ceil(least * s / 100), so one with fewer
  n-grams that any other document holds is discarded. Document frequencies of all n-grams come from
  ``exchange``; n-grams of a single document take no further part.
* with n-grams ordered by document frequency, rarest first, linked documents share one of the first
  s - ceil(least * s / 100) + 1. Sharing one makes rows candidates, and clusters of candidates
  (connected components of stars around each such n-gram, never all pairs) become the blocks.
* pairs of sizes that differ too much are not counted.

Documents with equal sets form a class, of which one row takes part. A cluster of up to ``BLOCK`` rows
is multiplied whole; several share a task. A larger one is cut into blocks: every block is multiplied
with itself and with the cluster's pivots, a few rows with hardly any n-gram of their own. That joins a
group of near copies through the pivots in time linear in its size. Rows that are not joined to
the cluster's main component then meet the other blocks, so no link between components is missed. Of
the links only a spanning forest of each block leaves a task.

Nulls and edges: a text without words is an empty set and links with nothing; one with fewer words than
the n-gram is one n-gram. Rows with a null id link with nothing and have no component. Rows with the
same id are one document of the graph: what links to one of them is in their component. Repeated rows
are all returned. Extra columns stay out. Keys are 64-bit hashes of n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import exchange as X
from framelake.llm import text as T
from framelake.llm.graph import cluster_links, clustered, connected_components, forest

WIDTH = 5
LEAST = 80
BLOCK = 512
PIVOTS = 8
HEAVY = 24
COLUMNS = 4_096
ROW = "doc_id long, n_shingles long, sig binary, alone int, shared binary, first array<long>"


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    return np.unique(T.windows(T.hashed(T.folded(text)), width))


def needed(size, least: int):
    """The smallest overlap a document of ``size`` n-grams can link with."""
    return (least * size + 99) // 100


def _sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's set, the distinct keys of all and the place of every set's keys among them."""
    sets = [shingles(t, width) for t in texts]
    keys, place = np.unique(np.concatenate(sets), return_inverse=True)
    return sets, keys, place


def incidence(docs: DataFrame, width: int, least: int, parts: tuple[int, int] | None = None) -> DataFrame:
    """``ROW`` for every document; ``shared`` (its n-grams that others hold) is null if it can't link."""
    T.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    chunks, buckets = parts or X.sizes(rows)
    rows = rows.withColumn("chunk", X.chunk_of(chunks, "doc_id", "text"))

    def counted(chunk: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        _, keys, place = _sets(chunk.column("text").to_pylist(), width)
        return keys, [np.bincount(place, minlength=len(keys))]

    def reduce(key, chunk: pa.Table, answer: pa.Table) -> pa.Table:
        sets, keys, place = _sets(chunk.column("text").to_pylist(), width)
        (held,) = X.received(answer, keys, buckets, 1)
        ids, out, at = chunk.column("doc_id").to_pylist(), [], 0
        for doc_id, mine in zip(ids, sets):
            df = held[place[at : at + len(mine)]]
            at += len(mine)
            size, known = len(mine), df >= 2
            shared, first, alone = None, None, int(size - known.sum())
            if size and doc_id is not None and size - alone >= needed(size, least):
                shared = X._zip(mine[known].tobytes())
                order = np.lexsort((mine[known], df[known]))[: size - needed(size, least) + 1 - alone]
                first = mine[known][order].astype(np.int64)
            sig = xxhash.xxh3_128_digest(mine.tobytes()) if size else None
            out.append((doc_id, size, sig, alone, shared, first))
        return pa.table({f.name: pa.array(v, f.type) for f, v in zip(schema, zip(*out))})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ROW))
    told = X.answers(X.requests(rows, buckets, counted), 1).select(F.col("chunk").alias("_chunk"), "bucket", "totals")
    return rows.groupBy("chunk").cogroup(told.groupBy("_chunk")).applyInArrow(reduce, ROW)


def overlaps(sets: list[np.ndarray], sizes: np.ndarray, least: int) -> np.ndarray:
    """Intersection sizes of all rows of a block whose sizes allow a link: incidence times its transpose."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.lexsort((row, flat))
    flat, row = flat[order], row[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    many = np.bincount(column)
    total = np.zeros(n * n, dtype=np.int64)
    light = np.flatnonzero((many[column] > 1) & (many[column] <= HEAVY))
    c, r = column[light], row[light]
    for step in range(1, HEAVY):  # columns of few rows: entries that lie ``step`` apart in a column
        same = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else ()
        if not len(same):
            break
        a, b = r[same], r[same + step]
        fit = 100 * np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b])
        total += np.bincount(a[fit] * n + b[fit], minlength=n * n)
    total = total.reshape(n, n)
    heavy = np.flatnonzero(many > HEAVY)
    number = np.full(len(many), -1)
    number[heavy] = np.arange(len(heavy))
    for start in range(0, len(heavy), COLUMNS):  # columns of many rows: dense blocks of the product
        mine = (number[column] >= start) & (number[column] < start + COLUMNS)
        dense = np.zeros((n, min(COLUMNS, len(heavy) - start)), dtype=np.float32)
        dense[row[mine], number[column[mine]] - start] = 1
        total += np.triu(np.rint(dense @ dense.T).astype(np.int64), 1)
    return total


def links(sets: list[np.ndarray], sizes: np.ndarray, least: int, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block; with ``asks``, of those between marked and other rows."""
    if len(sets) < 2:
        return []
    common = overlaps(sets, sizes, least)
    a, b = np.nonzero((common > 0) & (100 * common >= least * (sizes[:, None] + sizes[None, :] - common)))
    if asks is not None:
        across = asks[a] != asks[b]
        a, b = a[across], b[across]
    return forest(zip(a.tolist(), b.tolist()), len(sets))


def _linker(least: int):
    """A block of rows (node, n_shingles, shared, asks) to its forest's edges (a, b)."""

    def run(block: pa.Table) -> pa.Table:
        nodes, sizes = block.column("node").to_numpy(), block.column("n_shingles").to_numpy()
        sets = [np.frombuffer(X._unzip(s), dtype=np.uint64) for s in block.column("shared").to_pylist()]
        asks = block.column("asks").to_pylist()
        kept = links(sets, sizes, least, None if asks[0] is None else np.array(asks))
        pairs = np.array(kept, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    return run


def components(rows: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of the linked class representatives; ``rows`` are those of ``incidence``."""
    able = rows.where("shared is not null")
    nodes = able.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("alone").alias("alone"), F.first("shared").alias("shared"), F.first("first").alias("first"))
    nodes = T.stored(nodes.drop("sig"), "jaccard-nodes")

    held = nodes.select("node", F.explode("first").alias("key"))
    hubs = held.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).where("hub <> _last")
    stars = held.join(hubs.select(F.col("key").alias("_key"), "hub"), F.col("key") == F.col("_key")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    placed = clustered(nodes.drop("first"), stars.distinct())
    return connected_components(cluster_links(placed, ["n_shingles", "shared"], F.col("alone") / F.col("n_shingles"), _linker(least), block, PIVOTS))


def join(docs: DataFrame, width: int = WIDTH, least: int = LEAST, parts: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document."""
    rows = T.stored(incidence(docs, width, least, parts), "jaccard-rows")
    able = rows.where("shared is not null")
    found = T.stored(components(rows, least), "jaccard-components")
    classes = able.groupBy("sig").agg(F.min("doc_id").alias("_class"))
    classes = classes.join(found, F.col("_class") == F.col("node"), "left").select(F.col("sig").alias("_sig"), F.coalesce("component", "_class").alias("_component"))
    classes = T.stored(classes, "jaccard-classes")  # a table of its own, so that a class of many copies is split in the join
    able = able.select("doc_id", "n_shingles", "sig").join(classes, F.col("sig") == F.col("_sig")).select("doc_id", "n_shingles", F.col("_component").alias("component_id"))
    alone = rows.where("shared is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return able.unionAll(alone)


def representatives(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The documents of which every group of linked ones keeps the one with the smallest id.

    Of rows that repeat the kept id within a linked group all stay; rows with a null id stay.
    """
    gone = join(docs.select("doc_id", "text"), width, least).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
