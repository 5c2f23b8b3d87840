"""Small helpers the operators share: words, hashes, batch sizes, identifiers, folders."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framelake.session import scratch_folder

#: Rows of one Arrow batch; a batch holds whole texts, so this bounds a task's memory.
BATCH_ROWS = 500
SPACES = b" \t\n\r\x0b\x0c"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words. ``bytes.split()`` parts at exactly the six ASCII spaces."""
    return (text or "").encode("utf-8", "replace").split()


def folded(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; ``bytes.lower()`` leaves every other character alone."""
    return (text or "").encode("utf-8", "replace").lower().split()


def hashed(items: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, items), dtype=np.uint64, count=len(items))


def mixed(a: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (fixed values: the constants of splitmix64)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; all words as one run if there are fewer."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def fold_of(doc_id: str = "doc_id", modulus: int = 10) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def worker_state(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, for caches whose loss costs only time."""
    home = sys.modules.setdefault("framelake_worker_state", types.ModuleType("framelake_worker_state"))
    return home.__dict__.setdefault(name, {})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(docs: DataFrame, keep: list[str], make: Callable[[list[str | None]], list], schema: str) -> DataFrame:
    """The columns ``keep`` and those that ``make`` derives from a list of texts, in the order of ``schema``.

    Runs inside the scan's tasks; nothing is shuffled. A kept column with the name of a made one gives way.
    """
    bounded_batches(docs.sparkSession)
    made = StructType.fromDDL(schema)
    keep = [c for c in keep if c.lower() not in {f.name.lower() for f in made}]
    names = [f"_k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("text").alias("_text"))

    def run(batches):
        for batch in batches:
            got = [pa.array(v, type=t) for v, t in zip(make(batch.column(len(names)).to_pylist()), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *got], [*names, *made.names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in made]
    out = source.mapInArrow(run, StructType([*source.drop("_text").schema, *made]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], *made.names)


def sampled_texts(docs: DataFrame, marks: DataFrame, mark: str, sample: int) -> DataFrame:
    """(text, mark) of at most ``sample`` documents for each value of ``mark``; ``marks`` is (doc_id, mark).

    The choice is made on ids alone: those with the smallest hashes. A bound on the hash, from the number of
    ids with that mark, leaves about three times ``sample`` of them to be ranked, whatever the corpus; the
    chosen ids are broadcast, and texts move only for them. Rows without id or mark are not chosen.
    """
    ids = marks.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull()).select("doc_id", F.col(mark).alias("_mark")).distinct()
    ids = ids.withColumn("_order", F.xxhash64("doc_id"))
    counts = ids.groupBy("_mark").count().collect()
    if not counts:
        return docs.select("text", F.lit(None).cast(marks.schema[mark].dataType).alias(mark)).limit(0)
    reach = [int(-(1 << 63) + ((1 << 64) - 1) * min(1.0, 3 * sample / r["count"])) for r in counts]
    bound = F.create_map(*[x for r, b in zip(counts, reach) for x in (F.lit(r["_mark"]), F.lit(min(b, (1 << 63) - 1)))])
    near = ids.where(F.col("_order") <= F.element_at(bound, F.col("_mark")))
    order = Window.partitionBy("_mark").orderBy("_order", "doc_id")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    few = texts.orderBy("_order", "doc_id", "_mark", F.xxhash64("text")).limit(sample * len(counts))
    return few.select("text", F.col("_mark").alias(mark))


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, sample: int) -> DataFrame:
    """``sampled_texts`` of the documents among ``docs`` that ``labels`` marks 0 or 1."""
    marks = labels.where(F.col(mark).isin(0, 1)).select("doc_id", F.col(mark).cast("int").alias(mark))
    return sampled_texts(docs, docs.select("doc_id").join(marks, "doc_id"), mark, sample)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
