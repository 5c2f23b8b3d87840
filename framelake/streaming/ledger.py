"""Idempotent appends: a record is stored once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LESSON_KEYS = ["run_id", "report_sha", "correction_sha", "action_index"]


def append_batch(batch: DataFrame, batch_id: int, sink: str, keys: list[str], schema: str) -> None:
    """Append the rows whose key no earlier batch stored.

    Each batch owns the folder ``batch=N`` and overwrites only that, so a replayed batch leaves the
    same rows behind.
    """
    from pyspark.errors import AnalysisException

    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        stored = spark.read.schema(schema).parquet(sink).filter(F.col("batch") < batch_id).select(*keys)
        fresh = fresh.join(stored, keys, "left_anti")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")


def append_stream(stream: DataFrame, sink: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", batch int"
    return (
        stream.writeStream.foreachBatch(lambda batch, n: append_batch(batch, n, sink, keys, schema))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
