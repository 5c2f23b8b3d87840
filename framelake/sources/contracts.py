"""Contract documents: JSON text to nested rows, and nested rows to their child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import schemas


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """(contract_id, contract) from a folder of version-2 JSON documents, one per file."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = text.select(F.col("_metadata.file_path").alias("contract_id"), F.col("value").alias("document"))
    return parse_contracts(named)


def parse_contracts(documents: DataFrame, schema: str = schemas.CONTRACT_V2) -> DataFrame:
    """documents(contract_id, document) -> (contract_id, contract); unreadable text gives a null contract."""
    return documents.select("contract_id", F.from_json("document", schema).alias("contract"))


def clips(contracts: DataFrame) -> DataFrame:
    """(contract_id, clip_pos, clip_id, loop_mode, frames)"""
    return contracts.select(
        "contract_id", F.posexplode_outer("contract.clips").alias("clip_pos", "clip")
    ).select("contract_id", "clip_pos", F.col("clip.id").alias("clip_id"), F.col("clip.loopMode").alias("loop_mode"), "clip.frames")


def clip_frames(contracts: DataFrame) -> DataFrame:
    """(contract_id, clip_id, idx, frame_id, semantic, duration_ms, tracks, sockets, contacts, ground_x, ground_y)"""
    return clips(contracts).select(
        "contract_id", "clip_id", F.posexplode_outer("frames").alias("idx", "frame")
    ).select(
        "contract_id", "clip_id", "idx", F.col("frame.id").alias("frame_id"), "frame.semantic",
        F.col("frame.duration").alias("duration_ms"), "frame.tracks", "frame.sockets", "frame.contacts",
        F.col("frame.groundTravel.x").alias("ground_x"), F.col("frame.groundTravel.y").alias("ground_y"),
    )


def frame_members(frames: DataFrame, listed: str) -> DataFrame:
    """Tracks, sockets or contacts of each frame in order: (contract_id, clip_id, idx, ord, member)."""
    return frames.select("contract_id", "clip_id", "idx", F.posexplode_outer(listed).alias("ord", "member"))


def definitions(contracts: DataFrame, listed: str) -> DataFrame:
    """Declared tracks, sockets or contacts: (contract_id, ord, <fields>)."""
    return contracts.select("contract_id", F.posexplode_outer(f"contract.{listed}").alias("ord", "d")).select(
        "contract_id", "ord", "d.*"
    )
