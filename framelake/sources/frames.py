"""Stills, frame sequences, frame-hash logs and file inventories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from framelake import schemas
from framelake.operators import buffers as B
from framelake.operators.ordered import hot_join

READ_BYTES = 1 << 20


@F.pandas_udf(BinaryType())
def _to_rgba(data: pd.Series, channels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    def convert(raw, n, w, h):
        if raw is None:
            return None
        n, w, h = int(n), int(w), int(h)
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(h * w, n)
        if n == 1:
            pixels = np.repeat(pixels, 3, axis=1)
        opaque = np.full((h * w, 1), 255, dtype=np.uint8)
        alpha = pixels[:, 3:4] if n == 4 else opaque
        return np.hstack([pixels[:, [2, 1, 0]], alpha]).tobytes()

    return pd.Series([convert(*row) for row in zip(data, channels, width, height)])


def read_frames(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """(file, sha256, width, height, rgba, code) of the stills below a folder, one row per file.

    ``code`` is IMAGE_INVALID for a file that can't be decoded and, with ``expected`` (file, sha256),
    HASH_MISMATCH for one whose bytes differ and FILE_MISSING for one that isn't there; such rows have no
    pixels. The image source stores blue first; buffers come back as red, green, blue, alpha.
    """
    # The two sources spell the same address with different numbers of slashes.
    address = lambda c: F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/")
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = binary.select(address(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"))
    code = F.lit(None).cast("string")
    if expected is not None:
        wanted = expected.select("file", F.col("sha256").alias("_want"))
        listed = listed.join(wanted, "file", "full_outer").where(F.col("sha256").isNull() | F.col("_want").isNotNull())
        code = F.when(F.col("sha256").isNull(), "FILE_MISSING").when(F.col("sha256") != F.col("_want"), "HASH_MISMATCH")
    listed = listed.select("file", "sha256", code.alias("_code"))
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(path)
    decoded = images.select(address(F.col("image.origin")).alias("file"), "image.width", "image.height", "image.nChannels", "image.data")
    both = listed.join(decoded, "file", "left")
    both = both.withColumn("code", F.coalesce("_code", F.when(F.col("data").isNull(), "IMAGE_INVALID")))
    good = lambda c: F.when(F.col("code").isNull(), F.col(c))
    both = both.select("file", "sha256", good("width").alias("width"), good("height").alias("height"), "nChannels", good("data").alias("data"), "code")
    return both.select("file", "sha256", "width", "height", _to_rgba("data", "nChannels", "width", "height").alias("rgba"), "code")


def sheet_cells(sheets: DataFrame, cell_width: int, cell_height: int, keep: tuple[str, ...]) -> DataFrame:
    """(keep.., cell, pixels): the cells of sprite sheets in reading order with their bytes."""
    return B.expand(sheets, keep, "cell int, pixels binary", B.cell_rows(cell_width, cell_height))


def parse_sequences(documents: DataFrame) -> DataFrame:
    """documents(source_id, part, document) -> ordered frames (source_id, part, pos, frame_id, path, duration_ms)."""
    nested = documents.select("source_id", "part", F.from_json("document", schemas.SEQUENCE).alias("d"))
    return nested.select("source_id", "part", F.posexplode_outer("d.frames").alias("pos", "f")).select(
        "source_id", "part", "pos", F.col("f.id").alias("frame_id"), "f.path", F.col("f.durationMs").alias("duration_ms")
    )


def read_frame_sequence(sequences: DataFrame, images: DataFrame) -> DataFrame:
    """Frames in manifest order with their image; ``code`` tells what is wrong with a frame.

    images(path, sha256). File names never decide the order.
    """
    joined = hot_join(sequences, images.select("path", F.col("sha256").alias("image_sha")), ["path"], ["source_id", "pos"], "left")
    code = (
        F.when(F.col("frame_id").isNull(), "FRAMES_MISSING")
        .when(F.col("image_sha").isNull(), "IMAGE_MISSING")
        .when(F.col("duration_ms").isNull() | ~F.col("duration_ms").between(1, 65_535), "DURATION_MISSING")
    )
    return joined.withColumn("code", code)


def read_framehash(spark: SparkSession, path: str) -> DataFrame:
    """Lines of frame-hash logs, (source_id, line_no, line). One log holds at most 10,000 frames."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.select(
        F.col("_metadata.file_path").alias("source_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")
    )


def parse_framehash(lines: DataFrame) -> DataFrame:
    """(source_id, line_no, timestamp_ms, duration_ms, code) using each log's own time base."""
    trimmed = lines.withColumn("line", F.trim("line")).filter(F.col("line") != "")
    base = r"^#tb\s+0:\s*(\d+)/(\d+)$"
    bases = trimmed.filter(F.col("line").rlike(base)).select(
        "source_id", "line_no",
        F.regexp_extract("line", base, 1).cast("long").alias("num"), F.regexp_extract("line", base, 2).cast("long").alias("den"),
    ).groupBy("source_id").agg(F.min_by(F.struct("num", "den"), "line_no").alias("tb"))
    records = trimmed.filter(~F.startswith("line", F.lit("#"))).withColumn(
        "fields", F.transform(F.split("line", ","), lambda f: F.trim(f))
    )
    joined = hot_join(records, bases, ["source_id"], ["line_no"], "left")
    usable = (F.size("fields") >= 6) & (F.get("fields", F.lit(0)) == "0")
    units = lambda at: F.when(usable & F.get("fields", F.lit(at)).rlike(r"^-?\d+$"), F.get("fields", F.lit(at)).try_cast("long"))
    scaled = joined.select(
        "source_id", "line_no", usable.alias("usable"), "tb", units(2).alias("pts"), units(3).alias("span"),
    ).withColumns({"pts": F.col("pts") * F.col("tb.num") * 1000, "span": F.col("span") * F.col("tb.num") * 1000})
    whole = lambda c: F.when(F.col(c) % F.col("tb.den") == 0, F.expr(f"{c} div tb.den"))
    timed = scaled.withColumns({"timestamp_ms": whole("pts"), "duration_ms": whole("span")})
    code = (
        F.when(F.col("tb").isNull() | (F.col("tb.num") < 1) | (F.col("tb.den") < 1), "TIME_BASE_MISSING")
        .when(~F.col("usable"), "RECORD_INVALID")
        .when(F.col("timestamp_ms").isNull() | (F.col("timestamp_ms") < 0), "TIMESTAMP_INVALID")
        .when(F.col("duration_ms").isNull() | ~F.col("duration_ms").between(1, 65_535), "DURATION_INVALID")
    )
    return timed.select("source_id", "line_no", "timestamp_ms", "duration_ms", code.alias("code"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, by path relative to it.

    Files are listed without their content; each is then hashed inside a task from reads of bounded
    length, whatever its size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
    at = F.locate(root + "/", F.col("path"))
    listed = files.select("path", F.substr("path", at + len(root) + 1).alias("relative"), F.col("length").alias("bytes"))

    def digest(batches):
        import hashlib
        import re

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            hashes = []
            for address in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", address))
                value = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(READ_BYTES):
                        value.update(block)
                hashes.append(value.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(hashes, pa.string())], ["path", "bytes", "sha256"])

    spread = listed.repartition(spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(digest, "path string, bytes long, sha256 string")
