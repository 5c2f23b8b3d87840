import os
import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("framelake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def raster(width, height, fill=(0, 255, 0, 255)):
    pixels = np.zeros((height, width, 4), dtype=np.uint8)
    pixels[:, :] = fill
    return pixels


def as_frames(spark, rasters, clip_id=1):
    rows = [(i, clip_id, r.shape[1], r.shape[0], bytearray(r.tobytes())) for i, r in enumerate(rasters)]
    return spark.createDataFrame(rows, "frame_key long, clip_id long, width int, height int, rgba binary")


def png_bytes(pixels):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, depth = pixels.shape
    lines = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 6 if depth == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
