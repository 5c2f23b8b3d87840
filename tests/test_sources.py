import hashlib
import os
import struct
import zlib

import pytest
from conftest import png_bytes, raster, rows
from pyspark.sql import functions as F

from framelake.sources import containers, frames, lessons, publish, registry


def parse(spark, **files):
    return containers.parse_headers(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file string, content binary"))


def gif(delays, trailer=b"\x3b", packed=0x05):
    body = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + bytes(6)
    body += b"\x21\xfe\x03abc\x00"
    for delay in delays:
        body += b"\x21\xf9\x04" + struct.pack("<BHB", packed, delay, 0) + b"\x00"
        body += b"\x2c" + struct.pack("<HHHHB", 1, 1, 2, 2, 0) + b"\x02\x02\x4c\x01\x00"
    return body + trailer


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def apng(delays, blend=1, count=None, denominator=1000):
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 6, 0, 0, 0))
    out += chunk(b"acTL", struct.pack(">II", count or len(delays), 0))
    sequence = 0
    for i, delay in enumerate(delays):
        out += chunk(b"fcTL", struct.pack(">IIIIIHHBB", sequence, 4, 4, 0, 0, delay, denominator, 0, blend if i else 0))
        sequence += 1
        if i:
            out += chunk(b"fdAT", struct.pack(">I", sequence) + b"x")
            sequence += 1
        else:
            out += chunk(b"IDAT", b"x")
    return out + chunk(b"IEND", b"")


def webp(delays):
    def part(kind, body):
        return kind + struct.pack("<I", len(body)) + body + (b"\0" if len(body) % 2 else b"")

    u24 = lambda v: v.to_bytes(3, "little")
    inner = b"WEBP" + part(b"VP8X", b"\x12\0\0\0" + u24(3) + u24(3)) + part(b"ANIM", bytes(6))
    for i, delay in enumerate(delays):
        inner += part(b"ANMF", u24(0) + u24(0) + u24(3) + u24(3) + u24(delay) + bytes([0 if i else 2]) + part(b"VP8L", b"abcde"))
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def test_animation_headers(spark):
    found = parse(spark, gif=gif([7, 13, 9]), apng=apng([80, 120]), webp=webp([60, 140]))
    assert rows(found, "file", "idx", "duration_ms", "blend") == [
        ("apng", 0, 80, "source"), ("apng", 1, 120, "over"), ("gif", 0, 70, "over"), ("gif", 1, 130, "over"), ("gif", 2, 90, "over"),
        ("webp", 0, 60, "source"), ("webp", 1, 140, "over"),
    ]
    first = found.filter("file='gif'").first()
    assert (first.canvas_width, first.x, first.y, first.width, first.dispose, first.has_alpha) == (4, 1, 1, 2, "none", True)


@pytest.mark.parametrize("content, message", [
    (gif([0]), "DELAY_ZERO"), (gif([5], trailer=b""), "FILE_CUT"), (gif([5]) + b"x", "TRAILING_DATA"),
    (gif([5], packed=0x10), "CONTROL_INVALID"), (b"", "FORMAT_UNKNOWN"), (b"JPEG....", "FORMAT_UNKNOWN"),
    (apng([80, 120], count=3), "FRAME_COUNT"), (apng([1], denominator=3), "DELAY_FRACTION"),
    (apng([80])[:-4] + b"\0\0\0\0", "CHECKSUM_WRONG"), (webp([60])[:-2], "FILE_CUT"), (webp([0]), "DELAY_ZERO"),
])
def test_bad_files_give_one_error_row(spark, content, message):
    assert rows(parse(spark, f=content), "idx", "error") == [(None, message)]


def test_zero_apng_denominator_means_hundredths(spark):
    assert rows(parse(spark, f=apng([7], denominator=0)), "duration_ms") == [(70,)]


def test_stills_and_inventory(spark, tmp_path):
    pixels = raster(5, 4, (1, 2, 3, 0))
    pixels[1, 2] = (200, 100, 50, 255)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png_bytes(pixels))
    (tmp_path / "sub" / "b.png").write_bytes(png_bytes(pixels[:, :, :3].copy()))
    got = {os.path.basename(r.file): r for r in frames.read_frames(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"].rgba) == pixels.tobytes()
    opaque = pixels.copy()
    opaque[:, :, 3] = 255
    assert bytes(got["b.png"].rgba) == opaque.tobytes()
    expected = spark.createDataFrame([(got["a.png"].file, got["a.png"].sha256), (got["b.png"].file, "0" * 64)], "file string, sha256 string")
    (tmp_path / "c.png").write_bytes(b"no image")
    told = {os.path.basename(r.file): (r.code, r.rgba is None) for r in frames.read_frames(spark, str(tmp_path), expected).collect()}
    assert told == {"a.png": (None, False), "b.png": ("HASH_MISMATCH", True)}
    told = {os.path.basename(r.file): (r.code, r.rgba is None) for r in frames.read_frames(spark, str(tmp_path)).collect()}
    assert told == {"a.png": (None, False), "b.png": (None, False), "c.png": ("IMAGE_INVALID", True)}
    listed = {r.path: (r.bytes, r.sha256) for r in frames.inventory(spark, str(tmp_path)).collect()}
    assert set(listed) == {"a.png", "sub/b.png", "c.png"}
    assert listed["c.png"] == (8, hashlib.sha256(b"no image").hexdigest())


def test_header_scan_reads_folders(spark, tmp_path):
    (tmp_path / "x.gif").write_bytes(gif([7]))
    assert rows(containers.scan_animation_headers(spark, str(tmp_path)), "format", "duration_ms") == [("gif", 70)]


def test_framehash_logs(spark, tmp_path):
    lines = ["#format: frame checksums", "#tb 0: 1/1000"] + [f"0, {t}, {t}, {d}, 64, hash" for t, d in [(0, 40), (40, 100), (140, 40), (180, 80)]]
    (tmp_path / "log.txt").write_text("\r\n".join(lines) + "\n")
    parsed = frames.parse_framehash(frames.read_framehash(spark, str(tmp_path)))
    assert rows(parsed, "timestamp_ms", "duration_ms", "code") == [(0, 40, None), (140, 40, None), (180, 80, None), (40, 100, None)]
    bad = spark.createDataFrame([("s", 0, "#tb 0: 1/3"), ("s", 1, "0,0,1,3,1,h"), ("s", 2, "1,0,1,3,1,h"), ("s", 3, "0,0,3,x,1,h"), ("t", 0, "0,0,0,9,1,h")], "source_id string, line_no long, line string")
    assert rows(frames.parse_framehash(bad), "source_id", "code") == [
        ("s", "DURATION_INVALID"), ("s", "RECORD_INVALID"), ("s", "TIMESTAMP_INVALID"), ("t", "TIME_BASE_MISSING")
    ]


def test_sequence_order_comes_from_the_manifest(spark):
    document = '{"schemaVersion":1,"frames":[{"id":"z","path":"z.png","durationMs":80},{"id":"a","path":"a.png","durationMs":120},{"id":"m","path":"m.png"}]}'
    sequence = frames.parse_sequences(spark.createDataFrame([(1, 0, document)], "source_id long, part long, document string"))
    images = spark.createDataFrame([("z.png", "1"), ("m.png", "3")], "path string, sha256 string")
    assert rows(frames.read_frame_sequence(sequence, images), "pos", "frame_id", "code") == [(0, "z", None), (1, "a", "IMAGE_MISSING"), (2, "m", "DURATION_MISSING")]


def test_lesson_rows_are_numbered_across_splits(spark, tmp_path):
    lines = [f'{{"run_id":{i}}}' if i % 50 else ("" if i % 100 else "{broken") for i in range(1, 2001)]
    (tmp_path / "lessons.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = lessons.read_lessons(spark, str(tmp_path), "run_id bigint")
        assert read.rdd.getNumPartitions() > 1
        got = {r.row_no: (r.row.run_id if r.error is None else r.error) for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {i: (i if i % 50 else "MALFORMED_ROW") for i in range(1, 2001) if i % 50 or i % 100 == 0}
    assert got == want


def test_published_bytes_are_immutable(spark, tmp_path):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x")], "path string, sha256 string, payload string")
    assert publish.publish_revision(first, root) == 1
    with pytest.raises(publish.PublishConflict):
        publish.publish_revision(first.withColumn("sha256", F.lit("2")), root)
    twice = first.unionByName(first.withColumn("sha256", F.lit("9")))
    with pytest.raises(publish.PublishConflict):
        publish.publish_revision(twice, str(tmp_path / "other"))
    (tmp_path / "out" / "content" / "attempt-dead").mkdir(parents=True, exist_ok=True)
    more = spark.createDataFrame([("a", "1", "x"), ("c", "3", "y")], first.schema)
    assert publish.publish_revision(more, root) == 2
    assert rows(publish.read_manifest(spark, root).filter("revision=2"), "path", "reused") == [("a", True), ("c", False)]


def test_registries_fail_closed(spark):
    known = registry.Registry("correction operation")
    known.register("repad", lambda df: df.withColumn("done", F.lit("repad")))
    with pytest.raises(ValueError):
        known.register("repad", lambda df: df)
    with pytest.raises(ValueError):
        known.register("Bad Name", lambda df: df)
    frames_ = spark.createDataFrame([(1,), (2,)], "frame_key long")
    plan = spark.createDataFrame([(1, "repad")], "frame_key long, operation string")
    with pytest.raises(KeyError):
        registry.run_corrections(known, plan, frames_, ["repad", "rekey"])
    assert rows(registry.run_corrections(known, plan, frames_, ["repad"]), "frame_key", "done") == [(1, "repad")]


def test_clock_is_a_literal(spark):
    assert str(spark.range(1).select(registry.fixed_clock("2026-07-23 10:00:00")).first()[0]) == "2026-07-23 10:00:00"
