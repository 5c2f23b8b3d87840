"""Queries over sources, sinks and streams. Files are derived from the tables inside the shared folder."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framelake.plans import fixtures as X
from framelake.plans.catalog import query
from framelake.plans.raster import FRAME_SHA
from framelake.plans.timelines import STAMPED, stamped
from framelake.session import scratch_folder
from framelake.sources import containers, frames, lessons, publish
from framelake.streaming import edits, intake, ledger

GRID = 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    lines = np.zeros((height, 1 + width * 4), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, width * 4)
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return containers.PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def write_boards(spark, sf_dir) -> str:
    """Frames as PNG boards of 64 x 64 cells in the shared folder; one file per 4,096 frame keys."""
    folder = scratch_folder(spark, "boards")

    def save(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        board = np.zeros((GRID * 8, GRID * 8, 4), dtype=np.uint8)
        for frame_key, rgba in zip(batch["frame_key"], batch["rgba"]):
            row, column = divmod(int(frame_key) % (GRID * GRID), GRID)
            board[row * 8 : row * 8 + 8, column * 8 : column * 8 + 8] = np.frombuffer(rgba, dtype=np.uint8).reshape(8, 8, 4)
        address = re.sub("^file:/+", "/", folder)
        system, root = fs.FileSystem.from_uri(address) if "://" in address else (fs.LocalFileSystem(), address)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/board-{key[0]:012d}.png") as out:
            out.write(_png(board))
        return pd.DataFrame({"board": [key[0]]})

    packed = X.packed_frames(spark, sf_dir).withColumn("board", F.floor(F.col("frame_key") / (GRID * GRID)))
    packed.groupBy("board").applyInPandas(save, "board long").write.format("noop").mode("overwrite").save()
    return folder


@query("s1_read_frames", "pixels", FRAME_SHA.replace("frame_key, clip_id, sha256", "frame_key, sha256").replace("GROUP BY frame_key, clip_id", "GROUP BY frame_key"))
def s1(spark, sf_dir):
    """Boards read as stills, cut back into cells; cells of known frames must carry the frames' bytes."""
    boards = frames.read_frames(spark, write_boards(spark, sf_dir)).filter("code IS NULL")
    number = F.regexp_extract("file", r"board-(\d+)\.png", 1).cast("long")
    cells = frames.sheet_cells(boards.withColumn("board", number), 8, 8, keep=("board",))
    found = cells.select(
        (F.col("board") * (GRID * GRID) + F.col("cell")).alias("frame_key"), F.sha2("pixels", 256).alias("sha256")
    )
    return found.join(X.packed_frames(spark, sf_dir).select("frame_key"), "frame_key", "left_semi")


@query("s9_inventory", "", """SELECT DISTINCT 'board-'||lpad(CAST(vec_id//4096 AS VARCHAR),12,'0')||'.png' AS path, true AS hashed FROM embeddings""")
def s9(spark, sf_dir):
    listed = frames.inventory(spark, write_boards(spark, sf_dir))
    return listed.select("path", (F.length("sha256") == 64).alias("hashed"))


@query("s2_read_frame_sequence", "timeline", """SELECT clip_id AS source_id, idx, frame_id AS frame, CASE WHEN event_type='error' THEN NULL ELSE CAST(duration_ms AS INT) END AS duration_ms,
  CASE WHEN event_type='view' AND value>20 THEN 'IMAGE_MISSING' WHEN event_type='error' THEN 'DURATION_MISSING' END AS code FROM timeline""")
def s2(spark, sf_dir):
    line = X.timeline(spark, sf_dir)
    name = F.concat(F.lit("frames/"), F.col("frame_id").cast("string"), F.lit(".png"))
    record = F.struct(
        F.concat(F.lit("f"), F.col("frame_id").cast("string")).alias("id"), name.alias("path"),
        F.when(F.col("event_type") != "error", F.col("duration_ms")).alias("durationMs"),
    )
    # A manifest file lists at most 1,024 frames; longer clips come in several files.
    parts = line.select("clip_id", F.floor(F.col("idx") / 1024).cast("long").alias("part"), F.struct("idx", record.alias("record")).alias("e"))
    parts = parts.groupBy("clip_id", "part").agg(F.array_sort(F.collect_list("e")).alias("listed"))
    body = F.struct(F.lit(1).alias("schemaVersion"), F.transform("listed", lambda e: e.record).alias("frames"))
    manifests = parts.select("clip_id", "part", F.to_json(body).alias("document"))
    sequence = frames.parse_sequences(manifests.select(F.col("clip_id").alias("source_id"), "part", "document"))
    images = X.view(spark, sf_dir, "timeline_raw").filter("NOT (event_type='view' AND value>20)").select(
        name.alias("path"), F.sha2(F.col("frame_id").cast("string"), 256).alias("sha256")
    )
    joined = frames.read_frame_sequence(sequence, images)
    return joined.select(
        "source_id", (F.col("part") * 1024 + F.col("pos")).alias("idx"), F.substr("frame_id", F.lit(2)).cast("long").alias("frame"), "duration_ms", "code"
    )


def le(value, size: int):
    """Little-endian hex of a non-negative integer column."""
    text = F.lpad(F.hex(value.cast("long")), size * 2, "0")
    return F.concat(*[F.substr(text, F.lit(size * 2 - 1 - 2 * i), F.lit(2)) for i in range(size)])


def be(value, size: int):
    return F.lpad(F.hex(value.cast("long")), size * 2, "0")


def png_chunk(kind: str, body):
    typed = F.concat(F.lit(kind.encode().hex()), body)
    size = F.lpad(F.hex((F.length(body) / 2).cast("long")), 8, "0")
    return F.concat(size, typed, F.lpad(F.hex(F.crc32(F.unhex(typed))), 8, "0"))


def animated_files(spark, sf_dir):
    """Timelines as GIF (clip 0, 3, ..), APNG (1, 4, ..) and WebP (2, 5, ..) bytes, at most 1,000 frames per file."""
    line = X.timeline(spark, sf_dir).withColumns({
        "file_no": F.floor(F.col("idx") / 1000).cast("long"), "pos": F.col("idx") % 1000,
        "ms": F.when(F.col("value") > 150, 0).otherwise(F.col("duration_ms")),
    })
    gif = F.concat(
        F.lit("21f90409"), le(F.floor(F.col("ms") / 10), 2), F.lit("0000"),
        F.lit("2c"), le(F.col("marker_x"), 2), F.lit("0000"), F.lit("04000400"), F.lit("00"), F.lit("02024c0100"),
    )
    sequence = F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.col("pos") * 2 - 1)
    apng = F.concat(
        png_chunk("fcTL", F.concat(be(sequence, 4), F.lit("0000000400000004"), be(F.col("marker_x"), 4), F.lit("00000000"),
                                   be(F.col("ms"), 2), be(F.lit(1000), 2), F.lit("0001"))),
        F.when(F.col("pos") == 0, png_chunk("IDAT", F.lit("00"))).otherwise(png_chunk("fdAT", F.concat(be(sequence + 1, 4), F.lit("00")))),
    )
    webp_frame = F.concat(le(F.floor(F.col("marker_x") / 2), 3), F.lit("000000030000030000"), le(F.col("ms"), 3), F.lit("03"), F.lit("5650384c0400000000000000"))
    webp = F.concat(F.lit("414e4d46"), le(F.length(webp_frame) / 2, 4), webp_frame)
    kind = F.col("clip_id") % 3
    parts = line.withColumn("bytes", F.when(kind == 0, gif).when(kind == 1, apng).otherwise(webp))
    body = parts.groupBy("clip_id", "file_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"), F.count(F.lit(1)).alias("n")
    ).withColumn("body", F.array_join(F.transform("parts", lambda p: p.bytes), ""))
    body_kind = F.col("clip_id") % 3
    as_gif = F.concat(F.lit("474946383961"), F.lit("20002000"), F.lit("000000"), F.col("body"), F.lit("3b"))
    as_apng = F.concat(
        F.lit(containers.PNG_SIGNATURE.hex()), png_chunk("IHDR", F.lit("00000020000000200806000000")),
        png_chunk("acTL", F.concat(be(F.col("n"), 4), F.lit("00000000"))), F.col("body"), png_chunk("IEND", F.lit("")),
    )
    inner = F.concat(F.lit("57454250"), F.lit("565038580a000000"), F.lit("120000001f00001f0000"), F.lit("414e494d06000000000000000000"), F.col("body"))
    as_webp = F.concat(F.lit("52494646"), le(F.length(inner) / 2, 4), inner)
    content = F.when(body_kind == 0, as_gif).when(body_kind == 1, as_apng).otherwise(as_webp)
    return body.select(
        F.concat_ws("/", F.col("clip_id").cast("string"), F.col("file_no").cast("string")).alias("file"), F.unhex(content).alias("content")
    )


@query("s3_scan_animation_headers", "timeline", """WITH t AS (SELECT *, clip_id||'/'||(idx//1000) AS file, idx%1000 AS pos, CASE WHEN value>150 THEN 0 ELSE duration_ms END AS ms FROM timeline),
  bad AS (SELECT file FROM t GROUP BY file HAVING bool_or(CASE WHEN clip_id%3=0 THEN ms<10 ELSE ms=0 END))
  SELECT file, CASE clip_id%3 WHEN 0 THEN 'gif' WHEN 1 THEN 'apng' ELSE 'webp' END AS format, CAST(pos AS INT) AS idx, CASE WHEN clip_id%3=2 THEN marker_x//2*2 ELSE marker_x END AS x,
    CAST(CASE WHEN clip_id%3=0 THEN ms//10*10 ELSE ms END AS INT) AS duration_ms, CASE clip_id%3 WHEN 0 THEN 'background' WHEN 1 THEN 'none' ELSE 'background' END AS dispose,
    CASE clip_id%3 WHEN 0 THEN 'over' WHEN 1 THEN 'over' ELSE 'source' END AS blend, true AS has_alpha, CAST(NULL AS VARCHAR) AS error FROM t WHERE file NOT IN (SELECT file FROM bad)
  UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'DELAY_ZERO' FROM bad""")
def s3(spark, sf_dir):
    return containers.parse_headers(animated_files(spark, sf_dir)).select(
        "file", "format", "idx", "x", "duration_ms", "dispose", "blend", "has_alpha", "error"
    )


@query("s4_read_framehash", "timeline", f"""WITH {STAMPED} SELECT clip_id AS source_id, idx+1 AS line_no, CASE WHEN clip_id%2=1 AND value>80 THEN NULL ELSE start_ms END AS timestamp_ms,
   duration_ms, CASE WHEN clip_id%2=1 AND value>80 THEN 'TIMESTAMP_INVALID' END AS code FROM stamped""")
def s4(spark, sf_dir):
    line = stamped(spark, sf_dir)
    fine = F.col("clip_id") % 2 == 1
    pts = F.when(fine, F.col("start_ms") * 90 + F.when(F.col("value") > 80, 7).otherwise(0)).otherwise(F.col("start_ms"))
    span = F.when(fine, F.col("duration_ms") * 90).otherwise(F.col("duration_ms"))
    records = line.select(
        F.col("clip_id").alias("source_id"), (F.col("idx") + 1).alias("line_no"),
        F.format_string("0, %d, %d, %d, 64, %s", pts, pts, span, F.sha2(F.col("k").cast("string"), 256)).alias("line"),
    )
    headers = X.timeline(spark, sf_dir).filter("idx=0").select(
        F.col("clip_id").alias("source_id"), F.lit(0).cast("long").alias("line_no"),
        F.when(fine, F.lit("#tb 0: 1/90000")).otherwise(F.lit("#tb 0: 1/1000")).alias("line"),
    )
    return frames.parse_framehash(headers.unionByName(records))


LESSON_SCHEMA = "run_id bigint, code string, action_index int"


@query("s6_read_lessons", "lessons", """SELECT CASE WHEN value>40 THEN NULL ELSE run_id END AS run_id, CASE WHEN value>40 THEN NULL ELSE failure_code END AS code, CASE WHEN value>40 THEN NULL ELSE action_index END AS action_index,
   CASE WHEN value>40 THEN 'MALFORMED_ROW' END AS error, count(*) AS rows FROM lessons WHERE value>=1 GROUP BY ALL""")
def s6(spark, sf_dir):
    folder = scratch_folder(spark, "lessons")
    rows = X.view(spark, sf_dir, "lessons")
    good = F.to_json(F.struct("run_id", F.col("failure_code").alias("code"), "action_index"))
    text = F.when(F.col("value") < 1, F.lit("")).when(F.col("value") > 40, F.concat(F.lit('{"run_id":'), F.col("run_id").cast("string"))).otherwise(good)
    rows.select(text.alias("value")).write.text(folder)
    read = lessons.read_lessons(spark, folder, LESSON_SCHEMA)
    plain = read.select(*[F.when(F.col("error").isNull(), F.col(f"row.{c}")).alias(c) for c in ("run_id", "code", "action_index")], "error")
    return plain.groupBy("run_id", "code", "action_index", "error").agg(F.count(F.lit(1)).alias("rows"))


@query("s7_publish_revision", "artifacts_left artifacts_right", """WITH extra AS (SELECT * FROM artifacts_right WHERE run_id='extra')
  SELECT 1 AS revision, path, sha256, false AS reused FROM artifacts_left UNION ALL SELECT 2, path, sha256, true FROM artifacts_left
  UNION ALL SELECT 2, path, sha256, sha256 IN (SELECT sha256 FROM artifacts_left) FROM extra""")
def s7(spark, sf_dir):
    """First revision, a refused one that would change bytes, then one that reuses and adds."""
    root = scratch_folder(spark, "publish")
    left, right = (X.view(spark, sf_dir, n).select("path", "sha256", F.col("run_id").alias("payload")) for n in ("artifacts_left", "artifacts_right"))
    publish.publish_revision(left, root)
    try:
        publish.publish_revision(right, root)
    except publish.PublishConflict:
        publish.publish_revision(left.unionByName(right.filter("payload='extra'")), root)
    return publish.read_manifest(spark, root).drop("content")


def _collect_stream(stream, spark, name: str, mode: str = "append"):
    """Run a stream over everything available into a table in the shared folder, and read it back."""
    folder = scratch_folder(spark, name)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


LATENESS_DAYS = 30
#: Fixed value: where clips begin on the stream's time axis; a stream's first watermark is 1970, and what lies there is late.
EPOCH_MS = 1_700_000_000_000


def write_in_time(spark, rows, days: float) -> str:
    """Files of ``rows`` for a stream, one slice of ``days`` of ``ts`` after the other, so none is late by more than a slice.

    A stream takes files by the time they were written; within a slice tasks end in any order.
    """
    staged, folder = scratch_folder(spark, "frames-staged"), scratch_folder(spark, "frames")
    rows.withColumn("slice", F.floor(F.unix_millis("ts") / F.lit(int(days * 86_400_000)))).write.parquet(staged)
    held = spark.read.parquet(staged)
    slices = [r["slice"] for r in held.select("slice").distinct().orderBy("slice").collect()]
    for number in slices or [0]:
        held.filter(F.col("slice") == number).drop("slice").repartitionByRange("ts").write.mode("append").parquet(folder)
    return folder


@query("x1_stream_frames", "timeline", f"""WITH {STAMPED}, p AS (SELECT *, lag(start_ms+duration_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS e FROM stamped)
  SELECT clip_id, idx, frame_id, start_ms, coalesce(e,0) AS expected_ms, 'DISCONTINUOUS' AS code FROM p WHERE start_ms<>coalesce(e,0)""")
def x1(spark, sf_dir):
    rows = stamped(spark, sf_dir).select(
        "clip_id", "idx", "frame_id", "start_ms", "duration_ms", F.timestamp_millis(F.col("start_ms") + EPOCH_MS).alias("ts")
    )
    folder = write_in_time(spark, rows, LATENESS_DAYS / 2)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    return _collect_stream(intake.continuity_failures(stream, f"{LATENESS_DAYS} days"), spark, "continuity")


@query("x1_stream_originals", "timeline", "SELECT clip_id, sha256(CAST(k AS VARCHAR)) AS sha256, min(frame_id) AS original, count(*) AS copies FROM timeline GROUP BY clip_id, k")
def x1_originals(spark, sf_dir):
    folder = scratch_folder(spark, "hashes")
    rows = X.view(spark, sf_dir, "timeline_raw").select(
        "clip_id", F.col("frame_id").alias("idx"), "frame_id", F.sha2(F.col("k").cast("string"), 256).alias("sha256")
    )
    rows.write.parquet(folder)
    sink = scratch_folder(spark, "originals")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(folder)
    save = lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/out/batch={n}")
    query_ = (
        intake.pixel_originals(stream).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    updates = spark.read.parquet(f"{sink}/out")
    latest = updates.groupBy("clip_id", "sha256").agg(F.max_by(F.struct("original", "copies"), "n").alias("s"))
    return latest.select("clip_id", "sha256", "s.*")


@query("x2_append_lessons", "lessons", """SELECT run_id, sha256(CAST(run_id AS VARCHAR)) AS report_sha, sha256(failure_code) AS correction_sha, action_index FROM lessons GROUP BY ALL""")
def x2(spark, sf_dir):
    folder, sink = scratch_folder(spark, "lesson-rows"), scratch_folder(spark, "lesson-log")
    rows = X.view(spark, sf_dir, "lessons").select(
        "run_id", F.sha2(F.col("run_id").cast("string"), 256).alias("report_sha"), F.sha2("failure_code", 256).alias("correction_sha"), "action_index"
    )
    rows.write.parquet(f"{folder}/first")
    rows.write.parquet(f"{folder}/again")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(folder)
    ledger.append_stream(stream, f"{sink}/log", f"{sink}/checkpoint", ledger.LESSON_KEYS).awaitTermination()
    return spark.read.parquet(f"{sink}/log").drop("batch")


@query("x3_accept_edits", "revisions", """WITH RECURSIVE e AS (SELECT run_id, revision, sha256, CASE WHEN size>1100 THEN sha256('stale') END AS stale FROM revisions),
  st AS (SELECT run_id, CAST(0 AS BIGINT) AS seq, sha256('root') AS head, CAST(NULL AS VARCHAR) AS sha256, 0 AS status FROM e WHERE revision=1
    UNION ALL SELECT e.run_id, e.revision, CASE WHEN coalesce(e.stale, s.head)=s.head THEN e.sha256 ELSE s.head END, e.sha256, CASE WHEN coalesce(e.stale, s.head)=s.head THEN 200 ELSE 409 END
      FROM st s JOIN e ON e.run_id=s.run_id AND e.revision=s.seq+1)
  SELECT run_id, seq, sha256, head, status FROM st WHERE seq>0""")
def x3(spark, sf_dir):
    from framelake.operators.ordered import Scan, ordered_scan

    stale = F.when(F.col("size") > 1100, F.sha2(F.lit("stale"), 256))
    kept = F.when(stale.isNull(), F.col("sha256"))
    # Honest editors base their edit on the last one that was accepted; the others on something stale.
    based = ordered_scan(X.view(spark, sf_dir, "revisions_raw"), ["run_id"], ["revision"], [Scan("last_kept", "last_before", kept)])
    root = F.sha2(F.lit("root"), 256)
    rows = based.select(
        "run_id", F.col("revision").alias("seq"), F.coalesce(stale, F.col("last_kept"), root).alias("base_sha"), "sha256", root.alias("root_sha")
    )
    folder = scratch_folder(spark, "edits")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    return _collect_stream(edits.accept_edits(stream), spark, "accepted")
