"""Frame headers of animated GIF, APNG and WebP files: one row per frame, or one error row per file.

Two steps. ``chunk_rows`` takes files apart into their chunks: a tag, the first bytes (in hex) and the length
of each, nothing decoded. Everything else is Column expressions over that table: numbers are read from the
chunk heads, rules give each chunk at most one code, and the first code of a file stands for the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Container limits and signatures.
MAX_FRAMES = 10_000
MAX_DURATION = 65_535
PNG_SIGNATURE = bytes.fromhex("89504e470d0a1a0a")

HEAD = 48
ROWS = 4_096
CHUNKS = "file string, format string, n int, tag string, head string, size long, inner string, note string"
Chunk = tuple[str, bytes, int, str, str | None]


def _gif_chunks(data: bytes) -> Iterator[Chunk]:
    """head, control, image (length: bytes of its data), other, bad and end (length: what follows it)."""

    def skip(at: int) -> tuple[int, int]:
        total = 0
        while at < len(data) and data[at]:
            total += data[at]
            at += data[at] + 1
        return at + 1, total

    colours = lambda flags: 6 << (flags & 7) if flags & 0x80 else 0
    yield "head", data[:13], 13, "", None
    at = 13 + colours(data[10]) if len(data) > 10 else len(data)
    while at < len(data):
        marker = data[at]
        if marker == 0x3B:
            yield "end", b"", len(data) - at - 1, "", None
            return
        if marker == 0x21:
            follows, total = skip(at + 2)
            tag = "control" if data[at + 1 : at + 2] == b"\xf9" else "other"
            yield tag, data[at + 2 : at + 8], total, "", "cut" if follows > len(data) else None
            at = follows
        elif marker == 0x2C:
            body = at + 10 + (colours(data[at + 9]) if at + 9 < len(data) else 0)
            follows, total = skip(body + 1)
            yield "image", data[at + 1 : at + 10] + data[body : body + 1], total, "", "cut" if follows > len(data) else None
            at = follows
        else:
            yield "bad", b"", 0, "", None
            return
    yield "", b"", 0, "", "cut"


def _sized_chunks(data: bytes, at: int, png: bool) -> Iterator[Chunk]:
    """PNG and RIFF chunks; ``inner`` lists the tags inside a WebP frame."""
    layout, extra = (">I4s", 12) if png else ("<4sI", 8)
    while at + extra <= len(data):
        first, second = struct.unpack_from(layout, data, at)
        tag, size = (second, first) if png else (first, second)
        body = data[at + 8 : at + 8 + size]
        whole = at + extra + size <= len(data)
        damaged = png and whole and zlib.crc32(tag + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        inside = ",".join(c[0] for c in _sized_chunks(body, 16, False)) if tag == b"ANMF" else ""
        yield tag.decode("latin-1"), body[:HEAD], size, inside, "damaged" if damaged else None if whole else "cut"
        at += extra + size + (0 if png else size & 1)
    if at < len(data):
        yield "", b"", len(data) - at, "", "cut"


def _chunks(data: bytes) -> tuple[str | None, Iterator[Chunk]]:
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", _gif_chunks(data)
    if data.startswith(PNG_SIGNATURE):
        return "apng", _sized_chunks(data, len(PNG_SIGNATURE), True)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        told = int.from_bytes(data[4:8], "little") + 8
        start = ("RIFF", b"", told, "", None if told == len(data) else "cut")
        return "webp", iter([start, *_sized_chunks(data, 12, False)])
    return None, iter([("", b"", len(data), "", None)])


def chunk_rows(files: DataFrame) -> DataFrame:
    """files(file, content) -> ``CHUNKS`` in file order, emitted in batches of bounded length."""
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in batches:
            for file, content in zip(part.column(0).to_pylist(), part.column(1)):
                kind, chunks = _chunks(content.as_py() or b"")
                for n, (tag, head, *rest) in enumerate(chunks):
                    rows.append((file, kind, n, tag, head.hex(), *rest))
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return files.select("file", "content").mapInArrow(split, CHUNKS)


def _number(at: int, size: int, big: bool = False) -> Column:
    """An unsigned number in the chunk's head; null beyond its end."""
    places = range(at, at + size) if big else range(at + size - 1, at - 1, -1)
    digits = F.substr("head", F.lit(2 * at + 1), F.lit(2 * size)) if big or size == 1 else F.concat(*[F.substr("head", F.lit(2 * p + 1), F.lit(2)) for p in places])
    return F.when(F.length("head") >= 2 * (at + size), F.conv(digits, 16, 10).cast("long"))


def _bits(at: int, shift: int, mask: int) -> Column:
    return F.shiftright(_number(at, 1), shift).bitwiseAND(mask)


def _name(code: Column, *names: str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code.cast("int"))


def _frames(chunks: DataFrame) -> DataFrame:
    """Chunks with what the heads say, by format, and running facts of their file."""
    gif, apng, webp = (F.col("format") == k for k in ("gif", "apng", "webp"))
    by_file = Window.partitionBy("file").orderBy("n")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    tag = lambda *names: F.col("tag").isin(*names)
    seen = lambda *names: F.coalesce(F.count_if(tag(*names)).over(before), F.lit(0))
    anywhere = lambda *names: F.count_if(tag(*names)).over(whole)

    control = F.struct(
        (_number(2, 2) * 10).alias("delay"), _bits(1, 2, 7).alias("dispose"), (_bits(1, 0, 1) == 1).alias("clear"), F.lit(True).alias("set")
    )
    used = F.struct(F.lit(0).cast("long").alias("delay"), F.lit(0).cast("long").alias("dispose"), F.lit(False).alias("clear"), F.lit(False).alias("set"))
    marks = F.when(gif & tag("control"), control).when(gif & tag("image"), used)
    rows = chunks.withColumn("last", F.last(marks, ignorenulls=True).over(before))
    held = lambda field, other: F.coalesce(F.col(f"last.{field}"), F.lit(other))
    ratio = F.when(_number(22, 2, True) == 0, 100).otherwise(_number(22, 2, True))
    pick = lambda a, b, c: F.when(gif, a).when(apng, b).otherwise(c)
    size = F.first(F.when(tag("head", "IHDR", "VP8X"), F.struct(
        pick(_number(6, 2), _number(0, 4, True), _number(4, 3) + 1).alias("w"), pick(_number(8, 2), _number(4, 4, True), _number(7, 3) + 1).alias("h"))
    ), ignorenulls=True).over(whole)
    clear = F.count_if((tag("IHDR") & F.substring("head", 19, 2).isin("04", "06")) | tag("tRNS")).over(whole) > 0
    rows = rows.withColumns({
        "is_frame": (gif & tag("image")) | (apng & tag("fcTL")) | (webp & tag("ANMF")),
        "canvas_width": size["w"], "canvas_height": size["h"],
        "x": pick(_number(0, 2), _number(12, 4, True), _number(0, 3) * 2), "y": pick(_number(2, 2), _number(16, 4, True), _number(3, 3) * 2),
        "width": pick(_number(4, 2), _number(4, 4, True), _number(6, 3) + 1), "height": pick(_number(6, 2), _number(8, 4, True), _number(9, 3) + 1),
        "scaled": pick(held("delay", 0), _number(20, 2, True) * 1000, _number(12, 3)), "ratio": pick(F.lit(1), ratio, F.lit(1)),
        "dispose": pick(
            _name(held("dispose", 0), "none", "none", "background", "previous"),
            _name(_number(24, 1), "none", "background", "previous"), _name(_bits(15, 0, 1), "none", "background"),
        ),
        "blend": pick(F.lit("over"), _name(_number(25, 1), "source", "over"), _name(_bits(15, 1, 1), "over", "source")),
        "has_alpha": pick(
            held("clear", False), clear,
            (F.max(F.when(tag("VP8X"), _bits(0, 4, 1))).over(whole) == 1) | F.array_contains(F.split("inner", ","), "ALPH"),
        ),
        "numbered": seen("fcTL", "fdAT"), "begun": seen("fcTL"), "pictured": seen("IDAT"), "filled": seen("IDAT", "fdAT"),
        "declared": seen("acTL", "ANIM"), "headed": seen("IHDR", "VP8X"), "ended": seen("IEND"),
        "end": anywhere("IEND", "end"), "animations": anywhere("acTL", "ANIM"),
        "told": F.max(F.when(tag("acTL"), _number(0, 4, True))).over(whole),
        "flagged": F.max(F.when(tag("VP8X"), _bits(0, 1, 1))).over(whole), "is_last": F.row_number().over(by_file) == F.count("*").over(whole),
    })
    owner = F.when(apng, F.count_if(tag("fcTL")).over(by_file))
    rows = rows.withColumn("owner", owner)
    return rows.withColumns({
        "frames": F.count_if("is_frame").over(whole), "idx": F.count_if("is_frame").over(by_file) - 1,
        "own_data": F.count_if(tag("IDAT", "fdAT") & (F.col("size") > 0)).over(Window.partitionBy("file", "owner")),
    })


def _rules() -> list[tuple[str, str]]:
    """(code, condition) in the order of precedence for one chunk; the conditions are data, one line each."""
    frame_order = "(format='apng' AND declared=0) OR (format='webp' AND declared=0)"
    return [
        ("FORMAT_UNKNOWN", "format IS NULL"),
        ("FILE_CUT", "note='cut'"),
        ("CHECKSUM_WRONG", "note='damaged'"),
        ("BLOCK_UNKNOWN", "tag='bad'"),
        ("TRAILING_DATA", "(tag='end' AND size>0) OR ended>0"),
        ("HEADER_INVALID", "(tag='IHDR' AND (n<>0 OR size<>13)) OR (tag='VP8X' AND (headed>0 OR size<>10 OR conv(substr(head,1,2),16,10) & 193 <> 0))"),
        ("CANVAS_INVALID", "tag IN ('head','IHDR','VP8X') AND coalesce(least(canvas_width,canvas_height),0)<1"),
        ("ANIMATION_INVALID", f"(tag='acTL' AND (headed=0 OR declared>0 OR filled>0 OR size<>8 OR NOT coalesce(told BETWEEN 1 AND {MAX_FRAMES},false))) OR (tag='ANIM' AND (headed=0 OR declared>0 OR size<>6))"),
        ("CONTROL_INVALID", "(tag='control' AND (size<>4 OR substr(head,1,2)<>'04' OR substr(head,11,2)<>'00' OR (shiftright(conv(substr(head,3,2),16,10),2) & 7)>3))"),
        ("CONTROL_INVALID", f"is_frame AND (({frame_order}) OR (tag='fcTL' AND size<>26) OR (tag='ANMF' AND (size<24 OR conv(substr(head,31,2),16,10) & 252 <> 0)) OR dispose IS NULL OR blend IS NULL)"),
        ("SEQUENCE_GAP", "tag IN ('fcTL','fdAT') AND conv(substr(head,1,8),16,10)<>numbered"),
        ("DATA_ORDER", "(tag='IDAT' AND declared>0 AND begun<>1) OR (tag='IDAT' AND declared=0 AND animations>0) OR (tag='fdAT' AND (pictured=0 OR size<5)) OR (tag='tRNS' AND filled>0)"),
        ("DATA_MISSING", "(tag='image' AND (size=0 OR NOT coalesce(conv(substr(head,19,2),16,10) BETWEEN 2 AND 8,false))) OR (tag='ANMF' AND NOT arrays_overlap(split(inner,','),array('VP8 ','VP8L')))"),
        ("RECT_OUTSIDE", "is_frame AND NOT coalesce(width>0 AND height>0 AND x+width<=canvas_width AND y+height<=canvas_height,false)"),
        ("DELAY_FRACTION", f"is_frame AND (scaled % ratio<>0 OR scaled/ratio>{MAX_DURATION} AND format='apng')"),
        ("DELAY_ZERO", "is_frame AND scaled=0"),
        ("DATA_MISSING", "tag='fcTL' AND own_data=0"),
        ("NOT_ANIMATED", "is_last AND (frames=0 OR (format<>'gif' AND animations=0) OR (format='webp' AND coalesce(flagged,0)=0))"),
        ("FRAME_COUNT", f"is_last AND (frames>{MAX_FRAMES} OR (format='apng' AND frames<>told))"),
        ("FILE_CUT", "is_last AND format<>'webp' AND end=0"),
    ]


def parse_headers(files: DataFrame) -> DataFrame:
    """files(file, content) -> one row per frame, or one row per file with the code of its first fault."""
    rows = _frames(chunk_rows(files))
    code = F.coalesce(*[F.when(F.expr(condition), F.lit(name)) for name, condition in _rules()])
    whole = Window.partitionBy("file")
    rows = rows.withColumn("_code", code).withColumn("error", F.min(F.when(F.col("_code").isNotNull(), F.struct("n", "_code"))).over(whole)["_code"])
    good = F.col("error").isNull()
    shown = rows.where((good & F.col("is_frame")) | (~good & (F.col("n") == 0)))
    ints = ("canvas_width", "canvas_height", "idx", "x", "y", "width", "height")
    kept = lambda c, kind: F.when(good, F.col(c)).cast(kind).alias(c)
    return shown.select(
        "file", kept("format", "string"), *[kept(c, "int") for c in ints],
        F.when(good, F.floor(F.col("scaled") / F.col("ratio"))).cast("int").alias("duration_ms"),
        kept("dispose", "string"), kept("blend", "string"), kept("has_alpha", "boolean"), "error",
    )


def scan_animation_headers(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_headers(files.select(F.col("path").alias("file"), "content"))
