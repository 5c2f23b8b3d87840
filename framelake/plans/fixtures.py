"""Frame, timeline and record views over the supplied tables.

Each view is one SQL text used twice: Spark reads it over the parquet files, the oracle repeats it
as a common table expression. Positions inside a clip are added by ``dense_index`` in Spark and by
``row_number`` in the oracle. Forged or missing records depend on data values only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.ordered import dense_index
from framelake.session import configure, scratch_folder, use_all_cores

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Colour of quantised level q; -1 and 0 are the transparent background level.
COLOUR_PARTS = [
    "CASE WHEN q IN (-1,0) THEN 0 ELSE 128+8*q END AS r",
    "CASE WHEN q IN (-1,0) THEN 0 ELSE 127-8*q END AS g",
    "CASE WHEN q IN (-1,0) THEN 0 ELSE (q*q*4)%256 END AS b",
    "CASE WHEN q IN (-1,0) THEN 0 WHEN q=1 THEN 128 ELSE 255 END AS a",
]
COLOUR = ", ".join(COLOUR_PARTS)


def level_colour(q: int) -> tuple[int, int, int, int]:
    """The colour the views give to level ``q``."""
    if q in (-1, 0):
        return (0, 0, 0, 0)
    return (128 + 8 * q, 127 - 8 * q, (q * q * 4) % 256, 128 if q == 1 else 255)


# Contract palette: transparent first, then the common opaque levels; rarer levels are drift.
PALETTE = [level_colour(q) for q in (0, -4, -3, -2, 2, 3, 4)]


def _sha(engine: str, expr: str) -> str:
    return f"sha2({expr},256)" if engine == "spark" else f"sha256({expr})"


def _digits(engine: str, expr: str) -> str:
    return f"CAST(regexp_extract({expr},'([0-9]+)',1) AS INT)"


def _pixels(engine: str) -> str:
    if engine == "spark":
        raster = """SELECT vec_id AS frame_key, CAST(label AS BIGINT) AS clip_id, CAST(i%8 AS INT) AS x,
            CAST(floor(i/8) AS INT) AS y, CAST(floor(v*16) AS INT) AS q
          FROM (SELECT vec_id, label, posexplode(embedding) AS (i,v) FROM embeddings)"""
    else:
        raster = """SELECT vec_id AS frame_key, CAST(label AS BIGINT) AS clip_id, CAST(i%8 AS INT) AS x,
            CAST(floor(i/8) AS INT) AS y, CAST(floor(embedding[i+1]*16) AS INT) AS q
          FROM embeddings, range(0,64) t(i)"""
    return f"SELECT frame_key, clip_id, x, y, {COLOUR} FROM ({raster})"


def _timeline(engine: str) -> str:
    return f"""SELECT user_id AS clip_id, event_id AS frame_id,
      CAST(20+(event_id*37)%180 AS BIGINT) AS duration_ms, event_type<>'error' AS included,
      CAST(event_id%16 AS INT) AS marker_x, CAST(floor(value) AS INT)%5 AS translation_x,
      {_digits(engine, 'props')} AS k, event_type, value FROM events"""


def _artifacts_left(engine: str) -> str:
    return f"""SELECT concat(source,'/',CAST(doc_id AS STRING)) AS path, source AS run_id, doc_id,
      {_sha(engine, 'text')} AS sha256, n_chars AS size FROM documents"""


def _artifacts_right(engine: str) -> str:
    # Spanish records were never published; German ones were rewritten.
    forged = _sha(engine, "concat(text,'x')")
    return f"""SELECT concat(source,'/',CAST(doc_id AS STRING)) AS path, source AS run_id, doc_id,
      CASE WHEN lang='de' THEN {forged} ELSE {_sha(engine, 'text')} END AS sha256, n_chars AS size
      FROM documents WHERE lang<>'es'
      UNION ALL SELECT concat('extra/',CAST(item_id AS STRING)), 'extra', item_id,
      {_sha(engine, 'text')}, CAST(length(text) AS BIGINT) FROM benchmark"""


def _revisions(engine: str) -> str:
    return f"""SELECT conv_id AS run_id, turn+1 AS revision, {_sha(engine, 'text')} AS sha256,
      length(text) AS size, role FROM conversations"""


def _clip_frames(engine: str) -> str:
    return """SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS ord,
      concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING)) AS frame_id,
      l_returnflag AS track_id, l_suppkey AS socket_id, l_partkey AS part_id, l_linestatus AS status,
      CAST(l_quantity*10 AS BIGINT) AS duration_ms, l_discount AS discount, l_tax AS tax FROM lineitem"""


def _sockets(engine: str) -> str:
    # Suppliers in debt are missing, so that references dangle.
    return "SELECT s_suppkey AS socket_id, s_nationkey AS track_id FROM supplier WHERE s_acctbal>=0"


def _approvals(engine: str) -> str:
    return """SELECT doc_id AS frame_key, CASE WHEN quality=1 THEN 'approved' ELSE 'rejected' END AS decision,
      toxic AS checkpoint_missing FROM labels"""


def _lessons(engine: str) -> str:
    return f"""SELECT user_id AS run_id, event_type AS failure_code, event_id AS row_no,
      {_digits(engine, 'props')}%3 AS action_index, value>5 AS valid, value FROM events"""


# Observed failures: one per event, with the code, stage and frame a validator would report.
def _failures(engine: str) -> str:
    return f"""SELECT user_id AS run_id, event_id AS idx,
      CASE event_type WHEN 'error' THEN 'PALETTE_DRIFT' WHEN 'click' THEN 'PIVOT_DRIFT'
        WHEN 'view' THEN 'FRAME_COUNT' WHEN 'signup' THEN 'CLIPPED_FOREGROUND'
        ELSE 'CANVAS_SIZE' END AS code,
      CASE WHEN value<5 THEN 'metadata' WHEN value<15 THEN 'runtime' WHEN value<30 THEN 'sheet'
        WHEN value<60 THEN 'preview' ELSE 'canonical' END AS stage,
      {_digits(engine, 'props')} AS frame, value>10 AS trusted, value FROM events"""


VIEWS = {
    "pixels": _pixels,
    "timeline_raw": _timeline,
    "artifacts_left": _artifacts_left,
    "artifacts_right": _artifacts_right,
    "revisions_raw": _revisions,
    "clip_frames": _clip_frames,
    "sockets": _sockets,
    "approvals": _approvals,
    "lessons": _lessons,
    "failures": _failures,
}

# Oracle-only wrappers: the same positions and links the Spark loaders add with ordered scans.
DERIVED_SQL = {
    "timeline": ("timeline_raw", "SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_id)-1 AS idx FROM timeline_raw"),
    "frames": (
        "embeddings",
        "SELECT vec_id AS frame_key, CAST(label AS BIGINT) AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS idx FROM embeddings",
    ),
    "indexed_pixels": ("pixels frames", "SELECT p.*, f.idx FROM pixels p JOIN frames f USING (frame_key)"),
    "revisions": (
        "revisions_raw",
        """SELECT run_id, revision, sha256, size, CASE WHEN size>1100 THEN sha256('forged') ELSE
           coalesce(lag(sha256) OVER (PARTITION BY run_id ORDER BY revision), sha256(concat('root-',CAST(run_id AS STRING)))) END AS previous_sha256
           FROM revisions_raw""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row."""
    return use_all_cores(table(spark, sf_dir, name), key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view without positions, straight from the parquet scan."""
    configure(spark)
    sql = VIEWS[name]("spark")
    for base in BASE_TABLES:
        sql = _replace_table(sql, base, f"parquet.`{sf_dir}/{base}.parquet`")
    return spark.sql(sql)


def _replace_table(sql: str, name: str, path: str) -> str:
    for lead in ("FROM ", "JOIN "):
        for tail in (" ", "\n", ")", ""):
            whole = f"{lead}{name}{tail}"
            if tail == "":
                if sql.endswith(whole):
                    sql = sql[: -len(whole)] + lead + path
            else:
                sql = sql.replace(whole, f"{lead}{path}{tail}")
    return sql


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's pixels, from arrays that were spread over the cores before they are exploded."""
    configure(spark)
    source = spread_table(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").alias("frame_key"), F.col("label").cast("long").alias("clip_id"), F.posexplode("embedding").alias("i", "v")
    )
    raster = source.select(
        "frame_key", "clip_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        F.floor(F.col("v") * 16).cast("int").alias("q"),
    )
    return raster.selectExpr("frame_key", "clip_id", "x", "y", *COLOUR_PARTS)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session into the shared folder.

    Positions and links belong to frame tables at rest. Writing them once keeps every query that
    needs them one scan deep, instead of repeating the numbering below each of its own scans.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = scratch_folder(spark, name)
        build().write.parquet(folder)
        _STORED[key] = folder
    return spark.read.parquet(_STORED[key])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_key, clip_id, idx): one row per frame, positions per clip."""
    return stored(spark, sf_dir, "frames", lambda: _frames(spark, sf_dir))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("frame_key"), F.col("label").cast("long").alias("clip_id")
    )
    return dense_index(base, ["clip_id"], "frame_key")


def _level_hex(value):
    """rrggbbaa text of one raster value."""
    q = F.floor(value * 16).cast("int")
    flat = q.isin(-1, 0)
    channels = [
        F.when(flat, 0).otherwise(128 + 8 * q),
        F.when(flat, 0).otherwise(127 - 8 * q),
        F.when(flat, 0).otherwise((q * q * 4) % 256),
        F.when(flat, 0).when(q == 1, 128).otherwise(255),
    ]
    return F.concat(*[F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0") for c in channels])


def packed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_key, clip_id, width, height, rgba): one row per frame with its byte buffer."""
    configure(spark)
    return spread_table(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").alias("frame_key"),
        F.col("label").cast("long").alias("clip_id"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.unhex(F.array_join(F.transform("embedding", _level_hex), "")).alias("rgba"),
    )


def runtime_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames exported at scale 2; the right half of levels 5 and -5 was blended by a bad scaler."""
    configure(spark)

    def cell(i):
        source = (F.floor(i / 32) * 8 + F.floor((i % 16) / 2)).cast("int")
        colour = F.get(F.col("hexes"), source)
        blended = F.substring(colour, 5, 2) == "64"
        return F.when(blended & (i % 2 == 1), F.lit("7f7f64ff")).otherwise(colour)

    return (
        spread_table(spark, sf_dir, "embeddings", "vec_id")
        .withColumn("hexes", F.transform("embedding", _level_hex))
        .select(
            F.col("vec_id").alias("frame_key"),
            F.col("label").cast("long").alias("clip_id"),
            F.lit(16).alias("width"),
            F.lit(16).alias("height"),
            F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), cell), "")).alias("rgba"),
        )
    )


# The runtime frames as pixel rows, for the oracle.
RUNTIME_SQL = """SELECT frame_key, clip_id, x*2+dx AS x, y*2+dy AS y,
  CASE WHEN b=100 AND dx=1 THEN 127 ELSE r END AS r, CASE WHEN b=100 AND dx=1 THEN 127 ELSE g END AS g,
  b, CASE WHEN b=100 AND dx=1 THEN 255 ELSE a END AS a
  FROM pixels, (VALUES (0),(1)) u(dx), (VALUES (0),(1)) w(dy)"""
DERIVED_SQL["runtime_pixels"] = ("pixels", RUNTIME_SQL)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every clip with their positions."""
    return stored(
        spark, sf_dir, "timeline", lambda: dense_index(view(spark, sf_dir, "timeline_raw"), ["clip_id"], "frame_id")
    )


def later_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later revision: sign-up frames were cut, the rest holds a little longer."""

    def build() -> DataFrame:
        kept = view(spark, sf_dir, "timeline_raw").filter("event_type<>'signup'")
        longer = kept.select("clip_id", "frame_id", (F.col("duration_ms") + F.col("k")).alias("duration_ms"), "included")
        return dense_index(longer, ["clip_id"], "frame_id")

    return stored(spark, sf_dir, "later-timeline", build)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revision chains; long turns carry a forged link."""
    return stored(spark, sf_dir, "revisions", lambda: _revisions_linked(spark, sf_dir))


def _revisions_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.operators.ordered import Scan, ordered_scan

    base = ordered_scan(
        view(spark, sf_dir, "revisions_raw"), ["run_id"], ["revision"], [Scan("before", "prev", F.col("sha256"))]
    )
    root = F.sha2(F.concat(F.lit("root-"), F.col("run_id").cast("string")), 256)
    previous = F.when(F.col("size") > 1100, F.sha2(F.lit("forged"), 256)).otherwise(F.coalesce("before", root))
    return base.select("run_id", "revision", "sha256", "size", previous.alias("previous_sha256"))


def oracle(names: str, body: str) -> str:
    """SQL text: the named views, with all they depend on, as CTEs in front of ``body``."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered or name in BASE_TABLES:
            return
        if name in DERIVED_SQL:
            for dep in DERIVED_SQL[name][0].split():
                need(dep)
        ordered.append(name)

    for name in names.split():
        need(name)
    kept = ("pixels", "indexed_pixels")  # read several times by one query
    parts = [f"{n} AS {'MATERIALIZED ' if n in kept else ''}({DERIVED_SQL[n][1] if n in DERIVED_SQL else VIEWS[n]('duckdb')})" for n in ordered]
    prefix = f"WITH {', '.join(parts)} " if parts else ""
    if body.lstrip().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body.lstrip()[len('WITH RECURSIVE '):]}"
    if body.lstrip().startswith("WITH "):
        return f"{prefix.rstrip()}, {body.lstrip()[5:]}" if parts else body
    return prefix + body
