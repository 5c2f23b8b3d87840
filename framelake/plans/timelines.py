"""Queries over animation timelines, motion and sheet layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import layout, motion
from framelake.operators import timeline as T
from framelake.operators.ordered import dense_index
from framelake.operators.pixels import alpha_counts, frame_colours
from framelake.plans import fixtures as X
from framelake.plans.catalog import query
from framelake.plans.raster import FRAME_SHA


@query("w1_cumulative_timestamps", "timeline", """SELECT clip_id, idx, frame_id, duration_ms,
  CAST(coalesce(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_ms FROM timeline""")
def w1(spark, sf_dir):
    return T.cumulative_timestamps(X.timeline(spark, sf_dir)).select("clip_id", "idx", "frame_id", "duration_ms", "start_ms")


@query("w2_duplicate_of", "timeline", """SELECT clip_id, idx, frame_id, sha256, CASE WHEN first_id<>frame_id THEN first_id END AS duplicate_of FROM (
  SELECT *, first(frame_id) OVER (PARTITION BY clip_id, sha256 ORDER BY idx) AS first_id FROM (SELECT *, sha256(CAST(k AS VARCHAR)) AS sha256 FROM timeline))""")
def w2(spark, sf_dir):
    hashed = X.timeline(spark, sf_dir).withColumn("sha256", F.sha2(F.col("k").cast("string"), 256))
    return T.duplicate_of(hashed).select("clip_id", "idx", "frame_id", "sha256", "duplicate_of")


def motion_frames(spark, sf_dir):
    """Timeline frames with markers and contacts; some markers are missing, some frames travel unsupported."""
    k = F.col("k")
    marker = lambda i, kind, x, y: F.struct(F.lit(i).alias("id"), F.lit(kind).alias("kind"), x.cast("int").alias("x"), F.lit(y).alias("y"))
    markers = F.array_compact(F.array(
        F.when(k % 5 != 0, marker("root", "root-pivot", F.col("marker_x"), 112)),
        F.when(k % 7 != 0, marker("left-foot", "planted-foot", F.col("marker_x") % 4, 111)),
        F.when(k % 3 == 0, marker("right-foot", "planted-foot", F.col("marker_x") % 2, 111)),
    ))
    contacts = F.array_compact(F.array(F.when(k % 2 == 0, F.lit("left-foot")), F.when(k % 3 == 0, F.lit("right-foot"))))
    return X.timeline(spark, sf_dir).withColumns({
        "translation": F.struct((F.col("translation_x") % 2).alias("x"), F.lit(0).alias("y")),
        "ground": F.struct(F.when(k % 11 == 0, 2).otherwise(0).alias("x"), F.lit(0).alias("y")),
        "markers": markers,
        "contacts": contacts,
    })


PIVOT = (64, 112)


@query("w3_motion_paths", "timeline", """WITH inc AS (SELECT *, translation_x%2-CASE WHEN k%11=0 THEN 2 ELSE 0 END AS shift FROM timeline WHERE included)
  SELECT clip_id, idx, frame_id, 'root' AS subject, CAST(CASE WHEN k%5<>0 THEN marker_x ELSE 64 END+shift AS BIGINT) AS x, CAST(112 AS BIGINT) AS y, CASE WHEN k%5=0 THEN 'missing-root' END AS issue FROM inc
  UNION ALL SELECT clip_id, idx, frame_id, 'left-foot', CASE WHEN k%7<>0 THEN CAST(marker_x%4+shift AS BIGINT) END, CASE WHEN k%7<>0 THEN 111 END, CASE WHEN k%7=0 THEN 'missing-contact-marker' END FROM inc WHERE k%2=0
  UNION ALL SELECT clip_id, idx, frame_id, 'right-foot', CAST(marker_x%2+shift AS BIGINT), 111, NULL FROM inc WHERE k%3=0""")
def w3(spark, sf_dir):
    frames = motion_frames(spark, sf_dir)
    root = motion.root_path(frames, PIVOT).withColumn("subject", F.lit("root"))
    feet = motion.foot_points(frames, PIVOT).select(
        "clip_id", "idx", "frame_id", F.col("contact_id").alias("subject"), "point.x", "point.y", "issue"
    )
    return root.unionByName(feet)


@query("w4_foot_slide", "timeline", """WITH inc AS (SELECT *, translation_x%2-CASE WHEN k%11=0 THEN 2 ELSE 0 END AS shift, row_number() OVER (PARTITION BY clip_id ORDER BY idx) AS act FROM timeline WHERE included),
  pts AS (SELECT clip_id, idx, frame_id, act, 'left-foot' AS contact_id, CASE WHEN k%7<>0 THEN CAST(marker_x%4+shift AS BIGINT) END AS x FROM inc WHERE k%2=0
    UNION ALL SELECT clip_id, idx, frame_id, act, 'right-foot', CAST(marker_x%2+shift AS BIGINT) FROM inc WHERE k%3=0),
  lagged AS (SELECT *, lag(x) OVER w AS px, lag(act) OVER w AS pa FROM pts WINDOW w AS (PARTITION BY clip_id, contact_id ORDER BY act))
  SELECT clip_id, contact_id, idx, frame_id, px AS from_x, CAST(111 AS BIGINT) AS from_y, x AS to_x, CAST(111 AS BIGINT) AS to_y FROM lagged WHERE pa=act-1 AND px<>x""")
def w4(spark, sf_dir):
    return motion.foot_slides(motion.foot_points(motion_frames(spark, sf_dir), PIVOT))


@query("a22_contact_presence", "timeline", """SELECT clip_id, idx, frame_id, 'GROUND_TRAVEL_CONTACT' AS code FROM timeline WHERE k%11=0 AND k%2<>0 AND k%3<>0""")
def a22(spark, sf_dir):
    return motion.unsupported_travel(motion_frames(spark, sf_dir))


STAMPED = """stamped AS (SELECT *, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT)
  +CASE WHEN value>40 THEN 300 ELSE 0 END AS start_ms FROM timeline)"""


def stamped(spark, sf_dir):
    exact = T.cumulative_timestamps(X.timeline(spark, sf_dir))
    return exact.withColumn("start_ms", F.col("start_ms") + F.when(F.col("value") > 40, 300).otherwise(0))


@query("w5_validate_timestamps", "timeline", f"""WITH {STAMPED}, around AS (SELECT *, lag(start_ms) OVER w AS p, lead(start_ms) OVER w AS n FROM stamped WINDOW w AS (PARTITION BY clip_id ORDER BY idx))
  SELECT clip_id, idx, 'START_NOT_ZERO' AS code FROM around WHERE p IS NULL AND start_ms<>0
  UNION ALL SELECT clip_id, idx, 'NOT_INCREASING' FROM around WHERE start_ms<=p
  UNION ALL SELECT clip_id, idx, 'DURATION_DISAGREES' FROM around WHERE n-start_ms<>duration_ms
  UNION ALL SELECT clip_id, idx, 'DURATION_RANGE' FROM around WHERE duration_ms NOT BETWEEN 1 AND 65535""")
def w5(spark, sf_dir):
    return T.timestamp_failures(stamped(spark, sf_dir))


@query("w7_neighbour_frames", "timeline", """WITH a AS (SELECT *, CASE WHEN included THEN idx END AS act FROM timeline),
  n AS (SELECT *, last_value(act IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(act IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f,
    min(act) OVER (PARTITION BY clip_id) AS first_idx, max(act) OVER (PARTITION BY clip_id) AS last_idx FROM a WINDOW w AS (PARTITION BY clip_id ORDER BY idx))
  SELECT clip_id, idx, coalesce(b, last_idx) AS previous_idx, coalesce(f, first_idx) AS next_idx, first_idx, last_idx FROM n""")
def w7(spark, sf_dir):
    return T.neighbour_frames(X.timeline(spark, sf_dir)).select("clip_id", "idx", "previous_idx", "next_idx", "first_idx", "last_idx")


@query("w9_sheet_layout", "timeline", """SELECT clip_id, idx, idx%6*256 AS x, idx//6*256 AS y, CAST(ceil(count(*) OVER (PARTITION BY clip_id)/6.0) AS BIGINT) AS rows FROM timeline""")
def w9(spark, sf_dir):
    frames = X.timeline(spark, sf_dir).select("clip_id", "idx")
    return layout.sheet_layout(frames, 6, 256, 256)


@query("w9_contact_sheet", "timeline", """SELECT clip_id, idx, 2+idx%c*130 AS x, 2+idx//c*130 AS y, c*128+(c+1)*2 AS sheet_width, r*128+(r+1)*2 AS sheet_height FROM (
  SELECT *, CAST(ceil(n/CAST(c AS DOUBLE)) AS BIGINT) AS r FROM (SELECT clip_id, idx, n, least(4,n) AS c FROM (
    SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY idx)-1 AS idx, count(*) OVER (PARTITION BY clip_id) AS n FROM timeline WHERE included)))""")
def w9_contact(spark, sf_dir):
    chosen = X.view(spark, sf_dir, "timeline_raw").filter("included").select("clip_id", "frame_id")
    return layout.contact_sheet_layout(dense_index(chosen, ["clip_id"], "frame_id"), 128, 128)


@query("w10_playback_range", "timeline", """SELECT clip_id, idx, duration_ms, duration_ms/0.5 AS delay_ms FROM timeline
  WHERE included AND idx BETWEEN least(40-clip_id%3, clip_id%20) AND greatest(40-clip_id%3, clip_id%20)""")
def w10(spark, sf_dir):
    chosen = T.playback_range(X.timeline(spark, sf_dir), 40 - F.col("clip_id") % 3, F.col("clip_id") % 20)
    return chosen.select("clip_id", "idx", "duration_ms", T.review_delay(F.col("duration_ms"), 0.5).alias("delay_ms"))


@query("w11_loop_transition", "timeline", """WITH ends AS (SELECT clip_id, arg_max(frame_id, idx) AS from_frame, arg_min(frame_id, idx) AS to_frame FROM timeline WHERE clip_id%3<>0 GROUP BY clip_id)
  SELECT ends.clip_id, from_frame, to_frame, CASE WHEN NOT coalesce(f.value>4 AND f.k%5<>0 AND t.value>4 AND t.k%5<>0 AND f.event_type=t.event_type, false) THEN 'HUMAN_REVIEW_REQUIRED' END AS warning
  FROM ends JOIN timeline f ON f.frame_id=from_frame JOIN timeline t ON t.frame_id=to_frame""")
def w11(spark, sf_dir):
    frames = X.timeline(spark, sf_dir).withColumn("loop_mode", F.when(F.col("clip_id") % 3 == 0, "once").otherwise("loop"))
    approvals = X.view(spark, sf_dir, "timeline_raw").select(
        "frame_id", (F.col("value") > 4).alias("approved"), F.col("event_type").alias("approved_by"),
        (F.col("k") % 5 != 0).alias("at_checkpoint"),
    )
    return T.loop_transitions(frames, approvals)


REVISION_B = """revb AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_id)-1 AS idx, frame_id, duration_ms+k AS duration_ms, included FROM timeline_raw WHERE event_type<>'signup')"""


@query("j5_ordered_coverage", "timeline timeline_raw", f"""WITH {REVISION_B} SELECT clip_id, idx, t.frame_id AS expected, r.frame_id AS actual
  FROM timeline t FULL JOIN revb r USING (clip_id, idx) WHERE t.frame_id IS DISTINCT FROM r.frame_id""")
def j5(spark, sf_dir):
    return T.ordered_coverage(X.timeline(spark, sf_dir), X.later_timeline(spark, sf_dir))


def samples(spark, sf_dir):
    """Moments to look up: one per order, at a time taken from its price, for the clip of its customer."""
    orders = X.table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_custkey") % 160).alias("clip_id"), F.col("o_orderkey").alias("sample_id"),
        (F.floor(F.col("o_totalprice") / 40) - 200).cast("long").alias("elapsed_ms"),
    )


def elapsed_sql(loop: bool) -> str:
    moment = "s.t%total_ms" if loop else "s.t"
    past = "false" if loop else "s.t>=total_ms"
    return f"""WITH shown AS (SELECT clip_id, idx, duration_ms, CAST(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS BIGINT)-duration_ms AS start_ms FROM timeline WHERE included),
  tot AS (SELECT clip_id, CAST(sum(duration_ms) AS BIGINT) AS total_ms, max(idx) AS last_idx, arg_max(duration_ms, idx) AS last_ms FROM shown GROUP BY clip_id),
  s AS (SELECT o_custkey%160 AS clip_id, o_orderkey AS sample_id, greatest(0, CAST(floor(o_totalprice/40)-200 AS BIGINT)) AS t FROM orders),
  m AS (SELECT s.clip_id, sample_id, total_ms, last_idx, last_ms, {moment} AS moment, {past} AS past FROM s LEFT JOIN tot USING (clip_id))
  SELECT m.clip_id, sample_id, CASE WHEN total_ms IS NULL THEN NULL WHEN past THEN last_idx ELSE idx END AS idx, coalesce(total_ms,0) AS total_ms,
    CASE WHEN total_ms IS NULL THEN 0 WHEN past THEN total_ms ELSE moment END AS elapsed_ms,
    CASE WHEN total_ms IS NULL THEN 0 WHEN past THEN last_ms ELSE moment-start_ms END AS frame_elapsed_ms, total_ms IS NULL OR past AS complete
  FROM m LEFT JOIN shown f ON f.clip_id=m.clip_id AND start_ms<=moment AND moment<start_ms+duration_ms"""


@query("j12_frame_at_elapsed", "timeline", elapsed_sql(False))
def j12(spark, sf_dir):
    return T.frame_at_elapsed(X.timeline(spark, sf_dir), samples(spark, sf_dir), loop=False)


@query("j12_frame_at_elapsed_loop", "timeline", elapsed_sql(True))
def j12_loop(spark, sf_dir):
    return T.frame_at_elapsed(X.timeline(spark, sf_dir), samples(spark, sf_dir), loop=True)


@query("j13_compare_timelines", "timeline timeline_raw", f"""WITH {REVISION_B},
  a AS (SELECT clip_id, idx, CAST(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS BIGINT)-duration_ms AS s FROM timeline WHERE included),
  b AS (SELECT clip_id, idx, CAST(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx) AS BIGINT)-duration_ms AS s FROM revb WHERE included),
  m AS (SELECT clip_id, s FROM a UNION SELECT clip_id, s FROM b)
  SELECT m.clip_id, m.s AS elapsed_ms, a.idx AS left_idx, b.idx AS right_idx FROM m ASOF LEFT JOIN a ON a.clip_id=m.clip_id AND a.s<=m.s ASOF LEFT JOIN b ON b.clip_id=m.clip_id AND b.s<=m.s""")
def j13(spark, sf_dir):
    return T.compare_timelines(X.timeline(spark, sf_dir), X.later_timeline(spark, sf_dir))


@query("a13_source_summary", "pixels frames", f"""WITH h AS ({FRAME_SHA}), p AS (SELECT frame_key, bool_or(a<255) AS alpha, bool_and(a=0) AS empty FROM pixels GROUP BY frame_key),
  f AS (SELECT clip_id, frame_key, sha256, CAST(20+(frame_key*37)%180 AS BIGINT) AS d, alpha, empty FROM h JOIN p USING (frame_key))
  SELECT clip_id, count(*) AS frames, bool_or(alpha) AS alpha, count(DISTINCT d)>1 AS variable_frame_rate, count(*)-count(DISTINCT sha256) AS duplicate_frames,
  count(*) FILTER (empty) AS empty_frames, true AS stable_canvas FROM f GROUP BY clip_id""")
def a13(spark, sf_dir):
    alpha = alpha_counts(frame_colours(X.pixels(spark, sf_dir), 8, 8)).select("frame_key", "alpha", "empty")
    frames = X.packed_frames(spark, sf_dir).select(
        "clip_id", "frame_key", F.col("frame_key").alias("frame_id"), F.sha2("rgba", 256).alias("sha256"),
        (20 + (F.col("frame_key") * 37) % 180).alias("duration_ms"), "width", "height",
    )
    return T.source_summary(frames.join(alpha, "frame_key"))


@query("a14_sequence_duration", "timeline", """SELECT clip_id, CAST(sum(CASE WHEN k%3=0 THEN k+1 ELSE duration_ms END) AS BIGINT) AS total_ms, count(*) AS frames FROM timeline
  WHERE included AND idx BETWEEN least(50, clip_id%30) AND greatest(50, clip_id%30) GROUP BY clip_id""")
def a14(spark, sf_dir):
    edited = X.timeline(spark, sf_dir).withColumn("edit_duration_ms", F.when(F.col("k") % 3 == 0, F.col("k") + 1))
    return T.sequence_duration(edited, F.lit(50), F.col("clip_id") % 30)


@query("a15_timing_share", "timeline", """SELECT clip_id, idx, round(CASE WHEN included THEN duration_ms/greatest(1, max(duration_ms) FILTER (included) OVER (PARTITION BY clip_id)) ELSE 0 END, 9)::DOUBLE AS share FROM timeline""")
def a15(spark, sf_dir):
    return T.timing_share(X.timeline(spark, sf_dir)).select("clip_id", "idx", F.round("share", 9).alias("share"))
