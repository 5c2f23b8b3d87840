"""Queries over pixels: colours, boxes, placement, grids, components, compositing."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import color as C
from framelake.operators import compare, components, composite, inspect, tiles
from framelake.operators import pixels as P
from framelake.plans import fixtures as X
from framelake.plans.catalog import query

SIDE = 8
CLEAR = (0, 0, 0, 0)
KEY = (96, 159, 64, 255)
PALETTE = X.PALETTE
IN_PALETTE = "(" + " OR ".join(f"(r={r} AND g={g} AND b={b} AND a={a})" for r, g, b, a in PALETTE) + ")"
PALETTE_VALUES = ",".join(f"({i},{r},{g},{b},{a})" for i, (r, g, b, a) in enumerate(PALETTE))
RGBA = "concat(CAST(r AS VARCHAR),',',CAST(g AS VARCHAR),',',CAST(b AS VARCHAR),',',CAST(a AS VARCHAR))"


def colours(spark, sf_dir):
    return P.frame_colours(X.pixels(spark, sf_dir), SIDE, SIDE)


def near(key, tolerance, channels="rgba"):
    parts = ",".join(f"abs({c}-{v})" for c, v in zip(channels, key))
    return f"greatest({parts})<={tolerance}"


@query("p1_explode_pixels", "pixels", "SELECT frame_key, clip_id, x, y, r, g, b, a FROM pixels")
def p1(spark, sf_dir):
    return P.explode_pixels(X.packed_frames(spark, sf_dir))


@query("p2_same_color", "pixels", f"""SELECT frame_key, count(*) FILTER ({near(KEY, 16)}) AS near_pixels,
  count(*) FILTER ({near(KEY, 0)}) AS exact_pixels FROM pixels GROUP BY frame_key""")
def p2(spark, sf_dir):
    px = C.channels()
    return X.pixels(spark, sf_dir).groupBy("frame_key").agg(
        F.count_if(C.same_color(px, C.literal(KEY), 16)).alias("near_pixels"),
        F.count_if(C.same_color(px, C.literal(KEY), 0)).alias("exact_pixels"),
    )


@query("p3_matches_background", "pixels", f"""SELECT frame_key,
  count(*) FILTER ({near(KEY, 24)} ) AS with_alpha, count(*) FILTER ({near(KEY, 24, 'rgb')}) AS rgb_only,
  count(*) FILTER (a=0 OR {near((9, 9, 9, 0), 2)}) AS clear_key FROM pixels GROUP BY frame_key""")
def p3(spark, sf_dir):
    px = C.channels()
    return X.pixels(spark, sf_dir).groupBy("frame_key").agg(
        F.count_if(C.matches_background(px, C.literal(KEY), 24)).alias("with_alpha"),
        F.count_if(C.matches_background(px, C.literal(KEY), 24, use_alpha=False)).alias("rgb_only"),
        F.count_if(C.matches_background(px, C.literal((9, 9, 9, 0)), 2)).alias("clear_key"),
    )


@query("p4_chroma_spill_mask", "pixels", f"""SELECT frame_key,
  count(*) FILTER ({near(KEY, 8)}) AS key_pixels,
  count(*) FILTER ({near(KEY, 8)} OR (abs(a-255)<=8 AND g-greatest(r,b)>=24)) AS removed_pixels,
  'g' AS channel FROM pixels GROUP BY frame_key""")
def p4(spark, sf_dir):
    px, key = C.channels(), C.literal(KEY)
    return X.pixels(spark, sf_dir).groupBy("frame_key").agg(
        F.count_if(C.same_color(px, key, 8)).alias("key_pixels"),
        F.count_if(C.is_chroma_spill(px, key, 8, 24)).alias("removed_pixels"),
        F.max(C.dominant_channel(key)).alias("channel"),
    )


@query("p5_classify_alpha", "pixels", """SELECT frame_key, count(*) FILTER (a=255) AS opaque,
  count(*) FILTER (a=0) AS transparent, count(*) FILTER (a>0 AND a<255) AS partial,
  bool_or(a<255) AS alpha, bool_and(a=0) AS empty FROM pixels GROUP BY frame_key""")
def p5(spark, sf_dir):
    return P.alpha_counts(colours(spark, sf_dir))


DX, DY = "CAST(frame_key%7-3 AS INT)", "CAST(clip_id%5-2 AS INT)"


@query("p6_translate_pixels", "pixels", f"""SELECT frame_key, clip_id, retained, clipped, CASE WHEN retained=0 THEN 'NO_VISIBLE_PIXELS'
  WHEN clip_id%2=0 AND clipped>0 THEN 'CLIPPED_FOREGROUND' END AS code FROM (
  SELECT frame_key, clip_id, count(*) FILTER (a>0 AND inside) AS retained, count(*) FILTER (a>0 AND NOT inside) AS clipped
  FROM (SELECT *, x+{DX} BETWEEN 0 AND 7 AND y+{DY} BETWEEN 0 AND 7 AS inside FROM pixels) GROUP BY frame_key, clip_id)""")
def p6(spark, sf_dir):
    return P.translation_report(
        X.pixels(spark, sf_dir), F.expr(DX), F.expr(DY), SIDE, SIDE, F.col("clip_id") % 2 == 0
    )


@query("p7_upscale_nearest", "pixels", """SELECT frame_key, x, y, r, g, b, a FROM (
  SELECT frame_key, CAST(x*2+dx AS INT) AS x, CAST(y*2+dy AS INT) AS y, r, g, b, a
  FROM pixels, (VALUES (0),(1)) u(dx), (VALUES (0),(1)) w(dy))""")
def p7(spark, sf_dir):
    return P.upscale_nearest(X.pixels(spark, sf_dir).drop("clip_id"), 2)


@query("p8_collapse_grid", "runtime_pixels", f"""SELECT frame_key, clip_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a,
  CASE WHEN colours>1 THEN 'mixed' WHEN NOT {IN_PALETTE} THEN 'outside' END AS verdict FROM (
  SELECT frame_key, clip_id, x//2 AS x, y//2 AS y, count(DISTINCT (r,g,b,a)) AS colours,
  min((r,g,b,a)) AS lo, min((r,g,b,a))[1] AS r, min((r,g,b,a))[2] AS g, min((r,g,b,a))[3] AS b, min((r,g,b,a))[4] AS a
  FROM runtime_pixels GROUP BY frame_key, clip_id, x//2, y//2)""")
def p8(spark, sf_dir):
    return P.collapse_grid(P.explode_pixels(X.runtime_frames(spark, sf_dir)), 2, PALETTE)


def boxes(spark, sf_dir):
    cs = colours(spark, sf_dir)
    return cs.groupBy("frame_key", "clip_id").agg(*P.bounds_where(F.col("a") > 0))


BOX = """box AS (SELECT frame_key, clip_id, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b,
  max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h FROM pixels WHERE a>0 GROUP BY frame_key, clip_id)"""


EVERY = "(SELECT DISTINCT frame_key, clip_id FROM pixels)"
CROPS = f"""SELECT frame_key, clip_id, l AS left, t AS top, w+2 AS crop_width, h+2 AS crop_height,
  max(w+2) OVER c AS canvas_width, max(h+2) OVER c AS canvas_height,
  (max(w+2) OVER c - (w+2))//2 AS offset_x, (max(h+2) OVER c - (h+2))//2 AS offset_y, CASE WHEN w IS NULL THEN 'NO_FOREGROUND' END AS code
  FROM {EVERY} LEFT JOIN box USING (frame_key, clip_id) WINDOW c AS (PARTITION BY clip_id)"""


def drawn_sql(plan: str) -> str:
    """sha256 of canvases: plan(frame_key, clip_id, cw, ch, dx, dy, k, code) moves visible pixels to x*k+dx, y*k+dy."""
    return f"""plan AS ({plan}),
  grid AS (SELECT frame_key, gx, gy FROM plan, range(0, 64) a(gx), range(0, 64) b(gy) WHERE gx<cw AND gy<ch AND dx IS NOT NULL),
  moved AS (SELECT frame_key, x*k+dx+sx AS gx, y*k+dy+sy AS gy, {HEXES} AS hex FROM pixels JOIN plan USING (frame_key), range(0, 4) u(sx), range(0, 4) v(sy) WHERE a>0 AND sx<k AND sy<k),
  drawn AS (SELECT g.frame_key, sha256(unhex(string_agg(coalesce(hex,'00000000'), '' ORDER BY gy, gx))) AS sha256 FROM grid g LEFT JOIN moved m USING (frame_key, gx, gy) GROUP BY g.frame_key)
  SELECT p.frame_key, p.clip_id, CASE WHEN sha256 IS NOT NULL THEN cw END AS width, CASE WHEN sha256 IS NOT NULL THEN ch END AS height, sha256, code FROM plan p LEFT JOIN drawn USING (frame_key)"""


HEXES = "lower(lpad(to_hex(r),2,'0')||lpad(to_hex(g),2,'0')||lpad(to_hex(b),2,'0')||lpad(to_hex(a),2,'0'))"


def digest(drawn):
    return drawn.withColumn("sha256", F.sha2("rgba", 256)).drop("rgba")


@query("p10_crop_and_center", "pixels", f"WITH {BOX} {CROPS}")
def p10(spark, sf_dir):
    return P.crop_and_center(boxes(spark, sf_dir), 1)


@query("p10_cropped_pixels", "pixels", f"""WITH {BOX}, crops AS ({CROPS}), {drawn_sql("SELECT frame_key, clip_id, CAST(canvas_width AS INT) AS cw, CAST(canvas_height AS INT) AS ch, offset_x+1-'left' AS dx, offset_y+1-top AS dy, 1 AS k, code FROM crops").replace("-'left'", '-"left"')}""")
def p10_pixels(spark, sf_dir):
    crops = P.crop_and_center(boxes(spark, sf_dir), 1)
    return digest(P.cropped_frames(X.packed_frames(spark, sf_dir), crops, 1))


@query("p11_fit_contract_canvas", "pixels", """SELECT frame_key, kept, lost, CASE WHEN lost>0 THEN 'CANVAS_OVERFLOW' END AS code FROM (
  SELECT frame_key, count(*) FILTER (a>0 AND x<7 AND y<10) AS kept, count(*) FILTER (a>0 AND NOT (x<7 AND y<10)) AS lost
  FROM pixels GROUP BY frame_key)""")
def p11(spark, sf_dir):
    return P.fit_canvas(X.pixels(spark, sf_dir), 7, 10)


@query("p11_fitted_pixels", "pixels", "WITH " + drawn_sql("""SELECT frame_key, clip_id, 8 AS cw, 10 AS ch, CASE WHEN count(*) FILTER (a>0 AND NOT (x<8 AND y<10))=0 THEN 0 END AS dx, 0 AS dy, 1 AS k,
  CASE WHEN count(*) FILTER (a>0 AND NOT (x<8 AND y<10))>0 THEN 'CANVAS_OVERFLOW' END AS code FROM pixels GROUP BY frame_key, clip_id"""))
def p11_pixels(spark, sf_dir):
    frames = X.packed_frames(spark, sf_dir)
    return digest(P.fitted_frames(frames, P.fit_canvas(X.pixels(spark, sf_dir), 8, 10), 8, 10))


@query("p12_apply_edit", "pixels", """SELECT frame_key, CAST(x AS INT) AS x, CAST(y AS INT) AS y, r, g, b, a FROM (
  SELECT frame_key, r, g, b, a, CAST(trunc((11-8*s)/2.0) AS INT)+CAST(frame_key%3-1 AS INT)+rx*s+dx AS x,
    CAST(trunc((11-8*s)/2.0) AS INT)+CAST(frame_key%2 AS INT)+ry*s+dy AS y FROM (
    SELECT *, CAST(1+clip_id%2 AS INT) AS s,
      CASE turn WHEN 1 THEN 7-y WHEN 2 THEN 7-x WHEN 3 THEN y ELSE x END AS rx,
      CASE turn WHEN 1 THEN x WHEN 2 THEN 7-y WHEN 3 THEN 7-x ELSE y END AS ry
    FROM (SELECT *, clip_id%4 AS turn FROM pixels)),
  (VALUES (0),(1)) u(dx), (VALUES (0),(1)) w(dy) WHERE dx<s AND dy<s) WHERE x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 10""")
def p12(spark, sf_dir):
    return P.apply_edit(
        X.pixels(spark, sf_dir), SIDE,
        turns=F.col("clip_id").cast("int") % 4 - 4,
        scale=(1 + F.col("clip_id") % 2).cast("int"),
        dx=(F.col("frame_key") % 3 - 1).cast("int"),
        dy=(F.col("frame_key") % 2).cast("int"),
        canvas=11,
    ).drop("clip_id")


def places_sql(left: str, top: str, k: int, width: int, height: int) -> str:
    return f"""placed AS (SELECT frame_key, clip_id, {left} AS place_left, {top} AS place_top, w*{k} AS place_width, h*{k} AS place_height FROM {EVERY} LEFT JOIN box USING (frame_key, clip_id)),
  over AS (SELECT *, coalesce(place_left<0 OR place_top<0 OR place_left+place_width>{width} OR place_top+place_height>{height}, false) AS overflow FROM placed),
  coded AS (SELECT *, CASE WHEN place_width IS NULL THEN 'NO_FOREGROUND' WHEN overflow THEN 'CANVAS_OVERFLOW' END AS code FROM over),
  places AS (SELECT *, bool_or(code IS NOT NULL) OVER (PARTITION BY clip_id) AS clip_rejected FROM coded)"""


BY_PIVOT = places_sql("6-w//2", "8-h", 1, 9, 9)
BY_LANDMARK = places_sql("12-(4-l)*2", "20-(7-t)*2", 2, 20, 24)


def placement(spark, sf_dir, by_landmark=False):
    if by_landmark:
        return P.place_on_canonical(boxes(spark, sf_dir), (12, 20), 20, 24, scale=2, landmark=(F.lit(4), F.lit(7)))
    return P.place_on_canonical(boxes(spark, sf_dir), (6, 8), 9, 9)


@query("p13_place_on_canonical", "pixels", f"WITH {BOX}, {BY_PIVOT} SELECT * FROM places")
def p13(spark, sf_dir):
    return placement(spark, sf_dir)


@query("p13_place_by_landmark", "pixels", f"WITH {BOX}, {BY_LANDMARK} SELECT * FROM places")
def p13_landmark(spark, sf_dir):
    return placement(spark, sf_dir, by_landmark=True)


@query("p13_canonical_pixels", "pixels", f"""WITH {BOX}, {BY_LANDMARK}, {drawn_sql("""SELECT frame_key, clip_id, 20 AS cw, 24 AS ch, CASE WHEN NOT clip_rejected THEN place_left-l*2 END AS dx, place_top-t*2 AS dy, 2 AS k,
  coalesce(code, CASE WHEN clip_rejected THEN 'CLIP_REJECTED' END) AS code FROM places LEFT JOIN box USING (frame_key, clip_id)""")}""")
def p13_pixels(spark, sf_dir):
    bounds = boxes(spark, sf_dir)
    return digest(P.canonical_frames(X.packed_frames(spark, sf_dir), bounds, placement(spark, sf_dir, by_landmark=True), 20, 24, 2))


@query("p14_prepare_anchor", "pixels", """WITH keyed AS (SELECT p.*, k.r AS kr, k.g AS kg, k.b AS kb, k.a AS ka FROM pixels p
  JOIN (SELECT * FROM pixels WHERE x=0 AND y=0) k USING (frame_key)),
  boxed AS (SELECT frame_key, kr, kg, kb, ka, count(*) FILTER (fg) AS n, min(x) FILTER (fg) AS l, min(y) FILTER (fg) AS t,
    max(x) FILTER (fg)-min(x) FILTER (fg)+1 AS w, max(y) FILTER (fg)-min(y) FILTER (fg)+1 AS h
    FROM (SELECT *, (r,g,b,a)<>(kr,kg,kb,ka) AS fg FROM keyed) GROUP BY frame_key, kr, kg, kb, ka)
  SELECT frame_key, concat_ws(',',kr,kg,kb,ka) AS background,
    CASE WHEN kr=0 AND kg=0 AND kb=0 AND ka=0 THEN '0,255,0,255' ELSE concat_ws(',',kr,kg,kb,255) END AS chroma,
    n AS foreground_pixels, 8-w//2 AS canonical_left, 7-h AS canonical_top, 128 AS plate_side,
    16 AS runtime_pivot_x, 14 AS runtime_pivot_y,
    CASE WHEN w IS NULL THEN 'NO_FOREGROUND' WHEN 8-w//2<0 OR 7-h<0 OR 8-w//2+w>16 OR 7>16 THEN 'CANVAS_SIZE' END AS code FROM boxed""")
def p14(spark, sf_dir):
    cs = P.frame_colours(X.pixels(spark, sf_dir), SIDE, SIDE)
    corner = F.max_by(C.packed(C.channels()), F.when(F.col("visit_raster") == 0, 1))
    anchors = cs.groupBy("frame_key").agg(
        corner.alias("background"),
        F.collect_list(F.struct(*C.CHANNELS, "n", "left", "top", "right", "bottom")).alias("colours"),
    )
    return P.prepare_anchor(anchors, pivot=(8, 7), cell=16, generation_scale=8, runtime_scale=2)


@query("p15_palette_hex", "pixels", """SELECT frame_key, count(*) AS opaque_colours, string_agg(h, ',' ORDER BY r,g,b) AS palette_hex FROM (
  SELECT DISTINCT frame_key, r, g, b, lower(lpad(to_hex(r),2,'0')||lpad(to_hex(g),2,'0')||lpad(to_hex(b),2,'0')) AS h
  FROM pixels WHERE a=255) GROUP BY frame_key""")
def p15(spark, sf_dir):
    opaque = colours(spark, sf_dir).filter("a=255")
    entries = F.array_sort(F.collect_list(F.struct("r", "g", "b")))
    listed = opaque.groupBy("frame_key").agg(F.count(F.lit(1)).alias("opaque_colours"), entries.alias("entries"))
    return listed.select(
        "frame_key", "opaque_colours",
        F.array_join(F.transform("entries", lambda e: C.hex6({c: e.getField(c) for c in "rgb"})), ",").alias("palette_hex"),
    )


@query("p20_margins", "pixels", f"""WITH {BOX} SELECT frame_key, l AS margin_left, t AS margin_top, 7-r AS margin_right, 7-b AS margin_bottom,
  concat_ws(',', CASE WHEN l=0 THEN 'left' END, CASE WHEN t=0 THEN 'top' END, CASE WHEN r=7 THEN 'right' END, CASE WHEN b=7 THEN 'bottom' END) AS clipped_edges,
  l=0 OR t=0 OR r=7 OR b=7 AS clipped FROM box""")
def p20(spark, sf_dir):
    return P.margins(boxes(spark, sf_dir), SIDE, SIDE)


@query("a1_palette_histogram", "pixels", """SELECT clip_id, r, g, b, a, count(*) AS pixels,
  CAST(row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, r, g, b, a) AS INT) AS position FROM pixels GROUP BY clip_id, r, g, b, a""")
def a1(spark, sf_dir):
    return P.clip_histogram(colours(spark, sf_dir))


@query("a2_dominant_border", "pixels", f"""WITH border AS (SELECT *, {RGBA} AS colour, CASE WHEN y=0 THEN 2*x WHEN y=7 THEN 2*x+1
    ELSE 16+2*(y-1)+CASE WHEN x=0 THEN 0 ELSE 1 END END AS vc, y*8+x AS vr FROM pixels WHERE x IN (0,7) OR y IN (0,7)),
  counted AS (SELECT frame_key, colour, count(*) AS n, min(vc) AS vc, min(vr) AS vr FROM border GROUP BY frame_key, colour)
  SELECT frame_key, arg_max(colour, n*1000-vc) AS by_columns, arg_max(colour, n*1000-vr) AS by_raster FROM counted GROUP BY frame_key""")
def a2(spark, sf_dir):
    picked = P.dominant_border(colours(spark, sf_dir))
    return picked.select("frame_key", *[C.text(C.fields(F.col(c))).alias(c) for c in ("by_columns", "by_raster")])


@query("a3_foreground_bounds", "pixels", f"""SELECT frame_key, min(x) FILTER (fg) AS left, min(y) FILTER (fg) AS top,
  max(x) FILTER (fg) AS right, max(y) FILTER (fg) AS bottom, max(x) FILTER (fg)-min(x) FILTER (fg)+1 AS width,
  max(y) FILTER (fg)-min(y) FILTER (fg)+1 AS height, min(x) FILTER (a>0) AS alpha_left, min(y) FILTER (a>0) AS alpha_top,
  max(x) FILTER (a>0) AS alpha_right, max(y) FILTER (a>0) AS alpha_bottom,
  max(x) FILTER (a>0)-min(x) FILTER (a>0)+1 AS alpha_width, max(y) FILTER (a>0)-min(y) FILTER (a>0)+1 AS alpha_height
  FROM (SELECT *, NOT ({near((112, 143, 16, 255), 20)}) AS fg FROM pixels) GROUP BY frame_key""")
def a3(spark, sf_dir):
    return P.foreground_bounds(colours(spark, sf_dir), (112, 143, 16, 255), 20)


RUNS = """cells AS (SELECT frame_key, clip_id, axis, line, pos, r, g, b, a FROM (
    SELECT frame_key, clip_id, 'horizontal' AS axis, y AS line, x AS pos, r, g, b, a FROM pixels
    UNION ALL SELECT frame_key, clip_id, 'vertical', x, y, r, g, b, a FROM pixels)),
  marked AS (SELECT *, CASE WHEN lag((r,g,b,a)) OVER w = (r,g,b,a) THEN 0 ELSE 1 END AS opens FROM cells WINDOW w AS (PARTITION BY frame_key, axis, line ORDER BY pos)),
  islands AS (SELECT *, sum(opens) OVER (PARTITION BY frame_key, axis, line ORDER BY pos) AS island FROM marked),
  runs AS (SELECT frame_key, clip_id, axis, line, min(pos) AS start, count(*) AS length, min(r) AS r, min(g) AS g, min(b) AS b, min(a) AS a
    FROM islands GROUP BY frame_key, clip_id, axis, line, island)"""
BORDER = """border AS (SELECT frame_key, r, g, b, a, count(*) AS n, min(CASE WHEN y=0 THEN 2*x WHEN y=7 THEN 2*x+1
    ELSE 16+2*(y-1)+CASE WHEN x=0 THEN 0 ELSE 1 END END) AS v FROM pixels WHERE x IN (0,7) OR y IN (0,7) GROUP BY frame_key, r, g, b, a),
  key AS (SELECT frame_key, arg_max((r,g,b,a), n*1000-v) AS k FROM border GROUP BY frame_key)"""
HIST = f"""{RUNS}, {BORDER}, fg_runs AS (SELECT runs.* FROM runs JOIN key USING (frame_key) WHERE (r,g,b,a)<>k),
  hist AS (SELECT frame_key, axis, CAST(length AS INT) AS length, count(*) AS n, min(line*1000+start) AS seen FROM fg_runs GROUP BY frame_key, axis, length)"""


@query("a8_run_lengths", "pixels", f"""WITH {RUNS} SELECT clip_id, axis, CAST(length AS INT) AS length, count(*) AS runs
  FROM runs WHERE a>0 GROUP BY clip_id, axis, length""")
def a8(spark, sf_dir):
    runs = P.axis_runs(X.packed_frames(spark, sf_dir)).filter("a>0")
    return runs.groupBy("clip_id", "axis", "length").agg(F.count(F.lit(1)).alias("runs"))


def frame_histogram(spark, sf_dir):
    packed = X.packed_frames(spark, sf_dir)
    border = P.dominant_border(P.own_colours(packed))
    return inspect.run_histogram(
        inspect.foreground_runs(packed, border.select("frame_key", F.col("by_columns").alias("background")), 0)
    )


GRID = f"""{HIST}, totals AS (SELECT frame_key, axis, sum(n) AS runs FROM hist GROUP BY frame_key, axis),
  strong AS (SELECT h.*, row_number() OVER (PARTITION BY frame_key, axis ORDER BY n DESC, seen) AS rk, count(*) OVER (PARTITION BY frame_key, axis) AS k
    FROM hist h JOIN totals t USING (frame_key, axis) WHERE length>1 AND n>=4 AND n/CAST(runs AS DOUBLE)>=0.15),
  modes AS (SELECT frame_key, axis, string_agg(length||':'||n, ',' ORDER BY rk) AS m FROM strong WHERE k>=2 AND rk<=3 GROUP BY frame_key, axis),
  useful AS (SELECT frame_key, CAST(sum(n) AS BIGINT) AS sample_count, list_sort(list(DISTINCT length)) AS ls FROM hist WHERE length>1 GROUP BY frame_key),
  grid AS (SELECT f.frame_key, list_aggregate(list_filter(range(1, ls[1]+1), lambda d: len(list_filter(ls, lambda v: v%d<>0))=0),'max') AS bs,
    array_to_string(ls[1:32],',') AS run_lengths, coalesce(sample_count,0) AS sample_count,
    mh.m AS horizontal_modes, mv.m AS vertical_modes, CAST(mh.m IS NOT NULL AS INT)+CAST(mv.m IS NOT NULL AS INT) AS mixed
    FROM (SELECT DISTINCT frame_key FROM hist) f LEFT JOIN useful u USING (frame_key)
    LEFT JOIN (SELECT * FROM modes WHERE axis='horizontal') mh USING (frame_key)
    LEFT JOIN (SELECT * FROM modes WHERE axis='vertical') mv USING (frame_key)),
  graded AS (SELECT frame_key, CAST(bs AS INT) AS block_size, coalesce(run_lengths,'') AS run_lengths, sample_count, horizontal_modes, vertical_modes, mixed>0 AS mixed_blocks,
    round(CASE WHEN mixed>0 THEN least(0.8, 0.55+mixed*0.1) WHEN bs=1 THEN 0.55 WHEN bs IS NOT NULL AND sample_count>=4 THEN least(0.75, 0.35+sample_count/100.0)
      WHEN bs IS NOT NULL THEN 0.25 ELSE 0 END, 6)::DOUBLE AS confidence FROM grid)"""


@query("a9_infer_grid", "pixels", f"WITH {GRID} SELECT * FROM graded")
def a9(spark, sf_dir):
    return inspect.infer_grid(frame_histogram(spark, sf_dir))


@query("t1_top_modes", "pixels", f"""WITH {HIST} SELECT frame_key, axis, rank, length, n AS runs FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY frame_key, axis ORDER BY n DESC, seen) AS INT) AS rank FROM hist WHERE length>1) WHERE rank<=3""")
def t1(spark, sf_dir):
    return inspect.top_modes(frame_histogram(spark, sf_dir))


@query("a10_inspect_frames", "pixels", f"""WITH {GRID}, stats AS (SELECT frame_key, k, count(DISTINCT (r,g,b,a)) AS palette_size,
    min(x) FILTER ((r,g,b,a)<>k) AS left, min(y) FILTER ((r,g,b,a)<>k) AS top, max(x) FILTER ((r,g,b,a)<>k) AS right, max(y) FILTER ((r,g,b,a)<>k) AS bottom,
    count(*) FILTER (a=255) AS opaque, count(*) FILTER (a=0) AS transparent, count(*) FILTER (a>0 AND a<255) AS partial
    FROM pixels JOIN key USING (frame_key) GROUP BY frame_key, k)
  SELECT frame_key, concat_ws(',',k[1],k[2],k[3],k[4]) AS background, palette_size, "left", top, "right", bottom, opaque, transparent, partial,
    block_size, sample_count, horizontal_modes, vertical_modes, confidence,
    concat_ws(',', CASE WHEN "left" IS NULL THEN 'NO_FOREGROUND' END, CASE WHEN palette_size>256 THEN 'LARGE_PALETTE' END,
      CASE WHEN "left"=0 OR top=0 OR "right"=7 OR bottom=7 THEN 'EDGE_CLIPPING' END, CASE WHEN partial>0 THEN 'SMOOTHING_SUSPECTED' END,
      CASE WHEN mixed_blocks THEN 'MIXED_PIXEL_BLOCKS' END) AS diagnostics FROM stats LEFT JOIN graded USING (frame_key)""")
def a10(spark, sf_dir):
    return inspect.inspect_frames(X.packed_frames(spark, sf_dir))


@query("a11_background_evidence", "pixels", f"""SELECT frame_key, count(*) FILTER (a>0 AND (x IN (0,7) OR y IN (0,7))) AS opaque_border_pixels,
  count(*) FILTER (a>0 AND {near(KEY, 20, 'rgb')}) AS configured_color_pixels FROM pixels GROUP BY frame_key""")
def a11(spark, sf_dir):
    return P.background_evidence(colours(spark, sf_dir), KEY, 20)


FRAME_SHA = f"SELECT frame_key, clip_id, sha256(unhex(string_agg({HEXES}, '' ORDER BY y, x))) AS sha256 FROM pixels GROUP BY frame_key, clip_id"


@query("a12_frame_hash", "pixels", FRAME_SHA)
def a12(spark, sf_dir):
    return P.frame_hash(X.packed_frames(spark, sf_dir)).select("frame_key", "clip_id", "sha256")


@query("a16_scale_consistency", "pixels", f"""WITH {BOX}, derived AS (SELECT frame_key, clip_id, CASE WHEN frame_key%9=0 THEN w*3 ELSE w*2 END AS ow, h*2 AS oh, w, h FROM {EVERY} LEFT JOIN box USING (frame_key, clip_id)),
  scaled AS (SELECT frame_key, clip_id, coalesce(ow%w=0 AND oh%h=0 AND ow//w>=1 AND ow//w=oh//h, false) AS ok, ow//w AS s FROM derived)
  SELECT clip_id, count(*) FILTER (NOT ok) AS broken_frames, count(DISTINCT s) FILTER (ok) AS scales,
  CASE WHEN count(*) FILTER (NOT ok)>0 OR count(DISTINCT s) FILTER (ok)>1 THEN 'GLOBAL_SCALE_DRIFT' END AS code FROM scaled GROUP BY clip_id""")
def a16(spark, sf_dir):
    from framelake.operators.validate import scale_consistency

    pairs = boxes(spark, sf_dir).select(
        "frame_key", "clip_id", F.col("width").alias("src_width"), F.col("height").alias("src_height"),
        F.when(F.col("frame_key") % 9 == 0, F.col("width") * 3).otherwise(F.col("width") * 2).alias("out_width"),
        (F.col("height") * 2).alias("out_height"),
    )
    return scale_consistency(pairs)


# Contracts of odd clips leave out the last palette entry; every seventh clip has no contract.
SMALL = PALETTE[:-1]
OWN_SQL = "own AS (SELECT DISTINCT clip_id, clip_id%7=6 AS lacking, clip_id%2 AS small FROM pixels)"
IN_OWN = f"(NOT lacking AND {IN_PALETTE} AND NOT (small=1 AND r={PALETTE[-1][0]} AND g={PALETTE[-1][1]} AND b={PALETTE[-1][2]} AND a={PALETTE[-1][3]}))"


def palettes(spark, sf_dir):
    entries = lambda p: F.array(*[F.array(*[F.lit(v) for v in e]) for e in p])
    clips = X.packed_frames(spark, sf_dir).select("clip_id").distinct().filter("clip_id % 7 <> 6")
    return clips.withColumn("palette", F.when(F.col("clip_id") % 2 == 1, entries(SMALL)).otherwise(entries(PALETTE)))


@query("j1_nearest_palette", "pixels", f"""WITH {OWN_SQL}, pal AS (SELECT * FROM (VALUES {PALETTE_VALUES}) v(ord, pr, pg, pb, pa) WHERE ord>0),
  cs AS (SELECT frame_key, clip_id, r, g, b, a, count(*) AS pixels FROM pixels GROUP BY ALL),
  fr AS (SELECT frame_key, count(*) FILTER (a=255) AS opaque, count(*) FILTER (a>0 AND a<255) AS part FROM cs GROUP BY frame_key),
  d AS (SELECT frame_key, r, g, b, a, ord, (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb) AS dist FROM cs JOIN own USING (clip_id), pal WHERE a=255 AND NOT lacking AND ord<{len(PALETTE)}-small)
  SELECT cs.frame_key, cs.clip_id, cs.r, cs.g, cs.b, cs.a, pixels, CASE WHEN cs.a=0 THEN 0 ELSE m.ord END AS ord, CAST(m.dist AS BIGINT) AS dist,
    CASE WHEN lacking THEN 'NO_PALETTE' WHEN part>0 THEN 'PARTIAL_ALPHA' WHEN opaque>16 THEN 'TOO_MANY_COLOURS' END AS code
  FROM cs JOIN own USING (clip_id) JOIN fr USING (frame_key) LEFT JOIN (SELECT frame_key, r, g, b, a, arg_min(ord, dist*100+ord) AS ord, min(dist) AS dist FROM d GROUP BY ALL) m USING (frame_key, r, g, b, a)""")
def j1(spark, sf_dir):
    return P.nearest_palette(colours(spark, sf_dir), palettes(spark, sf_dir))


@query("j2_palette_drift", "pixels", f"""WITH {OWN_SQL} SELECT frame_key, clip_id, {RGBA} AS colour, count(*) AS pixels, CASE WHEN lacking THEN 'NO_PALETTE' ELSE 'PALETTE_DRIFT' END AS code
  FROM pixels JOIN own USING (clip_id) WHERE NOT {IN_OWN} GROUP BY frame_key, clip_id, r, g, b, a, lacking""")
def j2(spark, sf_dir):
    return P.palette_drift(colours(spark, sf_dir), palettes(spark, sf_dir))


@query("j6_block_match", "pixels runtime_pixels", """SELECT s.frame_key, s.clip_id, CAST(count(*) FILTER ((s.r,s.g,s.b,s.a)<>(o.r,o.g,o.b,o.a)) AS INT) AS mismatches,
  count(*) FILTER ((s.r,s.g,s.b,s.a)<>(o.r,o.g,o.b,o.a))=0 AS matches
  FROM pixels s LEFT JOIN runtime_pixels o ON s.frame_key=o.frame_key AND s.x=o.x//2 AND s.y=o.y//2 GROUP BY s.frame_key, s.clip_id""")
def j6(spark, sf_dir):
    return compare.block_match(X.packed_frames(spark, sf_dir), X.runtime_frames(spark, sf_dir), 2)


@query("j7_translated_match", "pixels runtime_pixels", """WITH shifted AS (SELECT frame_key, x*2+dx+2 AS x, y*2+dy-2 AS y, r, g, b, a
    FROM pixels, (VALUES (0),(1)) u(dx), (VALUES (0),(1)) w(dy) WHERE a>0),
  both_sides AS (SELECT o.frame_key, o.clip_id, (coalesce(s.r,0),coalesce(s.g,0),coalesce(s.b,0),coalesce(s.a,0))<>(o.r,o.g,o.b,o.a) AS wrong
    FROM runtime_pixels o LEFT JOIN shifted s ON s.frame_key=o.frame_key AND s.x=o.x AND s.y=o.y)
  SELECT frame_key, clip_id, CAST(count(*) FILTER (wrong) AS INT) AS mismatches, count(*) FILTER (wrong)=0 AS matches FROM both_sides GROUP BY frame_key, clip_id""")
def j7(spark, sf_dir):
    return compare.translated_match(
        X.packed_frames(spark, sf_dir), X.runtime_frames(spark, sf_dir), F.lit(1), F.lit(-1), scale=2
    )


SHEET_SQL = """sheet AS (SELECT clip_id, (idx%4)*8+x AS x, (idx//4)*8+y AS y, CASE WHEN b=100 THEN 1 ELSE r END AS r, g, b, a FROM indexed_pixels
  UNION ALL SELECT clip_id, ((SELECT count(*) FROM frames f WHERE f.clip_id=p.clip_id)%4)*8+x, ((SELECT count(*) FROM frames f WHERE f.clip_id=p.clip_id)//4)*8+y, r, g, b, a
  FROM indexed_pixels p WHERE b=196)"""


@query("j8_sheet_match", "indexed_pixels", f"""WITH {SHEET_SQL}, cells AS (SELECT clip_id, (y//8)*4+x//8 AS idx, x%8 AS x, y%8 AS y, (r,g,b,a) AS s, a FROM sheet),
  j AS (SELECT coalesce(c.clip_id,p.clip_id) AS clip_id, coalesce(c.idx,p.idx) AS idx, c.s, c.a, (p.r,p.g,p.b,p.a) AS f, p.frame_key IS NOT NULL AS known, c.clip_id IS NOT NULL AS drawn
    FROM cells c FULL JOIN indexed_pixels p ON c.clip_id=p.clip_id AND c.idx=p.idx AND c.x=p.x AND c.y=p.y)
  SELECT clip_id, idx, count(*) FILTER (known AND (NOT drawn OR s<>f)) AS mismatches, count(*) FILTER (NOT known AND a>0) AS bleed FROM j
  GROUP BY clip_id, idx HAVING mismatches>0 OR bleed>0""")
def j8(spark, sf_dir):
    from framelake.operators.ordered import Scan, ordered_scan

    frames = ordered_scan(X.frames(spark, sf_dir), ["clip_id"], ["idx"], [Scan("frames", "total")])
    indexed = X.pixels(spark, sf_dir).join(frames.select("frame_key", "idx", "frames"), "frame_key")
    at = lambda cell: [
        "clip_id", ((cell % 4) * 8 + F.col("x")).cast("int").alias("x"),
        (F.floor(cell / 4) * 8 + F.col("y")).cast("int").alias("y"),
    ]
    drawn = indexed.select(*at(F.col("idx")), F.when(F.col("b") == 100, 1).otherwise(F.col("r")).alias("r"), "g", "b", "a")
    stray = indexed.filter("b=196").select(*at(F.col("frames")), "r", "g", "b", "a")
    return compare.sheet_match(drawn.unionByName(stray), indexed, 4, SIDE, SIDE)


@query("j9_preview_match", "pixels frames", f"""WITH fr AS (SELECT f.clip_id, f.idx, f.frame_key, h.sha256, CAST(20+(f.frame_key*37)%180 AS BIGINT) AS duration_ms
    FROM frames f JOIN ({FRAME_SHA}) h USING (frame_key)),
  pg AS (SELECT f.clip_id, f.idx, h.sha256, (CAST(20+(f.frame_key*37)%180 AS BIGINT)//10)*10 AS delay_ms FROM frames f JOIN (
    SELECT frame_key, sha256(unhex(replace(string_agg({HEXES}, '' ORDER BY y, x),'a85764ff','a05f40ff'))) AS sha256 FROM pixels GROUP BY frame_key) h USING (frame_key))
  SELECT clip_id, idx, 'PREVIEW_MISMATCH' AS code, field, delay_ms, duration_ms FROM (
    SELECT *, CASE WHEN pg.sha256 IS NULL OR fr.sha256 IS NULL THEN 'pages' WHEN pg.sha256<>fr.sha256 THEN 'pixels' WHEN delay_ms<>duration_ms THEN 'delays' END AS field
    FROM pg FULL JOIN fr USING (clip_id, idx)) WHERE field IS NOT NULL""")
def j9(spark, sf_dir):
    duration = (20 + (F.col("frame_key") * 37) % 180).cast("long")
    packed = X.packed_frames(spark, sf_dir).drop("clip_id").join(X.frames(spark, sf_dir), "frame_key")
    frames = packed.select("clip_id", "idx", F.sha2("rgba", 256).alias("sha256"), duration.alias("duration_ms"))
    quantised = F.unhex(F.replace(F.lower(F.hex("rgba")), F.lit("a85764ff"), F.lit("a05f40ff")))
    pages = packed.select(
        "clip_id", "idx", F.sha2(quantised, 256).alias("sha256"), (F.floor(duration / 10) * 10).cast("long").alias("delay_ms")
    )
    return compare.preview_match(pages, frames)


@query("u2_palette_diff", "pixels", """SELECT frame_key, r, g, b, a, left_n, right_n FROM (
  SELECT frame_key, r, g, b, a, CAST(sum(l) AS BIGINT) AS left_n, CAST(sum(rn) AS BIGINT) AS right_n FROM (
    SELECT frame_key, r, g, b, a, 1 AS l, 0 AS rn FROM pixels
    UNION ALL SELECT frame_key, CASE WHEN b=100 THEN 127 ELSE r END, CASE WHEN b=100 THEN 127 ELSE g END, b, a, 0, 1 FROM pixels)
  GROUP BY frame_key, r, g, b, a) WHERE left_n<>right_n""")
def u2(spark, sf_dir):
    base = X.pixels(spark, sf_dir)
    blended = base.withColumns({c: F.when(F.col("b") == 100, 127).otherwise(F.col(c)) for c in "rg"})
    return compare.palette_difference(
        P.frame_colours(base, SIDE, SIDE), P.frame_colours(blended, SIDE, SIDE), ["frame_key"]
    )


OVER = """SELECT *, CASE WHEN ta=255 THEN tr WHEN ta=0 THEN ur ELSE CAST(floor((tr*ta*255+ur*ua*(255-ta))/CAST(ta*255+ua*(255-ta) AS DOUBLE)+0.5) AS INT) END AS nr,
  CASE WHEN ta=255 THEN tg WHEN ta=0 THEN ug ELSE CAST(floor((tg*ta*255+ug*ua*(255-ta))/CAST(ta*255+ua*(255-ta) AS DOUBLE)+0.5) AS INT) END AS ng,
  CASE WHEN ta=255 THEN tb WHEN ta=0 THEN ub ELSE CAST(floor((tb*ta*255+ub*ua*(255-ta))/CAST(ta*255+ua*(255-ta) AS DOUBLE)+0.5) AS INT) END AS nb,
  CASE WHEN ta=255 THEN ta WHEN ta=0 THEN ua ELSE CAST(floor((ta*255+ua*(255-ta))/255.0+0.5) AS INT) END AS na FROM """


def indexed_frames(spark, sf_dir):
    """The packed frames with their position inside the clip."""
    return X.packed_frames(spark, sf_dir).join(X.frames(spark, sf_dir).select("frame_key", "idx"), "frame_key")


@query("h4_alpha_over", "indexed_pixels", f"""WITH pairs AS (SELECT frame_key, x, y, r AS tr, g AS tg, b AS tb, a AS ta,
    lag(r) OVER p AS ur, lag(g) OVER p AS ug, lag(b) OVER p AS ub, lag(a) OVER p AS ua FROM indexed_pixels WINDOW p AS (PARTITION BY clip_id, x, y ORDER BY idx))
  SELECT frame_key, x, y, nr AS r, ng AS g, nb AS b, na AS a FROM ({OVER} pairs WHERE ua IS NOT NULL)""")
def h4(spark, sf_dir):
    indexed = indexed_frames(spark, sf_dir)
    under = indexed.select("clip_id", (F.col("idx") + 1).alias("idx"), F.col("rgba").alias("under"))
    pairs = indexed.join(under, ["clip_id", "idx"])
    return P.explode_pixels(composite.alpha_over_frames(pairs).select("frame_key", "width", "height", "rgba"), ("frame_key",))


LAYERS = ", ".join(f"max({c}) FILTER (WHERE idx%3={k}) AS {c}{k}" for k in range(3) for c in "rgba")


@query("h5_composite_layers", "indexed_pixels", f"""WITH l AS (SELECT clip_id, idx//3 AS grp, x, y, {LAYERS} FROM indexed_pixels GROUP BY clip_id, idx//3, x, y),
  p1 AS (SELECT *, coalesce(r1,0) AS tr, coalesce(g1,0) AS tg, coalesce(b1,0) AS tb, coalesce(a1,0) AS ta,
    CASE WHEN a0=0 THEN 0 ELSE r0 END AS ur, CASE WHEN a0=0 THEN 0 ELSE g0 END AS ug, CASE WHEN a0=0 THEN 0 ELSE b0 END AS ub, a0 AS ua FROM l),
  s1 AS (SELECT clip_id, grp, x, y, nr AS ur, ng AS ug, nb AS ub, na AS ua, coalesce(r2,0) AS tr, coalesce(g2,0) AS tg, coalesce(b2,0) AS tb, coalesce(a2,0) AS ta FROM ({OVER} p1))
  SELECT clip_id, grp, x, y, nr AS r, ng AS g, nb AS b, na AS a FROM ({OVER} s1)""")
def h5(spark, sf_dir):
    layers = indexed_frames(spark, sf_dir).withColumn("grp", F.floor(F.col("idx") / 3).cast("long"))
    return P.explode_pixels(composite.composite_layers(layers, ["clip_id", "grp"], "idx"), ("clip_id", "grp"))


@query("w15_replay_disposal", "indexed_pixels", f"""WITH RECURSIVE prog AS (SELECT clip_id, idx//8 AS anim, idx%8 AS step, x, y, r, g, b, a,
    x>=clip_id%3 AND y>=(idx%2) AS inside, CASE idx%3 WHEN 0 THEN 'none' WHEN 1 THEN 'background' ELSE 'previous' END AS dispose,
    CASE WHEN idx%2=0 THEN 'source' ELSE 'over' END AS blend FROM indexed_pixels),
  st AS (SELECT clip_id, anim, x, y, -1::BIGINT AS step, 0 AS ur, 0 AS ug, 0 AS ub, 0 AS ua, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM prog WHERE step=0
    UNION ALL SELECT clip_id, anim, x, y, step, CASE WHEN inside AND dispose='background' THEN 0 WHEN dispose='previous' THEN ur ELSE r2 END,
      CASE WHEN inside AND dispose='background' THEN 0 WHEN dispose='previous' THEN ug ELSE g2 END,
      CASE WHEN inside AND dispose='background' THEN 0 WHEN dispose='previous' THEN ub ELSE b2 END,
      CASE WHEN inside AND dispose='background' THEN 0 WHEN dispose='previous' THEN ua ELSE a2 END, r2, g2, b2, a2 FROM (
      SELECT *, CASE WHEN NOT inside THEN ur WHEN blend='source' THEN tr ELSE nr END AS r2, CASE WHEN NOT inside THEN ug WHEN blend='source' THEN tg ELSE ng END AS g2,
        CASE WHEN NOT inside THEN ub WHEN blend='source' THEN tb ELSE nb END AS b2, CASE WHEN NOT inside THEN ua WHEN blend='source' THEN ta ELSE na END AS a2 FROM (
        {OVER} (SELECT s.clip_id, s.anim, s.x, s.y, p.step, ur, ug, ub, ua, p.r AS tr, p.g AS tg, p.b AS tb, p.a AS ta, inside, dispose, blend
          FROM st s JOIN prog p ON p.clip_id=s.clip_id AND p.anim=s.anim AND p.x=s.x AND p.y=s.y AND p.step=s.step+1))))
  SELECT clip_id, anim, x, y, step, r, g, b, a FROM st WHERE step>=0""")
def w15(spark, sf_dir):
    indexed = indexed_frames(spark, sf_dir)
    x, y = (F.col("clip_id") % 3).cast("int"), (F.col("idx") % 2).cast("int")
    # The part of each frame from (x, y) on, as a patch that starts there.
    patch = F.expr(f"array_join(transform(sequence(y, {SIDE - 1}), i -> substring(hex(rgba), 8*({SIDE}*i+x)+1, 8*({SIDE}-x))), '')")
    frames = indexed.withColumns({"x": x, "y": y}).select(
        "clip_id", F.floor(F.col("idx") / 8).cast("long").alias("anim"), (F.col("idx") % 8).alias("step"),
        F.lit(SIDE).alias("canvas_w"), F.lit(SIDE).alias("canvas_h"),
        F.col("x").alias("rect_x"), F.col("y").alias("rect_y"), (SIDE - F.col("x")).alias("rect_w"), (SIDE - F.col("y")).alias("rect_h"),
        F.element_at(F.array(F.lit("none"), F.lit("background"), F.lit("previous")), (F.col("idx") % 3 + 1).cast("int")).alias("dispose"),
        F.when(F.col("idx") % 2 == 0, "source").otherwise("over").alias("blend"), F.unhex(patch).alias("rgba"),
    )
    tiles = composite.replay_disposal(frames, ["clip_id", "anim"])
    return P.explode_pixels(composite.whole_pages(tiles, ["clip_id", "anim"]), ("clip_id", "anim", "step"))


# Oracle components: every foreground pixel reaches the smallest raster index of its component.
COMPONENTS = """WITH RECURSIVE fg AS (SELECT frame_key, clip_id, x, y, y*8+x AS i FROM pixels WHERE a<>0),
  reach AS (SELECT frame_key, i AS root, x, y FROM fg
    UNION SELECT n.frame_key, root, n.x, n.y FROM reach c JOIN fg n ON n.frame_key=c.frame_key AND abs(n.x-c.x)+abs(n.y-c.y)=1),
  labelled AS (SELECT frame_key, x, y, min(root) AS label FROM reach GROUP BY frame_key, x, y),
  comp AS (SELECT l.frame_key, clip_id, CAST(label AS BIGINT) AS label, count(*) AS pixel_count, min(l.x) AS l, min(l.y) AS t, max(l.x) AS r, max(l.y) AS b,
    avg(l.x) AS cx, avg(l.y) AS cy FROM labelled l JOIN fg USING (frame_key, x, y) GROUP BY l.frame_key, clip_id, label),
  named AS (SELECT *, pixel_count<3 AS noise, concat(CASE WHEN pixel_count<3 THEN 'noise-' ELSE 'component-' END,
    printf('%04d', row_number() OVER (PARTITION BY frame_key, pixel_count<3 ORDER BY label))) AS component_id FROM comp)"""


def runs(spark, sf_dir):
    key = F.struct(*[F.lit(0).alias(c) for c in C.CHANNELS])
    return components.component_runs(X.packed_frames(spark, sf_dir), key)


@query("a4_connected_components", "pixels", f"{COMPONENTS} SELECT frame_key, clip_id, label, pixel_count FROM comp")
def a4(spark, sf_dir):
    return components.component_stats(runs(spark, sf_dir)).select("frame_key", "clip_id", "label", "pixel_count")


@query("a4_tiled_components", "pixels", f"{COMPONENTS} SELECT frame_key, clip_id, label, pixel_count, l AS left, t AS top, r AS right, b AS bottom FROM comp")
def a4_tiled(spark, sf_dir):
    """The frames as boards of four tiles."""
    key = F.struct(*[F.lit(0).alias(c) for c in C.CHANNELS])
    found = tiles.tiled_runs(tiles.cut_tiles(X.packed_frames(spark, sf_dir), 5), key, side=5)
    return components.component_stats(found).select("frame_key", "clip_id", "label", "pixel_count", "left", "top", "right", "bottom")


@query("a5_component_stats", "pixels", f"""{COMPONENTS} SELECT frame_key, clip_id, label, component_id, pixel_count, l AS left, t AS top, r AS right, b AS bottom,
  round(cx,6) AS centroid_x, round(cy,6) AS centroid_y, noise FROM named""")
def a5(spark, sf_dir):
    stats = components.component_stats(runs(spark, sf_dir), minimum=3)
    return stats.withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@query("a5_component_hash", "pixels", f"""{COMPONENTS} SELECT l.frame_key, CAST(label AS BIGINT) AS label, sha256('['||string_agg('{{"rgba":['||concat_ws(',',r,g,b,a)||'],"x":'||x||',"y":'||y||'}}', ',' ORDER BY y, x)||']') AS pixel_sha256
  FROM labelled l JOIN pixels p USING (frame_key, x, y) GROUP BY l.frame_key, label""")
def a5_hash(spark, sf_dir):
    key = F.struct(*[F.lit(0).alias(c) for c in C.CHANNELS])
    return components.component_hash(X.packed_frames(spark, sf_dir), key)


@query("a6_retain_components", "pixels", f"""{COMPONENTS}, k AS (SELECT *, pixel_count>=3 AND row_number() OVER (PARTITION BY frame_key ORDER BY pixel_count DESC, label)=1 AS kept FROM comp)
  SELECT frame_key, count(label) AS component_count, count(*) FILTER (pixel_count>=3) AS eligible_count, count(*) FILTER (kept) AS retained_count,
  CAST(coalesce(sum(pixel_count) FILTER (kept),0) AS BIGINT) AS retained_pixels, min(l) FILTER (kept) AS left, min(t) FILTER (kept) AS top,
  max(r) FILTER (kept) AS right, max(b) FILTER (kept) AS bottom, CASE WHEN count(*) FILTER (pixel_count>=3)=0 THEN 'NO_COMPONENT' END AS code
  FROM (SELECT DISTINCT frame_key FROM pixels) LEFT JOIN k USING (frame_key) GROUP BY frame_key""")
def a6(spark, sf_dir):
    return components.retain_components(components.component_stats(runs(spark, sf_dir)), "largest", 3, X.packed_frames(spark, sf_dir))


@query("a6_retained_pixels", "pixels", f"""{COMPONENTS}, k AS (SELECT * FROM comp WHERE pixel_count>=3 QUALIFY row_number() OVER (PARTITION BY frame_key ORDER BY pixel_count DESC, label)=1),
  g AS (SELECT k.frame_key, k.l, k.t, k.r-k.l+1 AS w, k.b-k.t+1 AS h, string_agg(CASE WHEN m.label=k.label THEN p.hex ELSE '00000000' END, '' ORDER BY p.y, p.x) AS hex
    FROM k JOIN (SELECT *, {HEXES} AS hex FROM pixels) p ON p.frame_key=k.frame_key AND p.x BETWEEN k.l AND k.r AND p.y BETWEEN k.t AND k.b LEFT JOIN labelled m ON m.frame_key=p.frame_key AND m.x=p.x AND m.y=p.y GROUP BY ALL)
  SELECT e.frame_key, clip_id, l AS left, t AS top, CAST(w AS INT) AS width, CAST(h AS INT) AS height, sha256(unhex(hex)) AS sha256, CASE WHEN g.frame_key IS NULL THEN 'NO_COMPONENT' END AS code
  FROM {EVERY} e LEFT JOIN g ON g.frame_key=e.frame_key""")
def a6_pixels(spark, sf_dir):
    key = F.struct(*[F.lit(0).alias(c) for c in C.CHANNELS])
    return digest(components.retained_pixels(X.packed_frames(spark, sf_dir), key, "largest", 3))


CANDIDATES = f"""{COMPONENTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY pixel_count DESC, label) AS rk FROM named WHERE NOT noise),
  tagged AS (SELECT *, CASE WHEN rk<=2 THEN 'candidate-0001' END AS gid FROM ranked),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY frame_key, gid IS NULL ORDER BY label) AS nth FROM tagged),
  ids AS (SELECT *, coalesce(gid, 'candidate-'||printf('%04d', nth+1)) AS cid FROM numbered),
  cands AS (SELECT frame_key, cid AS candidate_id, string_agg(component_id, ',' ORDER BY component_id) AS component_ids, CAST(sum(pixel_count) AS BIGINT) AS pixel_count,
    min(l) AS left, min(t) AS top, max(r) AS right, max(b) AS bottom, sum(cx*pixel_count)/sum(pixel_count) AS centroid_x, sum(cy*pixel_count)/sum(pixel_count) AS centroid_y
    FROM ids GROUP BY frame_key, cid)"""


def candidates(spark, sf_dir, frames=None):
    stats = components.component_stats(runs(spark, sf_dir), minimum=3)
    pairs = components.ranked_components(stats.filter(~F.col("noise"))).filter("size_rank<=2")
    groups = pairs.select("frame_key", F.lit("candidate-0001").alias("group_id"), "component_id")
    return components.build_candidates(stats, groups, 1, 4, frames)


@query("a7_candidates", "pixels", f"""{CANDIDATES} SELECT frame_key, candidate_id, component_ids, pixel_count, "left", top, "right", bottom, round(centroid_x,6) AS centroid_x,
  round(centroid_y,6) AS centroid_y, count(candidate_id) OVER (PARTITION BY frame_key) BETWEEN 1 AND 4 AS count_in_range FROM (SELECT DISTINCT frame_key FROM pixels) LEFT JOIN cands USING (frame_key)""")
def a7(spark, sf_dir):
    return candidates(spark, sf_dir, X.packed_frames(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})


@query("t2_largest_component", "pixels", f"""{COMPONENTS} SELECT frame_key, label, pixel_count FROM (
  SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY pixel_count DESC, label) AS rk FROM comp) WHERE rk=1""")
def t2(spark, sf_dir):
    ranked = components.ranked_components(components.component_stats(runs(spark, sf_dir)))
    return ranked.filter("size_rank=1").select("frame_key", "label", "pixel_count")


@query("w8_row_major_order", "pixels", f"""{CANDIDATES}, opened AS (SELECT *, CASE WHEN top<=max(bottom) OVER (PARTITION BY frame_key ORDER BY top, round(centroid_y,6), candidate_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM cands),
  banded AS (SELECT *, CAST(sum(o) OVER (PARTITION BY frame_key ORDER BY top, round(centroid_y,6), candidate_id) AS BIGINT) AS band FROM opened)
  SELECT frame_key, candidate_id, band, CAST(row_number() OVER (PARTITION BY frame_key ORDER BY band, round(centroid_x,6), round(centroid_y,6), candidate_id) AS INT) AS position FROM banded""")
def w8(spark, sf_dir):
    rounded = candidates(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("centroid_x", "centroid_y")})
    return components.row_major_order(rounded).select("frame_key", "candidate_id", "band", "position")
