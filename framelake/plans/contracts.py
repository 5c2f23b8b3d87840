"""Queries over contracts, projects, edits, sources, selections and approvals."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from framelake import schemas
from framelake.operators import contracts as R
from framelake.plans import fixtures as X
from framelake.plans.catalog import query
from framelake.plans.timelines import motion_frames, stamped
from framelake.sources import contracts as read

PALETTE = [[0, 0, 0, 0], [20, 30, 60, 255], [200, 40, 40, 255]]
PALETTE_SHA = hashlib.sha256(json.dumps(PALETTE, separators=(",", ":")).encode()).hexdigest()
RGBA_SQL = "array(array(0,0,0,0),array(20,30,60,255),array(200,40,40,255))"
HEX_SQL = "array('141e3c','c82828')"


def contract_documents(spark, sf_dir):
    """One version-2 contract document per order, with faults that follow from the order's values."""
    return X.spread_table(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        "o_orderkey AS contract_id",
        f"""to_json(named_struct('version', CASE WHEN o_orderpriority='5-LOW' AND o_orderstatus='P' THEN 1 ELSE 2 END,
  'selectionApprovalSha256', sha2(CAST(o_orderkey AS STRING),256),
  'character', named_struct('id', concat(CASE WHEN o_orderstatus='P' THEN 'Hero-' ELSE 'hero-' END, o_orderkey), 'anchorSha256', sha2('anchor',256)),
  'canvas', named_struct('width',32,'height',32,'pivot',named_struct('x',CAST(floor(o_totalprice) AS INT)%40,'y',28),'baseline',27),
  'scale', named_struct('integer',2,'runtime',named_struct('width',CASE WHEN o_totalprice>400000 THEN 66 ELSE 64 END,'height',64)),
  'palette', named_struct('rgba',{RGBA_SQL},'sha256',CASE WHEN o_orderstatus='O' AND o_orderpriority='1-URGENT' THEN sha2('x',256) ELSE '{PALETTE_SHA}' END,'snapperPaletteHex',{HEX_SQL}),
  'tracks', array(named_struct('id','actor','kind','actor','required',true,'attachTo',CAST(NULL AS STRING)), named_struct('id','prop','kind','prop','required',false,'attachTo','hand')),
  'sockets', CASE WHEN o_totalprice<50000 THEN CAST(array() AS ARRAY<STRUCT<id:STRING,trackId:STRING,required:BOOLEAN>>) ELSE array(named_struct('id','hand','trackId','actor','required',true)) END,
  'contacts', array(named_struct('id','left-foot','trackId','actor','kind','planted-foot','required',true)),
  'clips', array(named_struct('id','walk','loopMode','loop','frames', transform(sequence(1,CAST(1+o_custkey%4 AS INT)), i -> named_struct('id',concat('f',i),'semantic','step',
    'duration',CAST((floor(o_totalprice)+i*37)%200 AS INT),'tracks',CASE WHEN i=3 THEN array('prop') ELSE array('actor','prop') END,'sockets',array('hand'),
    'contacts',CASE WHEN i=2 AND o_custkey%5=0 THEN array('right-foot') ELSE array('left-foot') END,'groundTravel',named_struct('x',0,'y',i))))),
  'review', named_struct('checkpoints',array('final-preview'),'approvers',array('owner')))) AS document""",
    )


@query("v2_validate_contract_v2", "", """WITH o AS (SELECT o_orderkey AS contract_id, *, CAST(floor(o_totalprice) AS BIGINT) AS tp, 1+o_custkey%4 AS n FROM orders)
  SELECT contract_id, 'version' AS code FROM o WHERE o_orderpriority='5-LOW' AND o_orderstatus='P'
  UNION ALL SELECT contract_id, 'character-id' FROM o WHERE o_orderstatus='P'
  UNION ALL SELECT contract_id, 'canvas-pivot' FROM o WHERE tp%40>=32
  UNION ALL SELECT contract_id, 'scale-runtime' FROM o WHERE o_totalprice>400000
  UNION ALL SELECT contract_id, 'palette-hash' FROM o WHERE o_orderstatus='O' AND o_orderpriority='1-URGENT'
  UNION ALL SELECT contract_id, c FROM o, (VALUES ('track-socket'),('frame-socket')) v(c) WHERE o_totalprice<50000
  UNION ALL SELECT DISTINCT contract_id, 'frame-duration' FROM o, range(1,5) t(i) WHERE i<=n AND (tp+i*37)%200<11
  UNION ALL SELECT contract_id, c FROM o, (VALUES ('frame-actor'),('frame-required-track')) v(c) WHERE n>=3
  UNION ALL SELECT contract_id, 'frame-contact' FROM o WHERE n>=2 AND o_custkey%5=0""")
def v2(spark, sf_dir):
    return R.contract_v2_failures(read.parse_contracts(contract_documents(spark, sf_dir)))


@query("s5_read_contracts", "", """WITH o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS tp FROM orders)
  SELECT o_orderkey AS contract_id, 'walk' AS clip_id, CAST(i-1 AS INT) AS idx, 'f'||i AS frame_id, CAST((tp+i*37)%200 AS INT) AS duration_ms,
   CAST(k AS INT) AS ord, CASE WHEN i=3 THEN 'prop' WHEN k=0 THEN 'actor' ELSE 'prop' END AS member, CAST(i AS INT) AS ground_y
  FROM o, range(1,5) t(i), range(0,2) u(k) WHERE i<=1+o_custkey%4 AND NOT (i=3 AND k=1)""")
def s5(spark, sf_dir):
    frames = read.clip_frames(read.parse_contracts(contract_documents(spark, sf_dir)))
    return frames.select(
        "contract_id", "clip_id", "idx", "frame_id", "duration_ms", F.posexplode_outer("tracks").alias("ord", "member"), "ground_y"
    )


def contract_v1_documents(spark, sf_dir):
    """One version-1 contract per part."""
    return X.spread_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey AS contract_id",
        f"""to_json(named_struct('version',1,'anchor',named_struct('sha256',sha2(p_name,256),'traitReferenceSha256',CASE WHEN p_size=7 THEN array(sha2('a',256),sha2('a',256)) ELSE array(sha2('a',256)) END),
  'sizes',named_struct('canonical',array(128,128),'generation',array(1024,1024),'runtime',array(256,CASE WHEN p_size>45 THEN 255 ELSE 256 END),'pixelSize',8),
  'pivot',named_struct('x',64,'y',112),'baseline',CASE WHEN p_retailprice>1900 THEN 112 ELSE 111 END,
  'palette',named_struct('rgba',{RGBA_SQL},'sha256','{PALETTE_SHA}','snapperPaletteHex',CASE WHEN p_size<4 THEN array('141e3c') ELSE {HEX_SQL} END),
  'clips',array(named_struct('id','idle','loopMode',CASE WHEN p_size%2=0 THEN 'loop' ELSE 'once' END,
    'loopTransition',CASE WHEN p_size%3=0 THEN NULL ELSE named_struct('fromFrameId',concat('f',1+p_size%5),'toFrameId','f1','reviewCheckpoint','final-preview') END,
    'frames',transform(sequence(1,1+p_size%5), i -> named_struct('id',concat('f',i),'pose',CASE WHEN p_size>40 THEN 'stand' ELSE concat('pose',i) END,'duration',p_size*i,
      'landmarkSemantic',named_struct('name','root','target',named_struct('x',64,'y',112)))))),
  'review',named_struct('checkpoints',array('final-preview'),'approvers',array('owner')))) AS document""",
    )


@query("v1_validate_contract_v1", "", """SELECT p_partkey AS contract_id, 'anchor-traits' AS code FROM part WHERE p_size=7
  UNION ALL SELECT p_partkey, 'sizes' FROM part WHERE p_size>45
  UNION ALL SELECT p_partkey, 'baseline' FROM part WHERE p_retailprice>1900
  UNION ALL SELECT p_partkey, 'palette-hex' FROM part WHERE p_size<4
  UNION ALL SELECT p_partkey, 'frame-poses' FROM part WHERE p_size>40 AND p_size%5>0
  UNION ALL SELECT p_partkey, 'frame-duration' FROM part WHERE p_size<11
  UNION ALL SELECT p_partkey, 'loop-transition' FROM part WHERE (p_size%2=0)=(p_size%3=0)""")
def v1(spark, sf_dir):
    return R.contract_v1_failures(read.parse_contracts(contract_v1_documents(spark, sf_dir), schemas.CONTRACT_V1))


@query("v3_validate_project", "", """WITH c AS (SELECT *, CAST(floor(abs(c_acctbal)) AS INT) AS bal FROM customer)
  SELECT c_custkey AS project_id, 'logical-height' AS code FROM c WHERE bal%150>127
  UNION ALL SELECT c_custkey, 'canonical-anchor' FROM c WHERE c_mktsegment='BUILDING'
  UNION ALL SELECT c_custkey, 'anchor-fields' FROM c WHERE c_acctbal<0
  UNION ALL SELECT c_custkey, 'source-kinds' FROM c WHERE c_nationkey=3
  UNION ALL SELECT c_custkey, 'action-source' FROM c WHERE c_nationkey IN (3,4)
  UNION ALL SELECT c_custkey, 'action-loop-mode' FROM c WHERE c_nationkey=5
  UNION ALL SELECT c_custkey, 'action-attachment' FROM c WHERE c_nationkey=6
  UNION ALL SELECT c_custkey, 'engine-target' FROM c WHERE c_nationkey=7
  UNION ALL SELECT c_custkey, 'approval-gates' FROM c WHERE c_nationkey=8
  UNION ALL SELECT c_custkey, 'approval-status' FROM c WHERE c_nationkey=9""")
def v3(spark, sf_dir):
    documents = X.spread_table(spark, sf_dir, "customer", "c_custkey").selectExpr(
        "c_custkey AS contract_id",
        f"""to_json(named_struct('schemaVersion',1,'id',concat('project-',c_custkey),
  'character',named_struct('name',c_name,'identity','courier','logicalHeight',1+CAST(floor(abs(c_acctbal)) AS INT)%150,
    'anchors',array(named_struct('id','front','role',CASE WHEN c_mktsegment='BUILDING' THEN 'trait' ELSE 'canonical' END,'path',CASE WHEN c_acctbal<0 THEN '../front.png' ELSE 'anchors/front.png' END,'sha256',sha2(c_name,256)))),
  'canvas',named_struct('width',128,'height',128,'pivot',named_struct('x',64,'y',112),'baseline',111),
  'scale',named_struct('integer',2,'runtime',named_struct('width',256,'height',256)),
  'palette',named_struct('rgba',{RGBA_SQL},'sha256','{PALETTE_SHA}'),
  'tracks',array(named_struct('id','actor','kind','actor','required',true,'attachTo',CAST(NULL AS STRING)), named_struct('id','prop','kind','prop','required',false,'attachTo','hand')),
  'sockets',array(named_struct('id','hand','trackId','actor','required',true)),
  'contacts',array(named_struct('id','left-foot','trackId','actor','kind','planted-foot','required',true)),
  'sources',named_struct('allowedKinds',CASE WHEN c_nationkey=3 THEN array('generated-still') ELSE array('generated-still','png-sequence') END,'defaultStillKind','generated-still'),
  'actions',array(named_struct('id','walk','semantic','walks','loopMode',CASE WHEN c_nationkey=5 THEN 'bounce' ELSE 'loop' END,'poses',array('contact','passing'),'tracks',array('actor','prop'),
    'sockets',CASE WHEN c_nationkey=6 THEN CAST(array() AS ARRAY<STRING>) ELSE array('hand') END,'contacts',array('left-foot'),
    'sources',named_struct('preferred','png-sequence','fallbacks',CASE WHEN c_nationkey=4 THEN array('gif') ELSE array('generated-still') END))),
  'engineTargets',array(named_struct('id','game','kind','godot','version',CASE WHEN c_nationkey=7 THEN CAST(NULL AS STRING) ELSE '4.3' END)),
  'approvals',named_struct('status',CASE WHEN c_nationkey=9 THEN 'done' ELSE 'draft' END,'identities',array('owner'),
    'requiredGates',CASE WHEN c_nationkey=8 THEN array('final-preview') ELSE array('canonical-anchor','annotated-animation','final-preview') END))) AS document""",
    )
    projects = documents.select(
        F.col("contract_id").alias("project_id"), F.from_json("document", schemas.PROJECT).alias("project")
    )
    return R.project_failures(projects)


@query("v7_validate_recovery_contract", "", """SELECT p_partkey AS contract_id, 'background-tolerance' AS code FROM part WHERE p_size*6>255
  UNION ALL SELECT p_partkey, 'background-colour' FROM part WHERE p_size%4=0
  UNION ALL SELECT p_partkey, 'spill-dominance' FROM part WHERE p_size%5=0
  UNION ALL SELECT p_partkey, 'connectivity' FROM part WHERE p_size=9
  UNION ALL SELECT p_partkey, 'candidate-range' FROM part WHERE p_size>20
  UNION ALL SELECT p_partkey, 'group-components' FROM part WHERE p_size=3
  UNION ALL SELECT p_partkey, 'group-membership' FROM part WHERE p_size=5""")
def v7(spark, sf_dir):
    documents = X.spread_table(spark, sf_dir, "part", "p_partkey").selectExpr(
        "p_partkey AS contract_id",
        """to_json(named_struct('schemaVersion',1,'background',named_struct('mode','color','rgba',CASE WHEN p_size%4=0 THEN array(0,256,0,255) ELSE array(0,255,0,255) END,'tolerance',p_size*6,
    'spill',CASE WHEN p_size%5=0 THEN named_struct('minimumDominance',0) END),
  'connectivity',CASE WHEN p_size=9 THEN 8 ELSE 4 END,'minimumComponentPixels',p_size,'maxDecodedRgbaBytes',1048576,'padding',2,
  'expectedCandidates',named_struct('min',p_size,'max',20),'allowUnassigned',true,
  'groups',array(named_struct('id','pair','componentIds',CASE WHEN p_size=3 THEN array('noise-0001') WHEN p_size=5 THEN array('component-0001','component-0001') ELSE array('component-0001','component-0002') END)))) AS document""",
    )
    return R.recovery_contract_failures(read.parse_contracts(documents, schemas.RECOVERY))


@query("v14_closed_schema", "", """SELECT event_id, 'missing' AS problem, 'session' AS field FROM events WHERE event_type<>'click'
  UNION ALL SELECT event_id, 'unknown', 'k' FROM events WHERE event_type='error'
  UNION ALL SELECT event_id, 'missing', 'user' FROM events WHERE event_type='view'""")
def v14(spark, sf_dir):
    documents = X.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE event_type WHEN 'click' THEN concat('{"user":',user_id,',"session":',event_id,'}') WHEN 'error' THEN concat('{"user":',user_id,',"k":1}')
  WHEN 'view' THEN '{}' ELSE concat('{"user":',user_id,'}') END AS document""",
    )
    return R.closed_schema_failures(documents, "event_id", "document", ["user", "session"])


@query("j3_dangling_references", "clip_frames sockets", """SELECT 'socket' AS kind, CAST(socket_id AS VARCHAR) AS ref, count(*) AS uses, min(clip_id) AS first_clip, max(clip_id) AS last_clip
   FROM clip_frames WHERE socket_id NOT IN (SELECT socket_id FROM sockets) GROUP BY socket_id
  UNION ALL SELECT 'track', track_id, count(*), min(clip_id), max(clip_id) FROM clip_frames WHERE track_id NOT IN ('A','N') GROUP BY track_id""")
def j3(spark, sf_dir):
    frames = X.view(spark, sf_dir, "clip_frames")
    both = F.array(
        F.struct(F.lit("socket").alias("kind"), F.col("socket_id").cast("string").alias("ref")),
        F.struct(F.lit("track").alias("kind"), F.col("track_id").alias("ref")),
    )
    references = frames.select("clip_id", F.explode(both).alias("r")).select("clip_id", "r.*")
    sockets = X.view(spark, sf_dir, "sockets").select(F.lit("socket").alias("kind"), F.col("socket_id").cast("string").alias("ref"))
    tracks = X.table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('A','N')").select(
        F.lit("track").alias("kind"), F.col("l_returnflag").alias("ref")
    ).distinct()
    return R.dangling_references(references, sockets.unionByName(tracks))


@query("j4_missing_required", "clip_frames", """WITH m AS (SELECT clip_id, status AS frame_id, bool_or(track_id='A') AS a, bool_or(track_id='N') AS n, bool_or(track_id='R') AS r FROM (SELECT clip_id, status, track_id FROM clip_frames UNION ALL SELECT o_orderkey, s, '' FROM orders, (VALUES ('F'),('O')) v(s)) GROUP BY clip_id, status)
  SELECT clip_id, frame_id, 'A' AS missing_track FROM m WHERE NOT a UNION ALL SELECT clip_id, frame_id, 'N' FROM m WHERE NOT n UNION ALL SELECT clip_id, frame_id, 'R' FROM m WHERE NOT r""")
def j4(spark, sf_dir):
    members = X.view(spark, sf_dir, "clip_frames").select("clip_id", F.col("status").alias("frame_id"), "track_id")
    states = F.explode(F.array(F.lit("F"), F.lit("O"))).alias("frame_id")
    every = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), states)
    return R.missing_required(members, ["A", "N", "R"], every)


@query("j16_selection_disposition", "clip_frames", """WITH c AS (SELECT DISTINCT clip_id, ord, part_id FROM clip_frames), s AS (SELECT clip_id, ord, part_id, count(*) AS n FROM clip_frames WHERE track_id<>'R' GROUP BY ALL),
  m AS (SELECT c.clip_id AS board, c.ord, c.part_id, coalesce(s.n,0) AS n FROM c LEFT JOIN s USING (clip_id, ord, part_id)),
  k AS (SELECT board, ord, sum(n) AS picked, count(*) FILTER (n=0) AS unused FROM m GROUP BY board, ord),
  p AS (SELECT board, part_id, sum(n) AS n FROM m GROUP BY board, part_id),
  x AS (SELECT board, count(*) FILTER (picked>0 AND unused>0) AS partial_candidates FROM k GROUP BY board),
  y AS (SELECT board, count(*) FILTER (n>1) AS shared_components, count(*) FILTER (n=0) AS left_over FROM p GROUP BY board)
  SELECT board, CAST(0 AS BIGINT) AS unknown_candidates, partial_candidates, shared_components, left_over, partial_candidates=0 AND shared_components=0 AS valid,
   partial_candidates=0 AND shared_components=0 AND left_over=0 AS complete FROM x JOIN y USING (board)""")
def j16(spark, sf_dir):
    rows = X.view(spark, sf_dir, "clip_frames").select(
        F.col("clip_id").alias("board"), F.col("ord").alias("candidate_id"), F.col("part_id").alias("component_id"), "track_id"
    )
    return R.selection_disposition(rows, rows.filter("track_id<>'R'"))


@query("v5_validate_edit", "timeline", """WITH e AS (SELECT *, translation_x%2 AS tx FROM timeline)
  SELECT clip_id, idx, 'marker-canvas' AS code FROM e WHERE k%5<>0 AND marker_x>=14
  UNION ALL SELECT clip_id, idx, 'marker-contact' FROM e WHERE k%3=0
  UNION ALL SELECT clip_id, idx, 'contact-reference' FROM e WHERE k%3=0
  UNION ALL SELECT clip_id, idx, 'ground-without-contact' FROM e WHERE k%11=0 AND k%2<>0 AND k%3<>0
  UNION ALL SELECT clip_id, idx, 'transform-opt-in' FROM e WHERE value>50
  UNION ALL SELECT clip_id, idx, 'transform-range' FROM e WHERE value>100
  UNION ALL SELECT clip_id, idx, 'track-actor' FROM e WHERE event_type='view'
  UNION ALL SELECT clip_id, NULL, 'transform-mixed' FROM e GROUP BY clip_id HAVING bool_or(value>50)""")
def v5(spark, sf_dir):
    strings = lambda *v: F.array(*[F.lit(s) for s in v])
    edits = motion_frames(spark, sf_dir).withColumns({
        "transform": F.when(F.col("value") > 50, F.struct(
            F.when(F.col("value") > 100, 9).otherwise(2).alias("scale"), F.lit(1).alias("rotationQuarterTurns"))),
        "tracks": F.when(F.col("event_type") == "view", strings("prop")).otherwise(strings("actor")),
        "canvas_width": F.lit(14), "canvas_height": F.lit(128),
        "action_sockets": strings("hand"), "action_contacts": strings("left-foot"), "action_tracks": strings("actor", "prop"),
    })
    return R.edit_failures(edits)


@query("v6_validate_source", "timeline", """WITH s AS (SELECT *, CAST(coalesce(sum(duration_ms) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS e FROM timeline)
  SELECT clip_id, idx, 'frame-timestamp' AS code FROM s WHERE value>40
  UNION ALL SELECT clip_id, idx, 'frame-id' FROM s WHERE event_type='signup'
  UNION ALL SELECT clip_id, idx, 'frame-rect' FROM s WHERE marker_x+8>20
  UNION ALL SELECT clip_id, idx, 'frame-path' FROM s WHERE event_type='click'
  UNION ALL SELECT s.clip_id, s.idx, 'duplicate-of' FROM s LEFT JOIN s o ON o.clip_id=s.clip_id AND o.frame_id=s.frame_id-s.k*10+s.marker_x*40 WHERE s.k%4=0 AND coalesce(o.idx>=s.idx, true)""")
def v6(spark, sf_dir):
    name = lambda c: F.concat(F.lit("frame-"), c.cast("string"))
    frame_id = F.col("frame_id")
    target = frame_id - F.col("k") * 10 + F.col("marker_x") * 40
    upper = F.when(F.col("event_type") == "signup", F.lit("Frame-")).otherwise(F.lit("frame-"))
    base = stamped(spark, sf_dir).withColumns({
        "path": F.concat(F.when(F.col("event_type") == "click", F.lit("frames//")).otherwise(F.lit("frames/")), frame_id.cast("string"), F.lit(".png")),
        "sha256": F.sha2(frame_id.cast("string"), 256),
        "width": F.lit(20), "height": F.lit(20), "canvas_width": F.lit(20), "canvas_height": F.lit(20),
        "rect_x": F.col("marker_x"), "rect_y": F.lit(0), "rect_w": F.lit(8), "rect_h": F.lit(8),
        "duplicate_of": F.when(F.col("k") % 4 == 0, name(target)),
    }).withColumnRenamed("start_ms", "timestamp_ms")
    plain = base.withColumn("frame_id", name(frame_id))
    # The id check sees the id as written; references use the plain form of the same id.
    ids = R.failing(base.withColumn("written", F.concat(upper, frame_id.cast("string"))), ["clip_id", "idx"],
                    {"frame-id": R.unless(R.S.is_schema_id(F.col("written")))})
    return R.source_failures(plain).unionByName(ids)


@query("v12_validate_landmarks", "timeline", """WITH t AS (SELECT *, 112-(108+k%6) AS dy, 64-marker_x*4 AS dx FROM timeline)
  SELECT clip_id, idx, 'sockets-cover' AS code FROM t WHERE event_type='click'
  UNION ALL SELECT clip_id, idx, 'baseline-drift' FROM t WHERE 107+k%6+dy<>111 OR value>60
  UNION ALL SELECT clip_id, idx, 'named-leaves-canvas' FROM t WHERE translation_x*30+dx NOT BETWEEN 0 AND 127 OR 10+dy<0
  UNION ALL SELECT clip_id, idx, 'planted-off-baseline' FROM t WHERE 107+k%5+dy<>111
  UNION ALL SELECT clip_id, idx, 'ground-travel' FROM t WHERE event_type='view'""")
def v12(spark, sf_dir):
    k = F.col("k")
    landmarks = X.timeline(spark, sf_dir).select(
        "clip_id", "idx",
        (F.col("marker_x") * 4).alias("root_x"), (108 + k % 6).alias("root_y"),
        (107 + k % 6 + F.when(F.col("value") > 60, 1).otherwise(0)).alias("baseline"),
        F.array(F.struct(F.when(F.col("event_type") == "click", F.lit("back")).otherwise(F.lit("hand")).alias("id"),
                         (F.col("translation_x") * 30).alias("x"), F.lit(10).alias("y"))).alias("sockets"),
        F.array(F.struct(F.lit("left-foot").alias("id"), F.lit("planted-foot").alias("kind"),
                         (F.col("marker_x") * 4).alias("x"), (107 + k % 5).alias("y"))).alias("contacts"),
        F.array(F.lit("hand")).alias("want_sockets"), F.array(F.lit("left-foot")).alias("want_contacts"),
        F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")).alias("ground"),
        F.struct(F.when(F.col("event_type") == "view", 1).otherwise(0).alias("x"), F.lit(0).alias("y")).alias("want_ground"),
        F.lit(64).alias("pivot_x"), F.lit(112).alias("pivot_y"),
        F.lit(128).alias("canvas_width"), F.lit(128).alias("canvas_height"), F.lit(111).alias("canvas_baseline"),
    )
    return R.landmark_failures(landmarks)


@query("v13_validate_frame_approval", "timeline", """SELECT clip_id, idx, 'frame' AS code FROM timeline WHERE NOT included OR value<0.5
  UNION ALL SELECT clip_id, idx, 'approver' FROM timeline WHERE event_type='view'
  UNION ALL SELECT clip_id, idx, 'checkpoints' FROM timeline WHERE k%3=0
  UNION ALL SELECT clip_id, idx, 'identity' FROM (SELECT *, count(DISTINCT CASE WHEN event_type='view' THEN 'guest' ELSE 'owner' END) OVER (PARTITION BY clip_id) AS n FROM timeline) WHERE n>1""")
def v13(spark, sf_dir):
    strings = lambda *v: F.array(*[F.lit(s) for s in v])
    approvals = X.timeline(spark, sf_dir).select(
        "clip_id", "idx", "frame_id",
        F.when(F.col("value") < 0.5, F.col("frame_id") + 1).otherwise(F.col("frame_id")).alias("contract_frame_id"),
        F.col("included").alias("approved"),
        F.when(F.col("event_type") == "view", "guest").otherwise("owner").alias("approved_by"),
        strings("owner", "lead").alias("approvers"),
        F.when(F.col("k") % 3 == 0, strings("final-preview", "canonical-anchor")).otherwise(strings("canonical-anchor", "final-preview")).alias("checkpoints"),
        strings("canonical-anchor", "final-preview").alias("contract_checkpoints"),
        F.col("marker_x").alias("x"), F.lit(111).alias("y"),
    )
    return R.frame_approval_failures(approvals)


@query("v19_validate_decisions", "", """SELECT conv_id*1000+turn AS decision_id, 'approver-unknown' AS code FROM conversations WHERE role<>'user'
  UNION ALL SELECT conv_id*1000+turn, 'decision-value' FROM conversations WHERE turn=0
  UNION ALL SELECT conv_id*1000+turn, 'notes-required' FROM conversations WHERE turn%2=1 AND length(text)<100
  UNION ALL SELECT conv_id*1000+turn, 'notes-length' FROM conversations WHERE turn%2=0 AND length(text)>1300""")
def v19(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations")
    text, turn = F.col("text"), F.col("turn")
    decisions = turns.select(
        (F.col("conv_id") * 1000 + turn).alias("decision_id"), F.col("role").alias("approver"),
        F.when(turn == 0, "maybe").when(turn % 2 == 1, "rejected").otherwise("approved").alias("decision"),
        F.when((turn % 2 == 1) & (F.length(text) < 100), F.lit("  "))
        .when((turn % 2 == 0) & (F.length(text) > 1300), F.concat(text, text, text, text)).otherwise(F.lit("fine")).alias("notes"),
    )
    return R.decision_failures(decisions, ["user"])


@query("v20_validate_generation_request", "", """WITH r AS (SELECT l_orderkey*1000+l_linenumber*100+l_suppkey%100 AS request_id, l_returnflag, l_shipmode, o_orderpriority, o_orderstatus, p_brand, p_size FROM (SELECT *, '' AS l_shipmode FROM lineitem) JOIN orders ON o_orderkey=l_orderkey LEFT JOIN part ON p_partkey=l_partkey)
  SELECT request_id, 'project-hash' AS code FROM r WHERE o_orderpriority='5-LOW' AND l_returnflag='A'
  UNION ALL SELECT request_id, 'run-request' FROM r WHERE o_orderstatus='P' OR l_returnflag='R'
  UNION ALL SELECT request_id, 'action-unknown' FROM r WHERE l_returnflag='R'
  UNION ALL SELECT request_id, 'pose-unknown' FROM r WHERE l_returnflag='N' AND p_size>25""")
def v20(spark, sf_dir):
    lines, orders, parts = (X.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    priority = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    sizes = parts.select(F.col("p_partkey").alias("l_partkey"), "p_size")
    flag = F.col("l_returnflag")
    requests = lines.join(priority, "l_orderkey").join(sizes, "l_partkey", "left").select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("request_id"),
        F.col("l_orderkey").alias("run_id"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (flag == "A"), F.lit("other")).otherwise(F.lit("project")).alias("project_sha"),
        F.when(flag == "R", F.lit("dance")).otherwise(F.lit("walk")).alias("action_id"),
        F.when((flag == "N") & (F.col("p_size") > 25), F.lit("jump")).otherwise(F.lit("contact")).alias("pose_id"),
    )
    runs = orders.select(
        F.col("o_orderkey").alias("run_id"), F.lit("project").alias("project_sha"), F.lit("walk").alias("action_id"),
        F.when(F.col("o_orderstatus") == "P", "gif").otherwise("generated-still").alias("kind"),
    )
    actions = orders.select(
        F.when(F.col("o_orderstatus") != "", "walk").alias("action_id"), F.array(F.lit("contact"), F.lit("passing")).alias("poses")
    ).distinct()
    return R.generation_request_failures(requests, runs, actions)
