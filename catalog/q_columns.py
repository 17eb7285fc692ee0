"""Projections, snaps, boxes and array functions."""

from pyspark.sql import functions as F

from catalog.core import R6, query, r6
from catalog.sqlgeo import corner_list, gap, inverse, iou, product, px, py
from fieldmotion.functions import arrays as A
from fieldmotion.functions import boxes as B
from fieldmotion.functions import clips as C
from fieldmotion.functions import field as D
from fieldmotion.functions import geometry as G
from fieldmotion.functions import quality as Q

c = F.col


@query("parse_clip", """
SELECT doc_id, regexp_extract(path, '([^/]+)/(play_[^/]+)/([^/]+)\\.mp4$', 1) AS game,
  regexp_extract(path, '([^/]+)/(play_[^/]+)/([^/]+)\\.mp4$', 2) AS play,
  regexp_extract(path, '([^/]+)/(play_[^/]+)/([^/]+)\\.mp4$', 3) AS view,
  split_part(path, '/', 1)||'/'||split_part(path, '/', 2) AS tag,
  replace(replace(path, '/', '_'), '.mp4', '') AS label_id, path AS back
FROM fx_paths""")
def parse_clip(t):
    p = c("path")
    return t.paths.select("doc_id", *[v.alias(k) for k, v in C.parse_clip(p).items()],
                          C.clip_tag(p).alias("tag"), C.label_id(p).alias("label_id"),
                          C.path_of_label_id(C.label_id(p)).alias("back"))


@query("frame_key", """
SELECT doc_id, path||'#'||frame_idx AS frame_key,
  split_part(path, '/', 1)||'_'||split_part(path, '/', 2)||'_'||lpad(CAST(frame_idx AS VARCHAR), 4, '0') AS thumb_id
FROM fx_paths""")
def frame_key(t):
    return t.paths.select("doc_id", C.frame_key(c("path"), c("frame_idx")).alias("frame_key"),
                          C.thumb_id(c("path"), c("frame_idx")).alias("thumb_id"))


def BOX():
    return c("x1"), c("y1"), c("x2"), c("y2")


BOX_ID = ("clip", "frame_idx", "det_idx")


@query("foot_point", f"""
SELECT clip, frame_idx, det_idx, {R6('(x1+x2)*0.5e0')} AS foot_x, {R6('y1 + 0.95e0*(y2-y1)')} AS foot_y
FROM fx_boxes""")
def foot_point(t):
    x, y = B.foot_point(*BOX())
    return t.boxes.select(*BOX_ID, r6(x).alias("foot_x"), r6(y).alias("foot_y"))


def _box_cols(box, prefix=""):
    return [b.alias(prefix + n) for b, n in zip(box, ("x1", "y1", "x2", "y2"))]


@query("clamp_box", """
SELECT clip, frame_idx, det_idx, CASE WHEN ok THEN a END AS x1, CASE WHEN ok THEN b END AS y1,
  CASE WHEN ok THEN c END AS x2, CASE WHEN ok THEN d END AS y2
FROM (SELECT *, c-a >= 4 AND d-b >= 8 AS ok FROM (
  SELECT clip, frame_idx, det_idx, greatest(CAST(round_even(x1, 0) AS INT), 0) AS a, greatest(CAST(round_even(y1, 0) AS INT), 0) AS b,
    least(CAST(round_even(x2, 0) AS INT), 1280) AS c, least(CAST(round_even(y2, 0) AS INT), 720) AS d FROM fx_boxes))""")
def clamp_box(t):
    return t.boxes.select(*BOX_ID, *_box_cols(B.clamp_box(*BOX())))


@query("jersey_box", """
SELECT clip, frame_idx, det_idx, CASE WHEN ok THEN a END AS x1, CASE WHEN ok THEN b END AS y1,
  CASE WHEN ok THEN c END AS x2, CASE WHEN ok THEN d END AS y2
FROM (SELECT *, bw > 4 AND bh > 8 AND c-a >= 3 AND d-b >= 3 AS ok FROM (
  SELECT clip, frame_idx, det_idx, x2-x1 AS bw, y2-y1 AS bh,
    greatest(CAST(round_even(x1 + 0.2e0*(x2-x1), 0) AS INT), 0) AS a,
    greatest(CAST(round_even(y1 + 0.15e0*(y2-y1), 0) AS INT), 0) AS b,
    least(CAST(round_even(x2 - 0.2e0*(x2-x1), 0) AS INT), 1280) AS c,
    least(CAST(round_even(y1 + 0.5e0*(y2-y1), 0) AS INT), 720) AS d FROM fx_boxes))""")
def jersey_box(t):
    return t.boxes.select(*BOX_ID, *_box_cols(B.jersey_box(*BOX())))


@query("inner_box", """
SELECT clip, frame_idx, det_idx, CASE WHEN ok THEN a END AS x1, CASE WHEN ok THEN b END AS y1,
  CASE WHEN ok THEN c END AS x2, CASE WHEN ok THEN d END AS y2
FROM (SELECT *, bw > 1 AND bh > 1 AND c-a >= 2 AND d-b >= 2 AS ok FROM (
  SELECT clip, frame_idx, det_idx, x2-x1 AS bw, y2-y1 AS bh,
    greatest(CAST(floor(x1 + (x2-x1)*0.2e0) AS INT), 0) AS a, greatest(CAST(floor(y1 + (y2-y1)*0.2e0) AS INT), 0) AS b,
    least(CAST(ceil(x2 - (x2-x1)*0.2e0) AS INT), 1280) AS c, least(CAST(ceil(y2 - (y2-y1)*0.2e0) AS INT), 720) AS d FROM fx_boxes))""")
def inner_box(t):
    return t.boxes.select(*BOX_ID, *_box_cols(B.inner_box(*BOX())))


@query("yolo_to_xyxy", f"""
SELECT clip, frame_idx, det_idx, {R6('(cx - w/2)*1280')} AS x1, {R6('(cy - h/2)*720')} AS y1,
  {R6('(cx + w/2)*1280')} AS x2, {R6('(cy + h/2)*720')} AS y2
FROM (SELECT clip, frame_idx, det_idx, (x1+x2)/2560 AS cx, (y1+y2)/1440 AS cy, (x2-x1)/1280 AS w, (y2-y1)/720 AS h FROM fx_boxes)""")
def yolo_to_xyxy(t):
    n = t.boxes.select(*BOX_ID, ((c("x1") + c("x2")) / 2560).alias("cx"), ((c("y1") + c("y2")) / 1440).alias("cy"),
                       ((c("x2") - c("x1")) / 1280).alias("w"), ((c("y2") - c("y1")) / 720).alias("h"))
    box = B.centre_to_corners(c("cx"), c("cy"), c("w"), c("h"))
    return n.select(*BOX_ID, *_box_cols([r6(b) for b in box]))


_UV = ("(rmse*900+100)", "(n_corrs*20+50)")


def _uv():
    return c("rmse") * 900 + 100, c("n_corrs") * 20 + 50


@query("project", f"""
SELECT clip, frame_idx, {R6(px('h', *_UV))} AS x, {R6(py('h', *_UV))} AS y,
  {R6(px('h', *_UV, 'clamp'))} AS x_clamp, {R6(py('h', *_UV, 'clamp9'))} AS y_clamp9, {R6(px('h', *_UV, 'floor9'))} AS x_floor9
FROM fx_frames""")
def project(t):
    u, v = _uv()
    x, y = G.project(c("h"), u, v)
    return t.frames.select("clip", "frame_idx", r6(x).alias("x"), r6(y).alias("y"),
                           r6(G.project(c("h"), u, v, "clamp")[0]).alias("x_clamp"),
                           r6(G.project(c("h"), u, v, "clamp9")[1]).alias("y_clamp9"),
                           r6(G.project(c("h"), u, v, "floor9")[0]).alias("x_floor9"))


@query("unproject", f"""
SELECT clip, frame_idx, {R6(px('inv', '10+100*rmse', 'n_corrs', 'clamp'))} AS u, {R6(py('inv', '10+100*rmse', 'n_corrs', 'clamp'))} AS v
FROM (SELECT *, {inverse('h')} AS inv FROM fx_frames)""")
def unproject(t):
    u, v = G.unproject(c("h"), 10 + 100 * c("rmse"), c("n_corrs"))
    return t.frames.select("clip", "frame_idx", r6(u).alias("u"), r6(v).alias("v"))


@query("h_inverse", f"""
SELECT clip, frame_idx, {', '.join(f"{R6(f'inv[{i+1}]')} AS i{i}" for i in range(9))},
  {', '.join(f"{R6(f'prod[{i+1}]')} AS p{i}" for i in range(9))}
FROM (SELECT *, {product('h', 'inv')} AS prod FROM (SELECT *, {inverse('h')} AS inv FROM fx_frames))""")
def h_inverse(t):
    d = t.frames.withColumn("inv", G.h_inverse(c("h")))
    d = d.withColumn("prod", G.h_multiply(c("h"), c("inv")))
    return d.select("clip", "frame_idx", *[r6(c("inv")[i]).alias(f"i{i}") for i in range(9)],
                    *[r6(c("prod")[i]).alias(f"p{i}") for i in range(9)])


_K = [1100.0, 0.0, 640.0, 0.0, 1100.0, 360.0, 0.0, 0.0, 1.0]


def _bend_sql():
    """Five fixed-point steps written as nested selects."""
    d0 = "SELECT event_id, u, v, k1, -0.02e0 AS k2, 0.0003e0 AS p1, -0.0002e0 AS p2, 0.001e0 AS k3, (u-640)/1100 AS x0, (v-360)/1100 AS y0, (u-640)/1100 AS x, (v-360)/1100 AS y FROM (SELECT event_id, x*10 AS u, y*13 AS v, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE -0.1e0 END AS k1 FROM fx_yards)"
    for _ in range(5):
        rad = "(1 + k1*(x*x+y*y) + k2*(x*x+y*y)*(x*x+y*y) + k3*(x*x+y*y)*(x*x+y*y)*(x*x+y*y))"
        d0 = (f"SELECT event_id, u, v, k1, k2, p1, p2, k3, x0, y0, (x0 - (2*p1*x*y + p2*((x*x+y*y) + 2*x*x)))/{rad} AS x, "
              f"(y0 - (p1*((x*x+y*y) + 2*y*y) + 2*p2*x*y))/{rad} AS y FROM ({d0})")
    return d0


_RAD0 = "(1 + k1*(x0*x0+y0*y0) + k2*(x0*x0+y0*y0)*(x0*x0+y0*y0) + k3*(x0*x0+y0*y0)*(x0*x0+y0*y0)*(x0*x0+y0*y0))"


@query("undistort", f"""
SELECT event_id, {R6('CASE WHEN abs(k1) > 1e-6 THEN x*1100+640 ELSE u END')} AS u_flat,
  {R6('CASE WHEN abs(k1) > 1e-6 THEN y*1100+360 ELSE v END')} AS v_flat,
  {R6(f'(x0*{_RAD0} + 2*p1*x0*y0 + p2*((x0*x0+y0*y0) + 2*x0*x0))*1100+640')} AS u_bent,
  {R6(f'(y0*{_RAD0} + p1*((x0*x0+y0*y0) + 2*y0*y0) + 2*p2*x0*y0)*1100+360')} AS v_bent
FROM ({_bend_sql()})""")
def undistort(t):
    k = F.array(*[F.lit(v) for v in _K])
    k1 = F.when(c("event_id") % 5 == 0, 0.0).otherwise(-0.1)
    dist = F.array(k1, F.lit(-0.02), F.lit(0.0003), F.lit(-0.0002), F.lit(0.001))
    d = t.yards.select("event_id", (c("x") * 10).alias("u"), (c("y") * 13).alias("v"), k.alias("k"), dist.alias("d"))
    fu, fv = G.undistort(c("u"), c("v"), c("k"), c("d"))
    bu, bv = G.distort(c("u"), c("v"), c("k"), c("d"))
    return d.select("event_id", r6(fu).alias("u_flat"), r6(fv).alias("v_flat"),
                    r6(bu).alias("u_bent"), r6(bv).alias("v_bent"))


@query("on_field", """
SELECT event_id, x >= 8 AND x <= 112 AND y >= -2 AND y <= 53.33e0 + 2 AS inside,
  x >= 10 AND x <= 110 AND y >= 0 AND y <= 53.33e0 AS strict FROM fx_yards""")
def on_field(t):
    return t.yards.select("event_id", G.on_field(c("x"), c("y")).alias("inside"),
                          G.on_field(c("x"), c("y"), 0.0).alias("strict"))


@query("yard_slot", f"""
SELECT event_id, CAST(s AS INT) AS slot, 10e0 + 5*s AS snapped, {R6('abs(x - (10e0 + 5*s))')} AS distance
FROM (SELECT event_id, x, least(greatest(ceil((x-10)/5 - 0.5e0), 0), 20) AS s FROM fx_yards)""")
def yard_slot(t):
    s = D.yard_slot(c("x"))
    return t.yards.select("event_id", s.alias("slot"), D.slot_x(s).alias("snapped"),
                          r6(F.abs(c("x") - D.slot_x(s))).alias("distance"))


@query("snap_classes", f"""
SELECT event_id, least(greatest(k, 0), 20) AS clamped, CASE WHEN k BETWEEN 0 AND 20 THEN k ELSE -1 END AS or_minus,
  {R6('(10e0 + 5*least(greatest(k, 0), 20))/120')} AS share,
  CAST(CASE WHEN k BETWEEN 2 AND 18 AND e BETWEEN 2 AND 18 THEN e ELSE -1 END AS INT) AS number_class,
  CASE WHEN y < 53.33e0*0.5e0 THEN 0 ELSE 1 END AS side_row,
  CASE WHEN abs(y - 23.583e0) < abs(y - (53.33e0 - 23.583e0)) THEN 0 ELSE 1 END AS hash_row,
  CASE WHEN abs(y - 14e0) < abs(y - 39.33e0) THEN 0 ELSE 1 END AS number_row
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN k WHEN x > 10 + k*5 THEN k+1 ELSE k-1 END AS e
  FROM (SELECT event_id, x, y, CAST(round_even((x-10)/5, 0) AS INT) AS k FROM fx_yards))""")
def snap_classes(t):
    k = D.yard_class(c("x"))
    return t.yards.select("event_id", k.alias("clamped"), D.yard_class(c("x"), "minus").alias("or_minus"),
                          r6(D.class_share(k)).alias("share"), D.number_class(c("x")).alias("number_class"),
                          D.side_row(c("y")).alias("side_row"), D.hash_row(c("y")).alias("hash_row"),
                          D.number_row(c("y")).alias("number_row"))


@query("field_number", """
SELECT event_id, n AS painted, CASE WHEN n = 50 THEN '50' ELSE n||CASE WHEN x < 60 THEN 'L' ELSE 'R' END END AS label
FROM (SELECT event_id, x, CAST(trunc(least(x-10, 110-x)) AS INT) AS n FROM fx_yards)""")
def field_number(t):
    return t.yards.select("event_id", D.field_number(c("x")).alias("painted"), D.number_label(c("x")).alias("label"))


_TRAINED = ["10L", "10R", "20L", "20R", "30L", "30R", "40L", "40R", "50"]


@query("class_codes", """
SELECT track_id, [2,4,6,8,10,12,14,16,18][CAST(track_id % 9 AS INT) + 1] AS line_class,
  CAST(coalesce(list_position([2,4,6,8,10,12,14,16,18], CAST(track_id % 21 AS INT)), 0) - 1 AS INT) AS painted_class,
  """ + ", ".join(f"{R6(f'sig[{_TRAINED.index(n) + 1}]')} AS o{i}" for i, n in
                  enumerate(["10L", "20L", "30L", "40L", "50", "40R", "30R", "20R", "10R"])) + " FROM fx_sigs")
def class_codes(t):
    o = D.to_field_order(c("sig"), _TRAINED)
    return t.sigs.select("track_id", D.line_of_painted((c("track_id") % 9).cast("int")).alias("line_class"),
                         D.painted_of_line((c("track_id") % 21).cast("int")).alias("painted_class"),
                         *[r6(o[i]).alias(f"o{i}") for i in range(9)])


@query("keypoint_kind", """
SELECT event_id, kind, 10e0 + 5*slot AS cx, CASE kind WHEN 'near_hash' THEN 23.583e0 WHEN 'far_hash' THEN 53.33e0 - 23.583e0
  WHEN 'sideline_near' THEN 0e0 ELSE 53.33e0 END AS cy
FROM (SELECT event_id, CAST(event_id % 21 AS INT) AS slot,
  CASE WHEN event_id % 2 = 1 THEN CASE WHEN abs(y - (53.33e0 - 23.583e0)) < abs(y - 23.583e0) THEN 'far_hash' ELSE 'near_hash' END
    WHEN y > 53.33e0*0.5e0 THEN 'sideline_far' ELSE 'sideline_near' END AS kind FROM fx_yards)""")
def keypoint_kind(t):
    kind = D.keypoint_kind(c("y"), c("event_id") % 2)
    cx, cy = D.canonical_point(kind, (c("event_id") % 21).cast("int"))
    return t.yards.select("event_id", kind.alias("kind"), cx.alias("cx"), cy.alias("cy"))


EDGES = [10.0, 30.0, 50.0, 70.0, 90.0, 110.0]


@query("stratum", """
SELECT event_id, CASE WHEN x < 10 OR x > 110 THEN -1 WHEN x < 30 THEN 0 WHEN x < 50 THEN 1 WHEN x < 70 THEN 2
  WHEN x < 90 THEN 3 ELSE 4 END AS stratum FROM fx_yards""")
def stratum(t):
    return t.yards.select("event_id", D.stratum(c("x"), EDGES).alias("stratum"))


@query("painted_bucket", f"""
SELECT event_id, CASE WHEN ok THEN b END AS bucket,
  CASE WHEN ok THEN CASE WHEN b = 60 THEN '50' ELSE least(b-10, 110-b)||CASE WHEN b < 60 THEN 'L' ELSE 'R' END END END AS label,
  CASE WHEN ok THEN CASE WHEN dn < df THEN 'near' ELSE 'far' END END AS side,
  {R6('CASE WHEN ok THEN sqrt((x-b)*(x-b) + least(dn,df)*least(dn,df)) END')} AS distance
FROM (SELECT *, x BETWEEN 10 AND 110 AND b BETWEEN 20 AND 100 AND abs(x-b) <= 5 AND least(dn,df) <= 6 AS ok
  FROM (SELECT event_id, x, CAST(round_even(x/10, 0)*10 AS INT) AS b, abs(y-13e0) AS dn, abs(y-40.33e0) AS df FROM fx_yards))""")
def painted_bucket(t):
    p = D.painted_bucket(c("x"), c("y"))
    return t.yards.select("event_id", p["bucket"].alias("bucket"), p["label"].alias("label"), p["side"].alias("side"),
                          r6(p["distance"]).alias("distance"))


@query("allowed_region", """
SELECT event_id, abs(x - round_even(x/5, 0)*5) <= 1 AND y BETWEEN -1 AND 53.33e0+1 AS yard,
  (abs(y) <= 2 OR abs(y - 53.33e0) <= 2) AND x BETWEEN 0 AND 120 AS side,
  (abs(y - 23.583e0) <= 0.5e0 OR abs(y - (53.33e0 - 23.583e0)) <= 0.5e0) AND abs(x - round_even(x, 0)) <= 1 AND x BETWEEN 10 AND 110 AS hash,
  (y BETWEEN 11.5e0 AND 14.5e0 OR y BETWEEN 40.33e0-1.5e0 AND 40.33e0+1.5e0) AND abs(x - round_even(x/10, 0)*10) <= 3.5e0
    AND round_even(x/10, 0)*10 BETWEEN 20 AND 100 AS number
FROM fx_yards""")
def allowed_region(t):
    a = D.allowed_region(c("x"), c("y"))
    return t.yards.select("event_id", *[v.alias(k) for k, v in a.items()])


@query("quantise_conf", f"""
SELECT event_id, CASE WHEN ok THEN q ELSE 0e0 END AS value, ok AS has_value,
  {R6('CASE WHEN ok THEN least(greatest(1 - dev/2.5e0, 0e0), 1e0) ELSE 0e0 END')} AS conf
FROM (SELECT *, q BETWEEN 10 AND 110 AND dev < 3 AS ok FROM (
  SELECT event_id, CAST(round_even(x/5, 0)*5 AS DOUBLE) AS q, abs(x - round_even(x/5, 0)*5) AS dev FROM fx_yards))""")
def quantise_conf(t):
    q = D.quantise_conf(c("x"))
    return t.yards.select("event_id", q["value"].alias("value"), q["has_value"].alias("has_value"), r6(q["conf"]).alias("conf"))


@query("to_canvas", f"SELECT event_id, {R6('x*8')} AS px, {R6('426 - y*8')} AS py FROM fx_yards")
def to_canvas(t):
    px_, py_ = D.to_canvas(c("x"), c("y"))
    return t.yards.select("event_id", r6(px_).alias("px"), r6(py_).alias("py"))


_A4 = ("x1", "y1", "x2", "y2")
_B4 = ("(x1+25)", "(y1+part%40)", "(x2+supp%30)", "(y2+10)")


@query("expanded_iou", f"""
SELECT clip, frame_idx, det_idx, {R6(iou(_A4, _B4, 0.0))} AS plain, {R6(iou(_A4, _B4, 0.3))} AS strict,
  {R6(iou(_A4, _B4, 0.6))} AS relaxed, {R6(iou(_A4, ('x1', 'y1', 'x1', 'y2'), 0.3))} AS flat FROM fx_boxes""")
def expanded_iou(t):
    other = (c("x1") + 25, c("y1") + c("part") % 40, c("x2") + c("supp") % 30, c("y2") + 10)
    flat = (c("x1"), c("y1"), c("x1"), c("y2"))
    return t.boxes.select(*BOX_ID, r6(B.expanded_iou(BOX(), other)).alias("plain"),
                          r6(B.expanded_iou(BOX(), other, 0.3)).alias("strict"),
                          r6(B.expanded_iou(BOX(), other, 0.6)).alias("relaxed"),
                          r6(B.expanded_iou(BOX(), flat, 0.3)).alias("flat"))


@query("chromatic", """
SELECT track_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (h BETWEEN 35 AND 85 AND s > 60) AS BIGINT) AS grass,
  CAST(count(*) FILTER (s < 40 AND v > 150) AS BIGINT) AS white, CAST(count(*) FILTER (v < 50) AS BIGINT) AS dark,
  CAST(count(*) FILTER (s < 60 AND v > 220) AS BIGINT) AS glare,
  CAST(count(*) FILTER (NOT (h BETWEEN 35 AND 85 AND s > 60) AND s > 60 AND v BETWEEN 50 AND 220) AS BIGINT) AS keep
FROM fx_hsv GROUP BY track_id""")
def chromatic(t):
    rules = B.chromatic_rules(c("h"), c("s"), c("v"))
    return t.hsv.groupBy("track_id").agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in rules.items()])


@query("hue_features", f"""
SELECT track_id, h, s, v, {R6('fc')} AS fc, {R6('fs')} AS fs, {R6('((degrees(atan2(fs, fc)) + 360) % 360)/2')} AS back
FROM (SELECT DISTINCT track_id, h, s, v, cos(h/180e0*2*pi())*720 AS fc, sin(h/180e0*2*pi())*720 AS fs FROM fx_hsv)""")
def hue_features(t):
    a, b, _, _ = B.hue_features(c("h"), c("s"), c("v"))
    d = t.hsv.select("track_id", "h", "s", "v").distinct().withColumns({"a": a, "b": b})
    return d.select("track_id", "h", "s", "v", r6(c("a")).alias("fc"), r6(c("b")).alias("fs"),
                    r6(B.features_hue(c("a"), c("b"))).alias("back"))


_SHIFTED = "[h[1]+0.0005e0, h[2], h[3]+rmse, h[4], h[5]-0.0003e0, h[6], h[7], h[8], h[9]]"


def _shifted():
    h = c("h")
    return F.when(h.isNotNull(), F.array(h[0] + 0.0005, h[1], h[2] + c("rmse"), h[3], h[4] - 0.0003, h[5], h[6], h[7], h[8]))


@query("corner_residual", f"""
SELECT clip, frame_idx, {R6(gap('ca', 'cb'))} AS residual
FROM (SELECT clip, frame_idx, {corner_list('h')} AS ca, {corner_list('g')} AS cb
  FROM (SELECT *, CASE WHEN h IS NOT NULL THEN {_SHIFTED} END AS g FROM fx_frames))""")
def corner_residual(t):
    return t.frames.withColumn("g", _shifted()).select(
        "clip", "frame_idx", r6(G.corner_residual(c("h"), c("g"))).alias("residual"))


_FLAGS = """list_filter([CASE WHEN {rmse} > 0.30e0 THEN 'rmse' END, CASE WHEN {inl} < 0.95e0 THEN 'inliers' END,
  CASE WHEN {nc} < 12 THEN 'corrs' END, CASE WHEN {yf} < 5 THEN 'yard_fits' END, CASE WHEN {td} > 1.5e0 THEN 'temporal' END],
  lambda x: x IS NOT NULL)"""


@query("red_flags", f"""
SELECT clip, frame_idx, CAST(len(f) AS INT) AS n_flags, array_to_string(f, ',') AS flags
FROM (SELECT clip, frame_idx, {_FLAGS.format(rmse='rmse', inl='inlier_frac', nc='n_corrs', yf='n_yard_fits', td='CASE WHEN n_corrs % 4 > 0 THEN rmse*6 END')} AS f FROM fx_frames)""")
def red_flags(t):
    f = Q.red_flags(c("rmse"), c("inlier_frac"), c("n_corrs"), c("n_yard_fits"), F.when(c("n_corrs") % 4 > 0, c("rmse") * 6))
    return t.frames.withColumn("f", f).select("clip", "frame_idx", F.size("f").alias("n_flags"), F.array_join("f", ",").alias("flags"))


@query("choose_source", f"""
SELECT clip, frame_idx, CASE WHEN h IS NOT NULL AND rmse <= 0.1e0 THEN 'new' WHEN h IS NOT NULL AND n_corrs >= 12 THEN 'classical' END AS h_source,
  {R6('CASE WHEN h IS NOT NULL AND rmse <= 0.1e0 THEN h[1] WHEN h IS NOT NULL AND n_corrs >= 12 THEN h[1] + 0.0005e0 END')} AS h0
FROM fx_frames WHERE h IS NOT NULL AND (rmse <= 0.1e0 OR n_corrs >= 12)""")
def choose_source(t):
    none = F.array().cast("array<string>")
    fa = F.when(c("rmse") <= 0.1, none).otherwise(F.array(F.lit("rmse")))
    fb = F.when(c("n_corrs") >= 12, none).otherwise(F.array(F.lit("corrs")))
    d = t.frames.withColumn("g", _shifted())
    d = d.withColumns(Q.choose_source(c("h"), fa, c("g"), fb)).where(c("h_source").isNotNull())
    return d.select("clip", "frame_idx", "h_source", r6(c("h_used")[0]).alias("h0"))


_TOK = ["type", "cx", "cy"]


@query("token_features", f"""
SELECT clip, frame_idx, ch, comp, px, py, raw, {', '.join(f"CASE WHEN ch = {i} THEN 1e0 ELSE 0e0 END AS f{i}" for i in range(4))},
  round(px/1280e0, 9) AS f4, round(py/720e0, 9) AS f5, round((px-3)/1280e0, 9) AS f6, round((py-2)/720e0, 9) AS f7,
  round((px+4)/1280e0, 9) AS f8, round((py+3)/720e0, 9) AS f9, {R6('ln(greatest(raw % 900, 1))/ln(1280*720)')} AS f10,
  {R6('prob')} AS f11, {R6('1-prob')} AS f12, {R6('cls*5/120e0')} AS f13, CASE WHEN cls > 4 THEN 1e0 ELSE 0e0 END AS f14,
  {R6('prob')} AS f15, ch AS token_type
FROM (SELECT DISTINCT * FROM fx_pixels)""")
def token_features(t):
    f = A.token_features(c("ch"), c("px"), c("py"), c("px") - 3, c("py") - 2, c("px") + 4, c("py") + 3,
                         c("raw") % 900, c("prob"), 1 - c("prob"), c("cls") * 5, c("cls") > 4, c("prob"))
    d = t.pixels.distinct().withColumn("f", f)
    return d.select("clip", "frame_idx", "ch", "comp", "px", "py", "raw", *[F.round(c("f")[i], 9 if 4 <= i <= 9 else 6).alias(f"f{i}") for i in range(16)],
                    A.token_type(c("f")).alias("token_type"))


@query("clip_times", f"""
SELECT clip, sec, {R6('(sec - 12)/30e0')} AS display_time, {R6('CASE WHEN d > 1 THEN sec + 1e0 END')} AS cut_start,
  {R6('CASE WHEN d > 1 THEN d END')} AS cut_length FROM (SELECT clip, sec, conf*10 - 3 AS d FROM fx_views)""")
def clip_times(t):
    s = c("sec").cast("double")
    cut = C.trimmed(s, s + c("conf") * 10)
    return t.views.select("clip", "sec", r6(C.display_time(c("sec"), F.lit(12))).alias("display_time"),
                          r6(cut["cut_start"]).alias("cut_start"), r6(cut["cut_length"]).alias("cut_length"))


@query("shift_channel", """
SELECT clip, frame_idx, ch, px, CAST(CASE WHEN ch = 2 THEN py - 255 ELSE py END AS INT) AS py, CAST(count(*) AS BIGINT) AS n
FROM fx_pixels WHERE ch <> 2 OR py >= 255 GROUP BY ALL""")
def shift_channel(t):
    from fieldmotion.operators.masks import shift_channel as shift

    return shift(t.pixels, 2, 255).groupBy("clip", "frame_idx", "ch", "px", "py").agg(F.count("*").alias("n"))


@query("argmax", "SELECT track_id, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS best FROM fx_sigs")
def argmax(t):
    return t.sigs.select("track_id", A.argmax(c("logits")).alias("best"))


@query("softmax_expectation", f"""
SELECT track_id, {R6('list_sum([e[i]*(10e0+5*(i-1))/120 for i in range(1, 22)])/list_sum(e)')} AS expected
FROM (SELECT track_id, [exp(x*10 - list_max(logits)*10) for x in logits] AS e FROM fx_sigs)""")
def softmax_expectation(t):
    scaled = F.transform(c("logits"), lambda x: x * 10)
    values = F.transform(F.sequence(F.lit(0), F.lit(20)), D.class_share)
    return t.sigs.select("track_id", r6(A.softmax_expectation(scaled, values)).alias("expected"))


@query("sigmoid_threshold", f"""
SELECT track_id, {R6('1/(1+exp(-logits[1]))')} AS p, 1/(1+exp(-logits[1])) > 0.5e0 AS over_half, CASE WHEN logits[2] > 0 THEN 1 ELSE 0 END AS row FROM fx_sigs""")
def sigmoid_threshold(t):
    p = A.sigmoid(c("logits")[0])
    return t.sigs.select("track_id", r6(p).alias("p"), (p > 0.5).alias("over_half"),
                         F.when(c("logits")[1] > 0, 1).otherwise(0).alias("row"))


@query("cosine_distance", f"""
SELECT track_id, {R6('''CASE WHEN label <> 3 AND na > 1e-9 AND nb > 1e-9 THEN least(greatest(1 - ab/(na*nb), 0e0), 1e0) END''')} AS distance
FROM (SELECT track_id, label, sqrt(list_sum([x*x for x in sig[1:32]])) AS na, sqrt(list_sum([x*x for x in sig[33:64]])) AS nb,
  list_sum([sig[i]*sig[i+32] for i in range(1, 33)]) AS ab FROM fx_sigs)""")
def cosine_distance(t):
    a, b = F.slice("sig", 1, 32), F.when(c("label") != 3, F.slice("sig", 33, 32))
    return t.sigs.select("track_id", r6(A.cosine_distance(a, b)).alias("distance"))


@query("gather_scatter", f"""
SELECT track_id, {R6('sig[4]')} AS g0, {R6('sig[1]')} AS g1, {R6('sig[21]')} AS g2,
  {', '.join(R6("sig[1]" if i == 2 else "sig[2]" if i == 5 else "-1e0") + f" AS s{i}" for i in range(7))} FROM fx_sigs""")
def gather_scatter(t):
    g = A.gather(c("sig"), F.array(F.lit(3), F.lit(0), F.lit(20)))
    s = A.scatter(F.array(F.lit(2), F.lit(5)), F.slice("sig", 1, 2), F.lit(7), F.lit(-1.0))
    return t.sigs.select("track_id", *[r6(g[i]).alias(f"g{i}") for i in range(3)], *[r6(s[i]).alias(f"s{i}") for i in range(7)])


@query("pad_to", f"""
SELECT track_id, clip, CAST(n AS INT) AS n_max, CAST(n - k AS INT) AS n_pad, {R6('list_sum(sig[1:k])')} AS total, CAST(n AS INT) AS padded_size
FROM (SELECT *, max(k) OVER (PARTITION BY clip) AS n FROM (SELECT track_id, clip, sig, track_id % 7 + 1 AS k FROM fx_sigs))""")
def pad_to(t):
    d = t.sigs.withColumn("part", F.slice("sig", 1, (c("track_id") % 7 + 1).cast("int")))
    longest = d.groupBy("clip").agg(F.max(F.size("part")).alias("n_max"))
    d = d.join(longest, "clip").withColumns({"padded": A.pad_to(c("part"), c("n_max"), F.lit(0.0)),
                                             "mask": A.pad_mask(c("part"), c("n_max"))})
    return d.select("track_id", "clip", "n_max", F.size(F.filter("mask", lambda m: m)).alias("n_pad"),
                    r6(A.total(c("padded"))).alias("total"), F.size("padded").alias("padded_size"))


@query("kth_extreme", f"""
SELECT track_id, {R6('list_sort(sig)[6]')} AS low, {R6('list_sort(sig)[59]')} AS high, {R6('list_sort(sig[1:3])[3]')} AS short FROM fx_sigs""")
def kth_extreme(t):
    f = F.lit(False)
    return t.sigs.select("track_id", r6(A.kth_extreme(c("sig"), 5, f)).alias("low"),
                         r6(A.kth_extreme(c("sig"), 5, F.lit(True))).alias("high"),
                         r6(A.kth_extreme(F.slice("sig", 1, 3), 5, f)).alias("short"))


@query("normalise_sum", f"""
SELECT track_id, {R6('a[1]/greatest(list_sum(a), 1)')} AS first, {R6('list_sum(a)/greatest(list_sum(a), 1)')} AS total
FROM (SELECT track_id, [abs(x)*(track_id % 3) for x in sig] AS a FROM fx_sigs)""")
def normalise_sum(t):
    a = F.transform(c("sig"), lambda x: F.abs(x) * (c("track_id") % 3))
    d = t.sigs.withColumn("n", A.normalise_sum(a))
    return d.select("track_id", r6(c("n")[0]).alias("first"), r6(A.total(c("n"))).alias("total"))
