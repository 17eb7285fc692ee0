"""Files, rejections, label metrics and samples."""

import json

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.q_scoring import scratch
from catalog.sqlgeo import iou, px, py
from fieldmotion.functions import clips as C
from fieldmotion.functions import field as D
from fieldmotion.operators import labels as L
from fieldmotion.operators import rejects as X
from fieldmotion.operators import sampling as P
from fieldmotion.operators import scoring as S
from fieldmotion.sources import files as IO

c = F.col


def _entries():
    h = F.array(*[F.array(*[c("h")[3 * r + k] for k in range(3)]) for r in range(3)])
    return F.struct("frame_idx", (c("n_corrs") % 5).cast("int").alias("stratum"), "n_corrs", "inlier_frac",
                    (c("rmse") * 100).alias("mean_ngs_x"), c("rmse").alias("ngs_x_range"), h.alias("H"))


@query("read_stage", f"""
SELECT clip, frame_idx, 't_'||clip||'_'||lpad(CAST(frame_idx AS VARCHAR), 4, '0') AS id, n_corrs, {R6('rmse*100')} AS mean_ngs_x, {R6('h[5]')} AS h4
FROM fx_frames WHERE CAST(substr(clip, 2) AS INT) % 3 > 0""")
def read_stage(t):
    path = scratch(t)
    clip_no = F.substring("clip", 2, 20).cast("int")
    docs = t.frames.groupBy("clip").agg(F.collect_list(_entries()).alias("entries")).select(
        "clip", F.concat(F.lit("t_"), "clip").alias("tag"), F.when(clip_no % 3 > 0, F.lit("ok")).otherwise(F.lit("failed")).alias("status"), "entries")
    docs.write.json(path)
    d = IO.read_stage(t.spark, path)
    return d.select("clip", "frame_idx", "id", "n_corrs", r6("mean_ngs_x").alias("mean_ngs_x"), r6(c("H")[1][1]).alias("h4"))


@query("read_manifest", f"""
SELECT clip, CAST(count(*) AS BIGINT) AS n, {R6('avg(rmse*100)')} AS mean_x, 1000e0 + max(n_corrs) AS fx FROM fx_frames GROUP BY clip""")
def read_manifest(t):
    path = scratch(t)
    cams = t.frames.groupBy("clip").agg((1000.0 + F.max("n_corrs")).alias("f")).select("clip", F.struct(
        F.array(F.array(c("f"), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), c("f"), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("K"),
        F.array(*[F.lit(0.0)] * 5).alias("dist")).alias("i"))
    # one manifest document per clip, each holding that clip's entries and camera
    docs = t.frames.select("clip", F.struct("clip", _entries().alias("e")).alias("x")).groupBy("clip").agg(
        F.collect_list(F.struct("x.clip", "x.e.*")).alias("entries")).join(cams, "clip")
    docs.select("entries", F.map_from_arrays(F.array("clip"), F.array("i")).alias("intrinsics_by_clip")).write.json(path)
    entries, cameras = IO.read_manifest(t.spark, path, multi_line=False)
    a = entries.groupBy("clip").agg(F.count("*").alias("n"), r6(F.avg("mean_ngs_x")).alias("mean_x"))
    return a.join(cameras.select("clip", c("K")[0][0].alias("fx")), "clip")


@query("read_ledger", """
SELECT clip, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (decision = 'y') AS BIGINT) AS n_yes, CAST(sum(frame_idx) AS BIGINT) AS frames FROM (
  SELECT clip, decision, CAST(id AS INT) AS frame_idx FROM fx_decided WHERE decision IS NOT NULL) GROUP BY clip""")
def read_ledger(t):
    path = scratch(t)
    decided = t.decided.where(c("decision").isNotNull())
    pairs = F.map_from_entries(F.collect_list(F.struct(C.frame_key(c("clip"), c("id")), "decision")))
    decided.groupBy("clip", F.floor(c("id").cast("long") / 1000)).agg(pairs.alias("decisions")).select("decisions").write.json(path)  # bounded documents
    rows = IO.read_ledger(t.spark, path, multi_line=False)
    return rows.groupBy("clip").agg(F.count("*").alias("n"), F.count_if(c("decision") == "y").alias("n_yes"), F.sum("frame_idx").cast("long").alias("frames"))


@query("read_exclusions", "SELECT path AS name FROM fx_paths WHERE doc_id % 3 > 0")
def read_exclusions(t):
    path = scratch(t)
    line = (F.when(c("doc_id") % 3 == 0, F.concat(F.lit("# "), "path")).when(c("doc_id") % 3 == 1, F.concat("path", F.lit("  # blurred")))
            .otherwise(c("path")))
    t.paths.select(line.alias("value")).write.text(path)
    return IO.read_exclusions(t.spark, path)


@query("read_blacklist", "SELECT clip||'#'||frame_idx AS frame_key FROM fx_decided WHERE decision = 'n'")
def read_blacklist(t):
    path = scratch(t)
    t.decided.where("decision = 'n'").groupBy("clip", F.floor(c("frame_idx") / 1000)).agg(F.collect_list(C.frame_key(c("clip"), c("frame_idx"))).alias("bad_gt_keys")).select("bad_gt_keys").write.json(path)
    return IO.read_blacklist(t.spark, path, multi_line=False)


@query("read_box_labels", f"""
SELECT 'c'||CAST(floor(vec_id/22) AS BIGINT) AS image, CAST(count(*) AS BIGINT) AS n, {R6('sum(round(abs(embedding[1]), 4))')} AS sum_cx, {R6('sum(round(abs(embedding[4]), 4))')} AS sum_h, CAST(sum(label) AS BIGINT) AS classes FROM embeddings GROUP BY ALL""")
def read_box_labels(t):
    path = scratch(t)
    num = lambda i: F.round(F.abs(c("sig")[i]), 4).cast("string")
    t.sigs.select("clip", F.concat_ws(" ", c("label").cast("string"), num(0), num(1), num(2), num(3)).alias("value")).write.partitionBy("clip").text(path)
    d = IO.read_box_labels(t.spark, path, r"clip=([^/]+)/")
    return d.groupBy("image").agg(F.count("*").alias("n"), r6(F.sum("cx")).alias("sum_cx"), r6(F.sum("h")).alias("sum_h"), F.sum("class_id").alias("classes"))


@query("pack_frames", f"""
SELECT f.clip, f.frame_idx, CAST(count(b.det_idx) AS INT) AS n, CAST(coalesce(sum(count(b.det_idx)) OVER (PARTITION BY f.clip ORDER BY f.frame_idx), 0) AS BIGINT) AS "end", {R6('sum(b.x1)')} AS sum_x1
FROM fx_frames f LEFT JOIN fx_boxes b ON b.clip = f.clip AND b.frame_idx = f.frame_idx GROUP BY f.clip, f.frame_idx""")
def pack_frames(t):
    packed = IO.frame_offsets(IO.pack_frames(t.boxes, t.frames))
    return packed.select("clip", "frame_idx", "n", "end", r6(F.when(c("n") > 0, F.aggregate("dets", F.lit(0.0), lambda a, d: a + d["x1"]))).alias("sum_x1"))


@query("unpack_frames", f"""
SELECT f.clip, f.frame_idx, det_idx, {R6('x1')} AS x1, {R6('confidence')} AS confidence FROM fx_frames f LEFT JOIN fx_boxes b ON b.clip = f.clip AND b.frame_idx = f.frame_idx""")
def unpack_frames(t):
    d = IO.unpack_frames(IO.pack_frames(t.boxes, t.frames))
    return d.select("clip", "frame_idx", "det_idx", r6("x1").alias("x1"), r6("confidence").alias("confidence"))


@query("nearest_marking", f"""
WITH pts AS (SELECT CAST(i AS INT) AS slot, 10e0 + 5*i AS x, k.y, k.label||'_'||CAST(least(5*i, 100-5*i) AS INT)||CASE WHEN i % 2 = 1 THEN '+5yd' ELSE 'yd' END AS label
  FROM range(21) r(i), (VALUES (0e0, 'near_sideline'), (23.583e0, 'near_hash'), (53.33e0 - 23.583e0, 'far_hash'), (53.33e0, 'far_sideline')) k(y, label)
  UNION ALL SELECT CAST(i AS INT), 10e0 + 5*i, y, 'number_'||CAST(least(5*i, 100-5*i) AS INT) FROM range(21) r(i), (VALUES (13e0), (40.33e0)) n(y) WHERE i % 2 = 0 AND i BETWEEN 1 AND 19)
SELECT event_id, p.label, {R6('abs(e.y - p.y)')} AS dy FROM fx_yards e JOIN pts p ON p.slot = least(greatest(ceil((e.x-10)/5 - 0.5e0), 0), 20)""")
def nearest_marking(t):
    """The field-point dimension joined to positions on their yard line."""
    pts = IO.field_points(t.spark).select("slot", c("y").alias("py"), "label")
    d = t.yards.withColumn("slot", D.yard_slot(c("x"))).join(F.broadcast(pts), "slot")  # 102 fixed rows
    return d.select("event_id", "label", r6(F.abs(c("y") - c("py"))).alias("dy"))


@query("write_manifest", "SELECT CAST(count(*) AS BIGINT) AS n_total, CAST(count(DISTINCT clip) AS BIGINT) AS n_clips, '{\"seed\": 42}' AS config FROM fx_frames")
def write_manifest(t):
    path = scratch(t)
    IO.write_manifest(t.frames.select("clip", "frame_idx", "h"), path, {"seed": 42})
    return t.spark.read.schema("n_total bigint, n_clips bigint, config string").json(f"{path}/header")


@query("reusable", """
SELECT clip, clip LIKE '%1' OR clip LIKE '%2' AS reusable FROM (SELECT DISTINCT clip FROM fx_frames)""")
def reusable(t):
    clips = t.frames.select("clip").distinct()
    hit = c("clip").rlike("[12]$")
    stored = clips.select("clip", F.lit("w.pth").alias("weights"), F.when(hit, 0.3).otherwise(0.4).alias("conf"), F.lit(1280).alias("res"))
    wanted = clips.select("clip", F.lit("w.pth").alias("weights"), F.lit(0.3).alias("conf"), F.lit(1280).alias("res"))
    return IO.reusable(stored, wanted, ["weights", "conf", "res"]).select("clip", "reusable")


@query("pending", "SELECT DISTINCT clip FROM fx_frames WHERE clip NOT IN (SELECT clip FROM fx_frames WHERE frame_idx = 0 AND n_corrs > 14)")
def pending(t):
    done = t.frames.where("frame_idx = 0 and n_corrs > 14")
    return IO.pending(t.frames.select("clip").distinct(), done)


@query("per_frame_report", f"""
SELECT clip, CAST(floor(frame_idx/128) AS INT) AS block, CAST(count(*) AS INT) AS n_frames, {R6('sum(rmse)')} AS rmse FROM fx_frames GROUP BY ALL""")
def per_frame_report(t):
    d = IO.per_frame_report(t.frames, ["rmse", "method"], 128)
    return d.select("clip", "block", "n_frames", r6(F.aggregate("per_frame", F.lit(0.0), lambda a, f: a + f["rmse"])).alias("rmse"))


@query("confidence_gate", """
SELECT clip, CAST(count(*) FILTER (confidence >= 0.3e0) AS BIGINT) AS kept, CAST(count(*) FILTER (confidence < 0.3e0) AS BIGINT) AS interrupted FROM fx_points GROUP BY clip""")
def confidence_gate(t):
    kept = X.confidence_gate(t.points).groupBy("clip").agg(F.count("*").alias("kept"))
    return X.confidence_gate(t.points, drop=False).groupBy("clip").agg(F.count_if("interrupted").alias("interrupted")).join(kept, "clip")


@query("exclude_holdouts", "SELECT id, game, clip FROM fx_decided WHERE game <> 'fr' AND clip NOT IN ('src3', 'src7')")
def exclude_holdouts(t):
    games = t.decided.where("game = 'fr'").select("game").distinct()
    held = t.decided.where(c("clip").isin("src3", "src7")).select("clip").distinct()
    return X.exclude_holdouts(t.decided, games, held).select("id", "game", "clip")


@query("drop_blacklisted", """
WITH bad AS (SELECT DISTINCT clip||'#'||frame_idx AS k FROM fx_decided WHERE decision = 'n')
SELECT id, (SELECT CAST(count(*) AS BIGINT) FROM fx_decided WHERE clip||'#'||frame_idx IN (SELECT k FROM bad)) AS n_dropped FROM fx_decided WHERE clip||'#'||frame_idx NOT IN (SELECT k FROM bad)""")
def drop_blacklisted(t):
    d = t.decided.withColumn("frame_key", C.frame_key(c("clip"), c("frame_idx")))
    kept, dropped = X.drop_blacklisted(d, d.where("decision = 'n'"))
    return kept.select("id").join(F.broadcast(dropped))  # one counted row


@query("filter_decisions", """
SELECT id, 'y' AS mode FROM fx_decided WHERE decision = 'y' UNION ALL SELECT id, 'n' FROM fx_decided WHERE decision = 'n'
UNION ALL SELECT id, 'undecided' FROM fx_decided WHERE decision IS NULL UNION ALL SELECT id, 'all' FROM fx_decided""")
def filter_decisions(t):
    ids, dec = t.decided.select("id"), t.decided.where(c("decision").isNotNull()).select("id", "decision")
    tag = lambda df, m: df.withColumn("mode", F.lit(m))
    return (tag(X.filter_decisions(ids, dec, y_only=True), "y").unionByName(tag(X.filter_decisions(ids, dec, n_only=True), "n"))
            .unionByName(tag(X.filter_decisions(ids, dec, exclude_decided=True), "undecided")).unionByName(tag(X.filter_decisions(ids, dec), "all")))


@query("require_sidecar", "SELECT clip, frame_idx FROM fx_frames WHERE clip IN (SELECT clip FROM fx_boxes WHERE confidence > 0.95e0 AND det_idx = 9)")
def require_sidecar(t):
    return X.require(t.frames.select("clip", "frame_idx"), t.boxes.where("confidence > 0.95 and det_idx = 9"), "clip")


@query("long_tracks", """
WITH n AS (SELECT clip, track_id, CAST(count(*) FILTER (measured) AS BIGINT) AS n_measured FROM fx_points GROUP BY ALL)
SELECT * FROM n WHERE n_measured >= (SELECT greatest(1, floor(max(n_measured)*0.8e0)) FROM n m WHERE m.clip = n.clip)""")
def long_tracks(t):
    return X.long_tracks(t.points, c("measured"), 0.8)


@query("drop_small_groups", """
WITH g AS (SELECT clip, frame_idx, comp, CAST(count(*) AS BIGINT) AS area FROM fx_pixels WHERE ch = 3 GROUP BY ALL)
SELECT clip, frame_idx, comp, area FROM (SELECT *, quantile_cont(area, 0.5) OVER (PARTITION BY clip, frame_idx) AS med FROM g) WHERE area >= 0.9e0*med""")
def drop_small_groups(t):
    g = t.pixels.where("ch = 3").groupBy("clip", "frame_idx", "comp").agg(F.count("*").alias("area"))
    return X.drop_small_groups(g, 0.9)


_PB = f"""(SELECT b.clip, b.frame_idx, det_idx, {px('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS x_yd, {py('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS y_yd
  FROM fx_boxes b JOIN fx_frames f ON b.clip = f.clip AND b.frame_idx = f.frame_idx WHERE h IS NOT NULL)"""


@query("suppress_near_tracks", f"""
WITH p AS MATERIALIZED {_PB} SELECT clip, frame_idx, det_idx FROM p d WHERE det_idx % 2 = 1 AND NOT EXISTS (
  SELECT 1 FROM p t WHERE t.det_idx % 2 = 0 AND t.clip = d.clip AND t.frame_idx = d.frame_idx AND sqrt((d.x_yd-t.x_yd)*(d.x_yd-t.x_yd) + (d.y_yd-t.y_yd)*(d.y_yd-t.y_yd)) < 12)""")
def suppress_near_tracks(t):
    p = S.project_boxes(t.boxes, t.frames)
    return X.suppress_near_tracks(p.where("det_idx % 2 = 1"), p.where("det_idx % 2 = 0"), 12.0).select("clip", "frame_idx", "det_idx")


@query("contaminated", f"""
SELECT d.clip, d.frame_idx, d.det_idx, EXISTS (SELECT 1 FROM fx_boxes t WHERE t.clip = d.clip AND t.frame_idx = d.frame_idx AND t.det_idx % 2 = 0 AND t.det_idx <> d.det_idx - 1
  AND {iou(('d.x1', 'd.y1', 'd.x2', 'd.y2'), ('t.x1', 't.y1', 't.x2', 't.y2'), 0.0)} > 0.15e0) AS contaminated FROM fx_boxes d WHERE det_idx % 2 = 1""")
def contaminated(t):
    dets = t.boxes.where("det_idx % 2 = 1").withColumn("own_track", c("det_idx") - 1)
    return X.contaminated(dets, t.boxes.where("det_idx % 2 = 0").withColumn("track_id", c("det_idx"))).select("clip", "frame_idx", "det_idx", "contaminated")


@query("degenerate", """
WITH r AS (SELECT clip, frame_idx, round_even(fy/0.5e0, 0) AS b, count(*) AS c FROM fx_corrs GROUP BY ALL),
k AS (SELECT clip, frame_idx, round_even(fx/0.5e0, 0) AS b, count(*) AS c FROM fx_corrs GROUP BY ALL)
SELECT clip, frame_idx, CAST(n AS BIGINT) AS n_points, CAST(least(n - mr, n - mk) AS BIGINT) AS fewest_off, n < 4 OR least(n - mr, n - mk) < 2 AS degenerate
FROM (SELECT clip, frame_idx, sum(c) AS n, max(c) AS mr FROM r GROUP BY ALL) JOIN (SELECT clip, frame_idx, max(c) AS mk FROM k GROUP BY ALL) USING (clip, frame_idx)""")
def degenerate(t):
    return X.degenerate(t.corrs)


@query("inside_token", "SELECT corr_id, u BETWEEN 100-30 AND 700+30 AND v BETWEEN 90-30 AND 400+30 AS inside FROM fx_corrs")
def inside_token(t):
    return t.corrs.select("corr_id", X.inside_token(c("u"), c("v"), F.lit(100), F.lit(90), F.lit(700), F.lit(400)).alias("inside"))


@query("label_accuracy", f"""
SELECT type, CAST(co AS BIGINT) AS class_ok, CAST(cn AS BIGINT) AS class_n, CAST(ro AS BIGINT) AS row_ok, CAST(rn AS BIGINT) AS row_n, {R6('co/(1e0*greatest(cn, 1))')} AS class_acc, {R6('ro/(1e0*greatest(rn, 1))')} AS row_acc
FROM (SELECT type, count(*) FILTER (true_class >= 0 AND pred_class = true_class) AS co, count(*) FILTER (true_class >= 0) AS cn,
  count(*) FILTER (true_row >= 0 AND pred_row = true_row) AS ro, count(*) FILTER (true_row >= 0) AS rn FROM fx_labels GROUP BY type)""")
def label_accuracy(t):
    return L.label_accuracy(t.labels).withColumns({"class_acc": r6("class_acc"), "row_acc": r6("row_acc")})


@query("per_class_accuracy", f"""
SELECT true_class, CAST(count(*) FILTER (pred_class = true_class) AS BIGINT) AS n_ok, CAST(count(*) AS BIGINT) AS n, {R6('count(*) FILTER (pred_class = true_class)/(1e0*count(*))')} AS accuracy
FROM fx_labels WHERE true_class >= 0 GROUP BY true_class""")
def per_class_accuracy(t):
    return L.per_class_accuracy(t.labels).withColumn("accuracy", r6("accuracy"))


@query("channel_f1", f"""
SELECT ch, tp, fp, fn, {R6('f1')} AS f1, {R6('avg(f1) OVER ()')} AS mean_f1 FROM (SELECT *, 2*tp/(2*tp + fp + fn + 1e-9) AS f1 FROM (
  SELECT ch, CAST(count(*) FILTER (prob > 0.7e0 AND raw % 3 > 0) AS BIGINT) AS tp, CAST(count(*) FILTER (prob > 0.7e0 AND raw % 3 = 0) AS BIGINT) AS fp,
    CAST(count(*) FILTER (prob <= 0.7e0 AND raw % 3 > 0) AS BIGINT) AS fn FROM fx_pixels GROUP BY ch))""")
def channel_f1(t):
    return L.channel_f1(t.pixels, c("prob") > 0.7, c("raw") % 3 > 0).withColumns({"f1": r6("f1"), "mean_f1": r6("mean_f1")})


@query("class_weights", f"""
WITH n AS (SELECT CAST(i AS INT) AS class, CAST(count(l.true_class) AS BIGINT) AS n FROM range(25) r(i) LEFT JOIN fx_labels l ON l.true_class = i GROUP BY i)
SELECT class, n, {R6('(1e0/greatest(n, 1))*25/sum(1e0/greatest(n, 1)) OVER ()')} AS weight FROM n""")
def class_weights(t):
    return L.class_weights(t.labels.where("true_class >= 0"), 25).withColumn("weight", r6("weight"))


@query("drop_rates", f"""
SELECT ch, CAST(count(*) AS BIGINT) AS n, {R6('quantile_cont(r, 0.5)')} AS median_drop, {R6('avg(r)')} AS mean_drop FROM (
  SELECT clip, frame_idx, ch, (count(*) - count(*) FILTER (raw % 4 > 0))/(1e0*greatest(count(*), 1)) AS r FROM fx_pixels GROUP BY ALL) GROUP BY ch""")
def drop_rates(t):
    return L.drop_rates(t.pixels, c("raw") % 4 > 0, ["clip", "frame_idx"]).withColumns({"median_drop": r6("median_drop"), "mean_drop": r6("mean_drop")})


@query("n_corrections", "SELECT clip, frame_idx, CAST(count(*) FILTER (true_class >= 0 AND pred_class >= 0 AND true_class <> pred_class) AS BIGINT) AS n_corrections FROM fx_labels GROUP BY ALL")
def n_corrections(t):
    return L.n_corrections(t.labels, ["clip", "frame_idx"])


_MATCH = """(SELECT event_id, CASE WHEN NOT x BETWEEN 10 AND 110 THEN 'off_field' WHEN NOT ok THEN 'far' END AS skip_reason,
  CASE WHEN b = 60 THEN '50' ELSE least(b-10, 110-b)||CASE WHEN b < 60 THEN 'L' ELSE 'R' END END AS label, CASE WHEN dn < df THEN 'near' ELSE 'far' END AS side,
  sqrt((x-b)*(x-b) + least(dn,df)*least(dn,df)) AS distance
FROM (SELECT *, x BETWEEN 10 AND 110 AND b BETWEEN 20 AND 100 AND abs(x-b) <= 5 AND least(dn,df) <= 6 AS ok
  FROM (SELECT event_id, x, CAST(round_even(x/10, 0)*10 AS INT) AS b, abs(y-13e0) AS dn, abs(y-40.33e0) AS df FROM fx_yards)))"""


def _matches(t):
    p = D.painted_bucket(c("x"), c("y"))
    why = F.when(~c("x").between(10, 110), "off_field").when(p["bucket"].isNull(), "far")
    return t.yards.select("event_id", why.alias("skip_reason"), p["label"].alias("label"), p["side"].alias("side"), p["distance"].alias("distance"))


@query("class_side_counts", f"""
SELECT label, side, CAST(count(*) AS BIGINT) AS n, {R6('avg(distance)')} AS mean_distance, {R6('max(distance)')} AS max_distance,
  {R6('CASE WHEN grouping(label) = 1 AND grouping(side) = 1 THEN quantile_cont(distance, 0.5) END')} AS median_distance
FROM {_MATCH} WHERE skip_reason IS NULL GROUP BY GROUPING SETS ((label), (side), ())""")
def class_side_counts(t):
    return L.class_side_counts(_matches(t)).withColumns({k: r6(k) for k in ("mean_distance", "max_distance", "median_distance")})


@query("skip_counts", f"SELECT skip_reason, CAST(count(*) AS BIGINT) AS n FROM {_MATCH} WHERE skip_reason IS NOT NULL GROUP BY skip_reason")
def skip_counts(t):
    return L.skip_counts(_matches(t))


POOL = """SELECT clip, frame_idx, CAST(count(*) AS BIGINT) AS n_corrs, count(*) FILTER (v % 100 < 45)/(1e0*count(*)) AS inlier_frac, avg(fx) AS mean_ngs_x, max(fx) - min(fx) AS ngs_x_range FROM fx_corrs GROUP BY clip, frame_idx"""


@query("frame_pool_stats", f"SELECT clip, frame_idx, n_corrs, {R6('inlier_frac')} AS inlier_frac, {R6('mean_ngs_x')} AS mean_ngs_x, {R6('ngs_x_range')} AS ngs_x_range FROM ({POOL})")
def frame_pool_stats(t):
    return L.frame_pool_stats(t.corrs, c("v") % 100 < 45).withColumns({k: r6(k) for k in ("inlier_frac", "mean_ngs_x", "ngs_x_range")})


DIVERSE = """WITH r AS (SELECT *, md5('42|'||id) AS h, row_number() OVER (PARTITION BY stratum, clip ORDER BY md5('42|'||id), id) AS round FROM fx_decided),
s AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY round, md5('42|'||clip), clip) AS k FROM r), picks AS (SELECT * FROM s WHERE k <= 35)"""


@query("sample_report", f"""
{DIVERSE} SELECT a.stratum, a.n AS n_candidates, a.m AS clips_available, CAST(coalesce(b.n, 0) AS BIGINT) AS n_picks, CAST(coalesce(b.m, 0) AS BIGINT) AS clips_picked, {R6('coalesce(b.n, 0)/(1e0*greatest(coalesce(b.m, 0), 1))')} AS per_clip
FROM (SELECT stratum, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT clip) AS BIGINT) AS m FROM fx_decided GROUP BY stratum) a LEFT JOIN (SELECT stratum, count(*) AS n, count(DISTINCT clip) AS m FROM picks GROUP BY stratum) b USING (stratum)""")
def sample_report(t):
    return L.sample_report(t.decided, P.clip_diverse_sample(t.decided, 35)).withColumn("per_clip", r6("per_clip"))


@query("sidecar_join", """
WITH l AS (SELECT clip, frame_idx, count(*) AS n FROM fx_labels WHERE type = 3 GROUP BY ALL), s AS (SELECT clip, frame_idx, count(*) AS m FROM fx_labels WHERE type = 3 AND q < 45 GROUP BY ALL)
SELECT clip, frame_idx, CAST(n AS BIGINT) AS n_tokens, n = m AS matched, CASE WHEN n = m THEN CAST(m AS INT) END AS n_logits FROM l JOIN s USING (clip, frame_idx)""")
def sidecar_join(t):
    num = t.labels.where("type = 3")
    labels = num.groupBy("clip", "frame_idx").agg(F.count("*").alias("n_tokens"))
    logits = num.where("q < 45").groupBy("clip", "frame_idx").agg(F.collect_list("true_class").alias("token_idx"), F.collect_list(F.array("q")).alias("crop_logits"))
    d = L.sidecar_join(labels, logits)
    return d.select("clip", "frame_idx", "n_tokens", "matched", F.when(c("token_idx").isNotNull(), F.size("token_idx")).alias("n_logits"))


@query("top_residuals", f"""
SELECT 'overall' AS scope, clip, frame_idx, {R6('rmse')} AS rmse FROM (SELECT * FROM fx_frames ORDER BY rmse DESC, clip, frame_idx LIMIT 20)
UNION ALL SELECT 'clip', clip, frame_idx, {R6('rmse')} FROM fx_frames QUALIFY row_number() OVER (PARTITION BY clip ORDER BY rmse DESC, frame_idx) <= 10""")
def top_residuals(t):
    a = P.top_residuals(t.frames, "rmse", 20, tie=["clip", "frame_idx"]).withColumn("scope", F.lit("overall"))
    b = P.top_residuals(t.frames, "rmse", 10, ["clip"], ["frame_idx"]).withColumn("scope", F.lit("clip"))
    cols = ["scope", "clip", "frame_idx", r6("rmse").alias("rmse")]
    return a.select(*cols).unionByName(b.select(*cols))


@query("stratified_sample", "SELECT stratum, id FROM fx_decided QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42|'||id), id) <= 40")
def stratified_sample(t):
    return P.stratified_sample(t.decided, 40).select("stratum", "id")


@query("clip_diverse_sample", f"{DIVERSE} SELECT stratum, clip, id, CAST(round AS INT) AS round FROM picks")
def clip_diverse_sample(t):
    return P.clip_diverse_sample(t.decided, 35).select("stratum", "clip", "id", "round")


@query("random_pairs", """
WITH k AS (SELECT clip, frame_idx, -ln((CAST('0x'||substr(md5('42|'||clip||'|'||frame_idx), 1, 12) AS BIGINT) + 1e0)/281474976710657e0)*count(*) OVER (PARTITION BY clip) AS k FROM fx_frames)
SELECT clip, frame_idx FROM k ORDER BY k, clip, frame_idx LIMIT 50""")
def random_pairs(t):
    return P.random_pairs(t.frames.select("clip", "frame_idx"), 50)


@query("split_by_game", """
WITH g AS (SELECT game, count(*) AS n FROM fx_decided GROUP BY game), v AS (SELECT coalesce(
  (SELECT game FROM g WHERE n >= (SELECT floor(sum(n)*0.1e0) FROM g) ORDER BY n, game LIMIT 1), (SELECT game FROM g ORDER BY n DESC, game DESC LIMIT 1)) AS val)
SELECT id, game, CASE WHEN game = val THEN 'val' ELSE 'train' END AS split FROM fx_decided, v""")
def split_by_game(t):
    return P.split_by_game(t.decided.select("id", "game"))


@query("split_fraction", """
SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42|'||id), id) <= round_even(count(*) OVER ()*0.15e0, 0) THEN 'val' ELSE 'train' END AS split FROM fx_decided""")
def split_fraction(t):
    return P.split_fraction(t.decided.select("id"))


def _spaced(source, n, spacing, extra=""):
    """CTE body: greedy spaced picks per clip; ``source`` has clip, frame_idx; n a column or number."""
    return f"""sized AS (SELECT clip, max(frame_idx) + 1 AS total, {n} AS n FROM {source} GROUP BY clip),
drawn AS (SELECT clip, list(frame_idx ORDER BY frame_idx) AS l FROM (SELECT f.clip, frame_idx, n, row_number() OVER (PARTITION BY f.clip ORDER BY md5('42|'||f.clip||'|'||frame_idx), frame_idx) AS k
  FROM {source} f JOIN sized USING (clip)) WHERE k <= 5*n GROUP BY clip),
picked AS (SELECT clip, n, CASE WHEN n*{spacing} > total THEN CASE WHEN n >= total THEN range(0, total) ELSE [i*greatest(CAST(floor(total/(n+1)) AS BIGINT), 1) for i in range(1, n+1)] END
  ELSE list_reduce([[CAST(x AS BIGINT)] for x in l], lambda a, b: CASE WHEN len(a) < n AND b[1] - a[len(a)] >= {spacing} THEN list_concat(a, b) ELSE a END) END AS picks
  FROM sized JOIN drawn USING (clip))"""


@query("min_spacing", f"WITH src AS (SELECT clip, frame_idx FROM fx_frames), {_spaced('src', '6', 60)} SELECT clip, CAST(unnest(picks) AS INT) AS frame_idx FROM picked")
def min_spacing(t):
    return P.min_spacing(t.frames.select("clip", "frame_idx"), 6, 60).select("clip", F.explode("picks").alias("frame_idx"))


@query("clips_then_frames", f"""
WITH fr AS (SELECT 'g'||(CAST(substr(clip, 2) AS INT) % 4) AS game, clip, frame_idx FROM fx_frames),
ch AS (SELECT game, clip FROM (SELECT DISTINCT game, clip FROM fr) QUALIFY row_number() OVER (PARTITION BY game ORDER BY md5('42|'||clip), clip) <= 3),
want AS (SELECT game||'/'||clip AS clip, greatest(CAST(floor(20/count(*) OVER (PARTITION BY game)) AS BIGINT), 1) AS w FROM ch),
src AS (SELECT want.clip, frame_idx, w FROM fr JOIN want ON want.clip = game||'/'||fr.clip), {_spaced('src', 'max(w)', 60)}
SELECT split_part(clip, '/', 1) AS game, clip, CAST(unnest(picks) AS INT) AS frame_idx FROM picked""")
def clips_then_frames(t):
    fr = t.frames.select(F.concat(F.lit("g"), F.substring("clip", 2, 20).cast("int") % 4).alias("game"), "clip", "frame_idx")
    return P.clips_then_frames(fr, 3, 20, 60)


@query("every_kth_frame", "SELECT clip, frame_idx FROM fx_frames WHERE frame_idx % 30 = 0 AND method = 'full' AND inlier_frac >= 0.95e0")
def every_kth_frame(t):
    return P.every_kth_frame(t.frames).select("clip", "frame_idx")
