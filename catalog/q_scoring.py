"""Truth alignment, scores and reports."""

import uuid

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.q_sequence import CUTOFF
from catalog.sqlgeo import px, py
from catalog.sqlparts import TEMPORAL, slope
from fieldmotion.operators import scoring as S
from fieldmotion.operators import runs as R
from fieldmotion.operators.reliable import checkpoint_dir
from fieldmotion.sources import files as IO

c = F.col
OFFSET = 12


def scratch(t):
    """A new folder in the shared checkpoint location."""
    return f"{checkpoint_dir(t.spark)}/io-{uuid.uuid4().hex}"


def ours(t):
    return t.points.where("measured").select("clip", "track_id", "frame_idx", c("xs").alias("x"), "y")


OURS = "(SELECT clip, track_id, frame_idx, xs AS x, y FROM fx_points WHERE measured)"
SNAPS = "(SELECT clip, min(frame) AS snap_frame FROM fx_truth WHERE event = 'ball_snap' GROUP BY clip)"


@query("read_truth", f"SELECT frame, player_id AS \"nflId\", {R6('x')} AS x, {R6('y')} AS y, {R6('s')} AS s, event, display_name AS \"displayName\", jersey AS \"jerseyNumber\", position, team AS \"teamAbbr\" FROM fx_truth WHERE player_id % 7 <> 0")
def read_truth(t):
    path = scratch(t)
    t.truth.select("frame", F.when(c("player_id") % 7 != 0, c("player_id")).alias("nflId"), "x", "y", "s", "event",
                   c("display_name").alias("displayName"), c("jersey").alias("jerseyNumber"), "position",
                   c("team").alias("teamAbbr")).write.csv(path, sep="\t", header=True)
    d = IO.read_truth(t.spark, path)
    return d.withColumns({k: r6(k) for k in ("x", "y", "s")})


@query("event_frame", "SELECT clip, min(frame) AS snap_frame FROM fx_truth WHERE event = 'ball_snap' GROUP BY clip")
def event_frame(t):
    return S.event_frame(t.truth)


@query("player_meta", "SELECT clip, player_id, min_by(display_name, frame) AS display_name, min_by(jersey, frame) AS jersey, min_by(position, frame) AS position, min_by(team, frame) AS team FROM fx_truth GROUP BY clip, player_id")
def player_meta(t):
    return S.player_meta(t.truth, ["display_name", "jersey", "position", "team"])


@query("write_tracking", "SELECT clip, frame_idx, track_id, CAST(printf('%.3f', xs) AS DOUBLE) AS x_yd, CAST(printf('%.3f', y) AS DOUBLE) AS y_yd, 'team_A' AS team, CAST(confidence < 0.3e0 AS INT) AS in_bad_run FROM fx_points WHERE measured")
def write_tracking(t):
    path = scratch(t)
    rows = t.points.select("clip", "frame_idx", "track_id", F.when(c("measured"), c("xs")).otherwise(F.lit(float("nan"))).alias("x_yd"),
                           c("y").alias("y_yd"), F.lit("team_A").alias("team"), (c("confidence") < 0.3).alias("in_bad_run"))
    IO.write_tracking(rows, path)
    return IO.read_tracking(t.spark, path)


@query("project_boxes", f"""
WITH cut AS ({CUTOFF})
SELECT b.clip, b.frame_idx, det_idx, {R6(px('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)'))} AS x_yd, {R6(py('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)'))} AS y_yd
FROM fx_boxes b JOIN fx_frames f ON b.clip = f.clip AND b.frame_idx = f.frame_idx JOIN cut ON cut.clip = b.clip WHERE h IS NOT NULL AND b.frame_idx < cutoff""")
def project_boxes(t):
    d = S.project_boxes(t.boxes, t.frames, R.carry_cutoff(t.frames))
    return d.select("clip", "frame_idx", "det_idx", r6("x_yd").alias("x_yd"), r6("y_yd").alias("y_yd"))


@query("with_intrinsics", """
WITH cam AS (SELECT clip, 1000e0 + max(n_corrs) AS f, max(rmse) AS k1 FROM fx_frames GROUP BY clip HAVING max(n_corrs) + length(clip) > 31)
SELECT e.clip, coalesce(f, 1e0) AS fx, coalesce(k1, 0e0) AS k1, f IS NOT NULL AS has_camera, CAST(count(*) AS BIGINT) AS n_entries
FROM fx_frames e LEFT JOIN cam USING (clip) GROUP BY ALL""")
def with_intrinsics(t):
    f = c("f")
    cam = t.frames.groupBy("clip").agg((1000.0 + F.max("n_corrs")).alias("f"), F.max("rmse").alias("k1"), F.max("n_corrs").alias("m"))
    cam = cam.where(c("m") + F.length("clip") > 31).select(
        "clip", F.array(F.array(f, F.lit(0.0), F.lit(640.0)), F.array(F.lit(0.0), f, F.lit(360.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).alias("K"),
        F.array(c("k1"), *[F.lit(0.0)] * 4).alias("dist"))
    entries = t.frames.groupBy("clip").agg(F.count("*").alias("n_entries"))
    return S.with_intrinsics(entries, cam).select("clip", c("K")[0][0].alias("fx"), c("dist")[0].alias("k1"), "has_camera", "n_entries")


ALIGNED = f"""SELECT o.*, CAST(snap_frame + floor((frame_idx - {OFFSET})/3) AS INT) AS frame FROM {OURS} o JOIN {SNAPS} s USING (clip) WHERE ((frame_idx - {OFFSET}) % 3 + 3) % 3 = 0"""


@query("rate_align", f"""
SELECT a.clip, a.track_id, a.frame_idx, a.frame, t.player_id, {R6('t.x - a.x')} AS dx FROM ({ALIGNED}) a JOIN fx_truth t ON t.clip = a.clip AND t.frame = a.frame""")
def rate_align(t):
    d = S.rate_align(ours(t), t.truth, S.event_frame(t.truth), OFFSET)
    return d.select("clip", "track_id", "frame_idx", "frame", "player_id", r6(c("tx") - c("x")).alias("dx"))


COSTS = f"""SELECT a.clip, track_id, player_id, avg(sqrt((a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y))) AS cost, CAST(count(*) AS BIGINT) AS n_overlap
FROM ({ALIGNED}) a JOIN fx_truth t ON t.clip = a.clip AND t.frame = a.frame GROUP BY ALL"""


@query("pair_costs", f"SELECT clip, track_id, player_id, {R6('cost')} AS cost, n_overlap FROM ({COSTS})")
def pair_costs(t):
    d = S.pair_costs(ours(t), t.truth, S.event_frame(t.truth), OFFSET)
    return d.withColumn("cost", r6("cost"))


@query("offset_costs", f"""
WITH o AS (SELECT * FROM {OURS}, (SELECT * FROM range(-18, 43, 3) r(off))),
a AS (SELECT o.*, CAST(snap_frame + floor((frame_idx - off)/3) AS INT) AS frame FROM o JOIN {SNAPS} s USING (clip) WHERE ((frame_idx - off) % 3 + 3) % 3 = 0)
SELECT a.clip, CAST(off AS INT) AS "offset", track_id, player_id, {R6('avg(sqrt((a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y)))')} AS cost, CAST(count(*) AS BIGINT) AS n_overlap
FROM a JOIN fx_truth t ON t.clip = a.clip AND t.frame = a.frame GROUP BY a.clip, off, track_id, player_id""")
def offset_costs(t):
    return S.offset_costs(ours(t), t.truth, S.event_frame(t.truth), OFFSET, 30).withColumn("cost", r6("cost"))


@query("linear_interp_join", f"""
WITH p AS (SELECT clip, track_id, track_id + 1000 AS player_id, frame_idx, snap_frame + (frame_idx - {OFFSET})/3e0 AS tf FROM fx_points JOIN {SNAPS} s USING (clip)),
q AS (SELECT *, CAST(floor(tf) AS INT) AS lo FROM p)
SELECT q.clip, track_id, frame_idx, {R6('coalesce(a.x*(1-(tf-lo)) + b.x*(tf-lo), a.x)')} AS truth_x, {R6('coalesce(a.y*(1-(tf-lo)) + b.y*(tf-lo), a.y)')} AS truth_y
FROM q LEFT JOIN fx_truth a ON a.clip = q.clip AND a.player_id = q.player_id AND a.frame = lo LEFT JOIN fx_truth b ON b.clip = q.clip AND b.player_id = q.player_id AND b.frame = lo + 1""")
def linear_interp_join(t):
    mine = t.points.select("clip", "track_id", (c("track_id") + 1000).alias("player_id"), "frame_idx")
    d = S.linear_interp_join(mine, t.truth, S.event_frame(t.truth), OFFSET)
    return d.select("clip", "track_id", "frame_idx", r6("truth_x").alias("truth_x"), r6("truth_y").alias("truth_y"))


SCORES = f"""SELECT * FROM (SELECT clip, track_id, player_id, CAST(count(*) AS BIGINT) AS n_obs, sqrt(avg(e*e)) AS pos_rmse_yd, avg(e) AS pos_mean_yd,
    quantile_cont(e, 0.5) AS pos_p50_yd, quantile_cont(e, 0.9) AS pos_p90_yd, sqrt(avg((speed-s)*(speed-s))) AS speed_rmse_yds,
    CASE WHEN stddev_pop(speed) > 1e-6 AND stddev_pop(s) > 1e-6 THEN corr(speed, s) END AS speed_corr, avg(speed) AS speed_mean_us_yds, avg(s) AS speed_mean_ngs_yds,
    sqrt(avg((accel-ta)*(accel-ta))) AS accel_rmse_yds2, CASE WHEN stddev_pop(accel) > 1e-6 AND stddev_pop(ta) > 1e-6 THEN corr(accel, ta) END AS accel_corr
  FROM (SELECT *, {slope('speed', 't')} AS accel FROM (SELECT *, sqrt(vx*vx + vy*vy) AS speed FROM (
    SELECT *, {slope('x', 't')} AS vx, {slope('y', 't')} AS vy, {slope('s', 't')} AS ta FROM (
      SELECT a.clip, track_id, player_id, frame_idx, a.x, a.y, t.s, (frame_idx - {OFFSET})/30e0 AS t, sqrt((a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y)) AS e
      FROM ({ALIGNED}) a JOIN fx_truth t ON t.clip = a.clip AND t.frame = a.frame AND t.player_id = a.track_id + 1000)
    WINDOW w AS (PARTITION BY clip, track_id, player_id ORDER BY frame_idx))) WINDOW w AS (PARTITION BY clip, track_id, player_id ORDER BY frame_idx))
  GROUP BY clip, track_id, player_id) WHERE n_obs >= 5"""
SCORE_NUMS = ["pos_rmse_yd", "pos_mean_yd", "pos_p50_yd", "pos_p90_yd", "speed_rmse_yds", "speed_corr",
              "speed_mean_us_yds", "speed_mean_ngs_yds", "accel_rmse_yds2", "accel_corr"]


def own_scores(t):
    pairs = t.points.select("clip", "track_id", (c("track_id") + 1000).alias("player_id")).distinct()
    return S.score_pairs(ours(t), t.truth, S.event_frame(t.truth), pairs, F.lit(OFFSET))


@query("score_pairs", f"SELECT clip, track_id, player_id, n_obs, {', '.join(f'{R4(k)} AS {k}' for k in SCORE_NUMS)} FROM ({SCORES})")
def score_pairs(t):
    return own_scores(t).withColumns({k: r4(k) for k in SCORE_NUMS})


@query("summarise_scores", f"""
SELECT metric, CAST(count(value) AS BIGINT) AS n, {R4('quantile_cont(value, 0.5)')} AS median, {R4('avg(value)')} AS mean
FROM (UNPIVOT (SELECT {', '.join(S.METRICS)} FROM ({SCORES})) ON {', '.join(S.METRICS)} INTO NAME metric VALUE value) GROUP BY metric""")
def summarise_scores(t):
    return S.summarise_scores(own_scores(t)).withColumns({"median": r4("median"), "mean": r4("mean")})


@query("write_scores", f"""
SELECT track_id, player_id AS nfl_id, 'P'||player_id AS player, CAST(track_id % 99 + 1 AS BIGINT) AS jersey, n_obs, {R4('pos_rmse_yd')} AS pos_rmse_yd FROM ({SCORES})""")
def write_scores(t):
    path = scratch(t)
    meta = S.player_meta(t.truth, ["display_name", "jersey", "position", "team"])
    full = own_scores(t).join(meta, ["clip", "player_id"]).select(
        "*", c("player_id").alias("nfl_id"), c("display_name").alias("player"), c("position").alias("pos"),
        c("n_obs").alias("n_overlap_frames"), c("pos_mean_yd").alias("match_cost_yd"))
    IO.write_scores(full, path)
    d = IO.read_scores(t.spark, path)
    return d.select("track_id", "nfl_id", "player", "jersey", "n_obs", r4("pos_rmse_yd").alias("pos_rmse_yd"))


@query("residual_percentiles", f"""
SELECT CAST(count(rmse) AS BIGINT) AS n, {', '.join(f"{R6(f'quantile_cont(rmse, {q})')} AS {k}" for k, q in (('median', .5), ('p90', .9), ('p95', .95), ('p99', .99)))}, {R6('max(rmse)')} AS max
FROM (SELECT CASE WHEN h IS NOT NULL THEN rmse END AS rmse FROM fx_frames)""")
def residual_percentiles(t):
    d = S.residual_percentiles(t.frames.select(F.when(c("h").isNotNull(), c("rmse")).alias("rmse")), "rmse")
    return d.select("n", *[r6(k).alias(k) for k in ("median", "p90", "p95", "p99", "max")])


@query("residual_percentiles_by_clip", f"""
SELECT clip, CAST(count(rmse) AS BIGINT) AS n, {', '.join(f"{R6(f'quantile_cont(rmse, {q})')} AS {k}" for k, q in (('median', .5), ('p90', .9), ('p95', .95), ('p99', .99)))}, {R6('max(rmse)')} AS max
FROM fx_frames GROUP BY clip""")
def residual_percentiles_by_clip(t):
    d = S.residual_percentiles(t.frames.select("clip", "rmse"), "rmse", ["clip"])
    return d.select("clip", "n", *[r6(k).alias(k) for k in ("median", "p90", "p95", "p99", "max")])


@query("filter_confusion", f"""
SELECT *, {R6('CASE WHEN "both" + old_only > 0 THEN "both"/(1e0*("both" + old_only)) END')} AS recall FROM (
SELECT clip, CAST(count(*) FILTER (old_red AND new_red) AS BIGINT) AS "both", CAST(count(*) FILTER (old_red AND NOT new_red) AS BIGINT) AS old_only,
  CAST(count(*) FILTER (new_red AND NOT old_red) AS BIGINT) AS new_only, CAST(count(*) FILTER (NOT old_red AND NOT new_red) AS BIGINT) AS neither
FROM fx_decided GROUP BY ROLLUP (clip))""")
def filter_confusion(t):
    return S.filter_confusion(t.decided).withColumn("recall", r6("recall"))


@query("qc_summary", f"""
SELECT clip, n_yes, n_no, n_skip, {R6('rate')} AS accept_rate, CASE WHEN rate >= 0.95e0 THEN 'ready' WHEN rate >= 0.90e0 THEN 'caution' ELSE 'debug' END AS readiness
FROM (SELECT *, n_yes/(1e0*greatest(n_yes + n_no, 1)) AS rate FROM (
  SELECT clip, CAST(count(*) FILTER (d = 'y') AS BIGINT) AS n_yes, CAST(count(*) FILTER (d = 'n') AS BIGINT) AS n_no, CAST(count(*) FILTER (d = 's') AS BIGINT) AS n_skip
  FROM (SELECT clip, CASE WHEN id % 40 = 3 THEN 's' ELSE decision END AS d FROM fx_decided) GROUP BY clip))""")
def qc_summary(t):
    d = t.decided.withColumn("decision", F.when(c("id") % 40 == 3, F.lit("s")).otherwise(c("decision")))
    return S.qc_summary(d, ["clip"]).withColumn("accept_rate", r6("accept_rate"))


@query("flag_sets", """
SELECT id, clip, CASE WHEN old_red AND new_red THEN 'both' WHEN old_red THEN 'old_only' ELSE 'new_only' END AS caught FROM fx_decided WHERE old_red OR new_red""")
def flag_sets(t):
    return S.flag_sets(t.decided, ["id", "clip"])


@query("kept_and_probationary", """
SELECT corr_id, kind, CASE WHEN u < 400 THEN 'kept' ELSE 'probationary' END AS pool FROM fx_corrs WHERE u < 400 OR v > 200""")
def kept_and_probationary(t):
    kept = t.corrs.where("u < 400").select("corr_id", "kind", F.lit("kept").alias("pool"))
    return kept.unionByName(t.corrs.where("u >= 400 and v > 200").select("corr_id", "kind", F.lit("probationary").alias("pool")))


@query("distinct_clips", "SELECT DISTINCT clip FROM fx_frames")
def distinct_clips(t):
    return t.frames.select("clip").distinct()


@query("uncovered_identities", """
SELECT DISTINCT clip, kind, slot FROM fx_corrs a WHERE NOT EXISTS (SELECT 1 FROM fx_corrs b WHERE b.frame_idx % 50 = 0 AND a.clip = b.clip AND a.kind = b.kind AND a.slot = b.slot)""")
def uncovered_identities(t):
    covered = t.corrs.where(c("frame_idx") % 50 == 0).select("clip", "kind", "slot")
    return t.corrs.select("clip", "kind", "slot").distinct().join(covered, ["clip", "kind", "slot"], "left_anti")
