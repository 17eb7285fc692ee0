"""Composed pipelines (Q1-Q6)."""

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.q_columns import _FLAGS, _SHIFTED, EDGES, _shifted
from catalog.q_datasets import POOL
from catalog.q_scoring import COSTS, SCORE_NUMS, SCORES, ours
from catalog.q_sequence import CUTOFF, PLAYS
from catalog.sqlgeo import px, py
from catalog.sqlparts import TEMPORAL, fill_ctes, loo_ctes, smooth_h_ctes, smoothed
from fieldmotion.operators import labels as L
from fieldmotion.plans import pipelines as P

c = F.col
FRAME = ["clip", "frame_idx"]

_CUT = f"cut AS ({CUTOFF}), cutf AS MATERIALIZED (SELECT f.*, cutoff FROM fx_frames f JOIN cut USING (clip) WHERE frame_idx < cutoff)"


def on_cut(text):
    return text.replace("fx_frames", "cutf")


_TRK = f"""long AS (SELECT clip, CAST(det_idx AS BIGINT) AS track_id FROM fx_boxes JOIN cut USING (clip) GROUP BY clip, det_idx HAVING count(*) FILTER (part % 7 > 0) >= greatest(floor(max(cutoff)*0.5e0), 1)),
trk AS MATERIALIZED (SELECT b.clip, CAST(det_idx AS BIGINT) AS track_id, b.frame_idx, true AS measured, {px('h_smooth', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS xs, {py('h_smooth', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS y
  FROM fx_boxes b JOIN hs ON hs.clip = b.clip AND hs.frame_idx = b.frame_idx JOIN long ON long.clip = b.clip AND long.track_id = b.det_idx WHERE h_smooth IS NOT NULL),
rg AS (SELECT clip, frame_idx, red, frame_idx - row_number() OVER (PARTITION BY clip, red ORDER BY frame_idx) AS g FROM clean),
bad AS (SELECT clip, frame_idx, red AND count(*) OVER (PARTITION BY clip, red, g) >= 5 AS in_bad_run FROM rg)"""


@query("build_tracks", f"""
WITH {_CUT}, {on_cut(fill_ctes())}, {smooth_h_ctes()}, {_TRK}
SELECT clip, frame_idx, track_id, {R4('sx')} AS x_yd, {R4('sy')} AS y_yd, CASE WHEN track_id % 2 = 0 THEN 'team_A' ELSE 'unknown' END AS team, in_bad_run
FROM ({smoothed([9], 9, None).replace('fx_points', 'trk')}) JOIN bad USING (clip, frame_idx)""")
def build_tracks(t):
    tracked = t.boxes.withColumns({"track_id": c("det_idx").cast("long"), "interrupted": c("part") % 7 == 0})
    teams = tracked.where("track_id % 2 = 0").select("clip", "track_id").distinct().withColumn("team", F.lit("team_A"))
    d = P.build_tracks(tracked, t.frames, teams)
    return d.withColumns({"x_yd": r4("x_yd"), "y_yd": r4("y_yd")})


# the truth is shifted by 12 frames and each player is the track's id plus 1000
@query("score_against_truth", f"SELECT clip, track_id, player_id, n_obs, {', '.join(f'{R4(k)} AS {k}' for k in SCORE_NUMS)}, n_obs AS n_overlap_frames, {R4('cost')} AS match_cost_yd FROM ({SCORES}) JOIN ({COSTS}) USING (clip, track_id, player_id)")
def score_against_truth(t):
    scores, _ = P.score_against_truth(ours(t), t.truth, 12, 30)
    return scores.withColumns({k: r4(k) for k in (*SCORE_NUMS, "match_cost_yd")})


def _temporal(source):
    return TEMPORAL.replace("fx_frames", source).replace("SELECT clip, frame_idx, h, method, rmse,", "SELECT clip, frame_idx, h, rmse, inlier_frac, n_corrs, n_yard_fits,")


_TRUSTED = f"""fb AS (SELECT clip, frame_idx, CASE WHEN h IS NOT NULL THEN {_SHIFTED} END AS h, method, rmse/2 AS rmse, inlier_frac, n_corrs + 6 AS n_corrs, CAST(NULL AS INT) AS n_yard_fits FROM fx_frames),
ta AS (SELECT clip, frame_idx, h, {_FLAGS.format(rmse='rmse', inl='inlier_frac', nc='n_corrs', yf='n_yard_fits', td='temp_div')} AS f FROM ({_temporal('fx_frames')})),
tb AS (SELECT clip, frame_idx, h, {_FLAGS.format(rmse='rmse', inl='inlier_frac', nc='n_corrs', yf='n_yard_fits', td='temp_div')} AS f FROM ({_temporal('fb')})),
used AS MATERIALIZED (SELECT a.clip, a.frame_idx, CASE WHEN a.h IS NOT NULL AND len(a.f) = 0 THEN 'new' ELSE 'classical' END AS h_source, CASE WHEN a.h IS NOT NULL AND len(a.f) = 0 THEN a.h ELSE b.h END AS h
  FROM ta a JOIN tb b USING (clip, frame_idx) WHERE (a.h IS NOT NULL AND len(a.f) = 0) OR (b.h IS NOT NULL AND len(b.f) = 0))"""


def both_sources(t):
    none = F.lit(None).cast("int")
    b = t.frames.withColumns({"h": _shifted(), "rmse": c("rmse") / 2, "n_corrs": c("n_corrs") + 6, "n_yard_fits": none})
    return t.frames, b


@query("trusted_frames", f"WITH {_TRUSTED} SELECT clip, frame_idx, h_source, {R6('h[1]')} AS h0 FROM used")
def trusted_frames(t):
    return P.trusted_frames(*both_sources(t)).select(*FRAME, "h_source", r6(c("h_used")[0]).alias("h0"))


@query("derive_training_labels", f"""
WITH {_TRUSTED}, lab AS (SELECT u.clip, u.frame_idx, h_source, CAST(part % 4 AS INT) AS type, CAST(part % 21 AS INT) AS model, CAST(round_even(({px('h', 'x1', 'y1', 'clamp9')}-10)/5, 0) AS INT) AS k, {px('h', 'x1', 'y1', 'clamp9')} AS x FROM fx_boxes b JOIN used u ON u.clip = b.clip AND u.frame_idx = b.frame_idx),
t AS (SELECT *, CASE WHEN type IN (0, 2) THEN CASE WHEN k BETWEEN 0 AND 20 THEN k ELSE -1 END WHEN type = 3 THEN CASE WHEN k BETWEEN 2 AND 18 AND e BETWEEN 2 AND 18 THEN e ELSE -1 END ELSE -1 END AS true_class
  FROM (SELECT *, CASE WHEN k % 2 = 0 THEN k WHEN x > 10 + k*5 THEN k+1 ELSE k-1 END AS e FROM lab))
SELECT clip, frame_idx, h_source, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (true_class >= 0 AND model <> true_class) AS BIGINT) AS n_corrections FROM t GROUP BY ALL""")
def derive_training_labels(t):
    tokens = t.boxes.select(*FRAME, (c("part") % 4).cast("int").alias("type"), (c("part") % 21).cast("int").alias("pred_class"), c("x1").alias("u"), c("y1").alias("v"))
    d = P.derive_training_labels(*both_sources(t), tokens)
    n = d.groupBy(*FRAME, "h_source").agg(F.count("*").alias("n_tokens"))
    return n.join(L.n_corrections(d, FRAME), FRAME)


@query("build_pool", f"""
WITH e AS (SELECT *, clip||'#'||frame_idx AS id, CASE WHEN mean_ngs_x < 10 OR mean_ngs_x > 110 THEN -1 WHEN mean_ngs_x < 30 THEN 0 WHEN mean_ngs_x < 50 THEN 1 WHEN mean_ngs_x < 70 THEN 2 WHEN mean_ngs_x < 90 THEN 3 ELSE 4 END AS stratum FROM ({POOL}))
SELECT clip, frame_idx, stratum, n_corrs FROM e WHERE clip NOT IN ('c0', 'c5') AND inlier_frac >= 0.8e0 AND stratum >= 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('42|'||id), id) <= 60""")
def build_pool(t):
    e = L.frame_pool_stats(t.corrs, c("v") % 100 < 45).withColumns({"id": F.concat("clip", F.lit("#"), "frame_idx"), "game": c("clip")})
    held = lambda name: e.where(c("clip") == name).select("clip", "game").distinct()
    return P.build_pool(e, held("c0"), held("c5"), EDGES, 60, 0.8).select("clip", "frame_idx", "stratum", "n_corrs")


@query("segment_plays", f"""
SELECT *, CASE WHEN sideline_end - sideline_start - 3 > 1 THEN sideline_start + 1 END AS sideline_cut_start, CASE WHEN sideline_end - sideline_start - 3 > 1 THEN sideline_end - sideline_start - 3 END AS sideline_cut_length,
  CASE WHEN endzone_end > 0 AND endzone_end - endzone_start - 3 > 1 THEN endzone_start + 1 END AS endzone_cut_start, CASE WHEN endzone_end > 0 AND endzone_end - endzone_start - 3 > 1 THEN endzone_end - endzone_start - 3 END AS endzone_cut_length FROM ({PLAYS})""")
def segment_plays(t):
    return P.segment_plays(t.views)


_FLAGGED = f"""{_CUT}, td AS ({TEMPORAL}), {on_cut(loo_ctes())},
fl AS MATERIALIZED (SELECT c.clip, c.frame_idx, loo, c.h IS NULL OR coalesce(c.rmse > 0.30e0, false) OR coalesce(temp_div > 1, false) AS old_red, c.h IS NULL OR coalesce(loo > 0.20e0, false) AS new_red
  FROM cutf c JOIN td USING (clip, frame_idx) LEFT JOIN loo USING (clip, frame_idx))"""


@query("compare_h_filters", f"""
WITH {_FLAGGED} SELECT *, {R6('CASE WHEN "both" + old_only > 0 THEN "both"/(1e0*("both" + old_only)) END')} AS recall FROM (
SELECT clip, CAST(count(*) FILTER (old_red AND new_red) AS BIGINT) AS "both", CAST(count(*) FILTER (old_red AND NOT new_red) AS BIGINT) AS old_only,
  CAST(count(*) FILTER (new_red AND NOT old_red) AS BIGINT) AS new_only, CAST(count(*) FILTER (NOT old_red AND NOT new_red) AS BIGINT) AS neither FROM fl GROUP BY ROLLUP (clip))""")
def compare_h_filters(t):
    return P.compare_h_filters(t.frames)["confusion"].withColumn("recall", r6("recall"))


@query("compare_h_filters_top", f"WITH {_FLAGGED} SELECT clip, frame_idx, {R6('loo')} AS loo FROM fl WHERE new_red AND NOT old_red AND loo IS NOT NULL ORDER BY fl.loo DESC, clip, frame_idx LIMIT 20")
def compare_h_filters_top(t):
    return P.compare_h_filters(t.frames)["top_new"].select("clip", "frame_idx", r6("loo").alias("loo"))
