"""Assignment, motion, identity bank and plane fits."""

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.q_scoring import ALIGNED, COSTS, OFFSET, SNAPS, OURS, ours
from catalog.sqlgeo import inverse, iou, px, py
from fieldmotion.operators import assign as A
from fieldmotion.operators import bank as B
from fieldmotion.operators import identity_walk as W
from fieldmotion.operators import motion as K
from fieldmotion.operators import planar as P
from fieldmotion.operators import rejects as X
from fieldmotion.operators import scoring as S
from fieldmotion.operators.reliable import stage

c = F.col
FRAME = ["clip", "frame_idx"]


# every track's cheapest player is a different one here, so the row minima are the optimum
@query("assign_optimal", f"""
WITH k AS ({COSTS}) SELECT clip, track_id, player_id, {R6('cost')} AS cost FROM k QUALIFY row_number() OVER (PARTITION BY clip, track_id ORDER BY cost, player_id) = 1""")
def assign_optimal(t):
    costs = S.pair_costs(ours(t), t.truth, S.event_frame(t.truth), OFFSET)
    return A.assign_optimal(costs, ["clip"], "track_id", "player_id").withColumn("cost", r6("cost"))


SWEEP = 60  # frames of ours (two seconds) on either side of the centre: 41 offsets


@query("sweep_offsets")
def sweep_offsets(t):
    costs = S.offset_costs(ours(t), t.truth, S.event_frame(t.truth), OFFSET, SWEEP)
    log, best = A.best_offset(stage(A.sweep(costs)))
    picked = best.select("clip", c("offset").alias("best"))
    return log.join(picked, "clip").select("clip", "offset", "best", r4("total").alias("total"), "n_matched", r4("mean").alias("mean"))


_SPLIT = f"""p AS MATERIALIZED (SELECT b.clip, b.frame_idx, det_idx, x1, y1, x2, y2, part, supp, {px('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS x_yd, {py('h', '(x1+x2)*0.5e0', 'y1 + 0.95e0*(y2-y1)')} AS y_yd
  FROM fx_boxes b JOIN fx_frames f ON b.clip = f.clip AND b.frame_idx = f.frame_idx WHERE h IS NOT NULL)"""


def split(t):
    p = S.project_boxes(t.boxes, t.frames)
    tracks = p.where("det_idx % 2 = 0").withColumn("track_id", c("det_idx").cast("long"))
    return tracks, p.where("det_idx % 2 = 1")


@query("assign_greedy", f"""
WITH RECURSIVE {_SPLIT}, cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip, frame_idx ORDER BY d, cost, t) AS k FROM (
  SELECT a.clip, a.frame_idx, a.det_idx AS d, b.det_idx AS t, sqrt((a.x_yd-b.x_yd)*(a.x_yd-b.x_yd) + (a.y_yd-b.y_yd)*(a.y_yd-b.y_yd)) + 5e0*((b.part % 100)/90e0) AS cost, b.part % 100 AS age,
    sqrt((a.x_yd-b.x_yd)*(a.x_yd-b.x_yd) + (a.y_yd-b.y_yd)*(a.y_yd-b.y_yd)) AS dist
  FROM p a JOIN p b ON a.clip = b.clip AND a.frame_idx = b.frame_idx AND a.det_idx % 2 = 1 AND b.det_idx % 2 = 0) WHERE age BETWEEN 1 AND 90 AND dist <= 10e0*age*(1e0/30) AND cost < 8),
r AS (SELECT clip, frame_idx, k, [d] AS ds, [t] AS ts, d, t, cost, true AS took FROM cand WHERE k = 1
  UNION ALL SELECT r.clip, r.frame_idx, q.k, CASE WHEN list_contains(ds, q.d) OR list_contains(ts, q.t) THEN ds ELSE list_append(ds, q.d) END,
    CASE WHEN list_contains(ds, q.d) OR list_contains(ts, q.t) THEN ts ELSE list_append(ts, q.t) END, q.d, q.t, q.cost, NOT (list_contains(ds, q.d) OR list_contains(ts, q.t))
  FROM r JOIN cand q ON q.clip = r.clip AND q.frame_idx = r.frame_idx AND q.k = r.k + 1)
SELECT clip, frame_idx, CAST(d AS BIGINT) AS det_idx, CAST(t AS BIGINT) AS track_id, {R6('cost')} AS cost FROM r WHERE took""")
def assign_greedy(t):
    tracks, dets = split(t)
    cand = A.revival_candidates(dets, tracks.withColumn("age", c("part") % 100), FRAME)
    return A.assign_greedy(cand, FRAME).withColumn("cost", r6("cost"))


_SX, _SY, _SXY = "(0.5e0 + (t.part % 7)*2)", "(0.4e0 + (t.supp % 5)*2)", "(0.1e0*(t.part % 3))"


@query("gated_candidates", f"""
WITH {_SPLIT}, j AS (SELECT d.clip, d.frame_idx, d.det_idx, t.det_idx AS track_id, {_SX} AS sxx, {_SY} AS syy, {_SXY} AS sxy, d.x_yd - t.x_yd AS dx, d.y_yd - t.y_yd AS dy,
  {iou(('t.x1', 't.y1', 't.x2', 't.y2'), ('d.x1', 'd.y1', 'd.x2', 'd.y2'), 0.3)} AS iou, t.part % 6 AS n_obs, [1e0, t.supp % 5, t.part % 4] AS ts, [1e0, d.supp % 5, d.part % 4] AS ds
  FROM p d JOIN p t ON d.clip = t.clip AND d.frame_idx = t.frame_idx AND d.det_idx % 2 = 1 AND t.det_idx % 2 = 0),
m AS (SELECT *, (syy*dx*dx - 2*sxy*dx*dy + sxx*dy*dy)/(sxx*syy - sxy*sxy) AS m FROM j),
q AS (SELECT *, CASE WHEN n_obs >= 3 AND ds[2] <> 4 THEN least(greatest(1 - (ts[1]*ds[1] + ts[2]*ds[2] + ts[3]*ds[3])/(sqrt(ts[1]*ts[1] + ts[2]*ts[2] + ts[3]*ts[3])*sqrt(ds[1]*ds[1] + ds[2]*ds[2] + ds[3]*ds[3])), 0e0), 1e0) END AS dc FROM m WHERE m <= 9.21e0)
SELECT clip, frame_idx, CAST(track_id AS BIGINT) AS track_id, det_idx, {R6('m')} AS mahal_sq, {R6('0.5e0*m/9.21e0 + (1 - iou) + coalesce(dc, 0e0)')} AS cost FROM q""")
def gated_candidates(t):
    tracks, dets = split(t)
    sig = F.array(F.lit(1.0), (c("supp") % 5).cast("double"), (c("part") % 4).cast("double"))
    tracks = tracks.withColumns({"sxx": 0.5 + (c("part") % 7) * 2, "syy": 0.4 + (c("supp") % 5) * 2, "sxy": 0.1 * (c("part") % 3),
                                 "n_obs": c("part") % 6, "sig": sig})
    dets = dets.withColumn("sig", F.when(c("supp") % 5 != 4, sig))
    d = A.gated_candidates(tracks, dets, FRAME)
    return d.select(*FRAME, "track_id", "det_idx", r6("mahal_sq").alias("mahal_sq"), r6("cost").alias("cost"))


@query("ema", f"""
SELECT clip, track_id, {', '.join(f'{R6(f'e[{i+1}]')} AS e{i}' for i in range(3))} FROM (
  SELECT clip, track_id, list_reduce(list([x, y, confidence] ORDER BY frame_idx), lambda a, s: [0.9e0*a[i] + 0.1e0*s[i] for i in range(1, 4)]) AS e
  FROM fx_points WHERE measured AND event_id % 6 > 0 GROUP BY clip, track_id)""")
def ema(t):
    d = t.points.withColumn("sig", F.array("x", "y", "confidence"))
    out = K.ema(d, "sig", c("measured") & (c("event_id") % 6 > 0), 0.9)
    return out.select("clip", "track_id", *[r6(c("ema")[i]).alias(f"e{i}") for i in range(3)])


_DT = "(1/30e0)"


@query("kalman_track", f"""
WITH RECURSIVE b AS (SELECT clip, track_id, min(frame_idx) AS born FROM fx_points WHERE measured GROUP BY ALL),
p AS MATERIALIZED (SELECT f.clip, f.track_id, f.frame_idx, measured, xs AS zx, y AS zy, born FROM fx_points f JOIN b USING (clip, track_id) WHERE f.frame_idx >= born),
k AS (SELECT clip, track_id, frame_idx, zx AS x, zy AS y, 0e0 AS vx, 0e0 AS vy, 0.25e0 AS p11, 0e0 AS p12, 25e0 AS p22 FROM p WHERE frame_idx = born
  UNION ALL SELECT clip, track_id, frame_idx, px + g1*(zx - px), py + g1*(zy - py), vx + g2*(zx - px), vy + g2*(zy - py), q11*(1 - g1), q12*(1 - g1), q22 - g2*q12 FROM (
    SELECT *, CASE WHEN measured THEN q11/(q11 + 0.25e0) ELSE 0e0 END AS g1, CASE WHEN measured THEN q12/(q11 + 0.25e0) ELSE 0e0 END AS g2 FROM (
      SELECT n.clip, n.track_id, n.frame_idx, n.measured, n.zx, n.zy, k.x + {_DT}*k.vx AS px, k.y + {_DT}*k.vy AS py, k.vx, k.vy,
        k.p11 + 2*{_DT}*k.p12 + {_DT}*{_DT}*k.p22 + 64*pow({_DT}, 4)/4 AS q11, k.p12 + {_DT}*k.p22 + 64*pow({_DT}, 3)/2 AS q12, k.p22 + 64*pow({_DT}, 2) AS q22
      FROM k JOIN p n ON n.clip = k.clip AND n.track_id = k.track_id AND n.frame_idx = k.frame_idx + 1)))
SELECT clip, track_id, frame_idx, {R6('x')} AS fx, {R6('y')} AS fy, {R6('vx')} AS vx, {R6('vy')} AS vy, {R6('p11')} AS var FROM k""")
def kalman_track(t):
    d = K.kalman_track(t.points, "xs", "y")
    return d.select("clip", "track_id", "frame_idx", *[r6(k).alias(k) for k in ("fx", "fy", "vx", "vy", "var")])


# Frame by frame: the bank before a frame judges it, and what it accepts changes the bank.
WALK = """fr AS MATERIALIZED (SELECT clip, frame_idx, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS i, list({'id': corr_id, 'k': kind||'|'||slot, 'u': u, 'v': v} ORDER BY corr_id) AS c FROM fx_corrs GROUP BY clip, frame_idx),
wk AS (SELECT clip, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id VARCHAR, verdict VARCHAR)[]) AS said, CAST([] AS STRUCT(k VARCHAR, f BIGINT, l BIGINT, n BIGINT, u DOUBLE, v DOUBLE)[]) AS bank FROM fr WHERE i = 1
  UNION ALL SELECT clip, i, list_transform(c, lambda x: {'id': x.id, 'verdict': x.said}), list_filter(list_transform(list_distinct(list_concat(list_transform(bank, lambda b: b.k), list_transform(list_filter(c, lambda x: x.said IN ('kept', 'probationary')), lambda x: x.k))),
    lambda k: {'k': k, 'f': coalesce(list_filter(bank, lambda b: b.k = k)[1].f, frame_idx), 'l': CASE WHEN len(list_filter(c, lambda x: x.k = k AND x.said IN ('kept', 'probationary'))) > 0 THEN frame_idx ELSE list_filter(bank, lambda b: b.k = k)[1].l END,
      'n': coalesce(list_filter(bank, lambda b: b.k = k)[1].n, 0) + len(list_filter(c, lambda x: x.k = k AND x.said IN ('kept', 'probationary'))),
      'u': coalesce(list_filter(c, lambda x: x.k = k AND x.said IN ('kept', 'probationary'))[-1].u, list_filter(bank, lambda b: b.k = k)[1].u),
      'v': coalesce(list_filter(c, lambda x: x.k = k AND x.said IN ('kept', 'probationary'))[-1].v, list_filter(bank, lambda b: b.k = k)[1].v)}), lambda b: frame_idx - b.l <= 8)
  FROM (SELECT w.clip, f.i, CAST(f.frame_idx AS BIGINT) AS frame_idx, w.bank, list_transform(f.c, lambda x: {'id': x.id, 'k': x.k, 'u': x.u, 'v': x.v, 'said':
      CASE WHEN len(list_filter(w.bank, lambda b: b.n >= 3 AND b.k <> x.k AND sqrt((x.u - b.u)*(x.u - b.u) + (x.v - b.v)*(x.v - b.v)) < 20)) > 0 THEN 'cross'
      WHEN len(list_filter(w.bank, lambda b: b.n >= 3 AND b.k = x.k AND sqrt((x.u - b.u)*(x.u - b.u) + (x.v - b.v)*(x.v - b.v)) > 50)) > 0 THEN 'self'
      WHEN f.frame_idx >= 5 AND len(list_filter(w.bank, lambda b: b.k = x.k AND (b.n >= 3 OR b.f < 5))) = 0 THEN 'probationary' ELSE 'kept' END}) AS c
    FROM wk w JOIN fr f ON f.clip = w.clip AND f.i = w.i + 1)),
vd AS MATERIALIZED (SELECT s.id AS corr_id, s.verdict FROM (SELECT unnest(said) AS s FROM wk)),
ac AS MATERIALIZED (SELECT k.*, verdict FROM fx_corrs k JOIN vd USING (corr_id) WHERE verdict IN ('kept', 'probationary'))"""
HIST = f"""{WALK}, hs AS (SELECT clip, kind, slot, frame_idx, count(*) AS n_frame, max_by(u, corr_id) AS last_u, max_by(v, corr_id) AS last_v FROM ac GROUP BY clip, kind, slot, frame_idx),
hg AS (SELECT *, coalesce(frame_idx - lag(frame_idx) OVER w - 1 > 8, true) AS born, lag(frame_idx) OVER w AS pf, lag(last_u) OVER w AS pu, lag(last_v) OVER w AS pv, lead(frame_idx) OVER w AS next_frame FROM hs WINDOW w AS (PARTITION BY clip, kind, slot ORDER BY frame_idx)),
he AS (SELECT *, sum(CASE WHEN born THEN 1 ELSE 0 END) OVER (PARTITION BY clip, kind, slot ORDER BY frame_idx) AS epoch FROM hg),
hist AS MATERIALIZED (SELECT *, min(frame_idx) OVER (PARTITION BY clip, kind, slot, epoch) AS first_seen, sum(n_frame) OVER (PARTITION BY clip, kind, slot, epoch ORDER BY frame_idx) AS n_obs,
  CASE WHEN NOT born THEN sum(n_frame) OVER (PARTITION BY clip, kind, slot, epoch ORDER BY frame_idx) - n_frame END AS prev_obs FROM he)"""
STATES = """st AS MATERIALIZED (SELECT clip, kind, slot, frame_idx AS last_seen, first_seen, n_obs, n_obs >= 3 AS trusted, last_u, last_v, unnest(range(frame_idx + 1, least(coalesce(next_frame, frame_idx + 9), frame_idx + 9) + 1)) AS frame_idx FROM hist)"""


def states(t):
    """(accepted correspondences, what each frame starts with)."""
    judged = W.judged_corrs(t.corrs).where(c("verdict").isin("kept", "probationary"))
    judged = stage(judged.drop("corr_id", *W.BEFORE))
    return judged, B.states_before(W.accepted_history(judged))


def starts(t):
    """What each frame starts with, where nothing else reads the verdicts."""
    return B.states_before(W.accepted_history(W.judged_corrs(t.corrs)))


@query("identity_history", f"""
WITH RECURSIVE {HIST} SELECT clip, kind, slot, frame_idx, CAST(first_seen AS INT) AS first_seen, CAST(n_obs AS INT) AS n_obs, n_obs >= 3 AS trusted, CAST(prev_obs AS INT) AS prev_obs,
  CASE WHEN NOT born THEN pf END AS prev_frame, {R6('CASE WHEN NOT born THEN pu END')} AS prev_u FROM hist""")
def identity_history(t):
    d = W.accepted_history(W.judged_corrs(t.corrs))
    return d.select("clip", "kind", "slot", "frame_idx", "first_seen", "n_obs", "trusted", "prev_obs", "prev_frame", r6("prev_u").alias("prev_u"))


@query("cross_conflicts", f"""
WITH RECURSIVE {HIST}, {STATES} SELECT corr_id FROM fx_corrs k WHERE EXISTS (SELECT 1 FROM st WHERE trusted AND st.clip = k.clip AND st.frame_idx = k.frame_idx AND (st.kind <> k.kind OR st.slot <> k.slot)
  AND sqrt((k.u-last_u)*(k.u-last_u) + (k.v-last_v)*(k.v-last_v)) < 20)""")
def cross_conflicts(t):
    return B.cross_conflicts(t.corrs.select(*W.CORR), starts(t)).select("corr_id")


@query("prefilter_corrs", f"""
WITH RECURSIVE {WALK} SELECT corr_id, verdict FROM vd""")
def prefilter_corrs(t):
    return B.prefilter_corrs(t.corrs).select("corr_id", "verdict")


_KY = "CASE kind WHEN 'near_hash' THEN 23.583e0 WHEN 'far_hash' THEN 53.33e0 - 23.583e0 WHEN 'sideline_near' THEN 0e0 WHEN 'sideline_far' THEN 53.33e0 WHEN 'number_near' THEN 14e0 ELSE 39.33e0 END"


@query("coast", f"""
WITH RECURSIVE {HIST}, {STATES}, i AS (SELECT st.*, 10e0 + 5*slot AS fx, {_KY} AS fy FROM st WHERE trusted AND st.frame_idx - last_seen <= 4 AND NOT EXISTS (SELECT 1 FROM hist k WHERE k.clip = st.clip AND k.kind = st.kind AND k.slot = st.slot AND k.frame_idx = st.frame_idx)),
f AS (SELECT clip, frame_idx + 1 AS frame_idx, {inverse('h')} AS inv FROM fx_frames WHERE h IS NOT NULL)
SELECT i.clip, kind, slot, CAST(i.frame_idx AS INT) AS frame_idx, CAST(i.frame_idx - last_seen AS INT) AS coast_age, {R4(px('inv', 'fx', 'fy', 'clamp'))} AS u, {R4(py('inv', 'fx', 'fy', 'clamp'))} AS v
FROM i JOIN f ON f.clip = i.clip AND f.frame_idx = i.frame_idx""")
def coast(t):
    corrs, st = states(t)
    d = B.coast(st, corrs, t.frames)
    return d.select("clip", "kind", "slot", "frame_idx", "coast_age", r4("u").alias("u"), r4("v").alias("v"))


# residuals of trusted identities under each frame's homography; ck has one row a frame with a homography
CHECKED = f"""kp AS (SELECT * FROM ac WHERE verdict = 'kept'),
pts AS (SELECT k.clip, k.frame_idx, k.kind, k.slot, k.u, k.v, 'corr' AS via FROM kp k WHERE EXISTS (SELECT 1 FROM st WHERE trusted AND st.clip = k.clip AND st.kind = k.kind AND st.slot = k.slot AND st.frame_idx = k.frame_idx)
  UNION ALL SELECT clip, frame_idx, kind, slot, last_u, last_v, 'track' FROM st WHERE trusted AND NOT EXISTS (SELECT 1 FROM kp k WHERE k.clip = st.clip AND k.kind = st.kind AND k.slot = st.slot AND k.frame_idx = st.frame_idx)),
rs AS (SELECT f.clip, f.frame_idx, via, CASE WHEN via IS NOT NULL THEN sqrt(pow({px('h', 'u', 'v', 'clamp')} - (10e0 + 5*slot), 2) + pow({py('h', 'u', 'v', 'clamp')} - {_KY}, 2)) END AS r FROM fx_frames f LEFT JOIN pts p ON f.clip = p.clip AND f.frame_idx = p.frame_idx WHERE h IS NOT NULL),
ck AS (SELECT clip, CAST(frame_idx AS INT) AS frame_idx, CAST(count(via) AS BIGINT) AS n_checked, CAST(count(*) FILTER (via = 'corr') AS BIGINT) AS n_via_corrs, CAST(count(*) FILTER (via = 'track') AS BIGINT) AS n_via_track,
  CAST(count(*) FILTER (r > {{tol}}) AS BIGINT) AS n_bad, {R4('quantile_cont(r, 0.5)')} AS median_residual, {R4('avg(r)')} AS mean_residual,
  count(via) = 0 OR (count(*) FILTER (r > {{tol}})/(1e0*count(*)) <= 0.34e0 AND quantile_cont(r, 0.5) <= {{tol}}) AS valid FROM rs GROUP BY clip, frame_idx)"""


@query("validate_h", f"""
WITH RECURSIVE {HIST}, {STATES}, {CHECKED.format(tol=30)} SELECT * FROM ck""")
def validate_h(t):
    corrs, st = states(t)
    d = B.validate_h(corrs.where("verdict = 'kept'"), st, t.frames, 30.0)
    return d.withColumns({"median_residual": r4("median_residual"), "mean_residual": r4("mean_residual")})


@query("bank_stats", f"""
WITH RECURSIVE {HIST}, {STATES} SELECT clip, CAST(frame_idx AS INT) AS frame_idx, CAST(count(*) AS BIGINT) AS n_tracks, CAST(count(*) FILTER (trusted) AS BIGINT) AS n_trusted,
  CAST(count(*) FILTER (kind = 'near_hash') AS BIGINT) AS n_near_hash, CAST(count(*) FILTER (kind = 'sideline_far') AS BIGINT) AS n_sideline_far FROM st GROUP BY clip, frame_idx""")
def bank_stats(t):
    return B.bank_stats(starts(t), ["near_hash", "sideline_far"])


@query("fit_homography")
def fit_homography(t):
    d = P.fit_homography(t.corrs)
    return d.select("clip", "frame_idx", "n_corrs", "n_inliers", r4("rmse").alias("rmse"), r4(c("h")[0]).alias("h0"))


@query("fit_similarity", f"""
WITH s AS MATERIALIZED (SELECT clip, frame_idx, u*0.98e0 + 7 + slot + CASE WHEN slot % 9 = 4 THEN 150 ELSE 0 END AS pu, v*1.01e0 - 4 + (slot % 3) AS pv, u, v FROM fx_corrs),
p AS MATERIALIZED (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY clip, frame_idx) AS n FROM s WINDOW w AS (PARTITION BY clip, frame_idx ORDER BY pu, pv, u, v)),
t AS (SELECT *, (dx*ex + dy*ey)/sz AS a, (dx*ey - dy*ex)/sz AS b FROM (SELECT x.clip, x.frame_idx, x.n, x.i, y.i AS j, x.pu, x.pv, x.u, x.v, y.pu - x.pu AS dx, y.pv - x.pv AS dy, y.u - x.u AS ex, y.v - x.v AS ey,
    pow(y.pu - x.pu, 2) + pow(y.pv - x.pv, 2) AS sz FROM p x JOIN p y ON x.clip = y.clip AND x.frame_idx = y.frame_idx AND x.i < y.i) WHERE sz > 0),
r AS (SELECT t.clip, t.frame_idx, t.i, t.j, any_value(t.n) AS n, any_value(a) AS a, any_value(b) AS b, any_value(t.u - a*t.pu + b*t.pv) AS tx, any_value(t.v - b*t.pu - a*t.pv) AS ty,
    quantile_cont(pow(a*p.pu - b*p.pv + t.u - a*t.pu + b*t.pv - p.u, 2) + pow(b*p.pu + a*p.pv + t.v - b*t.pu - a*t.pv - p.v, 2), 0.5) AS med
  FROM t JOIN p ON p.clip = t.clip AND p.frame_idx = t.frame_idx GROUP BY t.clip, t.frame_idx, t.i, t.j),
m AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY clip, frame_idx ORDER BY round(med, 9), i, j) = 1),
k AS (SELECT p.* FROM p JOIN m ON m.clip = p.clip AND m.frame_idx = p.frame_idx WHERE sqrt(pow(a*pu - b*pv + tx - u, 2) + pow(b*pu + a*pv + ty - v, 2)) <= greatest(2.5e0*1.4826e0*(1 + 5e0/greatest(p.n - 2, 1))*sqrt(med), 0.001e0))
SELECT clip, frame_idx, n, n_inliers, {R4('scale')} AS scale, {R4('rot')} AS rot_deg, {R4('tx')} AS tx, {R4('ty')} AS ty, scale <= 1.8e0 AND scale >= 1/1.8e0 AND abs(rot) <= 3 AND sqrt(tx*tx + ty*ty) <= 400 AS accepted FROM (
  SELECT *, sqrt(a*a + b*b) AS scale, degrees(atan2(b, a)) AS rot, mu - a*mpu + b*mpv AS tx, mv - b*mpu - a*mpv AS ty FROM (
    SELECT *, cc/dd AS a, ss/dd AS b FROM (SELECT clip, frame_idx, CAST(any_value(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_inliers, avg(pu) AS mpu, avg(pv) AS mpv, avg(u) AS mu, avg(v) AS mv,
      covar_pop(pu, u) + covar_pop(pv, v) AS cc, covar_pop(pu, v) - covar_pop(pv, u) AS ss, var_pop(pu) + var_pop(pv) AS dd FROM k GROUP BY clip, frame_idx) WHERE dd > 0))""")
def fit_similarity(t):
    wrong = F.when(c("slot") % 9 == 4, 150).otherwise(0)
    d = t.corrs.withColumns({"pu": c("u") * 0.98 + 7 + c("slot") + wrong, "pv": c("v") * 1.01 - 4 + c("slot") % 3})
    d = P.fit_similarity(d, FRAME)
    return d.select(*FRAME, "n", "n_inliers", *[r4(k).alias(k) for k in ("scale", "rot_deg", "tx", "ty")], "accepted")
