"""Runs, cut-offs, smoothing and derivatives."""

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.sqlparts import (
    SEGMENTS, TEMPORAL, derivative_ctes, fill_ctes, loo_ctes, slope, smooth_h_ctes, smoothed,
)
from fieldmotion.operators import runs as R
from fieldmotion.operators import smoothing as S
from fieldmotion.operators.ordered import numbered

c = F.col
T3 = ("clip", "track_id", "frame_idx")


@query("segments", f'SELECT clip, track_id, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end" FROM ({SEGMENTS})')
def segments(t):
    return R.segments(t.points, c("measured"))


@query("bad_runs", """
WITH m AS (SELECT clip, frame_idx, coalesce(h IS NULL OR rmse > 0.1e0, false) AS red FROM fx_frames),
g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip, red ORDER BY frame_idx) AS g FROM m),
r AS (SELECT clip, g, min(frame_idx) AS s, max(frame_idx) + 1 AS e FROM g WHERE red GROUP BY ALL)
SELECT g.clip, g.frame_idx, CAST(s AS INT) AS run_start, CAST(e AS INT) AS run_end, coalesce(e - s >= 5, false) AS in_bad_run
FROM g LEFT JOIN r ON g.clip = r.clip AND g.red AND g.g = r.g""")
def bad_runs(t):
    d = R.bad_runs(t.frames, F.col("h").isNull() | (c("rmse") > 0.1))
    return d.select("clip", "frame_idx", "run_start", "run_end", "in_bad_run")


CUTOFF = """SELECT clip, CAST(coalesce(min(CASE WHEN method = 'carry' AND m1 = 'carry' AND m2 = 'carry' THEN frame_idx END), max(frame_idx) + 1) AS INT) AS cutoff,
  CAST(count(*) AS BIGINT) AS n_frames
FROM (SELECT *, lead(method) OVER w AS m1, lead(method, 2) OVER w AS m2 FROM fx_frames WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)) GROUP BY clip"""


@query("carry_cutoff", CUTOFF)
def carry_cutoff(t):
    return R.carry_cutoff(t.frames)


@query("temporal_divergence", f"SELECT clip, frame_idx, {R6('temp_div')} AS temp_div FROM ({TEMPORAL})")
def temporal_divergence(t):
    return S.temporal_divergence(t.frames).select("clip", "frame_idx", r6("temp_div").alias("temp_div"))


@query("loo_residual", f"WITH {loo_ctes()} SELECT clip, frame_idx, {R6('loo')} AS loo FROM fx_frames LEFT JOIN loo USING (clip, frame_idx)")
def loo_residual(t):
    return S.loo_residual(t.frames).select("clip", "frame_idx", r6("loo").alias("loo"))


@query("nearest_good", """
WITH m AS (SELECT clip, frame_idx, coalesce(h IS NULL OR rmse > 0.1e0, false) AS red FROM fx_frames),
g AS (SELECT *, sum(CASE WHEN red THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY frame_idx) AS g FROM m)
SELECT r.clip, r.frame_idx, n.frame_idx AS near_frame FROM g r JOIN g n ON r.clip = n.clip AND r.red AND NOT n.red AND n.g BETWEEN r.g - 2 AND r.g + 3""")
def nearest_good(t):
    d = t.frames.withColumn("red", c("h").isNull() | (c("rmse") > 0.1))
    return S.nearest_good(d).select("clip", "frame_idx", "near_frame")


@query("fill_bad", f"""
WITH {fill_ctes()} SELECT clip, frame_idx, red, {', '.join(f"{R6(f'h_clean[{i+1}]')} AS h{i}" for i in range(9))} FROM clean""")
def fill_bad(t):
    d = S.fill_bad(t.frames)
    return d.select("clip", "frame_idx", "red", *[r6(c("h_clean")[i]).alias(f"h{i}") for i in range(9)])


@query("smooth_h", f"""
WITH {smooth_h_ctes('fx_frames', 'h')} SELECT clip, frame_idx, {', '.join(f"{R6(f'h_smooth[{i+1}]')} AS h{i}" for i in range(9))}
FROM fx_frames LEFT JOIN hs USING (clip, frame_idx)""")
def smooth_h(t):
    d = S.smooth_h(t.frames, "h")
    return d.select("clip", "frame_idx", *[r6(c("h_smooth")[i]).alias(f"h{i}") for i in range(9)])


@query("gradient", f"""
WITH s AS (SELECT *, frame_idx/30e0 AS t FROM fx_points WHERE measured),
v AS (SELECT *, {slope('xs', 't')} AS vx, {slope('y', 't')} AS vy FROM s WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame_idx)),
p AS (SELECT *, sqrt(vx*vx + vy*vy) AS speed FROM v)
SELECT clip, track_id, frame_idx, {R6('speed')} AS speed, {R6(slope('speed', 't'))} AS accel FROM p WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame_idx)""")
def gradient(t):
    d = numbered(t.points.where("measured"), ["clip", "track_id"], "frame_idx", "k").withColumn("t", c("frame_idx") / 30.0)
    d = R.speed_and_accel(d, "t", "xs", "y", ["clip", "track_id"], "k")
    return d.select(*T3, r6("speed").alias("speed"), r6("accel").alias("accel"))


@query("smooth_track", f"SELECT clip, track_id, frame_idx, {R6('sx')} AS sx, {R6('sy')} AS sy FROM ({smoothed([9], 9, None)})")
def smooth_track(t):
    return S.smooth_track(t.points, "xs", "y", valid=c("measured")).select(*T3, r6("sx").alias("sx"), r6("sy").alias("sy"))


@query("smooth_track_adaptive", f"SELECT clip, track_id, frame_idx, {R6('sx')} AS sx, {R6('sy')} AS sy FROM ({smoothed([3, 5, 7, 9, 11], 5, 11)})")
def smooth_track_adaptive(t):
    return S.smooth_track_adaptive(t.points, "xs", "y", 11, valid=c("measured")).select(*T3, r6("sx").alias("sx"), r6("sy").alias("sy"))


_VALID = "(SELECT *, CASE WHEN measured THEN xs END AS mx, CASE WHEN measured THEN y END AS my FROM fx_points)"


@query("derivatives", f"""
WITH src AS {_VALID}, {derivative_ctes('src', 'mx', 'my', 10.0, 'frame_idx')}
SELECT clip, track_id, frame_idx, {', '.join(f'{R4(k)} AS {k}' for k in ('vx', 'vy', 'speed', 'accel'))} FROM d3""")
def derivatives(t):
    d = t.points.withColumns({"mx": F.when(c("measured"), c("xs")), "my": F.when(c("measured"), c("y"))})
    return R.derivatives(d, 10.0, "mx", "my").select(*T3, *[r4(k).alias(k) for k in ("vx", "vy", "speed", "accel")])


@query("downsample", f"""
SELECT clip, track_id, frame_idx, {R6('frame_idx/30e0')} AS time FROM (
  SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY frame_idx) - 1 AS k FROM fx_points WHERE measured) WHERE k % 3 = 0""")
def downsample(t):
    return R.downsample(t.points.where("measured"), 3).select(*T3, r6("time").alias("time"))


@query("smooth_and_downsample", f"""
WITH sm AS ({smoothed([3, 5, 7], 5, 7)}),
rows AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY frame_idx) - 1 AS k, count(*) OVER (PARTITION BY clip, track_id) AS n FROM sm),
ds AS (SELECT *, CAST(floor(k/3) AS INT) AS sample FROM rows WHERE n >= 10 AND k % 3 = 0),
{derivative_ctes('ds', 'sx', 'sy', 10.0, 'sample')}
SELECT clip, track_id, frame_idx, {R6('frame_idx/30e0')} AS time, {R6('sx')} AS sx, {R4('speed')} AS speed, {R4('accel')} AS accel FROM d3""")
def smooth_and_downsample(t):
    d = S.smooth_and_downsample(t.points, "xs", "y", c("measured"))
    return d.select(*T3, r6("time").alias("time"), r6("sx").alias("sx"), r4("speed").alias("speed"), r4("accel").alias("accel"))


@query("track_speeds", f"""
WITH sm AS ({smoothed([9], 9, None)}), {derivative_ctes('sm', 'sx', 'sy', 30.0, 'frame_idx')}
SELECT clip, track_id, CAST(count(*) AS BIGINT) AS n_frames, CAST(count(sx) AS BIGINT) AS n_measured,
  {R4('avg(speed)')} AS mean_speed, {R4('max(speed)')} AS max_speed FROM d3 GROUP BY clip, track_id""")
def track_speeds(t):
    sm = S.smooth_track(t.points, "xs", "y", valid=c("measured"))
    return R.derivatives(sm, 30.0, "sx", "sy").groupBy("clip", "track_id").agg(
        F.count("*").alias("n_frames"), F.count("sx").alias("n_measured"),
        r4(F.avg("speed")).alias("mean_speed"), r4(F.max("speed")).alias("max_speed"))


GATED = """SELECT clip, sec, label, conf, coalesce(last_value(CASE WHEN conf >= 0.7e0 OR sec = 0 THEN label END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY sec), label) AS gated FROM fx_views"""
SMOOTH = f"""SELECT *, CASE WHEN lag(gated) OVER w IS NULL OR gated = lead(gated) OVER w THEN gated ELSE lag(gated) OVER w END AS smooth
  FROM ({GATED}) WINDOW w AS (PARTITION BY clip ORDER BY sec)"""
VIEW_SEGMENTS = f"""SELECT clip, CAST(sec AS DOUBLE) AS start_s, CAST(coalesce(lead(sec) OVER (PARTITION BY clip ORDER BY sec), last + 1) AS DOUBLE) AS end_s, smooth AS view
  FROM (SELECT *, lag(smooth) OVER (PARTITION BY clip ORDER BY sec) AS p, max(sec) OVER (PARTITION BY clip) AS last FROM ({SMOOTH})) WHERE p IS NULL OR p <> smooth"""
PLAYS = f"""SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY start_s) AS INT) AS play_num, start_s AS sideline_start, end_s AS sideline_end,
    coalesce(ns, 0e0) AS endzone_start, coalesce(ne, 0e0) AS endzone_end
  FROM (SELECT *, lead(view) OVER w AS nv, lead(start_s) OVER w AS ns, lead(end_s) OVER w AS ne
    FROM ({VIEW_SEGMENTS}) WHERE end_s - start_s >= 3 AND view <> 'scoreboard' WINDOW w AS (PARTITION BY clip ORDER BY start_s))
  WHERE view = 'sideline' AND (nv IS NULL OR nv = 'endzone')"""


@query("carry_label", f"SELECT clip, sec, gated FROM ({GATED})")
def carry_label(t):
    return R.carry_label(t.views).select("clip", "sec", "gated")


@query("majority_smooth", """SELECT clip, sec, CASE WHEN lag(label) OVER w IS NULL OR label = lead(label) OVER w THEN label ELSE lag(label) OVER w END AS smooth
FROM fx_views WINDOW w AS (PARTITION BY clip ORDER BY sec)""")
def majority_smooth(t):
    return R.majority_smooth(t.views, "label").select("clip", "sec", "smooth")


@query("label_segments", f"SELECT * FROM ({VIEW_SEGMENTS}) WHERE end_s - start_s >= 3")
def label_segments(t):
    return R.label_segments(R.majority_smooth(R.carry_label(t.views))).drop("start_pos")


@query("group_plays", PLAYS)
def group_plays(t):
    return R.group_plays(R.label_segments(R.majority_smooth(R.carry_label(t.views))))


@query("spaced_samples", """
WITH m AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY clip, track_id) AS m FROM fx_points WHERE measured
  WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame_idx))
SELECT clip, track_id, frame_idx, CAST(i AS INT) AS sample FROM m JOIN (SELECT * FROM range(0, 12) r(i)) ON k = CAST(floor(i*(m-1)/11) AS BIGINT) WHERE m >= 12""")
def spaced_samples(t):
    return R.spaced_samples(t.points.where("measured"), 12).select(*T3, "sample")


@query("lifecycle", """
SELECT clip, track_id, frame_idx, CAST(frame_idx - m AS INT) AS idle,
  CASE WHEN frame_idx = m THEN 'live' WHEN frame_idx - m <= 8 THEN 'lost' WHEN frame_idx - m <= 30 THEN 'graveyard' WHEN m IS NOT NULL THEN 'dropped' END AS state
FROM (SELECT *, last_value(CASE WHEN event_id % 13 = 0 THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY clip, track_id ORDER BY frame_idx) AS m FROM fx_points)""")
def lifecycle(t):
    return R.lifecycle(t.points, c("event_id") % 13 == 0, 8, 30).select(*T3, "idle", "state")


@query("extrapolate", f"SELECT event_id, {R6('x + greatest(k - 10, 0)*(1/30e0)*y')} AS ahead FROM fx_yards")
def extrapolate(t):
    return t.yards.select("event_id", r6(R.extrapolate(c("x"), c("y"), c("k") - 10)).alias("ahead"))
