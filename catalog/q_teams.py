"""Histograms, signatures and team splits."""

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from fieldmotion.operators import histograms as H
from fieldmotion.operators import teams as T

c = F.col
KEEP = "(NOT (h BETWEEN 35 AND 85 AND s > 60) AND s > 60 AND v BETWEEN 50 AND 220)"


def arr(df, name, n, keys):
    return df.select(*keys, *[r6(c(name)[i]).alias(f"b{i}") for i in range(n)])


def bins_sql(expr, n, start=0):
    return ", ".join(f"count(*) FILTER ({expr} = {i + start}) AS n{i + start}" for i in range(n))


@query("histogram_1d", f"""
SELECT track_id, {', '.join(f"{R6(f'n{i}/(1e0*greatest(t, 1))')} AS b{i}" for i in range(12))} FROM (SELECT *, {'+'.join(f'n{i}' for i in range(12))} AS t FROM (
SELECT track_id, {bins_sql('CASE WHEN x BETWEEN 0 AND 180 THEN least(floor(x/15), 11) END', 12)} FROM (SELECT track_id, h*1.01e0 AS x FROM fx_hsv) GROUP BY track_id))""")
def histogram_1d(t):
    d = H.histogram_1d(t.hsv, ["track_id"], c("h") * 1.01, 12, 0, 180, normalise=True)
    return arr(d, "hist", 12, ["track_id"])


@query("histogram_2d", f"""
SELECT track_id, {', '.join(f'CAST(n{i} AS DOUBLE) AS b{i}' for i in range(12))} FROM (SELECT track_id,
{bins_sql('CASE WHEN v BETWEEN 50 AND 220 THEN least(floor(s/64), 3)*3 + least(floor((v-50)/(170e0/3)), 2) END', 12)} FROM fx_hsv GROUP BY track_id)""")
def histogram_2d(t):
    d = H.histogram_2d(t.hsv, ["track_id"], c("s"), c("v"), (4, 3), ((0, 256), (50, 220)))
    return arr(d, "hist", 12, ["track_id"])


@query("histogram_hsv", f"""
SELECT track_id, bin, {R6('n/(1e0*sum(n) OVER (PARTITION BY track_id))')} AS share FROM (
SELECT track_id, CAST(floor(h/22.5e0)*32 + floor(s/32)*4 + floor(v/64) AS INT) AS bin, count(*) AS n FROM fx_hsv GROUP BY ALL)""")
def histogram_hsv(t):
    return H.histogram_hsv(t.hsv, ["track_id"]).withColumn("share", r6("share"))


_SIG = f"""(SELECT clip, track_id, CASE WHEN t >= 20 THEN [{', '.join(f'n{i}/(1e0*greatest(t, 1))' for i in range(12))}, {', '.join(f'n{i}/(1e0*greatest(u, 1))' for i in range(12, 24))}] END AS sig
FROM (SELECT *, {'+'.join(f'n{i}' for i in range(12))} AS t, {'+'.join(f'n{i}' for i in range(12, 24))} AS u FROM (SELECT clip, track_id, {bins_sql('least(floor(h/15), 11)', 12)},
{bins_sql('12 + least(floor(s/64), 3)*3 + least(floor((v-50)/(170e0/3)), 2)', 12, 12)} FROM fx_hsv WHERE {KEEP} GROUP BY clip, track_id)))"""


@query("track_signature", f"SELECT track_id, {', '.join(f'{R6(f'sig[{i+1}]')} AS b{i}' for i in range(24))} FROM {_SIG}")
def track_signature(t):
    return arr(H.track_signature(t.hsv, ["clip", "track_id"]), "sig", 24, ["track_id"])


_HUE = f"""(WITH px AS (SELECT clip, track_id, sample, CAST(least(floor(h/5), 35) AS INT) AS bin, count(*) AS n FROM fx_hsv WHERE {KEEP} GROUP BY ALL),
sz AS (SELECT clip, track_id, sample, sum(n) AS t FROM px GROUP BY ALL HAVING sum(n) >= 5), m AS (SELECT clip, track_id, count(*) AS m FROM sz GROUP BY ALL),
sh AS (SELECT clip, track_id, bin, sum(n/(1e0*t)) AS s FROM px JOIN sz USING (clip, track_id, sample) GROUP BY ALL)
SELECT clip, track_id, [{', '.join(f'coalesce(sum(s) FILTER (bin = {i}), 0e0)/max(m)' for i in range(36))}] AS sig FROM sh JOIN m USING (clip, track_id) GROUP BY clip, track_id)"""


@query("mean_hue_signature", f"SELECT track_id, {', '.join(f'{R6(f'sig[{i+1}]')} AS b{i}' for i in range(36))} FROM {_HUE}")
def mean_hue_signature(t):
    return arr(H.mean_hue_signature(t.hsv, ["clip", "track_id"], "sample"), "sig", 36, ["track_id"])


@query("baseline_residual", f"""
SELECT track_id, {', '.join(f'{R6(f'sig[{i+1}] - avg(sig[{i+1}]) OVER (PARTITION BY clip)')} AS b{i}' for i in range(64))} FROM fx_sigs""")
def baseline_residual(t):
    return arr(T.baseline_residual(t.sigs, 64), "residual", 64, ["track_id"])


@query("split_at_median", f"""
WITH p AS (SELECT clip, track_id, sig[3] AS proj FROM fx_sigs), m AS (SELECT *, quantile_cont(proj, 0.5) OVER (PARTITION BY clip) AS m, stddev_pop(proj) OVER (PARTITION BY clip) AS s FROM p)
SELECT clip, track_id, {R6('abs(proj - m)/(s + 1e-6)')} AS confidence, CASE WHEN (proj >= m) = first_value(proj >= m) OVER (PARTITION BY clip ORDER BY track_id) THEN 'team_A' ELSE 'team_B' END AS team FROM m""")
def split_at_median(t):
    d = T.split_at_median(t.sigs.select("clip", "track_id", c("sig")[2].alias("proj")))
    return d.select("clip", "track_id", r6("confidence").alias("confidence"), "team")


@query("pca_split")
def pca_split(t):
    d = T.pca_split(t.sigs, 64)
    return d.select("clip", "track_id", r6("proj").alias("proj"), r6("confidence").alias("confidence"), "team")


def _sq(a, b, n):
    return "(" + " + ".join(f"({a}[{i}]-{b}[{i}])*({a}[{i}]-{b}[{i}])" for i in range(1, n + 1)) + ")"


def two_means_sql(source, width, order, weight="1e0", starts=10):
    """CTE list ending in km (clip, c0, c1); ``source`` has clip, <order>, v, and weight columns."""
    mean = lambda k: "[" + ", ".join(f"sum(v[{i}]*w) FILTER (k = {k})/sum(w) FILTER (k = {k})" for i in range(1, width + 1)) + "]"
    return f"""km0a AS (SELECT clip, j, min_by(v, md5(j||'|'||{order})) AS c0 FROM {source}, (SELECT unnest(range({starts})) AS j) GROUP BY clip, j),
km0 AS (SELECT s.clip, j, any_value(c0) AS c0, max_by(v, {{'d': {_sq('v', 'c0', width)}, 'o': -{order}}}) AS c1 FROM {source} s JOIN km0a USING (clip) GROUP BY s.clip, j),
kr AS (SELECT clip, j, 0 AS turn, c0, c1, '' AS was, 'start' AS now, 0e0 AS inertia FROM km0
  UNION ALL SELECT clip, j, any_value(turn) + 1, CASE WHEN count(*) FILTER (k = 0) > 0 THEN {mean(0)} ELSE any_value(c0) END, CASE WHEN count(*) FILTER (k = 1) > 0 THEN {mean(1)} ELSE any_value(c1) END,
    any_value(now), string_agg(CAST(k AS VARCHAR), '' ORDER BY o), sum(w*least(d0, d1))
  FROM (SELECT *, CASE WHEN d1 < d0 THEN 1 ELSE 0 END AS k FROM (SELECT s.clip, j, turn, now, c0, c1, v, s.{order} AS o, {weight} AS w, {_sq('v', 'c0', width)} AS d0, {_sq('v', 'c1', width)} AS d1
    FROM kr JOIN {source} s USING (clip) WHERE was <> now)) GROUP BY clip, j),
km AS (SELECT clip, c0, c1 FROM kr WHERE was = now QUALIFY row_number() OVER (PARTITION BY clip ORDER BY round(inertia, 6), j) = 1)"""


@query("kmeans_split", f"""
WITH RECURSIVE src AS (SELECT clip, track_id, sig AS v FROM fx_sigs), {two_means_sql('src', 64, 'track_id')},
a AS (SELECT clip, track_id, sqrt({_sq('v', 'c0', 64)}) AS d0, sqrt({_sq('v', 'c1', 64)}) AS d1 FROM src JOIN km USING (clip))
SELECT clip, track_id, {R4('(greatest(d0,d1) - least(d0,d1))/(least(d0,d1) + 1e-6)')} AS confidence,
  CASE WHEN (d1 < d0) = first_value(d1 < d0) OVER (PARTITION BY clip ORDER BY track_id) THEN 'team_A' ELSE 'team_B' END AS team FROM a""")
def kmeans_split(t):
    d = T.kmeans_split(t.sigs)
    return d.select("clip", "track_id", r4("confidence").alias("confidence"), "team")


@query("pixel_split", f"""
WITH RECURSIVE pt AS (SELECT clip, track_id, h, s, v AS val, count(*) AS n FROM fx_hsv WHERE {KEEP} GROUP BY ALL),
f AS (SELECT clip, track_id, n, CAST(h AS BIGINT)*65536 + s*256 + val AS code, [cos(h/180e0*2*pi())*720, sin(h/180e0*2*pi())*720, s, val] AS v FROM pt
  WHERE (clip, track_id) IN (SELECT (clip, track_id) FROM pt GROUP BY clip, track_id HAVING sum(n) >= 50)),
src AS (SELECT clip, code, any_value(v) AS v, sum(n) AS w FROM f GROUP BY clip, code), {two_means_sql('src', 4, 'code', 's.w')},
a AS (SELECT clip, track_id, sum(n*sqrt({_sq('v', 'c0', 4)}))/sum(n) AS d0, sum(n*sqrt({_sq('v', 'c1', 4)}))/sum(n) AS d1 FROM f JOIN km USING (clip) GROUP BY clip, track_id)
SELECT clip, track_id, {R4('(greatest(d0,d1) - least(d0,d1))/(least(d0,d1) + 1e-6)')} AS confidence,
  CASE WHEN (d0 < d1) = first_value(d0 < d1) OVER (PARTITION BY clip ORDER BY track_id) THEN 'team_A' ELSE 'team_B' END AS team FROM a""")
def pixel_split(t):
    return T.pixel_split(t.hsv).select("clip", "track_id", r4("confidence").alias("confidence"), "team")


POSITION = """SELECT clip, track_id, first_x, CASE WHEN n < 4 OR first_x IS NULL THEN 'unknown' WHEN first_x < m THEN 'team_A' ELSE 'team_B' END AS team
FROM (SELECT *, quantile_cont(first_x, 0.5) OVER (PARTITION BY clip) AS m, count(first_x) OVER (PARTITION BY clip) AS n FROM (
  SELECT clip, track_id, min_by(CASE WHEN measured THEN x END, CASE WHEN measured THEN frame_idx END) AS first_x FROM fx_points GROUP BY clip, track_id))"""


@query("position_split", f"SELECT clip, track_id, {R6('first_x')} AS first_x, team FROM ({POSITION})")
def position_split(t):
    return T.position_split(t.points, c("measured")).withColumn("first_x", r6("first_x"))


def _colour(t):
    k = F.when(c("track_id") % 5 < 2, T.B).otherwise(T.A)
    return t.points.where(c("track_id") % 7 > 0).select("clip", "track_id", k.alias("team"), ((c("track_id") % 10) / 100.0).alias("confidence")).distinct()


@query("reconcile_labels", f"""
WITH p AS (SELECT clip, track_id, team AS p FROM ({POSITION})), q AS (SELECT DISTINCT clip, track_id, CASE WHEN track_id % 5 < 2 THEN 'team_B' ELSE 'team_A' END AS q, (track_id % 10)/100e0 AS conf FROM fx_points WHERE track_id % 7 > 0),
b AS (SELECT clip, track_id, coalesce(p, 'unknown') AS p, coalesce(q, 'unknown') AS q, conf FROM p FULL JOIN q USING (clip, track_id)),
v AS (SELECT clip, count(*) FILTER (p <> 'unknown' AND q <> 'unknown' AND p = q) AS same, count(*) FILTER (p <> 'unknown' AND q <> 'unknown') AS n FROM b GROUP BY clip),
m AS (SELECT b.clip, track_id, p, conf, n, CASE WHEN same < n - same THEN CASE q WHEN 'team_A' THEN 'team_B' WHEN 'team_B' THEN 'team_A' ELSE q END ELSE q END AS q FROM b JOIN v USING (clip))
SELECT clip, track_id, CASE WHEN n = 0 THEN 'unknown' WHEN p = q THEN p WHEN p = 'unknown' THEN q WHEN q = 'unknown' THEN p WHEN coalesce(conf, 0) >= 0.05e0 THEN q ELSE p END AS team FROM m""")
def reconcile_labels(t):
    return T.reconcile_labels(T.position_split(t.points, c("measured")), _colour(t))


@query("canonical_labels", """
SELECT clip, track_id, CASE WHEN label % 2 = first_value(label % 2) OVER (PARTITION BY clip ORDER BY track_id) THEN 'team_A' ELSE 'team_B' END AS team FROM fx_sigs""")
def canonical_labels(t):
    return T.canonical_labels(t.sigs.withColumn("cluster", c("label") % 2)).select("clip", "track_id", "team")


@query("label_teams_hybrid")
def label_teams_hybrid(t):
    return T.label_teams(t.points.withColumn("track_id", c("track_id")), t.hsv, "hybrid")
