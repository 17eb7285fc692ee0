"""Shared SQL fragments for sequence, smoothing and homography oracles."""

from catalog.sqlgeo import corner_list, gap
from fieldmotion.operators.smoothing import hat_matrix


def lits(values):
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


SEGMENTS = """SELECT clip, track_id, min(frame_idx) AS s, max(frame_idx) + 1 AS e
  FROM (SELECT clip, track_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY clip, track_id ORDER BY frame_idx) AS g
        FROM fx_points WHERE measured) GROUP BY clip, track_id, g"""


def smoothed(sizes, min_len, min_total, x="xs", y="y"):
    """(clip, track_id, frame_idx, x, y, sx, sy, measured) of quadratic smoothing in runs."""
    widest = max(sizes)
    weights = "CASE w " + " ".join(f"WHEN {s} THEN {lits(hat_matrix(s).ravel())}" for s in sizes) + " END"
    w = f"least({widest}, e - s - CASE WHEN (e - s) % 2 = 0 THEN 1 ELSE 0 END)" if len(sizes) > 1 else str(widest)
    enough = f"e - s >= {min_len}" + (f" AND total >= {min_total}" if min_total else "")
    return f"""WITH seg AS ({SEGMENTS}),
    tot AS (SELECT clip, track_id, count(*) AS total FROM fx_points WHERE measured GROUP BY ALL),
    rows AS (SELECT p.clip, p.track_id, p.frame_idx, p.{x} AS x, p.{y} AS y, s, e, {w} AS w
      FROM fx_points p JOIN seg USING (clip, track_id) JOIN tot USING (clip, track_id)
      WHERE p.measured AND p.frame_idx >= s AND p.frame_idx < e AND {enough}),
    placed AS (SELECT *, greatest(s, least(frame_idx - CAST(floor((w-1)/2) AS INT), e - w)) AS f, {weights} AS c FROM rows),
    fit AS (SELECT a.clip, a.track_id, a.frame_idx, sum(c[(a.frame_idx - f)*w + b.frame_idx - f + 1]*b.{x}) AS sx,
        sum(c[(a.frame_idx - f)*w + b.frame_idx - f + 1]*b.{y}) AS sy
      FROM placed a JOIN fx_points b ON a.clip = b.clip AND a.track_id = b.track_id AND b.frame_idx >= f AND b.frame_idx < f + w
      GROUP BY ALL)
    SELECT p.clip, p.track_id, p.frame_idx, p.{x} AS x, p.{y} AS y, p.measured,
      CASE WHEN p.measured THEN coalesce(sx, p.{x}) END AS sx, CASE WHEN p.measured THEN coalesce(sy, p.{y}) END AS sy
    FROM fx_points p LEFT JOIN fit USING (clip, track_id, frame_idx)"""


def derivative_ctes(source, x, y, fps, pos):
    """CTEs d1 (velocity) and d2 (speed, acceleration) over ``source``."""
    dt = f"{1.0 / fps!r}"

    def diff(c):
        p = f"CASE WHEN lag({pos}) OVER w = {pos} - 1 THEN lag({c}) OVER w END"
        n = f"CASE WHEN lead({pos}) OVER w = {pos} + 1 THEN lead({c}) OVER w END"
        return f"CASE WHEN {c} IS NOT NULL THEN coalesce((({n}) - ({p}))/(2*{dt}), (({n}) - {c})/{dt}, ({c} - ({p}))/{dt}) END"

    win = f"WINDOW w AS (PARTITION BY clip, track_id ORDER BY {pos})"
    return f"""d1 AS (SELECT *, {diff(x)} AS vx, {diff(y)} AS vy FROM {source} {win}),
    d2 AS (SELECT *, {diff('vx')} AS ax, {diff('vy')} AS ay FROM d1 {win}),
    d3 AS (SELECT *, CASE WHEN {x} IS NOT NULL THEN sqrt(coalesce(vx*vx, 0) + coalesce(vy*vy, 0)) END AS speed,
      CASE WHEN {x} IS NOT NULL THEN sqrt(coalesce(ax*ax, 0) + coalesce(ay*ay, 0)) END AS accel FROM d2)"""


def slope(y, t, w="w"):
    hs, hd = f"({t} - lag({t}) OVER {w})", f"(lead({t}) OVER {w} - {t})"
    return f"""CASE WHEN {hs} IS NULL THEN (lead({y}) OVER {w} - {y})/{hd} WHEN {hd} IS NULL THEN ({y} - lag({y}) OVER {w})/{hs}
      ELSE ({hs}*{hs}*lead({y}) OVER {w} + ({hd}*{hd} - {hs}*{hs})*{y} - {hd}*{hd}*lag({y}) OVER {w})/({hs}*{hd}*({hd}+{hs})) END"""


TEMPORAL = f"""SELECT clip, frame_idx, h, method, rmse, {gap('c', 'm')} AS temp_div
  FROM (SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 AND lead(frame_idx) OVER w = frame_idx + 1
      AND lag(c) OVER w IS NOT NULL AND lead(c) OVER w IS NOT NULL
      THEN [0.5e0*(lag(c[i]) OVER w + lead(c[i]) OVER w) for i in range(1, 9)] END AS m
    FROM (SELECT *, {corner_list('h')} AS c FROM fx_frames) WINDOW w AS (PARTITION BY clip ORDER BY frame_idx))"""
TEMPORAL = f"""SELECT clip, frame_idx, h, method, rmse, {gap('c', 'm')} AS temp_div
  FROM (SELECT *, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN [0.5e0*(p[i] + n[i]) for i in range(1, 9)] END AS m
    FROM (SELECT *, CASE WHEN lag(frame_idx) OVER w = frame_idx - 1 THEN lag(c) OVER w END AS p,
        CASE WHEN lead(frame_idx) OVER w = frame_idx + 1 THEN lead(c) OVER w END AS n
      FROM (SELECT *, {corner_list('h')} AS c FROM fx_frames) WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)))"""


def quad_fit(sums, moments):
    s0, s1, s2, s3, s4 = sums
    a, b, c = f"({s2}*{s4} - {s3}*{s3})", f"({s2}*{s3} - {s1}*{s4})", f"({s1}*{s3} - {s2}*{s2})"
    det = f"({s0}*{a} + {s1}*{b} + {s2}*{c})"
    return "[" + ", ".join(f"({a}*{t0} + {b}*{t1} + {c}*{t2})/{det}" for t0, t1, t2 in moments) + "]"


def loo_ctes(source="fx_frames"):
    """CTEs ending in ``loo`` (clip, frame_idx, loo)."""
    sums = [f"sum(CAST(pow(b.k - a.k, {p}) AS DOUBLE)) AS s{p}" for p in range(5)]
    moms = [f"sum(CAST(pow(b.k - a.k, {p}) AS DOUBLE)*b.h[{c}]) AS t{p}_{c}" for p in range(3) for c in range(1, 10)]
    fit = quad_fit([f"s{p}" for p in range(5)], [(f"t0_{c}", f"t1_{c}", f"t2_{c}") for c in range(1, 10)])
    return f"""pres AS (SELECT clip, frame_idx, h, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS k FROM {source} WHERE h IS NOT NULL),
    nb AS (SELECT a.clip, a.frame_idx, {', '.join(sums)}, {', '.join(moms)} FROM pres a JOIN pres b
      ON a.clip = b.clip AND b.k BETWEEN a.k - 3 AND a.k + 3 AND b.k <> a.k GROUP BY ALL),
    fits AS (SELECT clip, frame_idx, CASE WHEN s0 >= 3 THEN {fit} END AS f FROM nb),
    loo AS (SELECT clip, frame_idx, {gap('ca', 'cb')} AS loo FROM (SELECT p.clip, p.frame_idx, {corner_list('p.h')} AS ca, {corner_list('f')} AS cb
      FROM pres p LEFT JOIN fits USING (clip, frame_idx)))"""


def fill_ctes():
    """CTEs ending in ``clean`` (clip, frame_idx, method, rmse, loo, red, h, h_clean)."""
    sums = [f"sum(pow(x, {p}) ORDER BY x) AS s{p}" for p in range(5)]
    moms = [f"sum(pow(x, {p})*h[{c}] ORDER BY x) AS t{p}_{c}" for p in range(3) for c in range(1, 10)]
    fit = quad_fit([f"s{p}" for p in range(5)], [(f"t0_{c}", f"t1_{c}", f"t2_{c}") for c in range(1, 10)])
    return loo_ctes() + f""",
    scored AS (SELECT f.*, loo, coalesce(f.h IS NULL OR loo > 0.20e0, false) OR coalesce(rmse > 0.30e0, false) AS red
      FROM fx_frames f LEFT JOIN loo USING (clip, frame_idx)),
    ranked AS (SELECT *, sum(CASE WHEN red THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY frame_idx) AS g FROM scored),
    fnx AS (SELECT r.clip, r.frame_idx, n.h, CAST(n.frame_idx - r.frame_idx AS DOUBLE)/max(abs(n.frame_idx - r.frame_idx)) OVER (PARTITION BY r.clip, r.frame_idx) AS x
      FROM ranked r JOIN ranked n ON r.clip = n.clip AND r.red AND NOT n.red AND n.g BETWEEN r.g - 2 AND r.g + 3),
    fnb AS (SELECT clip, frame_idx, {', '.join(sums)}, {', '.join(moms)} FROM fnx GROUP BY clip, frame_idx),
    clean AS (SELECT s.*, coalesce(x.f, s.h) AS h_clean FROM scored s LEFT JOIN
      (SELECT clip, frame_idx, {fit} AS f FROM fnb WHERE s0 >= 3) x USING (clip, frame_idx))"""


def smooth_h_ctes(source="clean", h="h_clean"):
    """CTEs ending in ``hs`` (clip, frame_idx, h_smooth)."""
    c = hat_matrix(7)[3]
    cells = "[" + ", ".join("(" + " + ".join(f"n{k}[{i}]*{float(c[k])!r}" for k in range(7)) + ")*scale" for i in range(1, 10)) + "]"
    return f"""hp AS (SELECT clip, frame_idx, {h} AS h, CASE WHEN abs({h}[9]) < 1e-9 THEN 1e0 ELSE {h}[9] END AS scale FROM {source} WHERE {h} IS NOT NULL),
    hu AS (SELECT *, [v/scale for v in h] AS u, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS k, count(*) OVER (PARTITION BY clip) AS n FROM hp),
    hn AS (SELECT *, u AS n3, {', '.join(f'coalesce(lag(u, {3 - j}) OVER w, first_value(u) OVER w) AS n{j}' for j in range(3))},
      {', '.join(f'coalesce(lead(u, {j - 3}) OVER w, last_value(u) OVER (PARTITION BY clip ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n{j}' for j in range(4, 7))}
      FROM hu WINDOW w AS (PARTITION BY clip ORDER BY k)),
    hs AS (SELECT clip, frame_idx, CASE WHEN n >= 7 THEN {cells} ELSE h END AS h_smooth FROM hn)"""
