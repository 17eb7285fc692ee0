"""Lines, components, groups, tokens and masks."""

from pyspark.sql import functions as F

from catalog.core import R4, R6, query, r4, r6
from catalog.sqlgeo import px, py
from fieldmotion.functions.field import quantise_conf
from fieldmotion.operators import lines as L
from fieldmotion.plans import field_mapping as M

c = F.col
FRAME = ["clip", "frame_idx"]


def fit_sql(ch, keys, along="py", across="px"):
    return f"""(SELECT * FROM (SELECT clip, frame_idx, {keys}, regr_intercept({across}, {along}) AS a, regr_slope({across}, {along}) AS b, CAST(min({along}) AS DOUBLE) AS lo, CAST(max({along}) AS DOUBLE) AS hi,
  CAST(count(*) AS BIGINT) AS n, var_pop({along}) AS vv FROM fx_pixels WHERE ch = {ch} GROUP BY ALL) WHERE n >= 20 AND vv >= 1)"""


FITS = fit_sql(0, "cls")


@query("fit_lines", f"""
SELECT clip, frame_idx, cls AS key, 'yard' AS kind, {R6('a')} AS a, {R6('b')} AS b, lo, hi, n FROM {FITS}
UNION ALL SELECT clip, frame_idx, row, 'side', {R6('a')}, {R6('b')}, lo, hi, n FROM {fit_sql(1, 'row', 'px', 'py')}""")
def fit_lines(t):
    yard = L.fit_lines(t.pixels.where("ch = 0"), [*FRAME, "cls"]).withColumnRenamed("cls", "key").withColumn("kind", F.lit("yard"))
    side = L.fit_lines(t.pixels.where("ch = 1"), [*FRAME, "row"], "px", "py").withColumnRenamed("row", "key").withColumn("kind", F.lit("side"))
    return yard.unionByName(side).withColumns({"a": r6("a"), "b": r6("b")})


COVER = f"""s AS (SELECT f.clip, f.frame_idx, f.cls, u.y, CAST(trunc(f.a + f.b*u.y) AS INT) AS x FROM fits f, unnest(range(CAST(lo AS BIGINT), least(CAST(hi AS BIGINT), 719) + 1, 2)) u(y) WHERE hi > lo),
m AS (SELECT DISTINCT clip, frame_idx, px, py FROM fx_pixels WHERE ch = 0),
h AS (SELECT clip, frame_idx, cls, count(*) AS n, count(*) FILTER (hit) AS k FROM (SELECT s.*, EXISTS (SELECT 1 FROM m WHERE m.clip = s.clip AND m.frame_idx = s.frame_idx AND m.px BETWEEN s.x - 1 AND s.x + 1 AND m.py BETWEEN s.y - 1 AND s.y + 1) AS hit
  FROM s WHERE x BETWEEN 0 AND 1279) GROUP BY ALL),
cov AS (SELECT f.*, coalesce(k/(1e0*h.n), 0e0) AS coverage FROM fits f LEFT JOIN h USING (clip, frame_idx, cls))"""


@query("mask_coverage", f"WITH fits AS MATERIALIZED {FITS}, {COVER} SELECT clip, frame_idx, cls, {R6('coverage')} AS coverage FROM cov")
def mask_coverage(t):
    yard = t.pixels.where("ch = 0")
    d = L.mask_coverage(L.fit_lines(yard, [*FRAME, "cls"]), yard, [*FRAME, "cls"])
    return d.select(*FRAME, "cls", r6("coverage").alias("coverage"))


def principal(xx, yy, xy):
    big = f"(({xx}+{yy})/2 + sqrt(greatest(({xx}+{yy})/2*({xx}+{yy})/2 - ({xx}*{yy} - {xy}*{xy}), 0e0)))"
    vx = f"(CASE WHEN abs({xy}) > 1e-9 THEN {big} - {yy} WHEN {xx} >= {yy} THEN 1e0 ELSE 0e0 END)"
    vy = f"(CASE WHEN abs({xy}) > 1e-9 THEN {xy} WHEN {xx} >= {yy} THEN 0e0 ELSE 1e0 END)"
    return big, vx, vy


def stats_sql(source, keys):
    _, vx, vy = principal("xx", "yy", "xy")
    return f"""(SELECT *, CASE WHEN area < 2 THEN 1e0 ELSE {vx}/sqrt({vx}*{vx} + {vy}*{vy}) END AS cos_t, CASE WHEN area < 2 THEN 0e0 ELSE {vy}/sqrt({vx}*{vx} + {vy}*{vy}) END AS sin_t FROM (
  SELECT {keys}, CAST(count(*) AS BIGINT) AS area, avg(px) AS cx, avg(py) AS cy, min(px) AS x_min, max(px) + 1 AS x_max, min(py) AS y_min, max(py) + 1 AS y_max, avg(prob) AS conf,
    var_samp(px) AS xx, var_samp(py) AS yy, covar_samp(px, py) AS xy FROM {source} GROUP BY {keys}))"""


@query("component_stats", f"""
SELECT clip, frame_idx, ch, comp, area, {R6('cx')} AS cx, {R6('cy')} AS cy, x_min, x_max, y_min, y_max, {R6('conf')} AS conf, {R6('cos_t')} AS cos_t, {R6('sin_t')} AS sin_t
FROM {stats_sql('fx_pixels', 'clip, frame_idx, ch, comp')}""")
def component_stats(t):
    d = L.component_stats(t.pixels, [*FRAME, "ch", "comp"])
    return d.withColumns({k: r6(k) for k in ("cx", "cy", "conf", "cos_t", "sin_t")})


def params_sql(ch, aspect, min_pixels):
    big, vx, vy = principal("xx", "yy", "xy")
    return f"""(SELECT clip, frame_idx, comp, n, s0/s1 AS aspect, nx*cx + ny*cy AS rho, atan2(ny, nx) AS theta FROM (
  SELECT *, CASE WHEN vx < 0 OR (vx = 0 AND -vy < 0) THEN vy ELSE -vy END AS nx, CASE WHEN vx < 0 OR (vx = 0 AND -vy < 0) THEN -vx ELSE vx END AS ny,
    sqrt(big*n) AS s0, sqrt(greatest(xx + yy - big, 0e0)*n) AS s1 FROM (
    SELECT *, {vx}/sqrt({vx}*{vx} + {vy}*{vy}) AS vx, {vy}/sqrt({vx}*{vx} + {vy}*{vy}) AS vy, {big} AS big FROM (
      SELECT clip, frame_idx, comp, CAST(count(*) AS BIGINT) AS n, avg(px) AS cx, avg(py) AS cy, var_pop(px) AS xx, var_pop(py) AS yy, covar_pop(px, py) AS xy
      FROM fx_pixels WHERE ch = {ch} GROUP BY ALL) WHERE n >= {min_pixels})) WHERE s1 >= 1e-6 AND s0/s1 >= {aspect})"""


@query("line_params", f"SELECT clip, frame_idx, comp, n, {R4('aspect')} AS aspect, {R4('rho')} AS rho, {R6('theta')} AS theta FROM {params_sql(1, '2e0', 5)}")
def line_params(t):
    d = L.line_params(t.pixels.where("ch = 1"), [*FRAME, "comp"], 2.0, 5)
    return d.withColumns({"aspect": r4("aspect"), "rho": r4("rho"), "theta": r6("theta")})


def grouping_ctes(params, theta, rho):
    """CTEs ending in grp (clip, frame_idx, comp, line)."""
    match = f"[least(abs(s[1]-theta), pi() - abs(s[1]-theta)) <= {theta} AND abs(s[2] - CASE WHEN abs(s[1]-theta) > pi()/2 THEN -rho ELSE rho END) <= {rho} for s in seeds]"
    return f"""it AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip, frame_idx ORDER BY comp, theta, rho) AS k FROM {params}),
rec AS (SELECT clip, frame_idx, 0::BIGINT AS k, CAST([] AS DOUBLE[][]) AS seeds, CAST(NULL AS INT) AS comp, CAST(NULL AS INT) AS line FROM (SELECT DISTINCT clip, frame_idx FROM it)
  UNION ALL SELECT clip, frame_idx, k, CASE WHEN hit > 0 THEN seeds ELSE list_append(seeds, [theta, rho]) END, comp, CAST(CASE WHEN hit > 0 THEN hit - 1 ELSE len(seeds) END AS INT) FROM (
    SELECT i.clip, i.frame_idx, i.k, i.comp, i.theta, i.rho, r.seeds, coalesce(list_position({match.replace('theta', 'i.theta').replace('-rho', '-i.rho').replace('ELSE rho', 'ELSE i.rho').replace('seeds', 'r.seeds')}, true), 0) AS hit
    FROM rec r JOIN it i ON i.clip = r.clip AND i.frame_idx = r.frame_idx AND i.k = r.k + 1)),
grp AS (SELECT clip, frame_idx, comp, line FROM rec WHERE k > 0)"""


@query("group_collinear", f"WITH RECURSIVE {grouping_ctes(params_sql(1, '2e0', 5), '0.10e0', '30e0')} SELECT * FROM grp")
def group_collinear(t):
    return L.group_collinear(L.line_params(t.pixels.where("ch = 1"), [*FRAME, "comp"], 2.0, 5), 0.10, 30.0)


def dups_ctes(source, radius):
    """CTEs ending in keep (clip, frame_idx, o) for the 1-D scan; source has x, o, n."""
    return f"""di AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip, frame_idx ORDER BY x, o, n) AS k, count(*) OVER (PARTITION BY clip, frame_idx) AS m FROM {source}),
scan AS (SELECT clip, frame_idx, k, m, x, o, n, CAST(NULL AS BIGINT) AS done FROM di WHERE k = 1
  UNION ALL SELECT s.clip, s.frame_idx, i.k, s.m, CASE WHEN i.x - s.x > {radius} OR i.n > s.n THEN i.x ELSE s.x END, CASE WHEN i.x - s.x > {radius} OR i.n > s.n THEN i.o ELSE s.o END,
    CASE WHEN i.x - s.x > {radius} OR i.n > s.n THEN i.n ELSE s.n END, CASE WHEN i.x - s.x > {radius} THEN s.o END
  FROM scan s JOIN di i ON i.clip = s.clip AND i.frame_idx = s.frame_idx AND i.k = s.k + 1),
keep AS (SELECT clip, frame_idx, done AS o FROM scan WHERE done IS NOT NULL UNION ALL SELECT clip, frame_idx, o FROM scan WHERE k = m)"""


@query("suppress_near_dups", f"""
WITH RECURSIVE src AS (SELECT clip, frame_idx, avg(px) AS x, CAST(ch*10 + comp AS BIGINT) AS o, CAST(count(*) AS BIGINT) AS n FROM fx_pixels GROUP BY clip, frame_idx, ch, comp),
{dups_ctes('src', 50)} SELECT clip, frame_idx, o AS line FROM keep""")
def suppress_near_dups(t):
    tok = t.pixels.groupBy(*FRAME, "ch", "comp").agg(F.avg("px").alias("cx"), F.count("*").alias("area")).withColumn("line", (c("ch") * 10 + c("comp")).cast("long"))
    return L.suppress_near_dups(tok).select(*FRAME, "line")


_BENT = f"""(SELECT clip, frame_idx, cls, a + CASE WHEN (frame_idx + cls) % 7 = 0 THEN 140e0 ELSE 0e0 END + CASE WHEN (frame_idx + cls) % 11 = 0 THEN -90e0 ELSE 0e0 END AS a, b FROM {FITS})"""


def outlier_ctes(fits):
    """CTEs ending in good (clip, frame_idx, cls): drop the worst line until all fit."""
    return f"""oi AS MATERIALIZED (SELECT clip, frame_idx, list({{'c': CAST(cls AS DOUBLE), 'x': a + b*360e0}} ORDER BY cls) AS l FROM {fits} GROUP BY clip, frame_idx),
od AS (SELECT clip, frame_idx, l, 0 AS r, true AS moved FROM oi
  UNION ALL SELECT clip, frame_idx, CASE WHEN len(l) >= 3 AND w.r > 25 THEN list_filter(l, lambda p: p.c <> -w.k) ELSE l END, r + 1, len(l) >= 3 AND w.r > 25 FROM (
    SELECT clip, frame_idx, l, r, list_max([{{'r': abs(p.x - mx - m*(p.c - mc)), 'k': -p.c}} for p in l]) AS w FROM (
      SELECT *, list_sum([(p.c - mc)*(p.x - mx) for p in l])/list_sum([(p.c - mc)*(p.c - mc) for p in l]) AS m FROM (
        SELECT *, list_avg([p.c for p in l]) AS mc, list_avg([p.x for p in l]) AS mx FROM od WHERE moved AND r < 21 AND len(l) >= 3)))),
good AS (SELECT clip, frame_idx, CAST(p.c AS INT) AS cls FROM (SELECT clip, frame_idx, unnest(l) AS p FROM od QUALIFY row_number() OVER (PARTITION BY clip, frame_idx ORDER BY r DESC) = 1))"""


@query("spacing_outliers", f"""
WITH RECURSIVE bent AS MATERIALIZED {_BENT}, {outlier_ctes('bent').replace("SELECT clip, frame_idx, unnest(l) AS p FROM od QUALIFY", "SELECT clip, frame_idx, unnest(l) AS p FROM (SELECT * FROM od QUALIFY").replace("ORDER BY r DESC) = 1)", "ORDER BY r DESC) = 1))")} SELECT * FROM good""")
def spacing_outliers(t):
    fits = L.fit_lines(t.pixels.where("ch = 0"), [*FRAME, "cls"])
    odd = lambda m: (c("frame_idx") + c("cls")) % m == 0
    bent = fits.withColumn("a", c("a") + F.when(odd(7), 140.0).otherwise(0.0) + F.when(odd(11), -90.0).otherwise(0.0))
    return L.spacing_outliers(bent).select(*FRAME, "cls")


SPACING = """(WITH y AS (SELECT clip, frame_idx, comp, avg(px) AS cx FROM fx_pixels WHERE ch = 0 GROUP BY ALL HAVING count(*) >= 50),
g AS (SELECT *, cx - lag(cx) OVER (PARTITION BY clip, frame_idx ORDER BY cx, comp) AS g FROM y), m AS (SELECT *, quantile_cont(g, 0.5) OVER (PARTITION BY clip, frame_idx) AS m FROM g)
SELECT clip, frame_idx, coalesce(quantile_cont(g, 0.5) FILTER (g > 0.4e0*m), any_value(m), 100e0) AS spacing FROM m GROUP BY clip, frame_idx)"""


@query("yard_spacing", f"SELECT clip, frame_idx, {R6('spacing')} AS spacing FROM {SPACING}")
def yard_spacing(t):
    comps = L.component_stats(t.pixels.where("ch = 0"), [*FRAME, "comp"]).where("area >= 50")
    return L.yard_spacing(comps).withColumn("spacing", r6("spacing"))


@query("single_link", """
WITH RECURSIVE p AS MATERIALIZED (SELECT clip, frame_idx, ch*10 + comp AS node, avg(px) AS x, avg(py) AS y FROM fx_pixels GROUP BY clip, frame_idx, ch, comp),
e AS MATERIALIZED (SELECT a.clip, a.frame_idx, a.node AS n, b.node AS m FROM p a JOIN p b ON a.clip = b.clip AND a.frame_idx = b.frame_idx AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 120),
r AS (SELECT clip, frame_idx, n, m FROM e UNION SELECT r.clip, r.frame_idx, r.n, e.m FROM r JOIN e ON e.clip = r.clip AND e.frame_idx = r.frame_idx AND e.n = r.m)
SELECT clip, frame_idx, n AS comp, min(m) AS cluster FROM r GROUP BY clip, frame_idx, n""")
def single_link(t):
    nodes = t.pixels.groupBy(*FRAME, (c("ch") * 10 + c("comp")).alias("comp")).agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return L.single_link(nodes, 120.0)


@query("majority_label", f"""
SELECT clip, frame_idx, comp, value, {R6('n/(1e0*t)')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY clip, frame_idx, comp) AS t, row_number() OVER (PARTITION BY clip, frame_idx, comp ORDER BY n DESC, value) AS k FROM (
  SELECT clip, frame_idx, comp, CAST(round_even((raw % 40 - 5)/5e0, 0)*5 AS DOUBLE) AS value, count(*) AS n FROM fx_pixels WHERE ch = 3 AND raw % 40 - 5 > 0 GROUP BY ALL)) WHERE k = 1""")
def majority_label(t):
    d = L.majority_label(t.pixels.where("ch = 3"), (c("raw") % 40 - 5).cast("double"), [*FRAME, "comp"])
    return d.withColumn("share", r6("share"))


@query("line_crossings", f"""
SELECT clip, frame_idx, cls, row, {R6('(y.a + y.b*s.a)/(1 - y.b*s.b)')} AS u, {R6('s.a + s.b*((y.a + y.b*s.a)/(1 - y.b*s.b))')} AS v
FROM {FITS} y JOIN {fit_sql(1, 'row', 'px', 'py')} s USING (clip, frame_idx) WHERE abs(1 - y.b*s.b) >= 1e-9""")
def line_crossings(t):
    yards = L.fit_lines(t.pixels.where("ch = 0"), [*FRAME, "cls"]).select(*FRAME, "cls", "a", "b")
    sides = L.fit_lines(t.pixels.where("ch = 1"), [*FRAME, "row"], "px", "py").select(*FRAME, "row", c("a").alias("a2"), c("b").alias("b2"))
    return L.line_crossings(yards, sides).select(*FRAME, "cls", "row", r6("u").alias("u"), r6("v").alias("v"))


_FIXED_OUT = outlier_ctes("covered").replace("SELECT clip, frame_idx, unnest(l) AS p FROM od QUALIFY", "SELECT clip, frame_idx, unnest(l) AS p FROM (SELECT * FROM od QUALIFY").replace("ORDER BY r DESC) = 1)", "ORDER BY r DESC) = 1))")


@query("extract_keypoints", f"""
WITH RECURSIVE fits AS MATERIALIZED {FITS}, {COVER}, covered AS MATERIALIZED (SELECT * FROM cov WHERE coverage >= 0.70e0), {_FIXED_OUT},
yards AS MATERIALIZED (SELECT f.* FROM fits f JOIN good USING (clip, frame_idx, cls)),
sides AS MATERIALIZED {fit_sql(1, 'row', 'px', 'py')}, hrows AS {fit_sql(2, 'row', 'px', 'py')},
marks AS (SELECT clip, frame_idx, comp, cls, row, avg(px) AS cx, avg(py) AS cy FROM fx_pixels WHERE ch = 2 GROUP BY ALL),
slopes AS (SELECT clip, frame_idx, row, coalesce(h.b, s.b) AS slope FROM hrows h FULL JOIN sides s USING (clip, frame_idx, row)),
nk AS (SELECT p.clip, p.frame_idx, comp, cls, row, slope, px, py, py - slope*px AS c, row_number() OVER (PARTITION BY p.clip, p.frame_idx, comp, cls, row ORDER BY CASE WHEN row = 0 THEN py - slope*px ELSE -(py - slope*px) END) AS k
  FROM fx_pixels p JOIN slopes USING (clip, frame_idx, row) WHERE ch = 3),
edge AS (SELECT clip, frame_idx, comp, cls, row, slope AS b2, max(c) FILTER (k = 6) AS a2, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM nk GROUP BY ALL HAVING count(*) >= 7),
met AS (SELECT e.*, (y.a + y.b*a2)/(1 - y.b*b2) AS u, a2 + b2*((y.a + y.b*a2)/(1 - y.b*b2)) AS v FROM yards y JOIN edge e USING (clip, frame_idx, cls) WHERE abs(1 - y.b*b2) >= 1e-9)
SELECT clip, frame_idx, {R4('coalesce(a + b*cy, cx)')} AS u, {R4('cy')} AS v, 10e0 + 5*cls AS fx, CASE WHEN row = 0 THEN 'near_hash' ELSE 'far_hash' END AS kind FROM marks LEFT JOIN yards USING (clip, frame_idx, cls)
UNION ALL SELECT clip, frame_idx, {R4('(y.a + y.b*s.a)/(1 - y.b*s.b)')}, {R4('s.a + s.b*((y.a + y.b*s.a)/(1 - y.b*s.b))')}, 10e0 + 5*cls, CASE WHEN row = 0 THEN 'sideline_near' ELSE 'sideline_far' END
  FROM yards y JOIN sides s USING (clip, frame_idx) WHERE abs(1 - y.b*s.b) >= 1e-9
UNION ALL SELECT clip, frame_idx, {R4('u')}, {R4('v')}, 10e0 + 5*cls, CASE WHEN row = 0 THEN 'number_near' ELSE 'number_far' END FROM met WHERE u BETWEEN x0 - 30 AND x1 + 30 AND v BETWEEN y0 - 30 AND y1 + 30""")
def extract_keypoints(t):
    d = M.extract_keypoints(t.pixels)
    return d.select(*FRAME, r4("u").alias("u"), r4("v").alias("v"), "fx", "kind")


_CLEAN = f"""(SELECT *, CASE ch WHEN 0 THEN abs(x - round_even(x/5, 0)*5) <= 1 AND y BETWEEN -1 AND 53.33e0+1
  WHEN 1 THEN (abs(y) <= 2 OR abs(y - 53.33e0) <= 2) AND x BETWEEN 0 AND 120
  WHEN 2 THEN (abs(y - 23.583e0) <= 0.5e0 OR abs(y - (53.33e0 - 23.583e0)) <= 0.5e0) AND abs(x - round_even(x, 0)) <= 1 AND x BETWEEN 10 AND 110
  ELSE (y BETWEEN 11.5e0 AND 14.5e0 OR y BETWEEN 40.33e0-1.5e0 AND 40.33e0+1.5e0) AND abs(x - round_even(x/10, 0)*10) <= 3.5e0 AND round_even(x/10, 0)*10 BETWEEN 20 AND 100 END AS allowed
FROM (SELECT p.clip, p.frame_idx, ch, px, py, {px('h', 'px', 'py', 'floor9')} AS x, {py('h', 'px', 'py', 'floor9')} AS y FROM fx_pixels p JOIN fx_frames f ON f.clip = p.clip AND f.frame_idx = p.frame_idx WHERE h IS NOT NULL))"""


@query("clean_masks", f"SELECT clip, frame_idx, ch, px, py, allowed, CAST(count(*) AS BIGINT) AS n FROM {_CLEAN} GROUP BY ALL")
def clean_masks(t):
    return M.clean_masks(t.pixels, t.frames).groupBy(*FRAME, "ch", "px", "py", "allowed").agg(F.count("*").alias("n"))


@query("mask_report", f"""
SELECT ch, CAST(count(*) AS BIGINT) AS n, {R6('quantile_cont(r, 0.5)')} AS median_drop, {R6('avg(r)')} AS mean_drop FROM (
  SELECT clip, frame_idx, ch, count(*) FILTER (NOT allowed)/(1e0*count(*)) AS r FROM {_CLEAN} GROUP BY ALL) GROUP BY ch""")
def mask_report(t):
    return M.mask_report(t.pixels, t.frames).withColumns({"median_drop": r6("median_drop"), "mean_drop": r6("mean_drop")})


def _tok(t, d):
    return d.select(*FRAME, "type", "line", "area", *[r6(c("token")[i]).alias(f"f{i}") for i in (4, 5, 11, 12, 13, 14, 15)])


@query("tokenise")
def tokenise(t):
    return _tok(t, M.tokenise(t.pixels))


@query("grouped_lines", f"""
WITH RECURSIVE {grouping_ctes(params_sql(1, '2e0', 5), '0.10e0', '30e0')},
px2 AS (SELECT p.*, line FROM fx_pixels p JOIN grp USING (clip, frame_idx, comp) WHERE ch = 1)
SELECT clip, frame_idx, line, area, {R6('cx')} AS cx, {R6('cy')} AS cy, {R6('cos_t')} AS cos_t, {R6('sin_t')} AS sin_t FROM {stats_sql('px2', 'clip, frame_idx, line')} WHERE area >= 20""")
def grouped_lines(t):
    rule = dict(min_pixels=5, aspect=2.0, rho=30.0, theta=0.10, fragments=1, singleton=20, total=20)
    d = M.grouped_lines(t.pixels, 1, rule, None)
    return d.select(*FRAME, "line", "area", *[r6(k).alias(k) for k in ("cx", "cy", "cos_t", "sin_t")])


@query("label_numbers", f"""
WITH g AS (SELECT clip, frame_idx, comp, avg(px) AS cx, avg(prob) AS conf FROM fx_pixels WHERE ch = 3 GROUP BY ALL),
q AS (SELECT *, CAST(round_even(cx/9/5, 0)*5 AS DOUBLE) AS v, abs(cx/9 - round_even(cx/9/5, 0)*5) AS dev FROM g)
SELECT clip, frame_idx, comp, CASE WHEN ok THEN v ELSE 0e0 END AS value, ok AS has_value, {R6('conf*CASE WHEN ok THEN least(greatest(1 - dev/2.5e0, 0e0), 1e0) ELSE 1e0 END')} AS conf
FROM (SELECT *, v BETWEEN 10 AND 110 AND dev < 3 AS ok FROM q) WHERE comp <> 2""")
def label_numbers(t):
    groups = t.pixels.where("ch = 3").groupBy(*FRAME, "comp").agg(F.avg("px").alias("cx"), F.avg("prob").alias("conf"))

    def labeller(g):
        q = quantise_conf(c("cx") / 9)
        return g.withColumns({"value": q["value"], "has_value": q["has_value"], "label_conf": q["conf"], "keep": c("comp") != 2})

    return M.label_numbers(groups, labeller).select(*FRAME, "comp", "value", "has_value", r6("conf").alias("conf"))


@query("label_numbers_truth", f"""
WITH g AS (SELECT clip, frame_idx, comp, avg(px) AS cx, avg(py) AS cy, avg(prob) AS conf FROM fx_pixels WHERE ch = 3 GROUP BY ALL),
x AS (SELECT g.*, {px('h', 'cx', 'cy')} AS x FROM g LEFT JOIN fx_frames f ON f.clip = g.clip AND f.frame_idx = g.frame_idx AND h IS NOT NULL),
q AS (SELECT *, round_even(x/5, 0)*5 AS v, abs(x - round_even(x/5, 0)*5) AS dev FROM x)
SELECT clip, frame_idx, comp, CASE WHEN ok THEN v ELSE 0e0 END AS value, ok AS has_value, {R6('conf*CASE WHEN ok THEN least(greatest(1 - dev/2.5e0, 0e0), 1e0) ELSE 1e0 END')} AS conf
FROM (SELECT *, coalesce(v BETWEEN 10 AND 110 AND dev < 3, false) AS ok FROM q)""")
def label_numbers_truth(t):
    groups = t.pixels.where("ch = 3").groupBy(*FRAME, "comp").agg(F.avg("px").alias("cx"), F.avg("py").alias("cy"), F.avg("prob").alias("conf"))
    return M.label_numbers(groups, M.truth_labeller(t.frames)).select(*FRAME, "comp", "value", "has_value", r6("conf").alias("conf"))


# two groups a frame: components 0 to 2, and the others
@query("label_numbers_majority", f"""
WITH g AS (SELECT clip, frame_idx, CAST(comp > 2 AS INT) AS line, avg(prob) AS conf FROM fx_pixels WHERE ch = 3 GROUP BY ALL),
n AS (SELECT clip, frame_idx, CAST(comp > 2 AS INT) AS line, CAST(round_even((raw % 40 - 25)/5e0, 0)*5 AS DOUBLE) AS v, count(*) AS n FROM fx_pixels WHERE ch = 3 AND raw % 40 - 25 > 0 GROUP BY ALL),
b AS (SELECT *, n/(1e0*sum(n) OVER (PARTITION BY clip, frame_idx, line)) AS share FROM n QUALIFY row_number() OVER (PARTITION BY clip, frame_idx, line ORDER BY n DESC, v) = 1)
SELECT clip, frame_idx, line, coalesce(v, 0e0) AS value, v IS NOT NULL AS has_value, {R6('conf*coalesce(share, 1e0)')} AS conf FROM g LEFT JOIN b USING (clip, frame_idx, line)""")
def label_numbers_majority(t):
    numbers = t.pixels.where("ch = 3").withColumn("line", (c("comp") > 2).cast("int"))
    groups = numbers.groupBy(*FRAME, "line").agg(F.avg("prob").alias("conf"), F.sort_array(F.collect_set("comp")).alias("members"))
    named = M.label_numbers(groups, M.majority_labeller(t.pixels.where("ch = 3"), (c("raw") % 40 - 25).cast("double")))
    return named.select(*FRAME, "line", "value", "has_value", r6("conf").alias("conf"))
