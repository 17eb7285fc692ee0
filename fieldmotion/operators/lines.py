"""Lines, components and groups from labelled mask pixels (clip, frame_idx, ch, comp, px, py)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.functions.constants import IMAGE_H, IMAGE_W

FRAME = ["clip", "frame_idx"]


def moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One mergeable record per key: n, sums and products of pixel places, box and summed
    probability. ``rows`` are pixels, or records of finer keys, whose sums are added up.

    Pixel places are whole numbers and probabilities are added as decimals of 15 places, so
    the sums are exact in any order of merging.
    """
    if "sxx" in rows.columns:
        total = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "sp")]
        return rows.groupBy(*keys).agg(*total, *[F.min(c).alias(c) for c in ("x_min", "y_min")], *[F.max(c).alias(c) for c in ("x_max", "y_max")])
    x, y = F.col("px").cast("long"), F.col("py").cast("long")
    prob = F.sum(F.col("prob").cast("decimal(18,15)")) if "prob" in rows.columns else F.lit(None).cast("double")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
        prob.alias("sp"), F.min("px").alias("x_min"), F.max("px").alias("x_max"), F.min("py").alias("y_min"), F.max("py").alias("y_max"))


def _spread(a: str, b: str) -> Column:
    """n * n times the covariance of two places, exactly."""
    return (F.col("n") * F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}")).cast("double")


def fit_lines(rows: DataFrame, keys: list[str], along: str = "py", across: str = "px", min_pixels: int = 20) -> DataFrame:
    """Straight line ``across = a + b * along`` through the pooled pixels of each key;
    needs ``min_pixels`` and some spread. Gives a, b, lo, hi (range of along) and n."""
    u, v = along[1], across[1]
    m = moments(rows, keys).where((F.col("n") >= min_pixels) & (_spread(u, u) >= F.col("n") * F.col("n") * 1.0))
    slope = _spread("x", "y") / _spread(u, u)
    out = m.withColumn("b", slope).withColumn("a", (F.col(f"s{v}") - F.col("b") * F.col(f"s{u}")) / F.col("n"))
    return out.select(*keys, "a", "b", F.col(f"{u}_min").cast("double").alias("lo"), F.col(f"{u}_max").cast("double").alias("hi"), "n")


def mask_coverage(fits: DataFrame, mask: DataFrame, keys: list[str], step: int = 2, radius: int = 1) -> DataFrame:
    """Share of samples along each line with a mask pixel within ``radius``.

    Samples carry their neighbourhood, so the hit test is an equi semi-join on pixels.
    """
    top = F.greatest(F.floor("lo"), F.lit(0)).cast("int")
    bottom = F.least(F.floor("hi"), F.lit(IMAGE_H - 1)).cast("int")
    s = fits.where(bottom > top).withColumn("_y", F.explode(F.sequence(top, bottom, F.lit(step))))
    s = s.withColumn("_x", (F.col("a") + F.col("b") * F.col("_y")).cast("int")).where((F.col("_x") >= 0) & (F.col("_x") < IMAGE_W))
    around = F.array(*[F.struct((F.col("_x") + i).alias("px"), (F.col("_y") + j).alias("py"))
                       for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    near = s.select(*keys, "_y", F.explode(around).alias("_p")).select(*keys, "_y", "_p.px", "_p.py")
    on = mask.select(*FRAME, "px", "py").distinct()
    hits = near.join(on, [*FRAME, "px", "py"], "left_semi").groupBy(*keys).agg(F.count_distinct("_y").alias("_hit"))
    total = s.groupBy(*keys).agg(F.count("*").alias("_all"))
    out = fits.join(total, keys, "left").join(hits, keys, "left")
    return out.withColumn("coverage", F.coalesce(F.coalesce(F.col("_hit"), F.lit(0)) / F.col("_all"), F.lit(0.0))).drop("_hit", "_all")


def _principal(sxx, syy, sxy):
    """Unit direction of the larger principal axis, and both eigenvalues."""
    half = (sxx + syy) / 2
    root = F.sqrt(F.greatest(half * half - (sxx * syy - sxy * sxy), F.lit(0.0)))
    big, small = half + root, half - root
    tilted = F.abs(sxy) > 1e-9
    vx = F.when(tilted, big - syy).when(sxx >= syy, 1.0).otherwise(0.0)
    vy = F.when(tilted, sxy).when(sxx >= syy, 0.0).otherwise(1.0)
    norm = F.hypot(vx, vy)
    return vx / norm, vy / norm, big, small


def component_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area, centroid, box, mean probability and orientation of each component."""
    n, per = F.col("n"), F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))
    vx, vy, _, _ = _principal(*(_spread(a, b) / per for a, b in ("xx", "yy", "xy")))
    flat = n < 2
    return moments(rows, keys).select(
        *keys, n.alias("area"), (F.col("sx") / n).alias("cx"), (F.col("sy") / n).alias("cy"), "x_min", (F.col("x_max") + 1).alias("x_max"), "y_min", (F.col("y_max") + 1).alias("y_max"),
        (F.col("sp").cast("double") / n).alias("conf"), F.when(flat, 1.0).otherwise(vx).alias("cos_t"), F.when(flat, 0.0).otherwise(vy).alias("sin_t"))


def line_params(rows: DataFrame, keys: list[str], min_aspect: float, min_pixels: int = 1) -> DataFrame:
    """(rho, theta in [0, pi)) of components long enough for a line."""
    m = moments(rows, keys).where(F.col("n") >= min_pixels)
    vx, vy, big, small = _principal(*(_spread(a, b) / (F.col("n") * F.col("n")) for a, b in ("xx", "yy", "xy")))
    m = m.withColumns({"_vx": vx, "_vy": vy, "_s0": F.sqrt(big * F.col("n")), "_s1": F.sqrt(F.greatest(small, F.lit(0.0)) * F.col("n"))})
    # the normal is turned into the upper half plane
    nx, ny = -F.col("_vy"), F.col("_vx")
    turn = F.when((ny < 0) | ((ny == 0) & (nx < 0)), -1.0).otherwise(1.0)
    m = m.withColumns({"_nx": nx * turn, "_ny": ny * turn, "aspect": F.when(F.col("_s1") >= 1e-6, F.col("_s0") / F.col("_s1"))})
    return m.where(F.col("aspect") >= min_aspect).select(
        *keys, "n", "aspect", ((F.col("_nx") * F.col("sx") + F.col("_ny") * F.col("sy")) / F.col("n")).alias("rho"), F.atan2("_ny", "_nx").alias("theta"))


def group_collinear(lines: DataFrame, theta_tol: float, rho_tol: float, keys: list[str] = FRAME, order: str = "comp") -> DataFrame:
    """Assign each line of a frame to the first earlier seed it agrees with, else make it
    a seed. A frame's lines (a handful) are folded in order inside one array."""
    items = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "theta", "rho"))).alias("_items"))
    seed_type = "array<struct<theta:double,rho:double>>"

    def step(acc, c):
        def agrees(s):
            gap = F.abs(s["theta"] - c["theta"])
            rho = F.when(gap > math.pi / 2, -c["rho"]).otherwise(c["rho"])
            return (F.least(gap, math.pi - gap) <= theta_tol) & (F.abs(s["rho"] - rho) <= rho_tol)

        at = F.array_position(F.transform(acc["seeds"], agrees), F.lit(True)).cast("int")
        fresh = F.struct(c["theta"].alias("theta"), c["rho"].alias("rho"))
        return F.struct(
            F.when(at > 0, acc["seeds"]).otherwise(F.concat(acc["seeds"], F.array(fresh))).alias("seeds"),
            F.concat(acc["groups"], F.array(F.when(at > 0, at - 1).otherwise(F.size(acc["seeds"])))).alias("groups"))

    start = F.struct(F.array().cast(seed_type).alias("seeds"), F.array().cast("array<int>").alias("groups"))
    folded = items.withColumn("_g", F.aggregate("_items", start, step, lambda acc: acc["groups"]))
    return folded.select(*keys, F.explode(F.arrays_zip("_items", "_g")).alias("z")).select(
        *keys, F.col(f"z._items.{order}").alias(order), F.col("z._g").alias("line"))


def suppress_near_dups(tokens: DataFrame, radius: float = 50.0, keys: list[str] = FRAME, x: str = "cx", size: str = "area", order: str = "line") -> DataFrame:
    """Among tokens of a frame closer than ``radius`` in x keep the larger, scanning in x
    order: the current survivor meets the next token, and the smaller one goes."""
    items = tokens.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(order).cast("long").alias("o"), F.col(size).cast("long").alias("n")))).alias("_items"))
    item_type = "struct<x:double,o:bigint,n:bigint>"

    def step(acc, c):
        cur = acc["cur"]
        clear = cur.isNull() | (c["x"] - cur["x"] > radius)
        bigger = c["n"] > cur["n"]
        kept = F.when(clear & cur.isNotNull(), F.concat(acc["kept"], F.array(cur["o"]))).otherwise(acc["kept"])
        return F.struct(F.when(clear | bigger, c).otherwise(cur).alias("cur"), kept.alias("kept"))

    start = F.struct(F.lit(None).cast(item_type).alias("cur"), F.array().cast("array<bigint>").alias("kept"))
    kept = items.select(*keys, F.explode(F.aggregate("_items", start, step, lambda a: F.concat(a["kept"], F.array(a["cur"]["o"])))).alias("_o"))
    return tokens.join(kept, [*[tokens[k] == kept[k] for k in keys], tokens[order].cast("long") == kept["_o"]], "left_semi")


def spacing_outliers(fits: DataFrame, limit: float = 25.0, min_fits: int = 3, keys: list[str] = FRAME, mid: float = IMAGE_H / 2) -> DataFrame:
    """Drop, one at a time, the line whose position at mid height is worst against a
    straight fit over the classes, while it is off by more than ``limit`` and at least
    ``min_fits`` lines remain. A frame has at most 21 classes, folded in one array."""
    pair = F.struct(F.col("cls").cast("double").alias("c"), (F.col("a") + F.col("b") * mid).alias("x"))
    items = fits.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("_items"))

    def total(arr, f):
        return F.aggregate(arr, F.lit(0.0), lambda t, p: t + f(p))

    def drop_worst(arr, _):
        n = F.size(arr).cast("double")
        mc, mx = total(arr, lambda p: p["c"]) / n, total(arr, lambda p: p["x"]) / n
        m = F.try_divide(total(arr, lambda p: (p["c"] - mc) * (p["x"] - mx)), total(arr, lambda p: (p["c"] - mc) * (p["c"] - mc)))
        scored = F.transform(arr, lambda p: F.struct(F.abs(p["x"] - mx - m * (p["c"] - mc)).alias("r"), (-p["c"]).alias("k")))
        worst = F.array_max(scored)
        bad = (F.size(arr) >= min_fits) & (worst["r"] > limit)
        return F.when(bad, F.filter(arr, lambda p: p["c"] != -worst["k"])).otherwise(arr)

    kept = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("_items") - (min_fits - 1), F.lit(1))), F.col("_items"), drop_worst)
    good = items.select(*keys, F.explode(kept).alias("_p")).select(*keys, F.col("_p.c").cast("int").alias("cls"))
    return fits.join(good, [*keys, "cls"], "left_semi")


def single_link(points: DataFrame, threshold: Column | float, keys: list[str] = FRAME, node: str = "comp", x: str = "cx", y: str = "cy") -> DataFrame:
    """Clusters of points linked by distances up to ``threshold`` (constant in a frame).

    Links come from a grid of that cell size; a task then joins one frame's links, whose
    points are a frame's few components, and names each cluster by its smallest node.
    """
    r = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pts = points.select(*keys, F.col(node).alias("_n"), F.col(x).alias("_x"), F.col(y).alias("_y"), r.cast("double").alias("_r"))
    cx, cy = F.floor(F.col("_x") / F.col("_r")), F.floor(F.col("_y") / F.col("_r"))
    left = pts.withColumns({"_cx": cx, "_cy": cy})
    around = F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = pts.select(*keys, F.col("_n").alias("_m"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2"), F.explode(around).alias("_a"))
    right = right.select(*keys, "_m", "_x2", "_y2", F.col("_a.cx").alias("_cx"), F.col("_a.cy").alias("_cy"))
    links = left.join(right, [*keys, "_cx", "_cy"]).where(F.hypot(F.col("_x") - F.col("_x2"), F.col("_y") - F.col("_y2")) <= F.col("_r"))
    links = links.select(*keys, "_n", "_m")
    fields = {f.name: f.dataType.simpleString() for f in links.schema}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), f"_n {fields['_n']}, _l {fields['_n']}"])

    def fold(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        """Disjoint sets over one frame's links; every point is linked with itself."""
        n, m = d.column("_n").to_pylist(), d.column("_m").to_pylist()
        root = {x: x for x in n}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(n, m, strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)  # the smallest node stays the root
        kind = d.schema.field("_n").type
        names = sorted(root)
        return pa.table({**{k: pa.array([v.as_py()] * len(names), v.type) for k, v in zip(keys, key, strict=True)},
                         "_n": pa.array(names, kind), "_l": pa.array([find(x) for x in names], kind)})

    labels = links.groupBy(*keys).applyInArrow(fold, schema)
    return labels.select(*keys, F.col("_n").alias(node), F.col("_l").alias("cluster"))


def yard_spacing(components: DataFrame, keys: list[str] = FRAME, x: str = "cx", order: str = "comp", fallback: float = 100.0) -> DataFrame:
    """Typical gap between neighbouring yard components of a frame: the median of the
    gaps above 0.4 of the median gap; ``fallback`` without two components."""
    w = Window.partitionBy(*keys).orderBy(x, order)
    gaps = components.withColumn("_g", F.col(x) - F.lag(x).over(w))
    mid = gaps.groupBy(*keys).agg(F.percentile("_g", F.lit(0.5)).alias("_m"))
    wide = gaps.join(mid, keys).groupBy(*keys).agg(
        F.percentile(F.when(F.col("_g") > 0.4 * F.col("_m"), F.col("_g")), F.lit(0.5)).alias("_w"), F.first("_m").alias("_m"))
    return wide.select(*keys, F.coalesce("_w", "_m", F.lit(fallback)).alias("spacing"))


def majority_label(pixels: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """Most frequent 5-yard value above 0 per key (smallest on a tie) and its share."""
    q = pixels.where(value > 0).select(*keys, (F.rint(value / 5) * 5).alias("value"))
    counts = q.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"), (F.max("n") / F.sum("n")).alias("share"))
    return best


def line_crossings(yards: DataFrame, others: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Where each yard line x = a + b y meets y = a2 + b2 x of the same frame; pairs that
    are nearly parallel are skipped. Both sides are a frame's few fitted lines."""
    pairs = yards.join(others, keys)
    den = 1 - F.col("b") * F.col("b2")
    x = (F.col("a") + F.col("b") * F.col("a2")) / den
    return pairs.where(F.abs(den) >= 1e-9).withColumn("u", x).withColumn("v", F.col("a2") + F.col("b2") * F.col("u"))
