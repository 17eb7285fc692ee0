"""Quadratic smoothing of tracks and homographies, leave-one-out checks and refills."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.functions.geometry import corner_gap, corner_residual, corners
from fieldmotion.operators.ordered import PIECE_BITS, bounded, numbered, run_bounds, running
from fieldmotion.operators.reliable import stage
from fieldmotion.operators.runs import TRACK, derivatives


def hat_matrix(window: int, degree: int = 2) -> np.ndarray:
    """Row i holds the weights that give the fitted polynomial at sample i."""
    a = np.vander(np.arange(window, dtype=float) - (window - 1) / 2, degree + 1)
    return a @ np.linalg.pinv(a)


def _weights(window, degree):
    return F.array(*[F.lit(float(v)) for v in hat_matrix(window, degree).ravel()])


def _fit_in_window(near: Column, field: str, first: Column, row: Column, window: Column, weights: Column) -> Column:
    """Weighted sum over the samples of ``near`` from ``first`` on."""
    inside = F.filter(near, lambda s: (s["p"] >= first) & (s["p"] < first + window))
    return F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + s[field] * F.element_at(
        weights, (row * window + s["p"] - first + 1).cast("int")))


def smooth_track(df: DataFrame, x: str = "x", y: str = "y", window: int = 9, degree: int = 2,
                 valid: Column | None = None, keys: Sequence[str] = TRACK, pos: str = "frame_idx",
                 out: tuple[str, str] = ("sx", "sy"), bits: int = PIECE_BITS) -> DataFrame:
    """Polynomial smoothing inside each run of valid frames at least ``window`` long;
    shorter runs stay as they are, run ends use the fit of the end window."""
    return _smooth(df, x, y, [window], window, None, degree, valid, keys, pos, out, bits).drop("row")


def smooth_track_adaptive(df: DataFrame, x: str = "x", y: str = "y", window: int = 7, degree: int = 2,
                          valid: Column | None = None, keys: Sequence[str] = TRACK,
                          pos: str = "frame_idx", out: tuple[str, str] = ("sx", "sy"),
                          bits: int = PIECE_BITS) -> DataFrame:
    """Like ``smooth_track`` with the window shrunk to the largest odd length of the run
    (at least 5 frames); tracks with fewer valid frames than the window stay unchanged."""
    return _smooth(df, x, y, _odd_windows(window, degree), max(5, degree + 2), window, degree,
                   valid, keys, pos, out, bits).drop("row")


def _odd_windows(window, degree):
    return [w for w in range(3, window + 1, 2) if w > degree]


def _smooth(df, x, y, sizes, min_len, min_total, degree, valid, keys, pos, out, bits, min_rows=0):
    """One carry pass (run bounds, row and valid counts), then one bounded window."""
    valid = F.col(x).isNotNull() if valid is None else valid
    widest = max(sizes)
    known = df.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    ok = F.col("_ok").cast("int")
    marked = run_bounds(known, keys, pos, F.col("_ok"), "_rs", "_re",
                        {"_ok_n": ok, "_row_n": F.lit(1)}, bits)
    marked = marked.withColumns({
        "_n_ok": F.col("_ok_n_upto") + F.col("_ok_n_from") - ok,
        "_rows": F.col("_row_n_upto") + F.col("_row_n_from") - 1,
        "row": (F.col("_row_n_upto") - 1).cast("int"),
    }).where(F.col("_rows") >= min_rows)
    length = F.col("_re") - F.col("_rs")
    odd = length - F.when(length % 2 == 0, 1).otherwise(0)
    w = F.least(F.lit(widest), odd) if len(sizes) > 1 else F.lit(widest)
    weights = F.lit(None).cast("array<double>")
    for size in sizes:
        weights = F.when(F.col("_w") == size, _weights(size, degree)).otherwise(weights)

    def near(win):
        sample = F.struct(F.col(pos).alias("p"), F.col(x).alias("a"), F.col(y).alias("b"))
        reach = win.rangeBetween(-(widest - 1), widest - 1)
        return {"_near": F.collect_list(F.when(F.col("_ok"), sample)).over(reach)}

    smoothable = length >= min_len
    if min_total is not None:
        smoothable = smoothable & (F.col("_n_ok") >= min_total)
    wide = bounded(marked, keys, pos, widest - 1, widest - 1, near, bits).withColumn("_w", w)
    half = ((F.col("_w") - 1) / 2).cast("int")
    first = F.greatest(F.col("_rs"), F.least(F.col(pos) - half, F.col("_re") - F.col("_w")))
    wide = wide.withColumn("_f", first).withColumn("_c", weights)
    at = F.col(pos) - F.col("_f")

    def fitted(field, raw):
        fit = _fit_in_window(F.col("_near"), field, F.col("_f"), at, F.col("_w"), F.col("_c"))
        return F.when(smoothable, fit).otherwise(F.when(F.col("_ok"), F.col(raw)))

    gone = ["_ok", "_rs", "_re", "_n_ok", "_rows", "_near", "_w", "_f", "_c",
            "_ok_n_upto", "_ok_n_from", "_row_n_upto", "_row_n_from"]
    return wide.withColumns({out[0]: fitted("a", x), out[1]: fitted("b", y)}).drop(*gone)


def smoothing_window(window_ms: int = 200, fps: float = 30.0, degree: int = 2) -> int:
    """Odd number of frames covering ``window_ms``, above the degree."""
    w = max(int(window_ms / 1000.0 * fps), degree + 2)
    return w if w % 2 else w + 1


def smooth_and_downsample(points: DataFrame, x: str = "x", y: str = "y", valid: Column | None = None,
                          source_fps: float = 30.0, target_fps: float = 10.0, window_ms: int = 200,
                          min_points: int = 10, keys: Sequence[str] = TRACK, pos: str = "frame_idx",
                          bits: int = PIECE_BITS) -> DataFrame:
    """Tracks of at least ``min_points`` rows, smoothed, sampled at the target rate and
    differentiated there."""
    window, degree = smoothing_window(window_ms, source_fps), 2
    step = round(source_fps / target_fps)
    smooth = _smooth(points, x, y, _odd_windows(window, degree), max(5, degree + 2), window, degree,
                     valid, keys, pos, ("sx", "sy"), bits, min_points)
    sampled = smooth.where(F.col("row") % step == 0).withColumns({
        "sample": (F.col("row") / step).cast("int"), "time": F.col(pos) / source_fps}).drop("row")
    return derivatives(sampled, target_fps, "sx", "sy", keys, "sample", bits)


def temporal_divergence(frames: DataFrame, h: str = "h", bits: int = PIECE_BITS) -> DataFrame:
    """Add temp_div: distance of a frame's corners to the mean of its neighbours'."""
    def layer(w):
        p = F.when(F.lag("frame_idx").over(w) == F.col("frame_idx") - 1, F.lag("_c").over(w))
        n = F.when(F.lead("frame_idx").over(w) == F.col("frame_idx") + 1, F.lead("_c").over(w))
        return {"_m": F.zip_with(p, n, lambda a, b: 0.5 * (a + b))}

    cut = frames.withColumn("_c", corners(F.col(h)))
    near = bounded(cut, ["clip"], "frame_idx", 1, 1, layer, bits)
    return near.withColumn("temp_div", corner_gap(F.col("_c"), F.col("_m"))).drop("_c", "_m")


def _quadratic_weights(n, s1, s2, s3, s4):
    """(c0, c1, c2) such that sum((c0 + c1 x + c2 x^2) y) is the fitted value at x = 0."""
    a, b, c = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    det = n * a + s1 * b + s2 * c
    # three or more distinct neighbours give det > 0; fewer give NULL
    return F.try_divide(a, det), F.try_divide(b, det), F.try_divide(c, det)


def _weighted_cells(terms: Sequence[tuple[Column, Column]]) -> Column:
    """Sum of nine-cell arrays times their weights, in their order; spelled out by cell,
    since folds over arrays are interpreted row by row."""
    return F.array(*[sum((h[i] * w for h, w in terms[1:]), terms[0][0][i] * terms[0][1]) for i in range(9)])


def loo_residual(frames: DataFrame, h: str = "h", half: int = 3, bits: int = PIECE_BITS) -> DataFrame:
    """Add loo: distance of a frame's corners to those of the quadratic through up to
    ``half`` neighbours on each side in the sequence of present homographies.

    Frames without a homography, or with under three neighbours, get NULL.
    """
    present = numbered(frames.where(F.col(h).isNotNull()), ["clip"], "frame_idx", "_k", bits)
    offsets = [k for k in range(-half, half + 1) if k]

    def layer(w):
        pick = lambda k: F.lag(h, -k).over(w) if k < 0 else F.lead(h, k).over(w)
        return {f"_n{i}": pick(k) for i, k in enumerate(offsets)}

    near = bounded(present, ["clip"], "_k", half, half, layer, bits)
    here = [F.col(f"_n{i}").isNotNull().cast("double") for i in range(len(offsets))]
    s = [sum((f * float(k**p) for f, k in zip(here, offsets)), F.lit(0.0)) for p in range(5)]
    near = near.withColumns({f"_s{p}": v for p, v in enumerate(s)})
    c0, c1, c2 = _quadratic_weights(*[F.col(f"_s{p}") for p in range(5)])
    near = near.withColumns({"_c0": c0, "_c1": c1, "_c2": c2})
    near = near.withColumns({f"_w{i}": F.when(here[i] > 0, F.col("_c0") + F.col("_c1") * float(k) + F.col("_c2") * float(k * k)).otherwise(0.0) for i, k in enumerate(offsets)})
    zero = F.array(*[F.lit(0.0)] * 9)
    fit = _weighted_cells([(F.coalesce(f"_n{i}", zero), F.col(f"_w{i}")) for i in range(len(offsets))])
    scored = near.withColumn("_fit", F.when(F.col("_s0") >= 3, fit)).select(
        "clip", "frame_idx", corner_residual(F.col(h), F.col("_fit")).alias("loo"))
    return frames.join(scored, ["clip", "frame_idx"], "left")


def nearest_good(frames: DataFrame, red: str = "red", half: int = 3, h: str = "h",
                 bits: int = PIECE_BITS) -> DataFrame:
    """For each red frame its ``half`` previous and next good frames: one row per
    (clip, frame_idx, neighbour frame) with the neighbour's homography."""
    ranked = running(frames.select("clip", "frame_idx", red, h), ["clip"], "frame_idx",
                     {"_g": ("sum", F.when(F.col(red), 0).otherwise(1))}, bits=bits)
    wanted = ranked.where(red).select(
        "clip", "frame_idx", F.explode(F.sequence(F.col("_g") - (half - 1), F.col("_g") + half)).alias("_g"))
    good = ranked.where(~F.col(red)).select("clip", "_g", F.col("frame_idx").alias("near_frame"), F.col(h).alias("near_h"))
    return wanted.join(good, ["clip", "_g"]).drop("_g")


def fill_bad(frames: DataFrame, loo_limit: float = 0.20, rmse_limit: float = 0.30, half: int = 3,
             bits: int = PIECE_BITS) -> DataFrame:
    """Mark red frames (no homography, LOO or RMSE too large) and refit them through the
    nearest good frames; ``h_clean`` keeps the raw value where fewer than three exist."""
    scored = loo_residual(frames, "h", half, bits)
    red = F.coalesce(F.col("h").isNull() | (F.col("loo") > loo_limit), F.lit(False)) | F.coalesce(
        F.col("rmse") > rmse_limit, F.lit(False))
    scored = stage(scored.withColumn("red", red))
    near = nearest_good(scored, "red", half, "h", bits)
    # The few neighbours are folded in frame order and scaled by the farthest, so that no
    # sum depends on the order in which rows arrive.
    x = (F.col("near_frame") - F.col("frame_idx")).cast("double")
    fits = near.groupBy("clip", "frame_idx").agg(F.sort_array(F.collect_list(F.struct(x.alias("x"), F.col("near_h").alias("h")))).alias("_near"))
    places = range(2 * half)
    fits = fits.where(F.size("_near") >= 3).withColumn("_far", F.greatest(F.abs(F.col("_near")[0]["x"]), F.abs(F.element_at("_near", -1)["x"])))
    # spelled out, since folds over arrays are interpreted; a missing neighbour adds nothing
    fits = fits.withColumns({f"_x{i}": F.get("_near", F.lit(i))["x"] / F.col("_far") for i in places})
    add = lambda terms: sum(terms, F.lit(0.0))
    fits = fits.withColumns({f"_s{p}": add(F.coalesce(F.pow(f"_x{i}", F.lit(float(p))), F.lit(0.0)) for i in places) for p in range(5)})
    fits = fits.withColumns({f"_c{p}": w for p, w in enumerate(_quadratic_weights(*[F.col(f"_s{p}") for p in range(5)]))})
    weight = lambda v: F.col("_c0") + F.col("_c1") * v + F.col("_c2") * v * v
    fits = fits.withColumns({f"_w{i}": weight(F.col(f"_x{i}")) for i in places})
    cell = lambda i, k: F.get("_near", F.lit(i))["h"][k] * F.col(f"_w{i}")
    known = lambda i, k: F.when(F.col(f"_x{i}").isNotNull(), cell(i, k)).otherwise(0.0)
    fill = F.array(*[add(known(i, k) for i in places) for k in range(9)])
    fits = fits.select("clip", "frame_idx", F.when(F.col("_c0").isNotNull(), fill).alias("_fill"))
    out = scored.join(fits, ["clip", "frame_idx"], "left")
    return out.withColumn("h_clean", F.coalesce("_fill", "h")).drop("_fill")


def smooth_h(frames: DataFrame, h: str = "h_clean", window: int = 7, degree: int = 2,
             out: str = "h_smooth", bits: int = PIECE_BITS) -> DataFrame:
    """Smooth each homography coefficient (over h33) along the present frames of a clip,
    end values repeated; clips with fewer than ``window`` present frames are unchanged."""
    half = window // 2
    centre = [float(v) for v in hat_matrix(window, degree)[half]]
    present = numbered(frames.where(F.col(h).isNotNull()).select("clip", "frame_idx", F.col(h).alias("_h")),
                       ["clip"], "frame_idx", "_k", bits)
    scale = F.when(F.abs(F.col("_h")[8]) < 1e-9, F.lit(1.0)).otherwise(F.col("_h")[8])
    present = present.withColumn("_scale", scale).withColumn("_u", F.array(*[F.col("_h")[i] / F.col("_scale") for i in range(9)]))

    def layer(w):
        first = F.first("_u").over(w.rowsBetween(-half, 0))
        last = F.last("_u").over(w.rowsBetween(0, half))
        cols = {"_enough": F.count("*").over(w.rowsBetween(-(window - 1), window - 1)) >= window}
        for k in range(1, half + 1):
            cols[f"_b{k}"] = F.coalesce(F.lag("_u", k).over(w), first)
            cols[f"_a{k}"] = F.coalesce(F.lead("_u", k).over(w), last)
        return cols

    near = bounded(present, ["clip"], "_k", window - 1, window - 1, layer, bits)
    terms = [(F.col("_u"), centre[half])]
    for k in range(1, half + 1):
        terms += [(F.col(f"_b{k}"), centre[half - k]), (F.col(f"_a{k}"), centre[half + k])]
    near = near.withColumn("_sum", _weighted_cells([(h, F.lit(w)) for h, w in terms]))
    cells = F.array(*[F.col("_sum")[i] * F.col("_scale") for i in range(9)])
    smooth = near.select("clip", "frame_idx", F.when(F.col("_enough"), cells).otherwise(F.col("_h")).alias(out))
    return frames.join(smooth, ["clip", "frame_idx"], "left")
