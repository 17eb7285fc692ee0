"""Plane fits per frame: homography by seeded consensus, similarity by least median of squares."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.operators.rejects import degenerate
from fieldmotion.operators.reliable import spread

FRAME = ["clip", "frame_idx"]
REACH = 4.0  # field units within which a correspondence supports a fit
RESIDUALS = 1 << 16  # residuals of two-point draws that are held at once
FEW_POINTS, FIRST_DRAWS = 192, 2048  # points up to which all draws are measured, and those that give the first bound beyond
SLACK, WIDE, LARGE = 1e-5, 100.0, 1e6  # pixels no rounding of a residual reaches, for scales and coordinates up to these
SPREAD_FACTOR, LEAST_REACH = 2.5 * 1.4826, 1e-3  # inliers by the median residual, pixels at least
CHUNK, TOGETHER = 1 << 16, 256  # correspondences that are held, and frames that are fitted, at once
SURE, MOST_DRAWS = 0.995, 2000  # chance of a clean draw to reach, and the draws after which none is expected


def _normalise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of many frames (frames, points, 2) about their centres at a mean distance of
    sqrt(2), and the moves that take them there."""
    c = p.mean(axis=1, keepdims=True)
    s = math.sqrt(2) / np.maximum(np.linalg.norm(p - c, axis=2).mean(axis=1), 1e-12)
    t = np.zeros((len(p), 3, 3))
    t[:, 0, 0] = t[:, 1, 1] = s
    t[:, :2, 2], t[:, 2, 2] = -s[:, None] * c[:, 0], 1
    return (p - c) * s[:, None, None], t


def plane_fits(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least-squares homographies of frames with equally many points, four or more, scaled to
    h33 = 1; NaN where there is none."""
    a, ta = _normalise(src)
    b, tb = _normalise(dst)
    p, zero = np.concatenate([a, np.ones((*a.shape[:2], 1))], axis=2), np.zeros((*a.shape[:2], 3))
    rows = np.concatenate([np.concatenate([p, zero, -b[..., :1] * p], axis=2), np.concatenate([zero, p, -b[..., 1:] * p], axis=2)], axis=1)
    h = np.linalg.inv(tb) @ _last_direction(rows).reshape(-1, 3, 3) @ ta
    with np.errstate(all="ignore"):
        return np.where(np.abs(h[:, 2:, 2:]) > 1e-12, h / h[:, 2:, 2:], np.nan)


def _last_direction(systems: np.ndarray) -> np.ndarray:
    """The right singular vector of the least value of each matrix; NaN where the search for
    it fails, which fails a whole call."""
    try:
        return np.linalg.svd(systems, full_matrices=systems.shape[1] < 9)[2][:, -1]
    except np.linalg.LinAlgError:
        if len(systems) == 1:
            return np.full((1, 9), np.nan)
        return np.concatenate([_last_direction(x) for x in np.array_split(systems, 2)])


def mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    w = np.where(np.abs(q[:, 2:]) < 1e-10, 1e-10, q[:, 2:])
    return q[:, :2] / w


def _misses(h: np.ndarray, src: np.ndarray, dst: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Distances of the mapped points from their places, by frame, homography (..., 3, 3) of
    the frame and point; weights under ``least`` are raised to it."""
    cell, (x, y) = h[..., None, :, :], (src[:, None, :, i] for i in (0, 1))
    u, v, w = (cell[..., r, 0] * x + cell[..., r, 1] * y + cell[..., r, 2] for r in range(3))
    w = np.where(np.abs(w) < least, least, w)
    with np.errstate(all="ignore"):
        u, v = u / w - dst[:, None, :, 0], v / w - dst[:, None, :, 1]
        return np.sqrt(u * u + v * v)


def _solved(systems: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of many linear systems; NaN for singular ones, of which numpy lets one fail all."""
    try:
        return np.linalg.solve(systems, right[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(systems) == 1:
            return np.full(right.shape, np.nan)
        half = len(systems) // 2
        return np.concatenate([_solved(systems[:half], right[:half]), _solved(systems[half:], right[half:])])


def _four_point_fits(src: np.ndarray, dst: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Homographies (h33 = 1) through many four-point draws (frames, draws, 4) at once."""
    a, ta = _normalise(src)
    b, tb = _normalise(dst)
    frame = np.arange(len(src))[:, None, None]
    p, q = a[frame, draws], b[frame, draws]
    system = np.zeros((*draws.shape[:2], 8, 8))
    for rows, at, axis in ((slice(0, 4), 0, 0), (slice(4, 8), 3, 1)):
        system[:, :, rows, at:at + 2], system[:, :, rows, at + 2] = p, 1
        system[:, :, rows, 6:] = -q[..., axis:axis + 1] * p
    system += 1e-12 * np.eye(8)
    flat = _solved(system.reshape(-1, 8, 8), np.concatenate([q[..., 0], q[..., 1]], axis=2).reshape(-1, 8))
    h = np.concatenate([flat, np.ones((len(flat), 1))], axis=1).reshape(*draws.shape[:2], 3, 3)
    return np.linalg.inv(tb)[:, None] @ h @ ta[:, None]


@lru_cache(1 << 14)
def _drawn(seed: int, n: int, batch: int, at: int) -> np.ndarray:
    """The draws of four of n points that a seed gives from draw ``at`` on; frames of one
    number and size share them."""
    rng = np.random.default_rng(seed)
    rng.bit_generator.advance(at * n)
    return np.argsort(rng.random((batch, n)), axis=1)[:, :4].astype(np.int32)


def consensus_fits(src: np.ndarray, dst: np.ndarray, seeds: Sequence[int], reach: float = REACH, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Best-supported homographies over seeded four-point draws, refitted on their support, of
    frames with equally many points (frames, points, 2): (h, inlier mask), NaN and no inlier
    where there is none. A frame draws until the share of support found makes a clean draw all
    but sure."""
    frames, n = src.shape[:2]
    best, h = np.zeros((frames, n), bool), np.full((frames, 3, 3), np.nan)
    active, drawn = np.arange(frames), 0
    while len(active) and drawn < MOST_DRAWS:
        draws = np.stack([_drawn(int(seeds[i]), n, batch, drawn) for i in active])
        near = _misses(_four_point_fits(src[active], dst[active], draws), src[active], dst[active]) <= reach
        found = near[np.arange(len(active)), np.argmax(near.sum(axis=2), axis=1)]
        more = found.sum(axis=1) > best[active].sum(axis=1)
        best[active[more]] = found[more]
        drawn += batch
        clean = best[active].mean(axis=1) ** 4
        with np.errstate(divide="ignore"):
            wanted = np.where(clean == 0, math.inf, math.log(1 - SURE) / np.log1p(-clean))
        active = active[drawn < wanted]
    whole = plane_fits(src, dst)
    near = _misses(whole[:, None], src, dst, 1e-10)[:, 0] <= reach
    more = near.sum(axis=1) > best.sum(axis=1)
    best[more] = near[more]
    support = best.sum(axis=1)
    for m in np.unique(support[support >= 4]).tolist():
        at = np.flatnonzero(support == m)
        h[at] = whole[at] if m == n else plane_fits(src[at][best[at]].reshape(-1, m, 2), dst[at][best[at]].reshape(-1, m, 2))
    best[~np.isfinite(h).all(axis=(1, 2))] = False
    h[~best.any(axis=1)] = np.nan
    return h, best


def consensus_fit(src: np.ndarray, dst: np.ndarray, seed: int, reach: float = REACH, batch: int = 64):
    """``consensus_fits`` of one frame: (h, inlier mask) or (None, None)."""
    h, inlier = consensus_fits(src[None], dst[None], [seed], reach, batch)
    return (h[0], inlier[0]) if inlier.any() else (None, None)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Firsts of the runs of equal values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _clip_codes(t: pa.Table) -> np.ndarray:
    return t.column("clip").combine_chunks().dictionary_encode().indices.to_numpy()


def _whole_frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches put together to tables of whole frames, some ``CHUNK`` rows each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        cut = int(_changes(_clip_codes(t), t.column("frame_idx").to_numpy())[-1])  # the last frame may go on
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held)


def _fitted(t: pa.Table) -> pa.RecordBatch:
    """One row a frame of a table of whole frames, in order of corr_id: the fit and its errors.
    Rows of a frame that share a corr_id count once for each of them."""
    frame, code = t.column("frame_idx").to_numpy(), _clip_codes(t)
    starts = _changes(code, frame)
    sizes = np.diff(np.append(starts, len(frame)))
    src, dst = (np.stack([t.column(c).to_numpy() for c in pair], axis=1) for pair in (("u", "v"), ("fx", "fy")))
    same = _changes(code, frame, t.column("corr_id").combine_chunks().dictionary_encode().indices.to_numpy())
    alike = np.diff(np.append(same, len(frame)))  # rows of each corr_id
    h, n_inliers, rmse = np.full((len(starts), 9), np.nan), np.zeros(len(starts), np.int64), np.full(len(starts), np.nan)
    n_corrs = np.add.reduceat(alike * alike, np.searchsorted(same, starts))
    times = np.repeat(alike, alike)
    owner = np.repeat(np.arange(len(same)), alike)
    for n in np.unique(sizes).tolist():
        for at in np.array_split(np.flatnonzero(sizes == n), math.ceil((sizes == n).sum() / TOGETHER)):
            rows = starts[at][:, None] + np.arange(n)
            fit, inlier = consensus_fits(src[rows], dst[rows], frame[starts[at]])
            h[at], n_inliers[at] = fit.reshape(-1, 9), (inlier * times[rows]).sum(axis=1)
            good = inlier.astype(float)
            if (times[rows] > 1).any():
                _, which = np.unique(owner[rows], return_inverse=True)
                good = np.bincount(which.ravel(), inlier.ravel())[which.reshape(inlier.shape)]
            e = _misses(fit[:, None], src[rows], dst[rows], 1e-10)[:, 0]
            with np.errstate(all="ignore"):
                rmse[at] = np.sqrt(np.where(good > 0, good * e * e, 0.0).sum(axis=1) / good.sum(axis=1))
    none = n_inliers == 0
    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * 9, pa.int32()), pa.array(h.ravel()), mask=pa.array(none))
    first = t.select(FRAME).take(pa.array(starts)).combine_chunks()
    return pa.RecordBatch.from_arrays([*(first.column(c).combine_chunks() for c in FRAME), cells, pa.array(n_corrs.astype(np.int64)), pa.array(n_inliers), pa.array(rmse, mask=none)],
                                      names=[*FRAME, "h", "n_corrs", "n_inliers", "rmse"])


def fit_homography(corrs: DataFrame) -> DataFrame:
    """One row per frame: h, number of points and inliers, and their RMSE in yards.

    Degenerate frames and rows with a null place are removed before anything reaches Python;
    a frame has at most a few dozen correspondences. Frames arrive sorted as Arrow batches, and
    those with equally many points are fitted at once.
    """
    corrs = corrs.dropna(subset=["corr_id", "u", "v", "fx", "fy"])
    slim = corrs.select("clip", F.col("frame_idx").cast("int").alias("frame_idx"), F.col("corr_id").cast("string").alias("corr_id"),
                        *[F.col(c).cast("double").alias(c) for c in ("u", "v", "fx", "fy")])
    placed = spread(slim, *FRAME)  # both sides of the join meet where they are
    usable = placed.join(degenerate(placed).where(~F.col("degenerate")).select(*FRAME), FRAME, "left_semi")
    ordered = usable.sortWithinPartitions(*FRAME, "corr_id", "u", "v", "fx", "fy")
    return ordered.mapInArrow(lambda batches: map(_fitted, _whole_frames(batches)),
                              f"clip {slim.schema['clip'].dataType.simpleString()}, frame_idx int, h array<double>, n_corrs bigint, n_inliers bigint, rmse double")


def _two_point_moves(p: np.ndarray, q: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, b, tx, ty) of the similarities through many two-point draws; NaN where points coincide."""
    d, e = p[draws[:, 1]] - p[draws[:, 0]], q[draws[:, 1]] - q[draws[:, 0]]
    size = (d * d).sum(axis=1)
    size = np.where(size > 0, size, np.nan)
    a, b = (d * e).sum(axis=1) / size, (d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) / size
    p0, q0 = p[draws[:, 0]], q[draws[:, 0]]
    return a, b, q0[:, 0] - a * p0[:, 0] + b * p0[:, 1], q0[:, 1] - b * p0[:, 0] - a * p0[:, 1]


def _least_median(p: np.ndarray, q: np.ndarray, first: np.ndarray, second: np.ndarray, bound: float = math.inf) -> tuple[float, np.ndarray | None]:
    """The least median of squared residuals over the draws, the first of equals to nine
    places, and its residuals. Medians are taken of draws with half of their residuals
    within the least median so far, or within ``bound``, which one draw is known to reach."""
    n = len(p)
    step, least, lowest, errors = max(1, RESIDUALS // n), math.inf, math.inf, None
    for at in range(0, len(first), step):  # all draws, so many at a time
        draws = np.stack([first[at:at + step], second[at:at + step]], axis=1)
        a, b, tx, ty = (x[:, None] for x in _two_point_moves(p, q, draws))
        r = (a * p[:, 0] - b * p[:, 1] + tx - q[:, 0]) ** 2 + (b * p[:, 0] + a * p[:, 1] + ty - q[:, 1]) ** 2
        limit = _loose(min(bound, least))
        if limit < math.inf:
            r = r[np.count_nonzero(r <= limit, axis=1) >= (n + 1) // 2]
        middle = np.median(r, axis=1) if len(r) else np.zeros(0)
        rounded = np.round(middle, 9)
        if np.isnan(rounded).all():
            continue
        best = int(np.nanargmin(rounded))
        if rounded[best] < lowest:
            least, lowest, errors = float(middle[best]), rounded[best], r[best]
    return least, errors


def _loose(bound: float) -> float:
    """A bound that values equal to it to nine places keep."""
    return bound + 1e-8 + 1e-9 * bound


def _may_win(p: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Which two-point draws may have a median of at most ``bound``, in the order of
    triu_indices; no other draw has one.

    With the first point fixed, a draw is a turn and scale (a, b), and another point's
    residual is its distance from that point's own (a, b), times the distance of the two
    points. So each point allows a disk, and a draw needs to lie in half of all disks. That
    is counted by their shadows on four axes, sorted, not draw by draw and point by point."""
    n = len(p)
    need, reach, out = (n + 1) // 2, math.sqrt(_loose(bound)) + SLACK, []
    for i in range(n - 1):
        d, e = p - p[i], q - q[i]
        size = (d * d).sum(axis=1)
        apart = size > 0
        d, e, size = d[apart], e[apart], size[apart]
        a, b = (d * e).sum(axis=1) / size, (d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0]) / size
        radius = reach / np.sqrt(size)
        mine = np.flatnonzero(np.flatnonzero(apart) > i)
        # points that coincide with the first are taken to allow every draw
        left = mine
        for x, wide in ((a, 1.0), (b, 1.0), (a + b, math.sqrt(2)), (a - b, math.sqrt(2))):
            lo, hi = np.sort(x - wide * radius), np.sort(x + wide * radius)
            inside = np.searchsorted(lo, x[left], side="right") - np.searchsorted(hi, x[left], side="left") + n - len(size)
            left = left[inside >= need]
        wild = mine[np.maximum(np.abs(a[mine]), np.abs(b[mine])) > WIDE]
        won = np.zeros(n, bool)
        won[np.flatnonzero(apart)[np.concatenate([left, wild])]] = True
        out.append(won[i + 1:])
    return np.concatenate(out)


def robust_similarity(p: np.ndarray, q: np.ndarray) -> tuple[float, float, float, float, np.ndarray] | None:
    """(a, b, tx, ty, inliers) of u = a x - b y + tx, v = b x + a y + ty by least median of
    squares over all two-point draws, refitted by least squares on its inliers; None without
    two different points."""
    n = len(p)
    if n < 2:
        return None
    first, second = np.triu_indices(n, 1)
    bound = math.inf
    if n > FEW_POINTS and np.abs(p).max() < LARGE and np.abs(q).max() < LARGE:
        some = np.unique(np.linspace(0, len(first) - 1, FIRST_DRAWS).astype(int))
        bound, _ = _least_median(p, q, first[some], second[some])
        if bound < math.inf:
            may = _may_win(p, q, bound)
            first, second = first[may], second[may]
    least, errors = _least_median(p, q, first, second, bound)
    if errors is None:
        return None
    reach = max(SPREAD_FACTOR * (1 + 5 / max(n - 2, 1)) * math.sqrt(least), LEAST_REACH)
    near = errors <= reach * reach
    x, y = p[near] - p[near].mean(axis=0), q[near] - q[near].mean(axis=0)
    size = (x * x).sum()
    if size <= 0:
        return None
    fa, fb = float((x * y).sum() / size), float((x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum() / size)
    mp, mq = p[near].mean(axis=0), q[near].mean(axis=0)
    return fa, fb, float(mq[0] - fa * mp[0] + fb * mp[1]), float(mq[1] - fb * mp[0] - fa * mp[1]), near


def fit_similarity(pairs: DataFrame, keys: list[str], max_scale: float = 1.8, max_rot: float = 3.0, max_shift: float = 400.0) -> DataFrame:
    """Scale, rotation and shift from (pu, pv) to (u, v) of each key's points, with the
    accept gates; up to half of the points may be wrong. Points are taken in order of their
    pixels, so the fit does not depend on how rows arrive. Null pixels are left out; keys
    without two different points give no row."""
    slim = pairs.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("pu", "pv", "u", "v")]).dropna(subset=["pu", "pv", "u", "v"])
    sorted_rows = spread(slim, *keys).sortWithinPartitions(*keys, "pu", "pv", "u", "v")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[: len(keys)]]

    def fits(t: pa.Table) -> pa.RecordBatch:
        names = [t.column(k).to_pylist() for k in keys]
        at = [i for i in range(t.num_rows) if i == 0 or any(k[i] != k[i - 1] for k in names)]
        pts = np.stack([t.column(c).to_numpy() for c in ("pu", "pv", "u", "v")], axis=1)
        rows, out = [], []
        for s, e in zip(at, [*at[1:], t.num_rows], strict=True):
            fit = robust_similarity(pts[s:e, :2], pts[s:e, 2:])
            if fit is not None:
                rows.append(s)
                out.append((e - s, int(fit[4].sum()), *fit[:4]))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays(
            [*(t.column(k).combine_chunks().take(pa.array(rows, pa.int64())) for k in keys), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 4, strict=True))],
            names=[*keys, "n", "n_inliers", "a", "b", "tx", "ty"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last, cut = [t.column(k)[-1] for k in keys], t.num_rows - 1
            while cut and all(t.column(k)[cut - 1] == x for k, x in zip(keys, last, strict=True)):
                cut -= 1
            if cut:
                yield fits(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield fits(rest)

    c = F.col
    m = sorted_rows.mapInArrow(run, ", ".join([*fields, "n long, n_inliers long, a double, b double, tx double, ty double"]))
    m = m.withColumns({"scale": F.hypot("a", "b"), "rot_deg": F.degrees(F.atan2("b", "a"))})
    ok = (c("scale") <= max_scale) & (c("scale") >= 1 / max_scale) & (F.abs("rot_deg") <= max_rot) & (F.hypot("tx", "ty") <= max_shift)
    return m.withColumn("accepted", ok)
