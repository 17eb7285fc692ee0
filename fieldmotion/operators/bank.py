"""Histories of field-marking identities (clip, kind, slot) and what they say about new
correspondences and homographies. Rows: clip, frame_idx, kind, slot, u, v, fx, fy, corr_id."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.functions.constants import KIND_Y
from fieldmotion.functions.field import kind_y, slot_x
from fieldmotion.functions.geometry import h_inverse, project
from fieldmotion.operators.identity_walk import IDENTITY, MAX_IDLE, judged_corrs
from fieldmotion.operators.reliable import spread

PAIRS = 1 << 21  # pairs of a clip's frames that are measured at once
NO_FRAME = -(1 << 62)


def states_before(history: DataFrame, max_idle: int = MAX_IDLE) -> DataFrame:
    """State each frame starts with: an identity seen at frame f holds until it is seen
    again or pruned, at most ``max_idle`` + 1 frames later."""
    end = F.least(F.coalesce("next_frame", F.col("frame_idx") + max_idle + 1), F.col("frame_idx") + max_idle + 1)
    return history.select(*IDENTITY, F.col("frame_idx").alias("last_seen"), "first_seen", "n_obs", "trusted", "last_u", "last_v",
                          F.explode(F.sequence(F.col("frame_idx") + 1, end)).alias("frame_idx"))


def cross_conflicts(corrs: DataFrame, states: DataFrame, radius: float = 20.0) -> DataFrame:
    """Correspondences closer than ``radius`` pixels to another trusted identity's last
    pixel. Both sides meet by clip, where the states lie already; a task holds one clip of
    them, and some million pairs of one frame."""
    others = states.where("trusted").select("clip", "frame_idx", "kind", "slot", F.col("last_u").cast("double").alias("u"), F.col("last_v").cast("double").alias("v"))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows or not a.column("clip")[0].is_valid:
            return a.slice(0, 0)
        a, b = a.combine_chunks(), b.combine_chunks()
        b = b.filter(b.column("frame_idx").is_valid()).sort_by("frame_idx")
        there, here = b.column("frame_idx").to_numpy(), np.flatnonzero(a.column("frame_idx").is_valid().to_numpy())
        frame = a.column("frame_idx").fill_null(0).to_numpy()[here]
        lo, hi = np.searchsorted(there, frame), np.searchsorted(there, frame, "right")
        place = lambda t: [t.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy() for c in ("u", "v")]
        (u, v), (ou, ov) = place(a), place(b)
        kinds = pa.chunked_array([*a.column("kind").chunks, *b.column("kind").chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        name = lambda t, kind: (kind, t.column("slot").fill_null(-1).to_numpy(), t.column("slot").is_valid().to_numpy())
        mine, other = name(a, kinds[:a.num_rows]), name(b, kinds[a.num_rows:])
        hit = np.zeros(a.num_rows, bool)
        ends = np.cumsum(hi - lo)
        for cut in np.split(np.arange(len(here)), np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            m = (hi - lo)[cut]
            i = np.repeat(here[cut], m)
            j = np.repeat(lo[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
            close = np.flatnonzero(np.hypot(u[i] - ou[j], v[i] - ov[j]) < radius)
            i, j = i[close], j[close]
            differ = ((mine[0][i] != other[0][j]) & (mine[0][i] >= 0) & (other[0][j] >= 0)) | ((mine[1][i] != other[1][j]) & mine[2][i] & other[2][j])
            hit[i[differ]] = True
        return a.filter(pa.array(hit))

    return spread(corrs, "clip").groupBy("clip").cogroup(others.groupBy("clip")).applyInArrow(near, corrs.schema)


def prefilter_corrs(corrs: DataFrame) -> DataFrame:
    """Verdict per correspondence: cross (another identity owns the pixel), self (jumped
    from its own), probationary (too young), or kept; judged by what earlier frames of the
    clip had accepted."""
    return judged_corrs(corrs).select(*IDENTITY, "frame_idx", "corr_id", "u", "v", "verdict")


def coast(states: DataFrame, corrs: DataFrame, frames: DataFrame, max_coast: int = 4) -> DataFrame:
    """Predicted pixel, by the previous frame's homography, of trusted identities not
    observed in a frame and seen at most ``max_coast`` frames ago."""
    seen = corrs.select(*IDENTITY, "frame_idx").distinct()
    idle = states.where(F.col("trusted") & (F.col("frame_idx") - F.col("last_seen") <= max_coast)).join(seen, [*IDENTITY, "frame_idx"], "left_anti")
    prev = frames.where(F.col("h").isNotNull()).select("clip", (F.col("frame_idx") + 1).alias("frame_idx"), h_inverse(F.col("h")).alias("_inverse"))
    held = idle.join(prev, ["clip", "frame_idx"]).withColumns({"fx": slot_x(F.col("slot")), "fy": kind_y(F.col("kind"))})
    u, v = project(F.col("_inverse"), F.col("fx"), F.col("fy"), "clamp")
    return held.select(*IDENTITY, "frame_idx", (F.col("frame_idx") - F.col("last_seen")).alias("coast_age"), "fx", "fy", u.alias("u"), v.alias("v"))


def validate_h(corrs: DataFrame, states: DataFrame, frames: DataFrame, tol: float = 1.0, bad_share: float = 0.34) -> DataFrame:
    """Check each frame's homography against trusted identities: current points of
    trusted identities, and the last pixels of those not observed now. A frame with a
    homography and nothing to check is valid with n_checked 0. The sides meet by clip, where
    the states lie already, and a clip's residuals are ranked in its task."""
    place = lambda u, v: (F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v"))
    trusted = states.where("trusted").select(*IDENTITY, "frame_idx", *place("last_u", "last_v"))
    held = frames.where(F.col("h").isNotNull()).select("clip", "frame_idx", "h")
    rows = held.unionByName(corrs.select(*IDENTITY, "frame_idx", *place("u", "v")), allowMissingColumns=True)
    keys = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in ("clip", "frame_idx"))
    schema = f"{keys}, n_checked bigint, n_via_corrs bigint, n_via_track bigint, n_bad bigint, median_residual double, mean_residual double"
    both = spread(rows, "clip").groupBy("clip").cogroup(trusted.groupBy("clip"))
    out = both.applyInArrow(lambda a, b: _checked(a, b, tol), schema)
    valid = (F.col("n_checked") == 0) | ((F.col("n_bad") / F.col("n_checked") <= bad_share) & (F.col("median_residual") <= tol))
    return out.withColumn("valid", valid)


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).cast(pa.float64()).fill_null(math.nan).to_numpy()


def _checked(rows: pa.Table, trusted: pa.Table, tol: float) -> pa.Table:
    """``validate_h`` of one clip: ``rows`` are its homographies (h) and its correspondences."""
    is_h = rows.column("h").is_valid()
    held, points = rows.filter(is_h), rows.filter(pc.invert(is_h))
    names = ["frame_idx", "kind", "slot", "u", "v"]
    known = [t.filter(reduce(pc.and_, [t.column(c).is_valid() for c in ("clip", "frame_idx", "kind", "slot")])).select(names) for t in (points, trusted)]
    t = pa.concat_tables(known, promote_options="permissive").combine_chunks()
    kind, frame, slot = t.column("kind").combine_chunks().dictionary_encode(), t.column("frame_idx").to_numpy(), t.column("slot").to_numpy()
    code = kind.indices.to_numpy().astype(np.int64)
    alike = np.unique(np.stack([frame, code, slot], axis=1).astype(np.int64), axis=0, return_inverse=True)[1].ravel()
    now, then = alike[:known[0].num_rows], alike[known[0].num_rows:]
    used = np.flatnonzero(np.concatenate([np.isin(now, then), ~np.isin(then, now)]))  # points of trusted ones, last pixels of the others
    used = used[np.argsort(frame[used], kind="stable")]
    via_corr = used < known[0].num_rows
    u, v, fx = (x[used] for x in (_numbers(t, "u"), _numbers(t, "v"), 10.0 + 5 * slot))
    fy = np.array([KIND_Y.get(k, math.nan) for k in kind.dictionary.to_pylist()])[code[used]]
    open_ = np.logical_not([t.column(c).is_valid().to_numpy()[used] for c in ("u", "v")]).any(axis=0) | np.isnan(fy)

    at = held.column("frame_idx").cast(pa.int64()).fill_null(NO_FRAME).to_numpy()
    frames, group = np.unique(at, return_inverse=True)
    cells = held.column("h").combine_chunks().flatten()
    h = cells.cast(pa.float64()).fill_null(math.nan).to_numpy().reshape(-1, 9)
    lost = ~cells.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 9).all(axis=1)
    lo, hi = np.searchsorted(frame[used], at), np.searchsorted(frame[used], at, "right")
    i = np.repeat(np.arange(len(at)), hi - lo)
    j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)
    x, y, w = (h[i, 3 * r] * u[j] + h[i, 3 * r + 1] * v[j] + h[i, 3 * r + 2] for r in range(3))
    with np.errstate(all="ignore"):
        w = np.where(np.abs(w) < 1e-10, 1e-10, w)
        r = np.hypot(x / w - fx[j], y / w - fy[j])
    g, unknown = group[i], open_[j] | lost[i]
    count = lambda which: np.bincount(g[which], minlength=len(frames))
    n, n_known = count(slice(None)), count(~unknown)
    # the median by rank: the two middle residuals of a frame, which may be the same one
    ranked = np.append(r[np.lexsort((r, unknown, g))], math.nan)
    first = np.cumsum(n) - n
    none = n_known == 0
    low, high = np.where(none, -1, first + (n_known - 1) // 2), np.where(none, -1, first + n_known // 2)
    mean = np.bincount(g[~unknown], r[~unknown], len(frames)) / np.maximum(n_known, 1)
    middle = np.where(low == high, ranked[low], (ranked[low] + ranked[high]) / 2)
    whole = lambda x: pa.array(x.astype(np.int64))
    return pa.table([pa.repeat(held.column("clip")[0], len(frames)) if len(frames) else held.column("clip"),
                     pa.array(frames, mask=frames == NO_FRAME).cast(rows.schema.field("frame_idx").type),
                     whole(n), whole(count(via_corr[j])), whole(count(~via_corr[j])), whole(count(~unknown & ~(r <= tol))), pa.array(middle, mask=none), pa.array(mean, mask=none)],
                    names=["clip", "frame_idx", "n_checked", "n_via_corrs", "n_via_track", "n_bad", "median_residual", "mean_residual"])


def bank_stats(states: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Identities, trusted ones and counts per kind at the start of each frame."""
    per_kind = [F.count_if(F.col("kind") == k).alias("n_" + k) for k in kinds]
    return states.groupBy("clip", "frame_idx").agg(F.count("*").alias("n_tracks"), F.count_if("trusted").alias("n_trusted"), *per_kind)
