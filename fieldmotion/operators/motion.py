"""Running signatures and constant-velocity filtering along associated tracks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.operators.ordered import PIECE_BITS, numbered, with_totals
from fieldmotion.operators.reliable import spread

TRACK = ["clip", "track_id"]


def ema(rows: DataFrame, sig: str, usable: Column, alpha: float = 0.999, keys: list[str] = TRACK,
        pos: str = "frame_idx", bits: int = PIECE_BITS) -> DataFrame:
    """Exponential mean of the usable signatures of each track, seeded with the first.

    With m usable rows, row i weighs (1-alpha) alpha^(m-1-i), the first alpha^(m-1): an
    ordinary weighted sum, so nothing is folded in order.
    """
    good = numbered(rows.where(usable & F.col(sig).isNotNull()).select(*keys, pos, sig), keys, pos, "_k", bits)
    good = with_totals(good, keys, pos, {"_m": F.lit(1)}, bits)
    age = (F.col("_m") - 1 - F.col("_k")).cast("double")
    w = F.pow(F.lit(alpha), age) * F.when(F.col("_k") == 0, 1.0).otherwise(1.0 - alpha)
    cells = good.select(*keys, w.alias("_w"), F.posexplode(sig).alias("_i", "_x"))
    sums = cells.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_a"))
    return packed.select(*keys, F.transform("_a", lambda p: p["_s"]).alias("ema"))


# Acceleration noise, measurement noise, first velocity variance, frame rate.
PROCESS, MEASURE, VELOCITY_VAR, FPS = 8.0, 0.5, 25.0, 30.0


def _model():
    dt = 1.0 / FPS
    f = np.array([[1.0, dt], [0.0, 1.0]])
    g = np.array([[dt * dt / 2], [dt]])
    return f, g @ g.T * PROCESS**2, MEASURE**2


def _step_map(measured: bool, z: np.ndarray):
    """One frame as a map on (mean, covariance): A, b, C, eta, J (both axes share all
    but b and eta, which have one column per axis)."""
    f, q, r = _model()
    if not measured:
        return f, np.zeros((2, 2)), q, np.zeros((2, 2)), np.zeros((2, 2))
    s = q[0, 0] + r
    k = q[:, :1] / s
    cut = np.eye(2) - k @ np.array([[1.0, 0.0]])
    fh = f.T[:, :1]
    return cut @ f, k @ z[None, :], cut @ q, fh @ z[None, :] / s, fh @ fh.T / s


def _compose(a, b):
    """Map a followed by map b (temporal parallel filtering, after Sarkka and
    Garcia-Fernandez, 2021)."""
    a1, b1, c1, e1, j1 = a
    a2, b2, c2, e2, j2 = b
    m = np.linalg.inv(np.eye(2) + c1 @ j2)
    n = np.linalg.inv(np.eye(2) + j2 @ c1)
    return (a2 @ m @ a1, a2 @ m @ (b1 + c1 @ e2) + b2, a2 @ m @ c1 @ a2.T + c2,
            a1.T @ n @ (e2 - j2 @ b1) + e1, a1.T @ n @ j2 @ a1 + j1)


def _apply(element, mean, cov):
    a, b, c, e, j = element
    m = np.linalg.inv(np.eye(2) + cov @ j)
    return a @ m @ (mean + cov @ e) + b, a @ m @ cov @ a.T + c


_STATE = "mean array<double>, cov array<double>"


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """All frames of one piece of a track as a single map (24 numbers)."""
    pdf = pdf.sort_values("frame_idx")
    total = None
    for ok, x, y in zip(pdf["ok"], pdf["x"], pdf["y"]):
        step = _step_map(bool(ok), np.array([x, y], dtype=float) if ok else None)
        total = step if total is None else _compose(total, step)
    out = pdf.iloc[:1][["clip", "track_id", "piece"]].copy()
    out["element"] = [np.concatenate([m.ravel() for m in total]).tolist()]
    return out


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """State at the start of every piece of one track: one row per piece comes in."""
    pdf = pdf.sort_values("piece")
    mean = np.array([[pdf["x0"].iloc[0], pdf["y0"].iloc[0]], [0.0, 0.0]])
    cov = np.diag([MEASURE**2, VELOCITY_VAR])
    rows = []
    for piece, flat in zip(pdf["piece"], pdf["element"]):
        rows.append((piece, mean.ravel().tolist(), cov.ravel().tolist()))
        parts = np.asarray(flat).reshape(5, 2, 2)
        mean, cov = _apply(tuple(parts), mean, cov)
    out = pd.DataFrame(rows, columns=["piece", "mean", "cov"])
    out.insert(0, "track_id", pdf["track_id"].iloc[0])
    out.insert(0, "clip", pdf["clip"].iloc[0])
    return out


def _filter_pieces(t: pa.Table) -> pa.RecordBatch:
    """Predict every frame and correct the measured ones of whole pieces, side by side: frame
    after frame of all pieces, from each piece's start state (NULL when the track has one
    piece and starts at its birth)."""
    t = t.combine_chunks()
    dt, (q11, q12, _, q22), r = 1.0 / FPS, _model()[1].ravel(), MEASURE**2
    begin = _piece_starts(t)
    length = np.diff(np.append(begin, t.num_rows))
    longest = np.argsort(-length, kind="stable")
    begin, length = begin[longest], length[longest]
    frame, born, ok, x, y = (t.column(c).to_numpy() for c in ("frame_idx", "born", "ok", "x", "y"))
    state = np.stack([x[begin], y[begin], *np.zeros((2, len(begin))), np.full(len(begin), r), np.zeros(len(begin)), np.full(len(begin), VELOCITY_VAR)]).astype(float)
    for i, (mean, cov) in enumerate(zip(t.column("mean").take(pa.array(begin)).to_pylist(), t.column("cov").take(pa.array(begin)).to_pylist(), strict=True)):
        if mean is not None:
            state[:, i] = *mean, cov[0], cov[1], cov[3]
    out = np.empty((5, t.num_rows))
    for j in range(int(length[0])):
        live = int(np.searchsorted(-length, -j))  # pieces longer than j, which come first
        at, (px, py, vx, vy, p11, p12, p22) = begin[:live] + j, state[:, :live]
        later = frame[at] > born[at]
        hit = later & ok[at]
        nx, ny = px + dt * vx, py + dt * vy
        n11, n12, n22 = p11 + dt * (2 * p12 + dt * p22) + q11, p12 + dt * p22 + q12, p22 + q22
        g1, g2 = n11 / (n11 + r), n12 / (n11 + r)
        ex, ey = x[at] - nx, y[at] - ny
        guess = np.stack([nx, ny, vx, vy, n11, n12, n22])
        fixed = np.stack([nx + g1 * ex, ny + g1 * ey, vx + g2 * ex, vy + g2 * ey, n11 * (1 - g1), n12 * (1 - g1), n22 - g2 * n12])
        state[:, :live] = np.where(hit, fixed, np.where(later, guess, state[:, :live]))
        out[:, at] = state[:5, :live]
    return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in (*TRACK, "frame_idx")), *map(pa.array, out)], names=[*TRACK, "frame_idx", "fx", "fy", "vx", "vy", "var"])


def _piece_starts(t: pa.Table) -> np.ndarray:
    """First rows of the pieces of a table in their order."""
    new = np.ones(t.num_rows, bool)
    codes = [t.column("clip").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("track_id").to_numpy(), t.column("piece").to_numpy()]
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
    return np.flatnonzero(new)


def _filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        cut = int(_piece_starts(t)[-1])  # the last piece may go on in the next batch
        if cut:
            yield _filter_pieces(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None:
        yield _filter_pieces(rest)


def kalman_track(points: DataFrame, x: str = "x", y: str = "y", measured: str = "measured", bits: int = 10) -> DataFrame:
    """Constant-velocity filter along each track from its first measured frame.

    The axes share one gain. A long track is cut in pieces: every piece is condensed to
    one map on the state, the maps are chained (one row per piece), and the pieces are
    then filtered side by side from their exact start states.
    """
    ok = F.col(measured) & F.col(x).isNotNull()
    rows = points.select(*TRACK, "frame_idx", F.col(x).alias("x"), F.col(y).alias("y"), F.coalesce(ok, F.lit(False)).alias("ok"))
    first = rows.where("ok").groupBy(*TRACK).agg(F.min("frame_idx").alias("born"), F.min_by(F.struct("x", "y"), "frame_idx").alias("_z"))
    last = rows.groupBy(*TRACK).agg(F.max("frame_idx").alias("_last"))
    first = first.join(last, TRACK)
    # (track, piece) is in the join key so that a long track is not one task
    cut = rows.withColumn("piece", F.shiftright("frame_idx", bits))
    births = first.select(*TRACK, "born", "_z.x", "_z.y", F.explode(F.sequence(F.shiftright("born", bits), F.shiftright("_last", bits))).alias("piece"),
                          (F.shiftright("_last", bits) > F.shiftright("born", bits)).alias("long"))
    births = births.withColumnsRenamed({"x": "x0", "y": "y0"})
    live = cut.join(births, [*TRACK, "piece"]).where(F.col("frame_idx") >= F.col("born"))
    # births are the prior, so the first frame itself is not a step
    steps = live.where(F.col("long") & (F.col("frame_idx") > F.col("born")))
    maps = steps.select(*TRACK, "piece", "frame_idx", "ok", "x", "y").groupBy(*TRACK, "piece").applyInPandas(
        _summarise, "clip string, track_id bigint, piece int, element array<double>")
    unit = F.array(*[F.lit(v) for v in np.concatenate([np.eye(2).ravel(), np.zeros(16)]).tolist()])
    chained = births.where("long").join(maps, [*TRACK, "piece"], "left").withColumn("element", F.coalesce("element", unit)).select(*TRACK, "piece", "x0", "y0", "element")
    starts = chained.groupBy(*TRACK).applyInPandas(_chain, f"clip string, track_id bigint, piece int, {_STATE}")
    by = [*TRACK, "piece"]
    inputs = live.select(*by, F.col("frame_idx").cast("int").alias("frame_idx"), "ok", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "born").join(starts, by, "left")
    inputs = inputs.withColumn("track_id", F.col("track_id").cast("long"))
    return spread(inputs, *by).sortWithinPartitions(*by, "frame_idx").mapInArrow(
        _filtered, "clip string, track_id bigint, frame_idx int, fx double, fy double, vx double, vy double, var double")
