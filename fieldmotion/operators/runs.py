"""Runs, cut-offs, labels and samples along a sequence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.operators.ordered import (
    PIECE_BITS, bounded, bounded_twice, numbered, run_bounds, running, with_totals,
)
from fieldmotion.operators.reliable import stage

TRACK = ("clip", "track_id")


def segments(df: DataFrame, valid: Column, keys: Sequence[str] = TRACK, pos: str = "frame_idx",
             bits: int = PIECE_BITS) -> DataFrame:
    """One row per run of consecutive valid positions: keys, start, end (exclusive)."""
    runs = run_bounds(df, keys, pos, valid, "start", "end", bits=bits)
    return runs.where(F.col(pos) == F.col("start")).select(*keys, "start", "end")


def bad_runs(frames: DataFrame, red: Column, min_len: int = 5, bits: int = PIECE_BITS) -> DataFrame:
    """Add run_start, run_end and in_bad_run (a red run of at least ``min_len`` frames)."""
    runs = run_bounds(frames, ["clip"], "frame_idx", red, "run_start", "run_end", bits=bits)
    return runs.withColumn(
        "in_bad_run", F.coalesce(F.col("run_end") - F.col("run_start") >= min_len, F.lit(False)))


def carry_cutoff(frames: DataFrame, streak: int = 3, bits: int = PIECE_BITS) -> DataFrame:
    """Per clip the start of the first run of ``streak`` carried frames, else its length.

    The first frame followed by streak-1 more carried frames is that start.
    """
    def look(w):
        held = [F.col("method") == "carry"]
        for k in range(1, streak):
            held.append((F.lead("method", k).over(w) == "carry")
                        & (F.lead("frame_idx", k).over(w) == F.col("frame_idx") + k))
        all_held = held[0]
        for h in held[1:]:
            all_held = all_held & h
        return {"_lost": F.coalesce(all_held, F.lit(False))}

    slim = frames.select("clip", "frame_idx", "method")
    marked = bounded(slim, ["clip"], "frame_idx", 0, streak - 1, look, bits)
    return marked.groupBy("clip").agg(
        F.coalesce(F.min(F.when(F.col("_lost"), F.col("frame_idx"))), F.max("frame_idx") + 1).cast("int").alias("cutoff"),
        F.count("*").alias("n_frames"))


def downsample(df: DataFrame, step: int, fps: float = 30.0, keys: Sequence[str] = TRACK,
               pos: str = "frame_idx", bits: int = PIECE_BITS) -> DataFrame:
    """Every ``step``-th row of a track (not frame number), with its time in seconds."""
    rows = numbered(df, keys, pos, "_row", bits)
    return rows.where(F.col("_row") % step == 0).drop("_row").withColumn("time", F.col(pos) / fps)


def spaced_samples(df: DataFrame, n: int, keys: Sequence[str] = TRACK, pos: str = "frame_idx",
                   bits: int = PIECE_BITS) -> DataFrame:
    """``n`` evenly spaced rows of every track that has at least ``n``.

    Sample i sits at floor(i * (m-1) / (n-1)); a row knows from its own position
    whether it is one, so nothing is joined.
    """
    rows = with_totals(numbered(df, keys, pos, "_at", bits), keys, pos, {"_m": F.lit(1)}, bits)
    at, m = F.col("_at").cast("long"), F.col("_m")
    span = F.greatest(m - 1, F.lit(1))
    i = F.ceil(at * (n - 1) / span).cast("long")
    hit = (i <= n - 1) & (F.floor(i * (m - 1) / F.lit(n - 1)).cast("long") == at)
    return rows.where((m >= n) & hit).withColumn("sample", i.cast("int")).drop("_at", "_m")


def carry_label(df: DataFrame, keys: Sequence[str] = ("clip",), pos: str = "sec",
                confident: float = 0.7, bits: int = PIECE_BITS) -> DataFrame:
    """Labels below the confidence inherit the previous one; the first row keeps its own."""
    first = bounded(df, keys, pos, 1, 0, lambda w: {"_first": F.lag(pos).over(w).isNull()}, bits)
    known = F.when((F.col("conf") >= confident) | F.col("_first"), F.col("label"))
    return running(first, keys, pos, {"gated": ("last", known)}, bits=bits).drop("_first")


def majority_smooth(df: DataFrame, label: str = "gated", keys: Sequence[str] = ("clip",),
                    pos: str = "sec", bits: int = PIECE_BITS) -> DataFrame:
    """Most frequent label of the row and its neighbours, the earliest on a tie."""
    def vote(w):
        prev, nxt, cur = F.lag(label).over(w), F.lead(label).over(w), F.col(label)
        return {"smooth": F.when(prev.isNull() | (cur == nxt), cur).otherwise(prev)}

    return bounded(df, keys, pos, 1, 1, vote, bits)


def label_segments(df: DataFrame, label: str = "smooth", keys: Sequence[str] = ("clip",),
                   pos: str = "sec", min_len: float = 3.0, bits: int = PIECE_BITS) -> DataFrame:
    """Runs of one label as (start_s, end_s, view); a run ends where the next starts, the
    last one second after the last row. Runs shorter than ``min_len`` are dropped."""
    def change(w):
        prev, nxt = F.lag(label).over(w), F.lead(label).over(w)
        return {"_start": prev.isNull() | (prev != F.col(label)),
                "_next": F.when(nxt != F.col(label), F.lead(pos).over(w))}

    marked = bounded(df, keys, pos, 1, 1, change, bits)
    ends = running(marked, keys, pos, backward={"_end": ("min", F.col("_next")), "_last": ("max", F.col(pos))}, bits=bits)
    out = ends.where("_start").select(
        *keys, F.col(pos).cast("double").alias("start_s"),
        F.coalesce(F.col("_end"), F.col("_last") + 1).cast("double").alias("end_s"),
        F.col(label).alias("view"), F.col(pos).cast("int").alias("start_pos"))
    # few rows per clip from here on, read several times by ``group_plays``
    return stage(out.where(F.col("end_s") - F.col("start_s") >= min_len))


def group_plays(segs: DataFrame, keys: Sequence[str] = ("clip",), bits: int = PIECE_BITS) -> DataFrame:
    """Plays: a sideline run directly followed by an end-zone run, scoreboards aside; a
    last lone sideline counts with end-zone times 0."""
    field = numbered(segs.where(F.col("view") != "scoreboard"), keys, "start_pos", "_k", bits)

    def pair(w):
        nxt = F.lead("view").over(w)
        return {"_next": nxt, "_ez_start": F.lead("start_s").over(w), "_ez_end": F.lead("end_s").over(w)}

    seen = bounded(field, keys, "_k", 0, 1, pair, bits)
    plays = seen.where((F.col("view") == "sideline") & (F.col("_next").isNull() | (F.col("_next") == "endzone")))
    out = numbered(plays, keys, "_k", "_n", bits)
    return out.select(*keys, (F.col("_n") + 1).cast("int").alias("play_num"),
                      F.col("start_s").alias("sideline_start"), F.col("end_s").alias("sideline_end"),
                      F.coalesce("_ez_start", F.lit(0.0)).alias("endzone_start"),
                      F.coalesce("_ez_end", F.lit(0.0)).alias("endzone_end"))


def lifecycle(points: DataFrame, measured: Column, max_lost: int = 8, max_age: int = 90,
              keys: Sequence[str] = TRACK, pos: str = "frame_idx", bits: int = PIECE_BITS) -> DataFrame:
    """State of a track at each row from the frames since its last measurement."""
    seen = running(points, keys, pos, {"last_measured": ("last", F.when(measured, F.col(pos)))}, bits=bits)
    idle = F.col(pos) - F.col("last_measured")
    return seen.withColumn("idle", idle).withColumn(
        "state", F.when(idle == 0, "live").when(idle <= max_lost, "lost")
        .when(idle <= max_age, "graveyard").when(idle.isNotNull(), "dropped"))


def extrapolate(x: Column, vx: Column, n: Column, dt: float = 1 / 30) -> Column:
    """Where a constant-velocity state will be after ``n`` more frames."""
    return x + F.greatest(n, F.lit(0)) * dt * vx


def gradient(df: DataFrame, time: str, values: dict[str, str], keys: Sequence[str],
             pos: str, bits: int = PIECE_BITS) -> DataFrame:
    """Second-order derivative on uneven times, one-sided at the ends.

    ``values`` maps output names to input columns; ``pos`` must be dense.
    """
    return bounded(df, keys, pos, 1, 1, lambda w: {o: _slope(i, time, w) for o, i in values.items()}, bits)


def _slope(value: str, time: str, w) -> Column:
    y, t = F.col(value), F.col(time)
    yp, yn = F.lag(value).over(w), F.lead(value).over(w)
    hs, hd = t - F.lag(time).over(w), F.lead(time).over(w) - t
    inner = (hs * hs * yn + (hd * hd - hs * hs) * y - hd * hd * yp) / (hs * hd * (hd + hs))
    return F.when(hs.isNull(), (yn - y) / hd).when(hd.isNull(), (y - yp) / hs).otherwise(inner)


def speed_and_accel(df: DataFrame, time: str, x: str, y: str, keys: Sequence[str], pos: str,
                    extra: dict[str, str] | None = None, bits: int = PIECE_BITS) -> DataFrame:
    """Speed from positions and acceleration from speed; ``extra`` maps further outputs
    to columns whose slope is wanted. ``pos`` must be dense."""
    def first(w):
        return {"_vx": _slope(x, time, w), "_vy": _slope(y, time, w),
                **{o: _slope(i, time, w) for o, i in (extra or {}).items()}}

    def second(_):
        return {"speed": F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy"))}

    def third(w):
        return {"accel": _slope("speed", time, w)}

    return bounded_twice(df, keys, pos, 2, 2, first, second, third, bits=bits).drop("_vx", "_vy")


def derivatives(df: DataFrame, fps: float, x: str = "x", y: str = "y", keys: Sequence[str] = TRACK,
                pos: str = "frame_idx", bits: int = PIECE_BITS) -> DataFrame:
    """Velocity, speed and acceleration at a fixed rate where x is known: central, else
    forward, else backward. A point without neighbours has NULL velocity and speed 0.

    ``pos`` numbers the samples; neighbours are the adjacent samples.
    """
    dt = 1.0 / fps

    def diff(col):
        def at(w):
            prev = F.when(F.lag(pos).over(w) == F.col(pos) - 1, F.lag(col).over(w))
            nxt = F.when(F.lead(pos).over(w) == F.col(pos) + 1, F.lead(col).over(w))
            return F.when(F.col(col).isNotNull(), F.coalesce(
                (nxt - prev) / (2 * dt), (nxt - F.col(col)) / dt, (F.col(col) - prev) / dt))
        return at

    def magnitude(a, b):
        sq = F.coalesce(F.col(a) * F.col(a), F.lit(0.0)) + F.coalesce(F.col(b) * F.col(b), F.lit(0.0))
        return F.when(F.col(x).isNotNull(), F.sqrt(sq))

    return bounded_twice(
        df, keys, pos, 2, 2,
        lambda w: {"vx": diff(x)(w), "vy": diff(y)(w)},
        lambda w: {"ax": diff("vx")(w), "ay": diff("vy")(w)},
        lambda w: {"speed": magnitude("vx", "vy"), "accel": magnitude("ax", "ay")},
        bits=bits)
