"""Aligning tracks with sensor truth and scoring them; homography and QC reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldmotion.functions.boxes import foot_point
from fieldmotion.functions.geometry import project
from fieldmotion.functions.quality import readiness
from fieldmotion.operators.ordered import numbered
from fieldmotion.operators.ranking import exact_percentiles
from fieldmotion.operators.reliable import spread, stage
from fieldmotion.operators.runs import speed_and_accel

STRIDE = 3  # our frames per truth frame
OUR_FPS = 30.0
BLOCK_BITS = 10  # truth frames of a clip that are compared in one task, as a power of two

METRICS = ["pos_rmse_yd", "pos_p50_yd", "pos_p90_yd", "speed_rmse_yds", "speed_corr",
           "accel_rmse_yds2", "accel_corr"]


def event_frame(truth: DataFrame, event: str = "ball_snap", keys=("clip",)) -> DataFrame:
    """First frame that carries an event, per key."""
    return truth.where(F.col("event") == event).groupBy(*keys).agg(F.min("frame").alias("snap_frame"))


def require_event(truth: DataFrame, event: str = "ball_snap", keys=("clip",)) -> DataFrame:
    """Like ``event_frame`` but fails when a key lacks the event."""
    has = truth.groupBy(*keys).agg(F.min(F.when(F.col("event") == event, F.col("frame"))).alias("snap_frame"))
    missing = F.raise_error(F.lit(f"no {event} event"))
    return has.withColumn("snap_frame", F.coalesce("snap_frame", missing.cast("int")))


def player_meta(truth: DataFrame, columns: list[str], keys=("clip", "player_id")) -> DataFrame:
    """Attributes of each player from the earliest row."""
    first = F.min_by(F.struct(*columns), F.col("frame")).alias("m")
    return truth.groupBy(*keys).agg(first).select(*keys, *[F.col(f"m.{c}").alias(c) for c in columns])


def project_boxes(boxes: DataFrame, frames: DataFrame, cutoffs: DataFrame | None = None, h: str = "h") -> DataFrame:
    """Foot points of boxes in yards; frames at or past the cut-off, or without a
    homography, drop out."""
    held = frames.where(F.col(h).isNotNull()).select("clip", "frame_idx", F.col(h).alias("_h"))
    joined = boxes.join(held, ["clip", "frame_idx"])
    if cutoffs is not None:
        joined = joined.join(cutoffs.select("clip", "cutoff"), "clip").where(F.col("frame_idx") < F.col("cutoff")).drop("cutoff")
    u, v = foot_point(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    placed = joined.withColumns({"_u": u, "_v": v})
    x, y = project(F.col("_h"), F.col("_u"), F.col("_v"))
    return placed.withColumns({"x_yd": x, "y_yd": y}).drop("_h", "_u", "_v")


def with_intrinsics(clips: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera per clip, identity and zero distortion where none is known."""
    eye = F.array(*[F.array(*[F.lit(float(r == c)) for c in range(3)]) for r in range(3)])
    none = F.array(*[F.lit(0.0)] * 5)
    out = clips.join(cameras.withColumn("has_camera", F.lit(True)), "clip", "left")
    return out.withColumns({"K": F.coalesce("K", eye), "dist": F.coalesce("dist", none),
                            "has_camera": F.coalesce("has_camera", F.lit(False))})


def aligned(ours: DataFrame, truth: DataFrame, snaps: DataFrame, offset: Column) -> DataFrame:
    """Our frames that fall on a truth frame, with that frame's number.

    ``snaps`` has one row per clip; ``offset`` is our frame of the snap.
    """
    delta = F.col("frame_idx") - offset
    return (ours.join(snaps, "clip").where(F.pmod(delta, F.lit(STRIDE)) == 0)
            .withColumn("frame", (F.col("snap_frame") + F.floor(delta / STRIDE)).cast("int")).drop("snap_frame"))


def rate_align(ours: DataFrame, truth: DataFrame, snaps: DataFrame, offset: int) -> DataFrame:
    """Join our 30 fps positions with the 10 Hz truth of the same clip."""
    theirs = truth.select("clip", "frame", "player_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("s").alias("ts"))
    return aligned(ours, truth, snaps, F.lit(offset)).join(theirs, ["clip", "frame"])


def _distance():
    return F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))


def pair_costs(ours: DataFrame, truth: DataFrame, snaps: DataFrame, offset: int) -> DataFrame:
    """Mean distance and overlap of every (track, player) pair of a clip.

    ``ours`` has clip, track_id, frame_idx, x, y. The pairs of one frame are the cost
    matrix itself; the join key is (clip, frame).
    """
    slim = ours.select("clip", "track_id", "frame_idx", "x", "y")
    return (rate_align(slim, truth, snaps, offset).groupBy("clip", "track_id", "player_id")
            .agg(F.avg(_distance()).alias("cost"), F.count("*").alias("n_overlap")))


def _block_sums(ours: pa.Table, theirs: pa.Table, offsets: Sequence[int], cells: int = 2_000_000) -> pa.Table:
    """Sums and counts of distances per (offset, track, player) within one block of truth
    frames; at most about ``cells`` pairs of rows are held at once."""
    theirs = theirs.sort_by("frame")
    track, player = (t.column(c).combine_chunks().dictionary_encode() for t, c in ((ours, "track_id"), (theirs, "player_id")))
    place = lambda t, c: np.nan_to_num(t.column(c).to_numpy(), nan=0.0) if t.column(c).null_count else t.column(c).to_numpy()
    known = lambda t, *cs: np.logical_and.reduce([t.column(c).is_valid().to_numpy() for c in cs])
    x, y, tx, ty = place(ours, "x"), place(ours, "y"), place(theirs, "tx"), place(theirs, "ty")
    mine, other = known(ours, "x", "y"), known(theirs, "tx", "ty")
    t, p, frames = track.indices.to_numpy(), player.indices.to_numpy(), theirs.column("frame").to_numpy().astype(np.int64)
    at, snap = ours.column("frame_idx").to_numpy().astype(np.int64), ours.column("snap_frame").to_numpy().astype(np.int64)
    wide, parts = len(player.dictionary), []
    size = len(track.dictionary) * wide
    for offset in offsets:
        rows = np.flatnonzero((at - offset) % STRIDE == 0)
        frame = snap[rows] + (at[rows] - offset) // STRIDE
        lo, hi = np.searchsorted(frames, frame), np.searchsorted(frames, frame, "right")
        ends = np.cumsum(hi - lo)
        n, k, total = np.zeros(size), np.zeros(size), np.zeros(size)
        for cut in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(ends // cells)) + 1):
            m = (hi - lo)[cut]
            if not m.sum():
                continue
            i = np.repeat(rows[cut], m)
            j = np.repeat(lo[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pair, ok = t[i].astype(np.int64) * wide + p[j], mine[i] & other[j]
            n += np.bincount(pair, minlength=size)
            k += np.bincount(pair, ok, minlength=size)
            total += np.bincount(pair, np.where(ok, np.sqrt((x[i] - tx[j]) ** 2 + (y[i] - ty[j]) ** 2), 0.0), minlength=size)
        hit = np.flatnonzero(n)
        parts.append((np.full(len(hit), offset, np.int32), hit // wide, hit % wide, total[hit], k[hit].astype(np.int64), n[hit].astype(np.int64)))
    offset, ti, pi, total, k, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    clip = pa.repeat(ours.column("clip")[0], len(ti))
    return pa.table([clip, offset, track.dictionary.take(pa.array(ti)), player.dictionary.take(pa.array(pi)), total, k, n], names=["clip", "offset", "track_id", "player_id", "_s", "_k", "n_overlap"])


def offset_costs(ours: DataFrame, truth: DataFrame, snaps: DataFrame, center: int, radius: int) -> DataFrame:
    """``pair_costs`` for every candidate offset center-radius, +3, ..., center+radius.

    Rows meet per (clip, block of truth frames), an own row in the blocks its offsets reach,
    one or two. A block is summed per offset and pair inside its task, so that neither the
    rows of an offset nor their pairs are shuffled.
    """
    offsets = list(range(center - radius, center + radius + 1, STRIDE))
    block = lambda offset: F.shiftright(F.col("snap_frame") + F.floor((F.col("frame_idx") - offset) / STRIDE), BLOCK_BITS)
    number = lambda *names: [F.col(c).cast("double").alias(c) for c in names]
    mine = ours.join(snaps, "clip").where(F.col("snap_frame").isNotNull() & F.col("frame_idx").isNotNull()).select("clip", "track_id", "frame_idx", *number("x", "y"), "snap_frame")
    mine = mine.withColumn("_b", F.explode(F.sequence(block(offsets[-1]), block(offsets[0]))))
    theirs = truth.where(F.col("frame").isNotNull()).select(
        F.col("clip").alias("_c"), F.col("frame").alias("frame"), F.col("player_id").alias("player_id"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"),
        F.shiftright(F.col("frame").cast("long"), BLOCK_BITS).alias("_d"))  # both sides may come from one table
    names = {"clip": mine, "track_id": mine, "player_id": theirs}
    clip, track, player = (f"`{c}` {d.schema[c].dataType.simpleString()}" for c, d in names.items())
    schema = f"{clip}, `offset` int, {track}, {player}, _s double, _k bigint, n_overlap bigint"
    empty = to_arrow_schema(T.StructType.fromDDL(schema)).empty_table()

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block_sums(a, b, offsets).cast(empty.schema) if a.num_rows and b.num_rows else empty

    both = spread(mine, "clip", "_b").groupBy("clip", "_b").cogroup(spread(theirs, "_c", "_d").groupBy("_c", "_d")).applyInArrow(sums, schema)
    return both.groupBy("clip", "offset", "track_id", "player_id").agg(F.try_divide(F.sum("_s"), F.sum("_k")).alias("cost"), F.sum("n_overlap").alias("n_overlap"))


def linear_interp_join(ours: DataFrame, truth: DataFrame, snaps: DataFrame, offset: int) -> DataFrame:
    """Truth position at each of our frames for the matched player: linear between the
    bracketing truth frames, held where the upper is missing, NULL without a lower."""
    at = F.col("snap_frame") + (F.col("frame_idx") - offset) / float(STRIDE)
    placed = ours.join(snaps, "clip").withColumn("_at", at).withColumn("_lo", F.floor("_at").cast("int")).drop("snap_frame")
    side = lambda n, shift: truth.select("clip", "player_id", (F.col("frame") - shift).cast("int").alias("_lo"),
                                         F.col("x").alias(f"_x{n}"), F.col("y").alias(f"_y{n}"))
    both = placed.join(side("a", 0), ["clip", "player_id", "_lo"], "left").join(side("b", 1), ["clip", "player_id", "_lo"], "left")
    share = F.col("_at") - F.col("_lo")
    mix = lambda c: F.coalesce(F.col(f"_{c}a") * (1 - share) + F.col(f"_{c}b") * share, F.col(f"_{c}a"))
    return both.withColumns({"truth_x": mix("x"), "truth_y": mix("y")}).drop("_at", "_lo", "_xa", "_ya", "_xb", "_yb")


def score_pairs(ours: DataFrame, truth: DataFrame, snaps: DataFrame, pairs: DataFrame, offset: Column) -> DataFrame:
    """Position, speed and acceleration errors of matched pairs (clip, track_id,
    player_id); pairs with under five shared samples are left out.

    ``offset`` may be a literal or a column of ``pairs``.
    """
    mine = ours.select("clip", "track_id", "frame_idx", "x", "y").join(pairs, ["clip", "track_id"])
    mine = aligned(mine, truth, snaps, offset).withColumn("t", (F.col("frame_idx") - offset) / OUR_FPS)
    theirs = truth.select("clip", "frame", "player_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("s").alias("ts"))
    both = mine.join(theirs, ["clip", "frame", "player_id"])
    keys = ["clip", "track_id", "player_id"]
    rows = numbered(both, keys, "frame_idx", "k")
    moves = speed_and_accel(rows, "t", "x", "y", keys, "k", {"ta": "ts"})
    e, se, ae = _distance(), F.col("speed") - F.col("ts"), F.col("accel") - F.col("ta")

    def rmse(c):
        return F.sqrt(F.avg(c * c))

    def corr(a, b):
        sa, sb = F.stddev_pop(a), F.stddev_pop(b)
        return F.when((sa > 1e-6) & (sb > 1e-6), F.try_divide(F.covar_pop(a, b), sa * sb))

    return moves.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), rmse(e).alias("pos_rmse_yd"), F.avg(e).alias("pos_mean_yd"),
        F.percentile(e, F.lit(0.5)).alias("pos_p50_yd"), F.percentile(e, F.lit(0.9)).alias("pos_p90_yd"),
        rmse(se).alias("speed_rmse_yds"), corr("speed", "ts").alias("speed_corr"),
        F.avg("speed").alias("speed_mean_us_yds"), F.avg("ts").alias("speed_mean_ngs_yds"),
        rmse(ae).alias("accel_rmse_yds2"), corr("accel", "ta").alias("accel_corr"),
    ).where(F.col("n_obs") >= 5)


def summarise_scores(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median and mean of the seven headline metrics."""
    keys = keys or []
    scores = stage(scores)  # one row per pair, read three times below
    long = scores.unpivot(keys, METRICS, "metric", "value")
    med = exact_percentiles(long, [*keys, "metric"], F.col("value"), {"median": 0.5})
    mean = long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"))
    return med.join(mean, [*keys, "metric"])


def residual_percentiles(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """n, median, p90, p95, p99 and max of the known values."""
    keys = keys or []
    probs = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    out = exact_percentiles(df, keys, F.col(value), probs)
    top = df.groupBy(*keys).agg(F.max(value).alias("max"))
    return out.join(top, keys) if keys else out.join(F.broadcast(top))  # one row each without keys


def filter_confusion(frames: DataFrame) -> DataFrame:
    """Agreement of two red flags per clip and overall (clip NULL), with recall of the old."""
    old, new = F.col("old_red"), F.col("new_red")
    out = frames.rollup("clip").agg(
        F.count_if(old & new).alias("both"), F.count_if(old & ~new).alias("old_only"),
        F.count_if(new & ~old).alias("new_only"), F.count_if(~old & ~new).alias("neither"))
    n_old = F.col("both") + F.col("old_only")
    return out.withColumn("recall", F.when(n_old > 0, F.col("both") / n_old))


def qc_summary(decisions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of y/n/s, acceptance among judged, and a readiness tier."""
    d = F.col("decision")
    out = decisions.groupBy(*(keys or [])).agg(
        F.count_if(d == "y").alias("n_yes"), F.count_if(d == "n").alias("n_no"), F.count_if(d == "s").alias("n_skip"))
    rate = F.col("n_yes") / F.greatest(F.col("n_yes") + F.col("n_no"), F.lit(1))
    return out.withColumn("accept_rate", rate).withColumn("readiness", readiness(F.col("accept_rate")))


def flag_sets(frames: DataFrame, key: list[str]) -> DataFrame:
    """Frames caught by both flags, only the old and only the new, as set operations."""
    old, new = frames.where("old_red").select(*key), frames.where("new_red").select(*key)
    tag = lambda df, name: df.withColumn("caught", F.lit(name))
    return (tag(old.intersect(new), "both").unionByName(tag(old.exceptAll(new), "old_only"))
            .unionByName(tag(new.exceptAll(old), "new_only")))
