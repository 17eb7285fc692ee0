"""Composed pipelines over many clips at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.functions.clips import trimmed
from fieldmotion.functions.field import stratum
from fieldmotion.functions.quality import choose_source, red_flags
from fieldmotion.operators import labels as L
from fieldmotion.operators import rejects as X
from fieldmotion.operators import runs as R
from fieldmotion.operators import sampling as P
from fieldmotion.operators import scoring as S
from fieldmotion.operators import smoothing as M
from fieldmotion.operators.assign import best_offset, sweep
from fieldmotion.operators.reliable import stage
from fieldmotion.operators.teams import label_teams
from fieldmotion.streaming.clips import derive_labels

FRAME = ["clip", "frame_idx"]


def clean_frames(frames: DataFrame, bad_len: int = 5) -> DataFrame:
    """Frames before the loss of each clip with red ones refitted, homographies smoothed
    and long red stretches marked: h_smooth, red, in_bad_run, cutoff."""
    cut = R.carry_cutoff(frames).select("clip", "cutoff")
    held = frames.join(cut, "clip").where(F.col("frame_idx") < F.col("cutoff"))
    clean = stage(M.fill_bad(held))
    smooth = M.smooth_h(clean).select(*FRAME, "h_smooth")
    return R.bad_runs(clean, F.col("red"), bad_len).join(smooth, FRAME)


def build_tracks(tracked: DataFrame, frames: DataFrame, teams: DataFrame | None = None, share: float = 0.5,
                 pixels: DataFrame | None = None, method: str = "pca") -> DataFrame:
    """Tracked boxes and raw homographies to smoothed field positions.

    ``tracked`` has clip, frame_idx, track_id and the box, and may have ``interrupted``.
    Tracks measured in too few frames are left out; interrupted points are positions but
    no measurements. Track counts include frames past the cut-off, the threshold does not.
    Teams are given (clip, track_id, team), or found for the tracks that stay by one of
    the team methods from colour ``pixels`` (clip, track_id, h, s, v), or unknown.
    """
    clean = stage(clean_frames(frames))
    cut = clean.groupBy("clip").agg(F.first("cutoff").alias("cutoff"))
    real = ~F.coalesce(F.col("interrupted"), F.lit(False)) if "interrupted" in tracked.columns else F.lit(True)
    counts = tracked.groupBy("clip", "track_id").agg(F.count_if(real).alias("_n")).join(cut, "clip")
    long_ = counts.where(F.col("_n") >= F.greatest(F.floor(F.col("cutoff") * share), F.lit(1))).select("clip", "track_id")
    mine = tracked.join(long_, ["clip", "track_id"], "left_semi")
    placed = stage(S.project_boxes(mine, clean, h="h_smooth").select(*FRAME, "track_id", "x_yd", "y_yd"))
    if teams is None and pixels is not None:
        points = placed.join(mine.select(*FRAME, "track_id", real.alias("measured")), [*FRAME, "track_id"]).withColumnRenamed("x_yd", "x")
        teams = label_teams(points, pixels.join(long_, ["clip", "track_id"], "left_semi"), method)
    smooth = M.smooth_track(placed, "x_yd", "y_yd", out=("sx", "sy"))
    flags = clean.select(*FRAME, "in_bad_run")
    out = smooth.join(flags, FRAME).where(F.col("sx").isNotNull() & F.col("sy").isNotNull())
    labelled = out.join(teams.select("clip", "track_id", "team"), ["clip", "track_id"], "left") if teams is not None else out.withColumn("team", F.lit(None).cast("string"))
    return labelled.select(*FRAME, "track_id", F.col("sx").alias("x_yd"), F.col("sy").alias("y_yd"),
                           F.coalesce("team", F.lit("unknown")).alias("team"), "in_bad_run")


def score_against_truth(ours: DataFrame, truth: DataFrame, center: int = 120, radius: int = 60) -> tuple[DataFrame, DataFrame]:
    """(scores per matched pair, chosen offset per clip): the offset is swept, tracks and
    players are assigned for each, and the least total cost wins."""
    snaps = S.event_frame(truth)
    costs = stage(S.offset_costs(ours, truth, snaps, center, radius))
    matched = stage(sweep(costs))
    _, best = best_offset(matched)
    best = stage(best)
    pairs = matched.join(best.select("clip", "offset"), ["clip", "offset"])
    scores = S.score_pairs(ours, truth, snaps, pairs.select("clip", "track_id", "player_id", F.col("offset").alias("_offset")), F.col("_offset"))
    overlap = costs.join(best.select("clip", "offset"), ["clip", "offset"]).select(
        "clip", "track_id", "player_id", F.col("cost").alias("match_cost_yd"), F.col("n_overlap").alias("n_overlap_frames"))
    return scores.join(overlap, ["clip", "track_id", "player_id"]), best


def trusted_frames(new: DataFrame, classical: DataFrame) -> DataFrame:
    """Per frame the homography to derive labels from, and where it came from.

    Both inputs have clip, frame_idx, h, rmse, inlier_frac, n_corrs, n_yard_fits. The
    second is only consulted for clips with a red frame in the first.
    """
    def flagged(df):
        d = M.temporal_divergence(df)
        return d.withColumn("flags", red_flags(*[F.col(c) for c in ("rmse", "inlier_frac", "n_corrs", "n_yard_fits", "temp_div")]))

    a = stage(flagged(new).select(*FRAME, "h", "flags"))
    red_clips = a.where(F.col("h").isNull() | (F.size("flags") > 0)).select("clip").distinct()
    b = flagged(classical.join(red_clips, "clip", "left_semi")).select(*FRAME, F.col("h").alias("_h"), F.col("flags").alias("_flags"))
    both = a.join(b, FRAME, "left")
    return both.select(*FRAME, *[c.alias(n) for n, c in choose_source(F.col("h"), F.col("flags"), F.col("_h"), F.col("_flags")).items()]).where(F.col("h_source").isNotNull())


def derive_training_labels(new: DataFrame, classical: DataFrame, tokens: DataFrame) -> DataFrame:
    """Token labels under the trusted homography of each frame, with the source."""
    used = trusted_frames(new, classical)
    return derive_labels(tokens.join(used, FRAME), "h_used")


def build_pool(entries: DataFrame, games: DataFrame, clips: DataFrame, edges: list[float], per_stratum: int,
               inlier_min: float = 0.95, diverse: bool = False, key: str = "id") -> DataFrame:
    """Sampled training pool: held-out games and clips removed, weak frames dropped, the
    rest sampled per stratum of mean x."""
    open_ = X.exclude_holdouts(entries, games, clips).where(F.col("inlier_frac") >= inlier_min)
    ranked = open_.withColumn("stratum", stratum(F.col("mean_ngs_x"), edges)).where(F.col("stratum") >= 0)
    return P.clip_diverse_sample(ranked, per_stratum, key) if diverse else P.stratified_sample(ranked, per_stratum, key)


def segment_plays(views: DataFrame) -> DataFrame:
    """Plays with trimmed cut points from per-second view labels."""
    plays = R.group_plays(R.label_segments(R.majority_smooth(R.carry_label(views))))
    side = trimmed(F.col("sideline_start"), F.col("sideline_end"))
    end = trimmed(F.col("endzone_start"), F.col("endzone_end"))
    return plays.withColumns({"sideline_" + k: v for k, v in side.items()} | {
        "endzone_" + k: F.when(F.col("endzone_end") > 0, v) for k, v in end.items()})


def h_filter_flags(frames: DataFrame, rmse_limit: float = 0.30, temporal_limit: float = 1.0, loo_limit: float = 0.20) -> DataFrame:
    """Old (RMSE or temporal jump) and new (leave-one-out) red flags before each cut-off."""
    cut = R.carry_cutoff(frames).select("clip", "cutoff")
    jumped = M.temporal_divergence(frames).join(cut, "clip").where(F.col("frame_idx") < F.col("cutoff"))
    scored = M.loo_residual(stage(jumped))
    gone = F.col("h").isNull()
    known = lambda c: F.coalesce(c, F.lit(False))
    return scored.withColumns({
        "old_red": gone | known(F.col("rmse") > rmse_limit) | known(F.col("temp_div") > temporal_limit),
        "new_red": gone | known(F.col("loo") > loo_limit)})


def compare_h_filters(frames: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Confusion per clip and overall, residual percentiles, disagreement lists."""
    flags = stage(h_filter_flags(frames))
    extra = flags.where(F.col("new_red") & ~F.col("old_red"))
    return {"confusion": S.filter_confusion(flags), "residuals": S.residual_percentiles(flags, "loo"),
            "sets": S.flag_sets(flags, FRAME), "top_new": P.top_residuals(extra, "loo", k, tie=FRAME)}
