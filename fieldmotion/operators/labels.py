"""Label accuracy, class balance and dataset reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.operators.ranking import exact_percentiles


def label_accuracy(labels: DataFrame) -> DataFrame:
    """Correct and total per token type, for classes and rows; targets under 0 are skipped."""
    cls, row = F.col("true_class") >= 0, F.col("true_row") >= 0
    out = labels.groupBy("type").agg(
        F.count_if(cls & (F.col("pred_class") == F.col("true_class"))).alias("class_ok"), F.count_if(cls).alias("class_n"),
        F.count_if(row & (F.col("pred_row") == F.col("true_row"))).alias("row_ok"), F.count_if(row).alias("row_n"))
    one = F.lit(1)
    return out.withColumns({"class_acc": F.col("class_ok") / F.greatest("class_n", one),
                            "row_acc": F.col("row_ok") / F.greatest("row_n", one)})


def per_class_accuracy(labels: DataFrame) -> DataFrame:
    out = labels.where(F.col("true_class") >= 0).groupBy("true_class").agg(
        F.count_if(F.col("pred_class") == F.col("true_class")).alias("n_ok"), F.count("*").alias("n"))
    return out.withColumn("accuracy", F.col("n_ok") / F.col("n"))


def channel_f1(pixels: DataFrame, predicted: Column, actual: Column, channel: str = "ch") -> DataFrame:
    """F1 per mask channel, and their mean on every row."""
    counts = pixels.groupBy(channel).agg(
        F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-9)
    scored = counts.withColumn("f1", f1)
    return scored.withColumn("mean_f1", F.avg("f1").over(Window.partitionBy()))  # one row per channel


def class_weights(labels: DataFrame, n_classes: int, label: str = "true_class") -> DataFrame:
    """Inverse frequency per class (counts floored at 1), scaled to a mean of 1."""
    counts = labels.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    spine = labels.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class"))
    every = spine.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = 1.0 / F.greatest("n", F.lit(1))
    return every.withColumn("weight", w * n_classes / F.sum(w).over(Window.partitionBy()))  # n_classes rows


def drop_rates(pixels: DataFrame, kept: Column, frame: list[str], channel: str = "ch") -> DataFrame:
    """Share of mask pixels lost per frame and channel, then its mean and median."""
    per_frame = pixels.groupBy(*frame, channel).agg(F.count("*").alias("raw"), F.count_if(kept).alias("clean"))
    rate = per_frame.select(channel, ((F.col("raw") - F.col("clean")) / F.greatest("raw", F.lit(1))).alias("rate"))
    mean = rate.groupBy(channel).agg(F.avg("rate").alias("mean_drop"))
    return exact_percentiles(rate, [channel], F.col("rate"), {"median_drop": 0.5}).join(mean, channel)


def n_corrections(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels whose known classes disagree with the model, per frame."""
    t, p = F.col("true_class"), F.col("pred_class")
    return labels.groupBy(*keys).agg(F.count_if((t >= 0) & (p >= 0) & (t != p)).alias("n_corrections"))


def class_side_counts(matches: DataFrame) -> DataFrame:
    """Counts per class, per side and overall with the match distance; the median is
    given overall. ``matches`` has label, side, distance and skip_reason (NULL when kept)."""
    kept = matches.where(F.col("skip_reason").isNull())
    sets = kept.groupingSets([["label"], ["side"], []], "label", "side").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    med = exact_percentiles(kept, [], F.col("distance"), {"median_distance": 0.5}).drop("n")
    whole = F.col("level") == 3
    return sets.join(F.broadcast(med)).withColumn("median_distance", F.when(whole, F.col("median_distance"))).drop("level")


def skip_counts(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("n"))


def frame_pool_stats(corrs: DataFrame, inlier: Column) -> DataFrame:
    """Per frame: correspondences, inlier share, mean x and x range."""
    return corrs.groupBy("clip", "frame_idx").agg(
        F.count("*").alias("n_corrs"), (F.count_if(inlier) / F.count("*")).alias("inlier_frac"),
        F.avg("fx").alias("mean_ngs_x"), (F.max("fx") - F.min("fx")).alias("ngs_x_range"))


def sample_report(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Candidates, clips, picks and picks per clip, by stratum."""
    a = candidates.groupBy("stratum").agg(F.count("*").alias("n_candidates"), F.count_distinct("clip").alias("clips_available"))
    b = picks.groupBy("stratum").agg(F.count("*").alias("n_picks"), F.count_distinct("clip").alias("clips_picked"))
    return a.join(b, "stratum", "left").fillna(0).withColumn(
        "per_clip", F.col("n_picks") / F.greatest("clips_picked", F.lit(1)))


def sidecar_join(labels: DataFrame, logits: DataFrame) -> DataFrame:
    """Frames with their logits; where the token counts differ the frame is blanked.

    ``labels`` has n_tokens, ``logits`` has arrays token_idx and crop_logits.
    """
    same = F.col("n_tokens") == F.size("token_idx")
    joined = labels.join(logits, ["clip", "frame_idx"])
    return joined.withColumns({"token_idx": F.when(same, F.col("token_idx")), "crop_logits": F.when(same, F.col("crop_logits")), "matched": same})
