"""Samples and splits. Random order is the md5 of a seed and the row key, so a sample
is repeatable on any cluster size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.operators.ranking import first_fraction, top_per_group


def shuffle_key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def top_residuals(df: DataFrame, value: str, k: int, keys: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """The k largest values, per key or overall."""
    order = [F.col(value).desc(), *[F.col(t) for t in (tie or [])]]
    known = df.where(F.col(value).isNotNull())
    return top_per_group(known, keys, order, k) if keys else known.orderBy(*order).limit(k)


def stratified_sample(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """At most n rows of every stratum."""
    hashed = df.withColumn("_h", shuffle_key(seed, F.col(key)))
    return top_per_group(hashed, ["stratum"], [F.col("_h"), F.col(key)], n).drop("_h", "rank")


def shortfall(df: DataFrame, n: int) -> DataFrame:
    """Strata with fewer than n candidates."""
    return df.groupBy("stratum").agg(F.count("*").alias("n_candidates")).where(F.col("n_candidates") < n)


def clip_diverse_sample(df: DataFrame, n: int, key: str = "id", seed: int = 42) -> DataFrame:
    """Up to n rows per stratum taken round-robin: one per clip, then a second, and so on."""
    hashed = df.withColumn("_h", shuffle_key(seed, F.col(key)))
    rounds = top_per_group(hashed, ["stratum", "clip"], [F.col("_h"), F.col(key)], n, "round")
    order = [F.col("round"), shuffle_key(seed, F.col("clip")), F.col("clip")]
    return top_per_group(rounds, ["stratum"], order, n).drop("_h", "rank")


def random_pairs(frames: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct (clip, frame): clips equally likely, then frames within the clip.

    Drawing pairs with chance 1/(frames of the clip) without repeats is the same as
    keeping the n smallest -ln(u) * frames, u from the row's hash.
    """
    sizes = frames.groupBy("clip").agg(F.count("*").alias("_m"))
    u = (F.conv(F.substring(shuffle_key(seed, F.col("clip"), F.col("frame_idx")), 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    weighed = frames.join(sizes, "clip").withColumn("_k", -F.log(u) * F.col("_m"))
    return weighed.orderBy("_k", "clip", "frame_idx").limit(n).drop("_k", "_m")


def split_by_game(df: DataFrame, val_games: list[str] | None = None, share: float = 0.1) -> DataFrame:
    """Mark rows as val or train, a game always whole: named games, else the smallest
    game holding at least ``share`` of the rows (else the largest)."""
    if val_games is not None:
        return df.withColumn("split", F.when(F.col("game").isin(val_games), "val").otherwise("train"))
    sizes = df.groupBy("game").agg(F.count("*").alias("_c"))
    total = sizes.agg(F.floor(F.sum("_c") * share).alias("_need"), F.max(F.struct("_c", "game")).alias("_big"))
    fit = sizes.join(F.broadcast(total)).agg(
        F.min(F.when(F.col("_c") >= F.col("_need"), F.struct("_c", "game"))).alias("_fit"), F.first("_big").alias("_big"))
    chosen = fit.select(F.coalesce("_fit.game", "_big.game").alias("_val"))
    # a single row is broadcast
    return df.join(F.broadcast(chosen)).withColumn("split", F.when(F.col("game") == F.col("_val"), "val").otherwise("train")).drop("_val")


def split_fraction(df: DataFrame, share: float = 0.15, key: str = "id", seed: int = 42) -> DataFrame:
    """Mark round(n * share) rows as val, by hash order over the whole table."""
    hashed = df.withColumn("_h", shuffle_key(seed, F.col(key)))
    out = first_fraction(hashed, F.substring("_h", 1, 4), [F.col("_h"), F.col(key)], F.rint(F.col("n_rows") * share))
    return out.withColumn("split", F.when(F.col("selected"), "val").otherwise("train")).drop("_h", "selected")


def spaced_picks(candidates: Column, n: Column, spacing: int) -> Column:
    """Greedy: keep a position at least ``spacing`` after the last kept one, up to n."""
    def take(kept, p):
        far = (F.size(kept) == 0) | (p - F.element_at(kept, -1) >= spacing)
        return F.when(far & (F.size(kept) < n), F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(F.sort_array(candidates), F.array().cast("array<int>"), take)


def min_spacing(frames: DataFrame, n: int | DataFrame, spacing: int = 60, seed: int = 42) -> DataFrame:
    """Frames of each clip at least ``spacing`` apart, picked from 5n hashed candidates;
    evenly spaced where the clip is too short. One row per clip with array ``picks``.
    ``n`` is one number or a table (clip, n), at least 1.

    Only 5n frames of a clip are gathered, the number the rule itself draws.
    """
    most = n.agg(F.max("n")).first()[0] or 0 if isinstance(n, DataFrame) else n
    sized = frames.groupBy("clip").agg((F.max("frame_idx") + 1).alias("total"))
    sized = sized.join(n, "clip") if isinstance(n, DataFrame) else sized.withColumn("n", F.lit(n))
    hashed = frames.where(F.col("frame_idx") >= 0).withColumn("_h", shuffle_key(seed, F.col("clip"), F.col("frame_idx")))
    drawn = top_per_group(hashed.select("clip", "frame_idx", "_h"), ["clip"], [F.col("_h"), F.col("frame_idx")], 5 * most)
    own = drawn.join(sized, "clip").where(F.col("rank") <= 5 * F.col("n"))
    both = own.groupBy("clip", "n", "total").agg(F.collect_list("frame_idx").alias("_d"))
    step = F.greatest(F.floor(F.col("total") / (F.col("n") + 1)), F.lit(1)).cast("int")
    even = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (i * step).cast("int"))
    short = F.when(F.col("n") >= F.col("total"), F.sequence(F.lit(0), F.col("total") - 1)).otherwise(even)
    picks = F.when(F.col("n") * spacing > F.col("total"), short).otherwise(spaced_picks(F.col("_d"), F.col("n"), spacing))
    return both.select("clip", "n", "total", picks.alias("picks"))


def clips_then_frames(frames: DataFrame, n_clips: int, frames_per_game: int, spacing: int = 60, seed: int = 42) -> DataFrame:
    """Per game up to ``n_clips`` clips by hash, and spaced frames in each of them."""
    clips = frames.select("game", "clip").distinct().withColumn("_h", shuffle_key(seed, F.col("clip")))
    chosen = top_per_group(clips, ["game"], [F.col("_h"), F.col("clip")], n_clips).drop("_h", "rank")
    share = F.floor(F.lit(frames_per_game) / F.count("*").over(Window.partitionBy("game")))
    each = chosen.select("game", "clip", F.greatest(share, F.lit(1)).cast("int").alias("want"))
    named = lambda df: df.withColumn("clip", F.concat_ws("/", "game", "clip"))
    held = named(frames.join(each.select("game", "clip"), ["game", "clip"], "left_semi"))
    picks = min_spacing(held.select("clip", "frame_idx"), named(each).select("clip", F.col("want").alias("n")), spacing, seed)
    return named(each).join(picks.select("clip", "picks"), "clip").select("game", "clip", F.explode("picks").alias("frame_idx"))


def every_kth_frame(frames: DataFrame, k: int = 30, inlier_min: float = 0.95) -> DataFrame:
    """One frame per second at 30 fps, with a full solution and enough inliers."""
    return frames.where((F.col("frame_idx") % k == 0) & (F.col("method") == "full") & (F.col("inlier_frac") >= inlier_min))
