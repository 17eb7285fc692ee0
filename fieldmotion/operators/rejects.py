"""Filters that drop rows by rule, membership or distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.functions.boxes import expanded_iou

FRAME = ["clip", "frame_idx"]
WIDE = 8  # cell of near pairs, in radii


def confidence_gate(boxes: DataFrame, gate: float = 0.3, drop: bool = True) -> DataFrame:
    """Drop boxes under the gate (detector), or only mark them interrupted (tracker)."""
    if drop:
        return boxes.where(F.col("confidence") >= gate)
    return boxes.withColumn("interrupted", F.col("confidence") < gate)


def exclude_holdouts(df: DataFrame, games: DataFrame, clips: DataFrame) -> DataFrame:
    """Drop held-out games (game) and clips (clip). Sides are small by nature; Spark
    broadcasts them when their size allows."""
    return df.join(games.select("game"), "game", "left_anti").join(clips.select("clip"), "clip", "left_anti")


def drop_blacklisted(df: DataFrame, blacklist: DataFrame, key: str = "frame_key") -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row count of dropped ones)."""
    bad = blacklist.select(key).distinct()
    dropped = df.join(bad, key, "left_semi").agg(F.count("*").alias("n_dropped"))
    return df.join(bad, key, "left_anti"), dropped


def filter_decisions(df: DataFrame, decisions: DataFrame, y_only: bool = False, n_only: bool = False,
                     exclude_decided: bool = False, key: str = "id") -> DataFrame:
    if y_only and (n_only or exclude_decided):
        raise ValueError("y_only cannot be combined with n_only or exclude_decided")
    if y_only or n_only:
        want = decisions.where(F.col("decision") == ("y" if y_only else "n")).select(key)
        return df.join(want, key, "left_semi")
    if exclude_decided:
        return df.join(decisions.select(key), key, "left_anti")
    return df


def require(df: DataFrame, present: DataFrame, key: str | list[str]) -> DataFrame:
    """Keep rows whose sidecar or thumbnail exists."""
    keys = [key] if isinstance(key, str) else key
    return df.join(present.select(*keys), keys, "left_semi")


def long_tracks(points: DataFrame, measured: Column, share: float = 0.5, n_valid: Column | None = None) -> DataFrame:
    """Tracks measured in at least max(1, floor(ref * share)) frames; ref is ``n_valid``
    or the largest count of the clip. One row per track with its count."""
    counts = points.groupBy("clip", "track_id").agg(F.count_if(measured).alias("n_measured"))
    ref = F.max("n_measured").over(Window.partitionBy("clip")) if n_valid is None else n_valid
    need = F.greatest(F.floor(ref * share), F.lit(1))
    return counts.withColumn("_need", need).where(F.col("n_measured") >= F.col("_need")).drop("_need")


def drop_small_groups(groups: DataFrame, share: float = 0.5, keys: list[str] = FRAME, area: str = "area") -> DataFrame:
    """Drop groups smaller than a share of their frame's median area."""
    med = groups.groupBy(*keys).agg(F.percentile(area, F.lit(0.5)).alias("_med"))
    return groups.join(med, keys).where(F.col(area) >= F.col("_med") * share).drop("_med")


def cells_within(c: Column, reach: Column, cell: float) -> Column:
    """Grid cells along one axis within ``reach`` of a point, and a hair more for rounding."""
    wide = reach * (1 + 1e-9)
    return F.sequence(F.floor((c - wide) / cell), F.floor((c + wide) / cell))


def near_pairs(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float,
               keys: list[str], how: str = "inner", extra: Column | None = None, strict: bool = True) -> DataFrame:
    """Join rows of the same frame closer than ``radius`` (or within it).

    Points meet only through grid cells, so far pairs are never formed. A cell is ``WIDE``
    radii wide and a right row goes to the cells its circle touches, 1.6 on average.
    """
    cell = WIDE * radius
    a = left.withColumns({"_cx": F.floor(F.col(lx) / cell), "_cy": F.floor(F.col(ly) / cell)})
    b = right.withColumn("_bx", F.explode(cells_within(F.col(rx), F.lit(radius), cell))).withColumn("_by", F.explode(cells_within(F.col(ry), F.lit(radius), cell)))
    for k in keys:
        b = b.withColumnRenamed(k, "_r_" + k)
    d = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    on = (F.col("_cx") == F.col("_bx")) & (F.col("_cy") == F.col("_by")) & ((d < radius) if strict else (d <= radius))
    for k in keys:
        on = on & (F.col(k) == F.col("_r_" + k))
    if extra is not None:
        on = on & extra
    return a.join(b, on, how).drop("_cx", "_cy", "_bx", "_by", *["_r_" + k for k in keys])


def suppress_near_tracks(dets: DataFrame, tracks: DataFrame, radius: float = 1.5) -> DataFrame:
    """Drop detections closer than ``radius`` yards to a track of the same frame."""
    there = tracks.select(*FRAME, F.col("x_yd").alias("_tx"), F.col("y_yd").alias("_ty"))
    return near_pairs(dets, there, "x_yd", "y_yd", "_tx", "_ty", radius, FRAME, "left_anti")


def contaminated(dets: DataFrame, tracks: DataFrame, limit: float = 0.15, cell: float = 256.0) -> DataFrame:
    """Mark detections whose box overlaps another track's box by more than ``limit``.

    Both sides are spread over the image cells they cover, so only boxes that share a
    cell are compared. ``dets`` has own_track (NULL when none).
    """
    def covered(df, x1, y1, x2, y2):
        xs = F.sequence(F.floor(F.col(x1) / cell), F.floor(F.col(x2) / cell))
        ys = F.sequence(F.floor(F.col(y1) / cell), F.floor(F.col(y2) / cell))
        return df.withColumn("_gx", F.explode(xs)).withColumn("_gy", F.explode(ys))

    solid = lambda df, a, b, c, d: df.where((F.col(c) > F.col(a)) & (F.col(d) > F.col(b)))
    a = covered(solid(dets, "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")
    t = tracks.select(F.col("clip").alias("_clip"), F.col("frame_idx").alias("_frame"), F.col("track_id").alias("_track"),
                      *[F.col(c).alias("_" + c) for c in ("x1", "y1", "x2", "y2")])
    b = covered(solid(t, "_x1", "_y1", "_x2", "_y2"), "_x1", "_y1", "_x2", "_y2").withColumnsRenamed({"_gx": "_hx", "_gy": "_hy"})
    iou = expanded_iou(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), tuple(F.col("_" + c) for c in ("x1", "y1", "x2", "y2")))
    on = ((F.col("clip") == F.col("_clip")) & (F.col("frame_idx") == F.col("_frame"))
          & (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy"))
          & ~F.col("own_track").eqNullSafe(F.col("_track")) & (iou > limit))
    hit = a.join(b, on, "left_semi").select(*FRAME, "det_idx").distinct().withColumn("_hit", F.lit(True))
    return dets.join(hit, [*FRAME, "det_idx"], "left").withColumn("contaminated", F.coalesce("_hit", F.lit(False))).drop("_hit")


def degenerate(corrs: DataFrame, bucket: float = 0.5, min_points: int = 4, min_off: int = 2) -> DataFrame:
    """Frames whose correspondences cannot fix a homography: under ``min_points``, or
    fewer than ``min_off`` off the fullest row or column."""
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.col("fx").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("fy").alias("v")))
    each = corrs.select(*FRAME, F.explode(axes).alias("a")).select(*FRAME, "a.axis", F.rint(F.col("a.v") / bucket).alias("b"))
    filled = each.groupBy(*FRAME, "axis", "b").agg(F.count("*").alias("c"))
    off = filled.groupBy(*FRAME, "axis").agg(F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("off"))
    return off.groupBy(*FRAME).agg(F.max("n").alias("n_points"), F.min("off").alias("fewest_off")).withColumn(
        "degenerate", (F.col("n_points") < min_points) | (F.col("fewest_off") < min_off))


def inside_token(x: Column, y: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column, margin: float = 30) -> Column:
    return x.between(x_min - margin, x_max + margin) & y.between(y_min - margin, y_max + margin)
