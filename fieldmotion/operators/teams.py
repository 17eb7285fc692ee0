"""Splitting the tracks of a clip into two teams."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.functions.arrays import dot
from fieldmotion.functions.boxes import chromatic_rules, hue_features
from fieldmotion.operators.histograms import mean_hue_signature, track_signature
from fieldmotion.operators.reliable import stage

#: Starts of two-means, and rows of a clip that one task takes.
STARTS, MOST = 10, 50_000

A, B, UNKNOWN = "team_A", "team_B", "unknown"


def baseline_residual(sigs: DataFrame, width: int, keys: list[str] = ["clip"], out: str = "residual") -> DataFrame:
    """Signature minus the mean signature of the clip."""
    mean = sigs.groupBy(*keys).agg(F.array(*[F.avg(F.col("sig")[i]) for i in range(width)]).alias("_mean"))
    return sigs.join(mean, keys).withColumn(out, F.zip_with("sig", "_mean", lambda a, b: a - b)).drop("_mean")


def canonical_labels(labels: DataFrame, cluster: str = "cluster", keys: list[str] = ["clip"]) -> DataFrame:
    """The cluster that holds the smallest track becomes team_A."""
    first = labels.groupBy(*keys).agg(F.min_by(cluster, "track_id").alias("_a"))
    return labels.join(first, keys).withColumn("team", F.when(F.col(cluster) == F.col("_a"), A).otherwise(B)).drop("_a")


def in_parts(rows: DataFrame, order: str, most: int = MOST) -> DataFrame:
    """Add ``_part``, so that no (clip, _part) has many more than ``most`` rows."""
    large = rows.groupBy("clip").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    part = F.coalesce(F.pmod(F.xxhash64(order), F.ceil(F.col("_n") / most)), F.lit(0)).cast("int")
    return rows.join(large, "clip", "left").withColumn("_part", part).drop("_n")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def principal_axis(residuals: DataFrame, value: str = "residual") -> DataFrame:
    """First principal direction per clip, its largest loading positive. A part of a clip
    adds up the upper triangle of its cross products; the triangles of a clip are merged."""

    def gram(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        x = _matrix(d.column(value))
        return pa.table({"clip": [key[0].as_py()], "sums": [(x.T @ x)[np.triu_indices(x.shape[1])].tolist()]})

    def axis(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        sums = _matrix(d.column("sums")).sum(axis=0)
        size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
        m = np.zeros((size, size))
        m[np.triu_indices(size)] = sums
        v = np.linalg.eigh(m + np.triu(m, 1).T)[1][:, -1]
        return pa.table({"clip": [key[0].as_py()], "axis": [(v * np.sign(v[np.argmax(np.abs(v))])).tolist()]})

    parts = in_parts(residuals.select("clip", "track_id", value), "track_id")
    sums = parts.groupBy("clip", "_part").applyInArrow(gram, "clip string, sums array<double>")
    return sums.groupBy("clip").applyInArrow(axis, "clip string, axis array<double>")


def pca_split(sigs: DataFrame, width: int) -> DataFrame:
    """Median split along the first principal direction of the residual signatures;
    confidence is the distance to the median over the spread."""
    known = stage(baseline_residual(sigs.where(F.col("sig").isNotNull()), width))
    proj = known.join(principal_axis(known), "clip").withColumn("proj", dot(F.col("residual"), F.col("axis")))
    return split_at_median(proj.select("clip", "track_id", "proj"))


def split_at_median(proj: DataFrame) -> DataFrame:
    """Cluster 1 at or above the clip's median, with confidence and canonical team."""
    mid = proj.groupBy("clip").agg(F.percentile("proj", F.lit(0.5)).alias("_m"), F.stddev_pop("proj").alias("_s"))
    out = proj.join(mid, "clip").withColumns({
        "cluster": F.when(F.col("proj") >= F.col("_m"), 1).otherwise(0),
        "confidence": F.abs(F.col("proj") - F.col("_m")) / (F.col("_s") + 1e-6)}).drop("_m", "_s")
    return canonical_labels(out)


def _square_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(d, F.lit(0.0), lambda t, v: t + v)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for grouping together with a relative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def spread_starts(points: DataFrame, order: str) -> DataFrame:
    """(clip, start, c0, c1) for STARTS starts: a point drawn by a hash, and the point
    farthest from it. ``points``: (clip, ``order``, _v)."""
    drawn = points.groupBy("clip").agg(F.array(*[F.min_by("_v", F.md5(F.concat_ws("|", F.lit(j), order))) for j in range(STARTS)]).alias("_c"))
    far = [F.max_by("_v", F.struct(_square_distance(F.col("_v"), F.col("_c")[j]), -F.col(order))) for j in range(STARTS)]
    pairs = points.join(drawn, "clip").groupBy("clip").agg(F.first("_c").alias("_c"), F.array(*far).alias("_d"))
    return pairs.select("clip", F.posexplode(F.arrays_zip("_c", "_d")).alias("start", "z")).select("clip", "start", F.col("z._c").alias("c0"), F.col("z._d").alias("c1"))


def lloyd_sums(x: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round for all starts c (starts, 2, width): (weighted sums with the weight last,
    labels, inertia of each start before the centres move)."""
    d = np.stack([((x[None] - c[:, k, None]) ** 2).sum(axis=2) for k in (0, 1)], axis=1)
    label = d[:, 1] < d[:, 0]
    full = np.hstack([x, np.ones((len(x), 1))]) * w[:, None]
    ones = label.astype(float) @ full
    return np.stack([full.sum(axis=0)[None] - ones, ones], axis=1), label, (d.min(axis=1) * w).sum(axis=1)


def moved(sums: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centres from weighted sums; one without points stays."""
    n = sums[:, :, -1:]
    return np.where(n > 0, sums[:, :, :-1] / np.where(n > 0, n, 1), c)


def two_means(points: DataFrame, value: str, order: str, weight: Column | None = None) -> DataFrame:
    """The best two cluster centres of every clip, (clip, c0, c1): Lloyd's rounds from
    STARTS spread starts until no point changes its cluster, least inertia (ties: the
    first start).

    A clip of up to MOST points goes through all its rounds in one task. Larger ones are
    in parts, whose sums are merged round by round; only clips that still change go on.
    """
    w = F.lit(1.0) if weight is None else weight
    pts = stage(in_parts(points.select("clip", order, F.col(value).alias("_v"), w.cast("double").alias("_w")), order))
    starts = _fresh(stage(spread_starts(pts, order)))
    large = pts.where("_part > 0").select("clip").distinct()

    def centres(t: pa.Table) -> tuple[np.ndarray, list]:
        t = t.sort_by("start")
        return np.stack([_matrix(t.column("c0")), _matrix(t.column("c1"))], axis=1), t.column("start").to_pylist()

    def whole(key: tuple[pa.Scalar, ...], d: pa.Table, s: pa.Table) -> pa.Table:
        x, weights, (c, _) = _matrix(d.column("_v")), d.column("_w").to_numpy(), centres(s)
        was = None
        while True:
            sums, label, inertia = lloyd_sums(x, weights, c)
            if was is not None and (label == was).all():
                break
            c, was = moved(sums, c), label
        best = int(np.argmin(np.round(inertia, 6)))
        return pa.table({"clip": [key[0].as_py()], "c0": [c[best, 0].tolist()], "c1": [c[best, 1].tolist()]})

    small = pts.join(large, "clip", "left_anti").groupBy("clip").cogroup(starts.join(large, "clip", "left_anti").groupBy("clip"))
    out = small.applyInArrow(whole, "clip string, c0 array<double>, c1 array<double>")
    return out if large.isEmpty() else out.unionByName(_rounds(pts.join(large, "clip", "left_semi"), starts.join(large, "clip", "left_semi"), centres))


def _rounds(pts: DataFrame, live: DataFrame, centres) -> DataFrame:
    """Lloyd's rounds over clips in parts: (clip, c0, c1)."""
    parts = pts.select("clip", "_part").distinct()
    state = "clip string, start int, c0 array<double>, c1 array<double>"

    def partial(key: tuple[pa.Scalar, ...], d: pa.Table, s: pa.Table) -> pa.Table:
        c, names = centres(s)
        sums, label, inertia = lloyd_sums(_matrix(d.column("_v")), d.column("_w").to_numpy(), c)
        marks = [zlib.crc32(np.packbits(x).tobytes()) for x in label[:, np.argsort(d.column("_o").to_numpy(), kind="stable")]]
        return pa.table({"clip": [key[0].as_py()] * len(names), "start": pa.array(names, pa.int32()), "part": pa.array([key[1].as_py()] * len(names), pa.int32()),
                         "sums": sums.reshape(len(names), -1).tolist(), "inertia": inertia, "mark": pa.array(marks, pa.int64())})

    def merge(key: tuple[pa.Scalar, ...], d: pa.Table, s: pa.Table) -> pa.Table:
        d, (c, _) = d.sort_by("part"), centres(s)
        new = moved(_matrix(d.column("sums")).sum(axis=0).reshape(1, 2, -1), c)
        return pa.table({"clip": [key[0].as_py()], "start": pa.array([key[1].as_py()], pa.int32()), "c0": new[:, 0].tolist(), "c1": new[:, 1].tolist(),
                         "inertia": [float(sum(d.column("inertia").to_pylist()))], "marks": [",".join(map(str, d.column("mark").to_pylist()))]})

    rows = pts.select("clip", "_part", F.xxhash64("_v").alias("_o"), "_v", "_w")
    done, marks = None, None
    while True:
        sums = rows.groupBy("clip", "_part").cogroup(_fresh(live.select("clip", "start", "c0", "c1").join(parts, "clip")).groupBy("clip", "_part")).applyInArrow(
            partial, "clip string, start int, part int, sums array<double>, inertia double, mark long")
        new = stage(_fresh(sums).groupBy("clip", "start").cogroup(_fresh(live).groupBy("clip", "start")).applyInArrow(merge, state + ", inertia double, marks string"))
        if marks is not None:
            same = new.join(marks.withColumnRenamed("marks", "_marks"), ["clip", "start"]).where("marks = _marks")
            rest = new.join(_fresh(same.select("clip", "start")), ["clip", "start"], "left_anti")
            done = same.drop("_marks") if done is None else done.unionByName(same.drop("_marks"))
            new = stage(rest)
            if new.isEmpty():
                break
        marks, live = _fresh(new.select("clip", "start", "marks")), _fresh(new.select("clip", "start", "c0", "c1"))
        rows = rows.join(live.select("clip").distinct(), "clip", "left_semi")
    best = done.groupBy("clip").agg(F.min_by(F.struct("c0", "c1"), F.struct(F.round("inertia", 6), "start")).alias("_b"))
    return best.select("clip", "_b.c0", "_b.c1")


def kmeans_split(sigs: DataFrame, value: str = "sig") -> DataFrame:
    """Cluster the tracks of each clip in two; confidence compares both centre distances."""
    known = sigs.where(F.col(value).isNotNull())
    return canonical_labels(assign_two(known.join(two_means(known, value, "track_id"), "clip"), value))


def assign_two(df: DataFrame, value: str) -> DataFrame:
    """Cluster and confidence of rows given columns c0 and c1."""
    d0, d1 = (F.sqrt(_square_distance(F.col(value), F.col(k))) for k in ("c0", "c1"))
    both = df.withColumns({"_d0": d0, "_d1": d1})
    own, other = F.least("_d0", "_d1"), F.greatest("_d0", "_d1")
    return both.withColumns({"cluster": F.when(F.col("_d1") < F.col("_d0"), 1).otherwise(0),
                             "confidence": (other - own) / (own + 1e-6)}).drop("_d0", "_d1", "c0", "c1")


def pixel_split(pixels: DataFrame, min_pixels: int = 50) -> DataFrame:
    """Cluster the pooled shirt pixels of a clip in two colours and give each track the
    colour its pixels are nearer to on average. Equal pixels are counted once, weighted."""
    kept = pixels.where(chromatic_rules(F.col("h"), F.col("s"), F.col("v"))["keep"])
    per_track = kept.groupBy("clip", "track_id", "h", "s", "v").agg(F.count("*").alias("n"))
    big = per_track.groupBy("clip", "track_id").agg(F.sum("n").alias("_t")).where(F.col("_t") >= min_pixels).drop("_t")
    feats = stage(per_track.join(big, ["clip", "track_id"], "left_semi").withColumns({
        "f": F.array(*hue_features(F.col("h"), F.col("s"), F.col("v"))),
        "code": F.col("h").cast("long") * 65536 + F.col("s") * 256 + F.col("v")}))
    pooled = feats.groupBy("clip", "code").agg(F.first("f").alias("f"), F.sum("n").alias("n"))
    centres = two_means(pooled, "f", "code", F.col("n"))
    dist = feats.join(centres, "clip").withColumns({k: F.sqrt(_square_distance(F.col("f"), F.col(k))) for k in ("c0", "c1")})
    mean = lambda k: F.sum(F.col(k) * F.col("n")) / F.sum("n")
    tracks = dist.groupBy("clip", "track_id").agg(mean("c0").alias("_d0"), mean("c1").alias("_d1"))
    own, other = F.least("_d0", "_d1"), F.greatest("_d0", "_d1")
    return canonical_labels(tracks.withColumns({"cluster": F.when(F.col("_d0") < F.col("_d1"), 0).otherwise(1),
                                                "confidence": (other - own) / (own + 1e-6)}).drop("_d0", "_d1"))


def position_split(points: DataFrame, measured: Column, x: str = "x", min_tracks: int = 4) -> DataFrame:
    """Split tracks at the clip's median of their first measured x (below is team_A)."""
    first = points.groupBy("clip", "track_id").agg(F.min_by(F.when(measured, F.col(x)), F.when(measured, F.col("frame_idx"))).alias("first_x"))
    mid = first.groupBy("clip").agg(F.percentile("first_x", F.lit(0.5)).alias("_m"), F.count("first_x").alias("_n"))
    team = (F.when((F.col("_n") < min_tracks) | F.col("first_x").isNull(), UNKNOWN)
            .when(F.col("first_x") < F.col("_m"), A).otherwise(B))
    return first.join(mid, "clip").withColumn("team", team).drop("_m", "_n")


def reconcile_labels(position: DataFrame, colour: DataFrame, trust: float = 0.05) -> DataFrame:
    """Merge both label sets of a clip: colour is flipped if it mostly disagrees;
    agreement wins, then confident colour, then position. Tracks without either are unknown."""
    p = position.select("clip", "track_id", F.col("team").alias("_p"))
    q = colour.select("clip", "track_id", F.col("team").alias("_c"), F.col("confidence").alias("_conf"))
    both = p.join(q, ["clip", "track_id"], "full").fillna(UNKNOWN, ["_p", "_c"])
    sided = (F.col("_p") != UNKNOWN) & (F.col("_c") != UNKNOWN)
    votes = both.groupBy("clip").agg(F.count_if(sided & (F.col("_p") == F.col("_c"))).alias("_same"), F.count_if(sided).alias("_all"))
    flip = F.col("_same") < F.col("_all") - F.col("_same")
    flipped = F.when(F.col("_c") == A, B).when(F.col("_c") == B, A).otherwise(F.col("_c"))
    merged = both.join(votes, "clip").withColumn("_c", F.when(flip, flipped).otherwise(F.col("_c")))
    team = (F.when(F.col("_all") == 0, UNKNOWN).when(F.col("_p") == F.col("_c"), F.col("_p"))
            .when(F.col("_p") == UNKNOWN, F.col("_c")).when(F.col("_c") == UNKNOWN, F.col("_p"))
            .when(F.coalesce(F.col("_conf"), F.lit(0.0)) >= trust, F.col("_c")).otherwise(F.col("_p")))
    return merged.select("clip", "track_id", team.alias("team"))


def _by_position(points, pixels):
    return position_split(points, F.col("measured"))


def _by_pca(points, pixels):
    return pca_split(track_signature(pixels, ["clip", "track_id"]), 24)


def _by_residual(points, pixels):
    sigs = mean_hue_signature(pixels, ["clip", "track_id"], "sample")
    return kmeans_split(baseline_residual(sigs, 36), "residual")


def _by_kmeans(points, pixels):
    return kmeans_split(track_signature(pixels, ["clip", "track_id"]))


def _by_pixels(points, pixels):
    return pixel_split(pixels)


def _by_hybrid(points, pixels):
    return reconcile_labels(_by_position(points, pixels), _by_residual(points, pixels))


# Every method takes track points and colour pixels and gives (clip, track_id, team, ...).
TEAM_METHODS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "kmeans": _by_kmeans, "position": _by_position, "pixels": _by_pixels,
    "pca": _by_pca, "residual": _by_residual, "hybrid": _by_hybrid,
}


def label_teams(points: DataFrame, pixels: DataFrame, method: str = "pca") -> DataFrame:
    if method not in TEAM_METHODS:
        raise ValueError(f"unknown team method {method!r}; known: {sorted(TEAM_METHODS)}")
    return TEAM_METHODS[method](points, pixels)
