"""Histograms and colour signatures from pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmotion.functions.boxes import chromatic_rules


def bin_of(value: Column, bins: int, lo: float, hi: float, closed: bool = True) -> Column:
    """Bin of a value, NULL outside; the last bin includes ``hi`` when closed."""
    b = F.floor((value - lo) / ((hi - lo) / bins)).cast("int")
    if closed:
        return F.when((value >= lo) & (value <= hi), F.least(b, F.lit(bins - 1)))
    return F.when((value >= lo) & (value < hi), b)


def counts_array(df: DataFrame, keys: list[str], bin_: Column, bins: int, name: str = "hist") -> DataFrame:
    """Counts per key as an array of ``bins``; rows are counted per bin first, so at
    most ``bins`` rows of a key are gathered."""
    per_bin = df.withColumn("_b", bin_).groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    filled = F.map_from_entries(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_b", "_n"))))
    out = per_bin.groupBy(*keys).agg(filled.alias("_m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0)).cast("double"))
    return out.select(*keys, whole.alias(name))


def share(a: Column) -> Column:
    """Array over its sum (at least 1)."""
    t = F.greatest(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.lit(1.0))
    return F.transform(a, lambda v: v / t)


def histogram_1d(df: DataFrame, keys: list[str], value: Column, bins: int, lo: float, hi: float,
                 normalise: bool = False, min_rows: int = 0) -> DataFrame:
    """Fixed-bin histogram; keys with fewer than ``min_rows`` rows give zeros."""
    out = counts_array(df, keys, bin_of(value, bins, lo, hi), bins)
    if min_rows:
        n = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        zero = F.array_repeat(F.lit(0.0), bins)
        out = out.join(n, keys).withColumn("hist", F.when(F.col("_rows") >= min_rows, F.col("hist")).otherwise(zero)).drop("_rows")
    return out.withColumn("hist", share(F.col("hist"))) if normalise else out


def histogram_2d(df: DataFrame, keys: list[str], a: Column, b: Column, bins: tuple[int, int],
                 ranges: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    i, j = bin_of(a, bins[0], *ranges[0]), bin_of(b, bins[1], *ranges[1])
    return counts_array(df, keys, i * bins[1] + j, bins[0] * bins[1])


def histogram_hsv(df: DataFrame, keys: list[str]) -> DataFrame:
    """8 x 8 x 4 colour histogram with half-open bins, as sparse shares (bin, share)."""
    h = bin_of(F.col("h"), 8, 0, 180, False)
    s, v = bin_of(F.col("s"), 8, 0, 256, False), bin_of(F.col("v"), 4, 0, 256, False)
    per_bin = df.withColumn("bin", h * 32 + s * 4 + v).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = per_bin.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return per_bin.join(total, keys).select(*keys, "bin", (F.col("n") / F.col("_t")).alias("share"))


def track_signature(pixels: DataFrame, keys: list[str], min_pixels: int = 20) -> DataFrame:
    """24 numbers per track from its pooled shirt pixels: 12 hue shares and 4 x 3
    saturation-value shares; NULL under ``min_pixels``."""
    kept = pixels.where(chromatic_rules(F.col("h"), F.col("s"), F.col("v"))["keep"])
    hue = bin_of(F.col("h"), 12, 0, 180)
    sv = bin_of(F.col("s"), 4, 0, 256) * 3 + bin_of(F.col("v"), 3, 50, 220)
    both = kept.withColumn("_b", F.explode(F.array(hue, sv + 12)))
    out = counts_array(both, keys, F.col("_b"), 24, "_a")
    enough = F.aggregate(F.slice("_a", 1, 12), F.lit(0.0), lambda x, y: x + y) >= min_pixels
    sig = F.concat(share(F.slice("_a", 1, 12)), share(F.slice("_a", 13, 12)))
    return out.select(*keys, F.when(enough, sig).alias("sig"))


def mean_hue_signature(pixels: DataFrame, keys: list[str], sample: str, bins: int = 36, min_pixels: int = 5) -> DataFrame:
    """Mean over samples of the normalised hue histogram; samples under ``min_pixels``
    are skipped. Long form (bin, share) aggregated before it is gathered."""
    kept = pixels.where(chromatic_rules(F.col("h"), F.col("s"), F.col("v"))["keep"])
    per_bin = kept.groupBy(*keys, sample, bin_of(F.col("h"), bins, 0, 180).alias("bin")).agg(F.count("*").alias("n"))
    sizes = per_bin.groupBy(*keys, sample).agg(F.sum("n").alias("_t")).where(F.col("_t") >= min_pixels)
    n_samples = sizes.groupBy(*keys).agg(F.count("*").alias("_m"))
    shares = per_bin.join(sizes, [*keys, sample]).groupBy(*keys, "bin").agg(F.sum(F.col("n") / F.col("_t")).alias("_s"))
    out = shares.join(n_samples, keys).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("_s") / F.col("_m")))).alias("_map"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.col("_map")[i], F.lit(0.0)))
    return out.select(*keys, whole.alias("sig"))
