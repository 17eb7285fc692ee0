"""Exact ranks, top-n and percentiles that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.operators.reliable import stage

SPREAD = 32
#: Values that are sorted in one task, and bins of a histogram.
MOST, BINS = 10_000, 1024


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank", spread: int = SPREAD) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, with their 1-based rank.

    Rows are first cut to ``n`` per (group, salt), so the final window sees at most
    ``n * spread`` rows of a group however large the group is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= n)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= n)
    )


def first_fraction(df: DataFrame, bucket: Column, order: Sequence[Column], count: Column,
                   flag: str = "selected") -> DataFrame:
    """Mark the first ``count`` rows of the whole table by (bucket, order).

    ``bucket`` is the leading part of the order (e.g. a hash prefix); only the
    per-bucket counts are scanned in sequence. ``count`` may use column ``n_rows``.
    """
    tagged = df.withColumn("_b", bucket)
    sizes = tagged.groupBy("_b").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "_b",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy()).alias("n_rows"),
    )
    inner = Window.partitionBy("_b").orderBy(*order)
    return (
        tagged.join(sizes, "_b")
        .withColumn(flag, F.col("_base") + F.row_number().over(inner) <= count)
        .drop("_b", "_base", "n_rows")
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float],
                      most: int = MOST, bins: int = BINS) -> DataFrame:
    """Linear-interpolated percentiles of possibly huge groups, exactly: one row per key
    with ``n`` and one column per entry of ``probs``.

    Groups of up to ``most`` values are sorted as they are. In larger ones every percentile
    lies in a bracket of values, at first the whole range; a pass over the data makes one
    histogram of each bracket, all percentiles and keys together, and the bin that holds
    the wanted ranks is the next bracket. It ends where the two ranks fall in two bins or
    on one value, or where a bracket holds few enough values to be sorted. Null values are
    left out; a table without values gives no row.
    """
    group = [*keys] or ["_all"]
    vals = df.where(value.isNotNull()).select(*keys, *([] if keys else [F.lit(0).alias("_all")]), value.cast("double").alias("_x"))
    vals = stage(vals)
    names = list(probs)
    sizes = vals.groupBy(*group).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    large = stage(sizes.where(F.col("n") > most))
    few = (lambda d: d) if keys else F.broadcast  # without keys all rows have one key: a shuffle on it is one task
    rest = vals.join(few(large), group, "left_anti").groupBy(*group)
    out = rest.agg(F.count("*").alias("n"), *[F.percentile("_x", F.lit(float(probs[k]))).alias(k) for k in names])
    if not large.isEmpty():
        asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(probs[k])).alias("p")) for i, k in enumerate(names)])).alias("q")
        at = F.col("q.p") * (F.col("n") - 1)
        state = large.select(*group, "n", "lo", "hi", asked).select(
            *group, "n", "lo", "hi", F.col("q.i").alias("i"), F.floor(at).alias("r"), (at - F.floor(at)).alias("f"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
        found = _narrowed(vals, state, group, most, bins, few)
        lerp = F.when(F.col("f") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))
        picks = [F.max(F.when(F.col("i") == i, lerp)).alias(k) for i, k in enumerate(names)]
        out = out.unionByName(found.groupBy(*group).agg(F.first("n").alias("n"), *picks))
    return out.select(*keys, "n", *names)


def _narrowed(vals: DataFrame, state: DataFrame, group: list[str], most: int, bins: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(group, i, n, f, a, b): the values at ranks r and r + 1 of each asked percentile."""
    done, one, turn = None, [*group, "i"], 0
    carried = [*one, "n", "r", "f"]
    fresh = lambda d: d.select(*[F.col(c).alias(c) for c in d.columns])
    while True:
        x, lo, hi = F.col("_x"), F.col("lo"), F.col("hi")
        inside = vals.join(small(fresh(state)), group).where(x.between(lo, hi))
        share = (x / 2 - lo / 2) / (hi / 2 - lo / 2)
        if turn % 2 == 0:  # every other pass in steps of magnitude, for long tails
            size = lambda v: F.signum(v) * F.log1p(F.abs(v) * 1e8)
            even = (size(x) - size(lo)) / (size(hi) - size(lo))
            share = F.when((size(hi) > size(lo)) & ~F.isnan(even), even).otherwise(share)
        turn += 1
        place = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor(share * bins))).otherwise(0)
        hist = inside.groupBy(*carried, "below", place.alias("bin")).agg(F.count("*").alias("c"), F.min("_x").alias("mn"), F.max("_x").alias("mx"))
        upto = F.sum("c").over(Window.partitionBy(*one).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # at most ``bins`` rows
        ranked = hist.withColumn("end", F.col("below") + upto).withColumn("begin", F.col("end") - F.col("c"))
        holds = lambda r: F.max(F.when((F.col("begin") <= r) & (r < F.col("end")), F.struct("bin", "mn", "mx", "begin", "c")))
        last = F.least(F.col("r") + 1, F.col("n") - 1)
        new = stage(ranked.groupBy(*carried).agg(holds(F.col("r")).alias("s"), holds(last).alias("t")))
        apart, flat = F.col("s.bin") != F.col("t.bin"), F.col("s.mn") == F.col("s.mx")
        solved = new.where(apart | flat).select(*one, "n", "f", F.col("s.mx").alias("a"), F.col("t.mn").alias("b"))
        done = solved if done is None else done.unionByName(solved)
        state = new.where(~apart & ~flat).select(*carried, F.col("s.mn").alias("lo"), F.col("s.mx").alias("hi"), F.col("s.begin").alias("below"), F.col("s.c").alias("inside"))
        widest = state.agg(F.max("inside").alias("m")).first()["m"]
        if widest is None:
            return done
        if widest <= most:
            few = vals.join(small(fresh(state)), group).where(F.col("_x").between(F.col("lo"), F.col("hi")))
            sorted_ = few.groupBy(*carried, "below").agg(F.sort_array(F.collect_list("_x")).alias("_v"))  # at most ``most`` values
            pick = lambda k: F.col("_v")[(F.least(F.col("r") + k, F.col("n") - 1) - F.col("below")).cast("int")]
            return done.unionByName(sorted_.select(*one, "n", "f", pick(0).alias("a"), pick(1).alias("b")))
