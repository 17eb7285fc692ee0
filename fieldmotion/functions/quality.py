"""Row-level quality rules for homographies and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A frame is red beyond these.
RMSE_YD, INLIER_SHARE, MIN_CORRS, MIN_YARD_FITS, TEMPORAL_YD = 0.30, 0.95, 12, 5, 1.5


def red_flags(rmse: Column, inlier_frac: Column, n_corrs: Column, n_yard_fits: Column,
              temporal: Column) -> Column:
    """Names of the rules a frame breaks; a NULL input never breaks one."""
    rules = [("rmse", rmse > RMSE_YD), ("inliers", inlier_frac < INLIER_SHARE),
             ("corrs", n_corrs < MIN_CORRS), ("yard_fits", n_yard_fits < MIN_YARD_FITS),
             ("temporal", temporal > TEMPORAL_YD)]
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def choose_source(h_a: Column, flags_a: Column, h_b: Column, flags_b: Column) -> dict[str, Column]:
    """First source if present and unflagged, else the second, else NULL."""
    a_ok = h_a.isNotNull() & (F.size(flags_a) == 0)
    b_ok = h_b.isNotNull() & (F.size(flags_b) == 0)
    return {"h_source": F.when(a_ok, F.lit("new")).when(b_ok, F.lit("classical")),
            "h_used": F.when(a_ok, h_a).when(b_ok, h_b)}


def readiness(rate: Column) -> Column:
    return (F.when(rate >= 0.95, F.lit("ready")).when(rate >= 0.90, F.lit("caution"))
            .otherwise(F.lit("debug")))
