"""Windows over long sequences without one task per sequence.

A plain ``Window.partitionBy(clip)`` sends a whole clip to one task. The helpers
here cut each sequence at fixed positions (``pos >> bits``), so a key that holds a
third of the rows is still spread over many tasks:

* ``bounded``  - windows that look a fixed number of positions back and ahead; the
  few rows near a cut are copied into the neighbouring piece.
* ``running``  - unbounded running aggregates; every piece is summarised, the
  summaries (one row per 2**bits positions) are scanned, and the carry is joined back.

``pos`` must be an integer column, unique within the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PIECE_BITS = 16

_PIECE = "_piece"
_OWNER = "_owner"


def bounded(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    bits: int = PIECE_BITS,
) -> DataFrame:
    """Add columns computed from at most ``before`` positions back and ``after`` ahead.

    ``build`` gets a window ordered by ``pos``. Rows of neighbouring positions are
    present in the window even when they belong to another piece.
    """
    p = F.col(pos).cast("long")
    owner = F.shiftright(p, bits)
    spread = df.withColumn(_OWNER, owner).withColumn(
        _PIECE,
        F.explode(F.sequence(F.shiftright(p - after, bits), F.shiftright(p + before, bits))),
    )
    w = Window.partitionBy(*keys, _PIECE).orderBy(pos)
    return (
        spread.withColumns(dict(build(w)))
        .where(F.col(_PIECE) == F.col(_OWNER))
        .drop(_PIECE, _OWNER)
    )


def bounded_twice(df, keys, pos, before, after, *builds, bits=PIECE_BITS):
    """Like ``bounded`` with several window layers over one shuffle.

    ``before``/``after`` must cover the summed reach of all layers.
    """
    p = F.col(pos).cast("long")
    spread = df.withColumn(_OWNER, F.shiftright(p, bits)).withColumn(
        _PIECE,
        F.explode(F.sequence(F.shiftright(p - after, bits), F.shiftright(p + before, bits))),
    )
    w = Window.partitionBy(*keys, _PIECE).orderBy(pos)
    for build in builds:
        spread = spread.withColumns(dict(build(w)))
    return spread.where(F.col(_PIECE) == F.col(_OWNER)).drop(_PIECE, _OWNER)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    forward: Mapping[str, tuple[str, Column]] | None = None,
    backward: Mapping[str, tuple[str, Column]] | None = None,
    bits: int = PIECE_BITS,
) -> DataFrame:
    """Add inclusive running aggregates, from the start (``forward``) or the end.

    Each entry is ``name: (kind, column)`` with kind ``sum``, ``max``, ``min`` or
    ``last`` (the nearest non-null value at or before, or at or after, the row).
    """
    forward, backward = dict(forward or {}), dict(backward or {})
    cut = df.withColumn(_PIECE, F.shiftright(F.col(pos).cast("long"), bits))
    for name, (_, col) in {**forward, **backward}.items():
        cut = cut.withColumn("_v_" + name, col)

    def summary(name, kind, is_forward):
        v = F.col("_v_" + name)
        if kind == "last":
            at = F.when(v.isNotNull(), F.col(pos))
            return (F.max_by if is_forward else F.min_by)(v, at)
        return getattr(F, kind)(v)

    entries = [(n, k, True) for n, (k, _) in forward.items()]
    entries += [(n, k, False) for n, (k, _) in backward.items()]
    totals = cut.groupBy(*keys, _PIECE).agg(
        *[summary(n, k, f).alias("_t_" + n) for n, k, f in entries]
    )
    earlier = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(1, Window.unboundedFollowing)

    def carry(name, kind, is_forward):
        t, w = F.col("_t_" + name), earlier if is_forward else later
        if kind == "last":
            pick = F.last if is_forward else F.first
            return pick(t, ignorenulls=True).over(w)
        return getattr(F, kind)(t).over(w)

    carried = totals.select(
        *keys, _PIECE, *[carry(n, k, f).alias("_c_" + n) for n, k, f in entries]
    )
    ordered = Window.partitionBy(*keys, _PIECE).orderBy(pos)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    onward = ordered.rowsBetween(0, Window.unboundedFollowing)

    def combined(name, kind, is_forward):
        v, c, w = F.col("_v_" + name), F.col("_c_" + name), upto if is_forward else onward
        if kind == "last":
            pick = F.last if is_forward else F.first
            return F.coalesce(pick(v, ignorenulls=True).over(w), c)
        inner = getattr(F, kind)(v).over(w)
        if kind == "sum":
            return F.coalesce(inner, F.lit(0)) + F.coalesce(c, F.lit(0))
        return (F.greatest if kind == "max" else F.least)(inner, c)

    joined = cut.join(carried, [*keys, _PIECE])
    out = joined.withColumns({n: combined(n, k, f) for n, k, f in entries})
    return out.drop(_PIECE, *["_v_" + n for n, _, _ in entries], *["_c_" + n for n, _, _ in entries])


def numbered(df: DataFrame, keys: Sequence[str], pos: str, name: str,
             bits: int = PIECE_BITS) -> DataFrame:
    """Dense 0-based position of each row within its keys, in ``pos`` order."""
    out = running(df, keys, pos, {name: ("sum", F.lit(1).cast("long"))}, bits=bits)
    return out.withColumn(name, (F.col(name) - 1).cast("int"))


def run_bounds(df: DataFrame, keys: Sequence[str], pos: str, inside: Column,
               start: str = "run_start", end: str = "run_end",
               counts: Mapping[str, Column] | None = None,
               bits: int = PIECE_BITS) -> DataFrame:
    """For rows where ``inside`` holds, the [start, end) of their run of consecutive
    positions; NULL elsewhere. ``counts`` adds running sums from both ends in the same
    pass, as ``name_upto`` and ``name_from`` (both inclusive)."""
    flagged = df.withColumn("_in", F.coalesce(inside, F.lit(False)))

    def edges(w):
        prev_in = F.coalesce(F.lag("_in").over(w) & (F.lag(pos).over(w) == F.col(pos) - 1), F.lit(False))
        next_in = F.coalesce(F.lead("_in").over(w) & (F.lead(pos).over(w) == F.col(pos) + 1), F.lit(False))
        return {
            "_s": F.when(F.col("_in") & ~prev_in, F.col(pos)),
            "_e": F.when(F.col("_in") & ~next_in, F.col(pos) + 1),
        }

    marked = bounded(flagged, keys, pos, 1, 1, edges, bits)
    sums = {n: ("sum", v) for n, v in (counts or {}).items()}
    spans = running(marked, keys, pos,
                    {start: ("max", F.col("_s")), **{n + "_upto": v for n, v in sums.items()}},
                    {end: ("min", F.col("_e")), **{n + "_from": v for n, v in sums.items()}}, bits)
    return spans.withColumns(
        {start: F.when(F.col("_in"), F.col(start)), end: F.when(F.col("_in"), F.col(end))}
    ).drop("_in", "_s", "_e")


def with_totals(df: DataFrame, keys: Sequence[str], pos: str, sums: Mapping[str, Column],
                bits: int = PIECE_BITS) -> DataFrame:
    """Add per-key totals to every row, joining on (key, piece) so that a hot key is
    spread like in ``running``."""
    cut = df.withColumn(_PIECE, F.shiftright(F.col(pos).cast("long"), bits))
    parts = cut.groupBy(*keys, _PIECE).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    per_piece = parts.select(*keys, _PIECE, *[F.sum(n).over(whole).alias(n) for n in sums])
    return cut.join(per_piece, [*keys, _PIECE]).drop(_PIECE)
