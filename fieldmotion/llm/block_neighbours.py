"""Nearest neighbours by a block matrix join.

Vectors are scaled to length 1 and rounded to int8. Blocks of queries meet blocks of
candidates in the cells of a grid of tasks; one product of int8 tiles gives every
similarity of the two blocks with a bound on its rounding error. A pair whose upper bound
is below the k-th best lower bound of its query cannot be among the k nearest. Heaps merge
the survivors of all blocks by their bounds; what is left meets its original vectors again
and is computed in double precision.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import parallelism, stored


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; an exact step
    that leaves the cosine as it is."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, adding in the order of the components as SQL engines do."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    q, c = scaled(q), scaled(c)
    return _dot(q, c) / (np.sqrt(_dot(q, q)) * np.sqrt(_dot(c, c)))


def quantised(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 tiles of unit vectors, the scale of each row and the length of its rounding error."""
    v = scaled(v)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error


Tile = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row numbers, int8 rows, scales, errors


def survivors(a: Tile, b: Tile, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, lower, upper bound) of the pairs that can be among a row's k nearest in b.

    |<a, b> - <A, B>| <= |a - A| |b| + |A| |b - B| with |b| = 1 and |A| <= 1 + |a - A|.
    """
    (a_rows, qi, qs, qe), (b_rows, ci, cs, ce) = a, b
    near = (qi.astype(np.float32) @ ci.astype(np.float32).T) * (qs[:, None] * cs[None, :])  # whole numbers below 2**24: exact for up to 1,040 dimensions
    if qi.shape[1] > 1040:
        near = (qi.astype(np.float64) @ ci.astype(np.float64).T) * (qs[:, None] * cs[None, :])
    slack = qe[:, None] + (1 + qe)[:, None] * ce[None, :] + 1e-6
    own = a_rows[:, None] == b_rows[None, :]
    low = np.where(own, -np.inf, near - slack)
    floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(qi), -np.inf)
    at, to = np.nonzero(~own & (near + slack >= floor[:, None]))
    return at, to, low[at, to], (near + slack)[at, to]


def usable(vector: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not all zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """(dim, block, ids, rows, tile, scales, errors): rows (row, id, vec) in blocks of about ``size``."""
    n = max(1, -(-rows.count() // size))
    keyed = rows.select("row", "id", "vec", F.size("vec").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block"))

    def gather(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        d = d.sort_by("row")
        v = d.column("vec").combine_chunks().flatten().to_numpy().reshape(d.num_rows, -1)
        q, scale, error = quantised(v)
        raw = [d.column("id").to_numpy(), d.column("row").to_numpy(), q, scale, error]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), **{c: [x.tobytes()] for c, x in zip(("ids", "rows", "tile", "scales", "errors"), raw, strict=True)}})

    return keyed.groupBy("dim", "block").applyInArrow(gather, "dim int, block int, ids binary, rows binary, tile binary, scales binary, errors binary")


def _grid(asked: int, kept: int, tasks: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``tasks`` cells, shaped so that blocks are copied least."""
    rows = max(1, min(asked, tasks, round(math.sqrt(tasks * asked / max(1, kept)))))
    return rows, max(1, min(kept, -(-tasks // rows)))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding",
            query_block: int = 1024, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query row.

    A row that repeats another's id is another candidate and another query, but no
    candidate for its own id. Ties go to
    the smaller id. Fewer candidates than k give fewer rows. Vectors of unequal length
    are not compared. Unusable vectors and null ids take no part; an empty table gives
    nothing. Block pairs are dealt to a grid of some four cells a core, however many there
    are; they carry int8 tiles, and vectors go only to the pairs that survive all bounds.
    """
    good = rows.where(usable(F.col(vector)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    good = stored(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = stored(_tiles(good.where("q").select("row", "id", "vec"), query_block), "query-tiles")
    kept = stored(_tiles(good.select("row", "id", "vec"), block), "tiles")
    g, h = _grid(asked.count(), kept.count(), 4 * parallelism(rows))
    names = ("ids", "rows", "tile", "scales", "errors")

    def cells(df: DataFrame, mine: str, n: int, m: int) -> DataFrame:
        other = "s" if mine == "r" else "r"
        spread = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        return df.select("dim", F.pmod("block", F.lit(n)).alias(mine), spread, *[F.col(c).alias(f"{mine}_{c}") for c in names])

    left, right = cells(asked, "r", g, h), cells(kept, "s", h, g)
    place = ["dim", "r", "s"]
    met = left.repartition(g * h, *place).join(right.repartition(g * h, *place), place)
    met = met.select("dim", *[f"r_{c}" for c in names], *[f"s_{c}" for c in names])

    def tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column(0)[i].as_py()
                raw = [b.column(c)[i].as_py() for c in range(1, 11)]
                read = lambda p: (np.frombuffer(p[0], np.int64), (np.frombuffer(p[1], np.int64), np.frombuffer(p[2], np.int8).reshape(-1, dim), np.frombuffer(p[3]), np.frombuffer(p[4])))  # noqa: B023, E731
                (q_ids, q), (c_ids, c) = read(raw[:5]), read(raw[5:])
                for s in range(0, len(q_ids), 256):
                    part = tuple(x[s : s + 256] for x in q)
                    at, to, low, high = survivors((q_ids[s : s + 256], *part[1:]), (c_ids, *c[1:]), k)
                    yield pa.RecordBatch.from_arrays([pa.array(part[0][at]), pa.array(q_ids[s + at]), pa.array(c[0][to]), pa.array(c_ids[to]), pa.array(low), pa.array(high)],
                                                     names=["q_row", "query_id", "c_row", "vec_id", "low", "high"])

    found = met.mapInArrow(tile, "q_row long, query_id long, c_row long, vec_id long, low double, high double")
    pairs = stored(found, "neighbour-pairs")
    left_over = pairs.join(_floors(pairs, k), "q_row").where("high >= floor").select("q_row", "query_id", "c_row", "vec_id")
    vec = good.select("row", "vec")
    both = (left_over.join(vec.select(F.col("row").alias("c_row"), F.col("vec").alias("cv")), "c_row")
            .join(vec.select(F.col("row").alias("q_row"), F.col("vec").alias("qv")), "q_row").select("q_row", "query_id", "vec_id", "qv", "cv"))

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            score = np.zeros(b.num_rows)
            for dim in np.unique(sizes):
                i = pa.array(np.flatnonzero(sizes == dim))
                x, y = (b.column(c).take(i).flatten().to_numpy().reshape(-1, dim) for c in (3, 4))
                score[i.to_numpy()] = cosine(x, y)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score)], names=["q_row", "query_id", "vec_id", "score"])

    scored = both.mapInArrow(exact, "q_row long, query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floors(pairs: DataFrame, k: int) -> DataFrame:
    """(q_row, floor): the k-th best lower bound of each query; tasks keep a heap of k a query."""

    def heaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[float]] = {}
        for b in batches:
            for q, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                heap = best.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, low)
                elif low > heap[0]:
                    heapq.heapreplace(heap, low)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.float64()))], names=["q_row", "lows"])

    def merge(key: tuple[pa.Scalar, ...], d: pa.Table) -> pa.Table:
        lows = sorted(d.column("lows").combine_chunks().flatten().to_pylist(), reverse=True)
        return pa.table({"q_row": [key[0].as_py()], "floor": [lows[k - 1] if len(lows) >= k else -math.inf]})

    return pairs.select("q_row", "low").mapInArrow(heaps, "q_row long, lows array<double>").groupBy("q_row").applyInArrow(merge, "q_row long, floor double")


def op5_query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(c.e, c.e))) AS score
      FROM g q JOIN g c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
