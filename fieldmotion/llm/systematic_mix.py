"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a target number of words. A document's expected number of copies is
its source's target over its source's size. Documents of a source are put in one order
(by size, then by a hash), expected copies are summed along it from one offset drawn per
source, and a document is emitted once per integer boundary its own span crosses. The
order by size makes the words taken, not only the documents, come near the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import WORD, rowed, stored


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _size_class(size: Column) -> Column:
    """Bit length and the four leading bits: classes one sixteenth of an octave wide."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))")).cast("int")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> target: ``share`` of all sizes split by weight, none above
    ``cap`` times its source's size, the excess given to the others by weight.

    Sources in code point order (null last) take the weights in turn. One row per source.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    d = (
        sizes.withColumn("_place", place)
        .withColumn("_w", F.element_at(table, (F.col("_place") - 1) % len(weights) + 1))
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0)))
        .withColumn("_total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.sum("_w").over(everything) - F.col("_used")))
    )
    # Capping one more source raises the level exactly while its ratio is below the level,
    # so the level that fits is the highest.
    level = F.max("_level").over(everything)
    return d.withColumn("_final", level).select(
        "source", "source_size",
        F.coalesce(F.least("_cap", F.col("_w") * F.col("_final")), F.col("_cap")).alias("target"),
    )


def systematic_mix(docs: DataFrame, size: Column, source: Column, key: Column, weights: Sequence[float] = (5, 2, 1),
                   share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """Rows (row, source, size, source_size, target, copies): ``row`` is the whole input row.

    A source that holds a third of all rows is numbered in many pieces (source, size
    class, hash), whose counts alone are summed in order; no task sees a whole source.
    Null sources form one source of their own; a null size counts as 0; size-0 documents
    are placed like others but take no words. Repeated rows are separate documents.
    An empty table gives no rows. Reruns agree: order and offset come from hashes.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    d = rowed(docs, source=source, _size=F.coalesce(size, F.lit(0)).cast("long"), _md5=digest)
    d = d.withColumn("_class", _size_class(F.col("_size"))).withColumn("_part", F.substring("_md5", 1, 2))
    pieces = stored(
        d.groupBy("source", "_class", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "mix-pieces")
    targets = source_targets(pieces.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        pieces.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_part").alias("_p"), "_base", "source_size", "target")
    )
    inside = Window.partitionBy("source", "_class", "_part").orderBy("_size", "_md5")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))), 1, 8), 16, 10)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = (
        d.withColumn("_in", F.row_number().over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_part") == F.col("_p")))
        .withColumn("_rank", (F.col("_base") + F.col("_in")).cast("double"))
        .withColumn("_u", offset.cast("double") / F.lit(4294967296.0))
        .withColumn("_rate", rate)
    )
    copies = F.floor(F.col("_rank") * F.col("_rate") + F.col("_u")) - F.floor((F.col("_rank") - 1.0) * F.col("_rate") + F.col("_u"))
    return ranked.select("row", "source", F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"))


def emitted(mix: DataFrame) -> DataFrame:
    """The mixed rows themselves: each input row as often as it has copies."""
    return mix.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    mix = systematic_mix(sized, F.col("size"), F.col("source"), F.col("doc_id"))
    return mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).cast("long").alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS wt,
             2e0 * source_size AS cap FROM s),
r AS (SELECT *, cap / wt AS ratio,
             coalesce(sum(cap) OVER (ORDER BY cap / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS capped,
             coalesce(sum(wt) OVER (ORDER BY cap / wt, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS used,
             1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(wt) OVER () AS wall FROM w),
l AS (SELECT *, (total - capped) / (wall - used) AS level FROM r),
t AS (SELECT source, source_size, coalesce(least(cap, wt * max(level) OVER ()), cap) AS target FROM l),
n AS (SELECT d.*, t.source_size, t.target,
             CAST(row_number() OVER (PARTITION BY d.source ORDER BY
               length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)), substr(h, 1, 2), size, h) AS DOUBLE) AS k,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
             CAST(CAST('0x' || substr(md5('mix|' || coalesce('s' || d.source, 'n')), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296e0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(k * rate + u) - floor((k - 1e0) * rate + u)) * size AS BIGINT) AS taken FROM n
"""
