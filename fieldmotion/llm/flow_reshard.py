"""Resharding by minimum-cost flow.

Old shards are sources with their sizes, new shards sinks with their capacities; a byte
that stays costs nothing, one that moves costs one. The cheapest flow says how many
bytes go from each old to each new shard. Documents of an old shard lie in one order in
which equal texts are neighbours; each transfer is a stretch of that order. Only shards
that gain or lose anything are written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import rowed, stored
from fieldmotion.operators.reliable import checkpoint_dir


def cheapest_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that ships all supply within the capacities.

    Successive shortest paths (Bellman-Ford) over a graph of shards only.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities are too small")
    m, n = len(supply), len(capacity)
    flow, left, room = [[0] * n for _ in range(m)], list(supply), list(capacity)
    while any(left):
        far: list[float] = [0.0 if left[i] else float("inf") for i in range(m)] + [float("inf")] * n
        via: list[int | None] = [None] * (m + n)
        for _ in range(m + n):
            moved = False
            for i in range(m):
                for j in range(n):
                    if far[i] + cost[i][j] < far[m + j]:
                        far[m + j], via[m + j], moved = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[m + j] - cost[i][j] < far[i]:
                        far[i], via[i], moved = far[m + j] - cost[i][j], m + j, True
            if not moved:
                break
        end = min((j for j in range(n) if room[j]), key=lambda j: far[m + j])
        path, at = [], m + end
        while via[at] is not None:
            path.append((via[at], at))
            at = via[at]
        amount = min(left[at], room[end], *(flow[b][a - m] for a, b in path if a >= m))
        for a, b in path:
            if a < m:
                flow[a][b - m] += amount
            else:
                flow[b][a - m] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


@dataclass(frozen=True)
class Resharding:
    """``rows``: (row, size, old, shard, slot); ``flow[i][j]``: bytes from old i to new j;
    ``affected``: new shards whose content changes."""

    rows: DataFrame
    flow: list[list[int]]
    affected: list[int]


def reshard(docs: DataFrame, size: Column, key: Column, tie: Column, old: Column, n_old: int, capacity: list[int] | int) -> Resharding:
    """Plan the move of every row from its old to its new shard.

    ``capacity``: bytes each new shard may hold, or the number of new shards of equal
    capacity. ``key`` orders an old shard's rows (equal keys are neighbours), ``tie``
    rows of one key. Sizes are summed by (old shard, part of the order) in two levels, so
    neither a large shard nor a large group of equal texts meets in one task. A row goes
    where its first byte falls, so a shard is off its capacity by less than a row at each
    end of a transfer. Null keys and ties count as empty; an empty table moves nothing.
    """
    text_key, tie_key = F.md5(F.coalesce(key.cast("string"), F.lit(""))), F.md5(F.coalesce(tie.cast("string"), F.lit("")))
    d = rowed(docs, _size=size.cast("long"), _old=old.cast("int"), _k=text_key, _t=tie_key)
    d = d.withColumns({"_p": F.substring("_k", 1, 2), "_q": F.substring("_t", 1, 2)})
    parts = stored(d.groupBy("_old", "_p", "_q").agg(F.sum("_size").alias("_bytes")), "reshard-parts")
    held = {r["_old"]: r["b"] for r in parts.groupBy("_old").agg(F.sum("_bytes").alias("b")).collect()}
    supply = [held.get(i, 0) for i in range(n_old)]
    if isinstance(capacity, int):
        capacity = [sum(supply) // capacity + (j < sum(supply) % capacity) for j in range(capacity)]
    flow = cheapest_flow(supply, capacity, [[int(i != j) for j in range(len(capacity))] for i in range(n_old)])
    spans = []
    for i, row in enumerate(flow):
        start = 0
        for j, b in enumerate(row):
            if b:
                spans.append((i, j, start, start + b))
                start += b
    affected = [j for j in range(len(capacity)) if any(flow[i][j] for i in range(n_old) if i != j) or (j < n_old and flow[j][j] < supply[j])]
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(spans or [(-1, -1, 0, 0)], "_old int, shard int, _from long, _to long"))  # at most old times new shards
    before = Window.partitionBy("_old").orderBy("_p", "_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_base", F.coalesce(F.sum("_bytes").over(before), F.lit(0))).drop("_bytes")
    inside = Window.partitionBy("_old", "_p", "_q").orderBy("_k", "_t", "_size")
    placed = (
        d.withColumn("_in", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
        .join(starts, ["_old", "_p", "_q"]).withColumn("_at", F.col("_base") + F.col("_in"))
        .join(table, ["_old"]).where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    )
    return Resharding(placed, flow, affected)


def with_slots(placed: DataFrame) -> DataFrame:
    """(row, size, old, shard, slot): slots count from 0 without gaps in every shard.

    First slots are joined by (old shard, part) alone, by which the rows, texts included,
    are dealt already: a part has one entry for each shard it goes to, hardly ever two.
    """
    counts = stored(placed.groupBy("shard", "_old", "_p", "_q").agg(F.count("*").alias("_n")), "reshard-counts")
    before = Window.partitionBy("shard").orderBy("_old", "_p", "_q").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .groupBy("_old", "_p", "_q").agg(F.map_from_entries(F.collect_list(F.struct("shard", "_first"))).alias("_firsts")))
    inside = Window.partitionBy("shard", "_old", "_p", "_q").orderBy("_k", "_t", "_size")
    return (placed.withColumn("_nth", F.row_number().over(inside) - 1).join(starts, ["_old", "_p", "_q"])
            .select("row", F.col("_size").alias("size"), F.col("_old").alias("old"), "shard", (F.col("_firsts")[F.col("shard")] + F.col("_nth")).alias("slot")))


def rewrite(numbered: DataFrame, affected: list[int], n_new: int, path: str) -> DataFrame:
    """Write the affected shards to path/shard=j and return all rows: those as read back
    from the new files, and the untouched ones."""
    changed = F.col("shard").isin(affected) if affected else F.lit(False)
    numbered.where(changed).write.partitionBy("shard").parquet(path)
    files = numbered.sparkSession.read.schema(numbered.schema).parquet(path)
    return files if len(affected) == n_new else files.unionByName(numbered.where(~changed))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Six shards by source, which are far from equal, become eight of equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(6))
    plan = reshard(docs, text_bytes(F.col("text")), F.col("text"), F.col("doc_id"), old, 6, 8)
    digest = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    files = rewrite(with_slots(plan.rows), plan.affected, 8, f"{checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")
    return files.select(F.col("row.doc_id").alias("doc_id"), "size", digest.alias("text_crc32"), F.lit("bytes").alias("law"),
                        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
