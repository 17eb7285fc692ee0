"""The prefix trie of conversations by recursion at half depth (van Emde Boas' cut).

A window of turns is cut in the middle. What is above the cut goes on as the upper trie,
under the same start name; the cut prefix gets a name made of the start's and of the
upper half's digest, and that name is the start of the forest below. Names depend on
content alone, so all windows of one height are cut side by side: blocks of a
conversation are named inside tasks, and the same cut is applied to the sequence of block
digests. Equal prefixes have equal names whoever computes them; one shuffle by name then
makes nodes.

A node belongs to its smallest member. The nodes a conversation owns are the lower end of
its path, since a prefix has no larger smallest member than what continues it. Totals are
added up along that lower end, block by block, and grafted onto the nodes above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import parallelism, stored

#: Conversations share the start of the first of every FAMILY ids, less than HEADS turns.
FAMILY, HEADS = 5, 9
#: Turns of one block of a conversation are 2 ** BITS; member ids hashed in one piece.
BITS, PIECE = 10, 50_000
#: The name of the empty prefix.
ROOT = bytes(16)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def cut_names(start: bytes, digests: list[bytes], height: int) -> tuple[list[bytes], bytes | None]:
    """(names of the prefixes with 0, 1, ... of these turns, digest of the full window).

    ``height`` is a power of two and at least the number of turns. In a full window the
    last prefix belongs to the next window and has no name here.
    """
    n, names = len(digests), [start] * min(len(digests) + 1, height)

    def visit(start: bytes, lo: int, hi: int) -> bytes | None:
        if hi - lo == 1:
            names[lo] = start
            return digests[lo] if lo < n else None
        mid = (lo + hi) // 2
        upper = visit(start, lo, mid)
        if upper is None or mid > n:
            return None
        if mid == n:
            if mid < height:
                names[mid] = _digest(start, upper)
            return None
        lower = visit(_digest(start, upper), mid, hi)
        return None if lower is None else _digest(upper, lower)

    return names, visit(start, 0, height)


def _by_group(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a group of ``keys`` ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(b.schema.get_field_index(k))[-1].as_py() for k in keys]
        cut = b.num_rows
        while cut and [b.column(b.schema.get_field_index(k))[cut - 1].as_py() for k in keys] == last:
            cut -= 1
        if not cut and held and [held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() for k in keys] != last:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, dig, bytes): every turn's place in its conversation, by turn (null
    first), role and text.

    Rows are dealt by ranges of the order, so a conversation of any length is many tasks;
    counts of the parts before give the places.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumns({"dig": F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32)), "bytes": F.octet_length("text").cast("long")})
    rows = rows.withColumn("_same", F.monotonically_increasing_id())  # equal rows can be cut apart
    order = ["conv_id", "turn", "role", "text", "_same"]
    sorted_rows = rows.repartitionByRange(parallelism(turns), *order).sortWithinPartitions(*order).select("conv_id", "dig", "bytes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids, place = b.column(0).to_pylist(), []
            for c in ids:
                n = n + 1 if c == conv else 0
                conv = c
                place.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(place, pa.int64()), b.column(1), b.column(2)],
                                             names=["conv_id", "part", "place", "dig", "bytes"])

    placed = stored(sorted_rows.mapInArrow(run, "conv_id long, part int, place long, dig binary, bytes long"), "trie-turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = parts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")  # at most one row a part
    return placed.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "dig", "bytes")


def shared_turns(c: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id), (conv_id, pos, dig, bytes)): conversations that start as the first
    of their family does and go on with their own turns."""
    own = stored(numbered(turns), "trie-own")
    length = stored(own.groupBy("conv_id").agg((F.max("pos") + 1).alias("own_n")), "trie-lengths")
    base = length.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    convs = length.withColumns({"h": shared_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(base, "base", "left")
    convs = stored(convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "base", "h", "taken"), "trie-convs")
    heads = own.where(F.col("pos") < HEADS - 1).withColumnRenamed("conv_id", "base")
    first = convs.where("taken > 0").join(heads, "base").where("pos < taken").select("conv_id", "pos", "dig", "bytes")
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "dig", "bytes")
    return convs.select("conv_id"), stored(first.union(rest), "trie-paths")


def prefix_names(seqs: DataFrame, longest: int) -> DataFrame:
    """(conv_id, pos, parent, name): of every prefix that ends with element ``pos``, and of
    the one before it, in sequences (conv_id, pos, dig) of at most ``longest`` elements."""
    rows = seqs.select("conv_id", F.shiftright("pos", BITS).alias("block"), "pos", "dig")
    height = 1 << BITS
    starts = None
    if longest > height:
        digest = _blocks(rows.withColumns({"start": F.lit(None).cast("binary"), "next": F.lit(None).cast("binary")}), digests_only=True)
        named = prefix_names(digest.select("conv_id", F.col("block").alias("pos"), F.col("name").alias("dig")), -(-longest // height))
        starts = stored(named.select("conv_id", F.col("pos").alias("block"), F.col("parent").alias("start"), F.col("name").alias("next")), "trie-starts")
        rest = named.groupBy("conv_id").agg(F.max_by("name", "pos").alias("start"), (F.max("pos") + 1).alias("block"))  # the last block need not be full
        starts = starts.union(rest.select("conv_id", "block", "start", F.lit(None).cast("binary").alias("next")))
        rows = rows.join(starts, ["conv_id", "block"], "left")
    else:
        rows = rows.withColumns({"start": F.lit(None).cast("binary"), "next": F.lit(None).cast("binary")})
    return _blocks(rows.withColumn("start", F.coalesce("start", F.lit(bytearray(ROOT)))), digests_only=False)


def _blocks(rows: DataFrame, digests_only: bool) -> DataFrame:
    """Names, or the digests of full blocks, of (conv_id, block, pos, dig, start, next)."""
    dealt = rows.select("conv_id", "block", "pos", "dig", "start", "next").repartition(parallelism(rows), "conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    height, mask = 1 << BITS, (1 << BITS) - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, ("conv_id", "block")):
            conv, block, pos, dig, start, after = (t.column(i).to_pylist() for i in range(6))
            out: tuple[list, ...] = ([], [], [], [], [])
            for s, e in _runs(list(zip(conv, block, strict=True))):
                names, whole = cut_names(start[s] or ROOT, dig[s:e], height)
                if digests_only:
                    if whole is not None:
                        for c, v in zip(out, (conv[s], block[s], None, None, whole), strict=True):
                            c.append(v)
                    continue
                if e - s == height:
                    names.append(after[s] if after[s] is not None else _digest(names[0], whole))
                for k in range(s, e):
                    at = pos[k] & mask
                    for c, v in zip(out, (conv[k], block[k], pos[k], names[at], names[at + 1]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                             names=["conv_id", "block", "pos", "parent", "name"])

    return dealt.mapInArrow(run, "conv_id long, block long, pos long, parent binary, name binary")


def grafted(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(name, n_leaves, saved_tokens): totals over each node's subtree, from nodes (name,
    conv_id, depth, leaf, saved) and paths (conv_id, depth, name)."""
    block = lambda c: F.shiftright(c, BITS)
    own = nodes.select("name", "conv_id", "depth", block("depth").alias("block"), "leaf", "saved")
    sums = own.groupBy("conv_id", "block").agg(F.sum("leaf").alias("bl"), F.sum("saved").alias("bs"))
    below = Window.partitionBy("conv_id").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("bl", "bs")])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    lower = own.withColumns({"l": F.sum("leaf").over(inside), "s": F.sum("saved").over(inside)}).join(sums, ["conv_id", "block"])
    lower = lower.select("name", (F.col("l") + F.col("bl")).alias("l"), (F.col("s") + F.col("bs")).alias("s"))
    owners = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("l"), F.sum("saved").alias("s")).where("top > 0")
    owners = owners.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), block(F.col("top") - 1))))
    upper = paths.withColumn("block", block("depth")).join(owners, ["conv_id", "block"]).where("depth < top").select("name", "l", "s")
    return lower.union(upper).groupBy("name").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): pieces of the ordered ids are joined side by
    side, then a node's pieces are hashed one after another."""
    n = parallelism(ends)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, conv = b.column(0).to_pylist(), b.column(1).to_pylist()
            spans = [(s + k, min(e, s + k + PIECE)) for s, e in _runs(name) for k in range(0, e - s, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([name[s] for s, _ in spans], pa.binary()), pa.array([conv[s] for s, _ in spans], pa.int64()),
                                              pa.array([",".join(map(str, conv[s:e])) for s, e in spans], pa.string())], names=["name", "first", "ids"])

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for b in batches:
            done = []
            for m, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if m != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = m, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])

    parts = ends.select("name", "conv_id").repartitionByRange(n, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(pieces, "name binary, first long, ids string")
    return parts.repartition(n, "name").sortWithinPartitions("name", "first").mapInArrow(hashes, "name binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Null roles and texts are empty ones; a null turn comes first; equal turns go by role,
    then text, and repeated rows are turns of their own. Rows without a conv_id belong to
    no conversation. Without conversations there is no root and no row. Other columns are
    not read.
    """
    convs, seqs = rebuilt(turns)
    longest = seqs.agg(F.max("pos").alias("p")).first()["p"]
    root = F.lit(bytearray(ROOT))
    named = stored(prefix_names(seqs, (longest or 0) + 1).select("conv_id", (F.col("pos") + 1).alias("depth"), "parent", "name"), "trie-names")
    size = seqs.select("conv_id", (F.col("pos") + 1).alias("depth"), "bytes")
    known = named.groupBy("name").agg(F.count("*").alias("n_convs"), F.min(F.struct("conv_id", "depth", "parent")).alias("top"))
    known = known.select("name", "n_convs", "top.*").join(size, ["conv_id", "depth"]).select("name", "parent", "depth", "conv_id", "n_convs", "bytes")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root.alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    known = stored(known.union(top), "trie-nodes")
    children = known.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = stored(known.join(children, "name", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "trie-family")

    paths = named.select("conv_id", "depth", "name")
    whole = nodes.where("depth > 0")
    totals = grafted(whole, paths).union(nodes.agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s")).where("l is not null").select(root.alias("name"), "l", "s"))
    last = paths.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("name", root).alias("name"), "conv_id")
    up = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "name").join(ends_hashes(ends), "name", "left").join(up, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op11_query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The checksum of zip files, 8 shifts a byte, with its fixed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST({c} AS VARCHAR)) + 1), lambda i: CAST(unicode(CAST({c} AS VARCHAR)[i]) AS BIGINT))),
  lambda x, y: list_reduce(list_prepend(xor(x, y), CAST(range(8) AS BIGINT[])), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY p) AS w FROM t GROUP BY c),
h AS (SELECT c, w, CAST({_CRC.format(c='c')} AS BIGINT) % 9 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
p AS (SELECT c, len(w) AS n, unnest(range(0, len(w) + 1)) AS depth, w FROM r),
n AS (SELECT w[1:depth] AS k, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY w[1:depth]),
q AS (SELECT *, CASE WHEN depth > 0 THEN k[1:depth - 1] END AS up, CASE WHEN depth > 0 THEN strlen(k[depth].text) ELSE 0 END * (n_convs - 1) AS saved FROM n),
f AS (SELECT q.*, coalesce(m.n_children, 0) AS n_children FROM q LEFT JOIN (SELECT up, count(*) AS n_children FROM q WHERE depth > 0 GROUP BY up) m ON m.up = q.k),
g AS (SELECT a.k, CAST(sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens
      FROM (SELECT k, depth, unnest(range(0, depth + 1)) AS d, n_children, saved FROM f) b JOIN f a ON a.depth = b.d AND a.k = b.k[1:b.d] GROUP BY a.k)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, g.n_leaves, g.saved_tokens, f.ends_sha256
FROM f JOIN g ON g.k = f.k LEFT JOIN f u ON u.k = f.up
"""
