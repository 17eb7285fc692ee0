"""Near-duplicate documents by an n-gram Jaccard join with adaptive multi-match prefixes.

Shingles are put in one global order, rarest first. Two sets with enough overlap share
at least m tokens of their prefixes when each prefix is m - 1 tokens longer than the
usual one. Every document picks its own m by the estimated cost of the candidates its
prefix would bring; a pair is verified only if it shares the smaller m of the two.

Steps: (1) documents with equal word sequences become one class; (2) a shuffle by hash
range counts in how many classes each shingle occurs; shingles of one class can match
nothing, so only the others go back to their documents; (3) candidates from prefixes,
verified on whole sets, give links; (4) links give components.

Only the components are asked for, so links inside a component already found need no
check. Rounds of one leader per shingle first join most of each group in linear work;
all remaining pairs between different components are then joined in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import parallelism, stored
from fieldmotion.llm.shingles import counted_shingle_sets, shingle_sets

#: Bytes of text hashed at once, and shingles sorted at once, in one task.
SLICE_BYTES, CHUNK = 1_000_000, 500_000
#: Postings that one group of the counting shuffle holds, besides those of single shingles.
GROUP = 1_000_000
#: Shingles in more than one class of HOT_SHARE are counted apart; there can be at most HOT_MOST.
HOT_SHARE, HOT_MOST = 256, 1 << 20
LONGEST = 8
#: Leader rounds go on while each links at least one in so many of the classes left.
LEAST_GAIN = 200
#: Leaders of a token, and leaders that a class is compared with, in one round.
SLOTS, LEADERS = 8, 12


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    part, size, start = [], 0, 0
    for i, t in enumerate(texts):
        part.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(part[-1])
        if size >= SLICE_BYTES:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def _local_hot(sets: dict[int, np.ndarray]) -> bytes:
    """(shingle, classes) of shingles that a large part of these classes has."""
    if not sets:
        return b""
    tokens, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    often = n >= max(4, len(sets) // (2 * HOT_SHARE))
    return np.stack([tokens[often], n[often].astype(np.uint64)]).tobytes()


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, sig, n, hot): one row per document, and rows with ``hot`` alone."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "sig", "n", "hot"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        size = 0
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for start, part in _slices(b.column(1).to_pylist()):
                sig, sets = shingle_sets(part, k)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array(sig.view(np.int64)), pa.array(n), pa.nulls(len(part), pa.binary())], names=names)
                for g, s in zip(sig.tolist(), sets, strict=True):
                    if len(s) and g not in seen:
                        seen[g] = s
                        size += len(s)
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_local_hot(seen)], pa.binary())], names=names)
                    seen, size = {}, 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_local_hot(seen)], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, sig long, n long, hot binary")


def hot_shingles(rows: DataFrame, n_classes: int, n_shingles: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many tasks found common, with their summed counts; at most
    HOT_MOST + 1, since that many cannot each hold a HOT_MOST-th of all shingles."""
    least = max(n_classes // HOT_SHARE, n_shingles // HOT_MOST, 64)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b["hot"]:
                t = np.frombuffer(x, np.uint64).reshape(2, -1)
                yield pd.DataFrame({"token": t[0].astype(np.int64), "n": t[1].astype(np.int64)})

    got = (rows.where("hot is not null").select("hot").mapInPandas(split, "token long, n long")
           .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("token").toPandas())
    return got["token"].to_numpy(np.uint64), got["n"].to_numpy(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte, which compresses when sorted."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unplanes(raw: bytes, width: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def postings(docs: DataFrame, k: int, groups: int, hot: np.ndarray) -> DataFrame:
    """(bucket, entries, tokens, owner, sigs, sizes): the shingles of a task's classes by hash range.

    ``owner`` points into ``sigs``. Negative buckets hold the hot shingles, spread by task
    chunk and not by value. Classes of fewer than k words take no part: they have one
    shingle that nothing but an equal sequence has.
    """
    names = ["bucket", "entries", "tokens", "owner", "sigs", "sizes"]

    def flush(seen: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
        sigs = np.array(list(seen), np.uint64)
        sizes = np.array([len(s) for s in seen.values()], np.int64)
        tokens, owner = np.concatenate(list(seen.values())), np.repeat(np.arange(len(seen)), sizes)
        is_hot = np.isin(tokens, hot)
        rows: list[tuple] = []

        def add(bucket: int, t: np.ndarray, o: np.ndarray) -> None:
            used, o = np.unique(o, return_inverse=True)
            rows.append((bucket, len(t), _planes(t, 7), _planes(o, 3), sigs[used].tobytes(), sizes[used].tobytes()))

        if is_hot.any():
            add(-1 - salt % groups, tokens[is_hot], owner[is_hot])
        tokens, owner = tokens[~is_hot], owner[~is_hot]
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        edges = np.searchsorted(tokens, [(i << 56) // groups for i in range(groups)] + [1 << 56])
        for i in range(groups):
            if edges[i] < edges[i + 1]:
                add(i, tokens[edges[i] : edges[i + 1]], owner[edges[i] : edges[i + 1]])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        size = 0
        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                for g, s, n in zip(*counted_shingle_sets(part, k), strict=True):
                    if n >= k and int(g) not in seen:
                        seen[int(g)] = s
                        size += len(s)
                if size >= CHUNK:
                    yield flush(seen, next(iter(seen)) >> 8)
                    seen, size = {}, 0
        if seen:
            yield flush(seen, next(iter(seen)) >> 8)

    return docs.select("text").mapInArrow(run, "bucket int, entries int, tokens binary, owner binary, sigs binary, sizes binary")


def shared(posted: DataFrame, hot: np.ndarray, hot_n: np.ndarray) -> DataFrame:
    """(sig, n, token, df) for every shingle that two classes or more have."""

    def decode(d: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, sigs, sizes = [], [], []
        for r in d.itertuples():
            o = _unplanes(r.owner, 3, r.entries)
            tokens.append(_unplanes(r.tokens, 7, r.entries))
            sigs.append(np.frombuffer(r.sigs, np.uint64)[o])
            sizes.append(np.frombuffer(r.sizes, np.int64)[o])
        return np.concatenate(tokens), np.concatenate(sigs), np.concatenate(sizes)

    def run(key, d):
        tokens, sigs, sizes = decode(d)
        if key[0] < 0:
            df = hot_n[np.searchsorted(hot, tokens)]
        else:
            order = np.argsort(tokens, kind="stable")
            same = np.diff(tokens[order]) == 0
            order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            order = order[np.lexsort((sigs[order], tokens[order]))]
            tokens, sigs, sizes = tokens[order], sigs[order], sizes[order]
            once = np.ones(len(tokens), bool)
            once[1:] = (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])  # a class that several tasks met
            tokens, sigs, sizes = tokens[once], sigs[once], sizes[once]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, int)
            n = np.diff(np.append(first, len(tokens)))
            df = np.repeat(n, n)
            tokens, sigs, sizes, df = tokens[df > 1], sigs[df > 1], sizes[df > 1], df[df > 1]
        return pd.DataFrame({"sig": sigs.astype(np.int64), "n": sizes.astype(np.int32), "token": tokens.astype(np.int64), "df": df.astype(np.int64)})

    return posted.groupBy("bucket").applyInPandas(run, "sig long, n int, token long, df long")


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Tokens that a set of n must share at least with any partner."""
    return -(-percent * n // 100)


def choose_matches(n: int, unique: int, df: np.ndarray, percent: int) -> int:
    """The number m of prefix tokens to share that makes a document's candidates cheapest.

    ``df``: classes of each of its non-unique shingles, ascending. The estimate takes a
    partner of the same size, as most candidates nearly are. A prefix for m brings one
    row per posting of its tokens, and at most rows / m pairs to verify.
    """
    rows = np.concatenate([[0], np.cumsum(df - 1)])
    plain = n - needed(n, percent) + 1 - unique
    equal = n + -2 * n * percent // (100 + percent) + 1 - unique
    most = max(1, min(LONGEST, needed(n, percent), len(df) - plain + 1))
    cost = [rows[min(len(df), max(0, equal + m - 1))] * (1 + (1 + n / 100) / m) for m in range(1, most + 1)]
    return 1 + int(np.argmin(cost))


def linkable(tokens: DataFrame, percent: int, groups: int) -> DataFrame:
    """(sig, n, skip, base, m, tokens) of classes with a non-unique shingle in their prefix.

    ``tokens``: non-unique shingles in global order (rarest first, then by hash), of which
    the first ``base`` are in the plain prefix and the first base + m - 1 in its own.
    """

    def run(key, d):
        sig, n, token, df = (d[c].to_numpy() for c in ("sig", "n", "token", "df"))
        order = np.lexsort((token, df, sig))
        sig, n, token, df = sig[order], n[order], token[order], df[order]
        once = np.ones(len(sig), bool)
        once[1:] = (sig[1:] != sig[:-1]) | (token[1:] != token[:-1])
        sig, n, token, df = sig[once], n[once], token[once], df[once]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        out = []
        for s, e in zip(first, np.append(first[1:], len(sig)), strict=True):
            size, unique = int(n[s]), int(n[s]) - int(e - s)
            base = size - int(needed(size, percent)) + 1 - unique
            if base > 0:
                out.append((sig[s], size, base, choose_matches(size, unique, df[s:e], percent), token[s:e]))
        return pd.DataFrame(out, columns=["sig", "n", "base", "m", "tokens"])

    return tokens.withColumn("_g", F.pmod(F.hash("sig"), F.lit(groups))).groupBy("_g").applyInPandas(
        run, "sig long, n int, base int, m int, tokens array<long>")


def _compatible(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    x = sets.select(F.col("sig").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    y = sets.select(F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))
    both = F.size(F.array_intersect("at", "bt"))
    return pairs.select("a", "b").join(y, "b").join(x, "a").where(100 * both >= percent * (F.col("an") + F.col("bn") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, by least neighbours and pointer jumping."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).where("x <> y").distinct(), "edges")
    label = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("root").alias("yr")), "y").groupBy(F.col("x").alias("node")).agg(F.min("yr").alias("yr"))
        hop = label.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "yr").alias("r"))
        up = label.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = stored(hop.join(up, "r", "left").select("node", "was", F.least("r", F.coalesce("rr", "r")).alias("root")), "labels")
        label = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return label


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked with another."""
    prefix = stored(
        sets.select("sig", "n", "m", (F.col("n") - F.size("tokens")).alias("unique"),
                    F.posexplode(F.slice("tokens", F.lit(1), F.least(F.size("tokens"), F.col("base") + F.col("m") - 1))).alias("pos", "token"))
        .select("token", "sig", "n", "m", "unique", (F.col("unique") + F.col("pos") + 1).alias("place")), "prefixes")
    label, turn, leaders = None, 0, True
    while True:
        p = prefix.withColumn("comp", F.col("sig")) if label is None else (
            prefix.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root"))
        mixed = p.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
        live = stored(p.join(mixed, "token"), "live")
        if not leaders:
            found = stored(verified(all_pairs(live, percent), sets, percent), "links")
            return label if found.isEmpty() else merged(label, found)
        found = stored(verified(leader_pairs(live, percent, turn), sets, percent), "links")
        size = live.agg(F.countDistinct("sig").alias("n")).first()["n"]
        # Once a round joins few of the classes left, joining all that is left costs less.
        gain = found.count()
        leaders, turn = gain * LEAST_GAIN > size, turn + 1
        if gain:
            label = merged(label, found)


def leader_pairs(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """At most LEADERS pairs a class, linear in the rows whatever a token's classes.

    Every token has one leader in each of SLOTS slots of its classes, others in every
    turn. A class may lead many tokens, so that the count of shared tokens tells the
    nearest leaders. Even turns favour classes with few shingles of their own, since
    those are near to most of their group.
    """
    chance = (F.shiftrightunsigned(F.xxhash64("sig", F.lit(turn)), 11) + 1) / float(1 << 53)
    order = chance if turn % 2 else chance * (F.col("unique") + 1) / F.col("n")
    slot = F.pmod(F.hash("sig", F.lit(turn)), F.lit(SLOTS))
    first = F.min(F.struct(order.alias("o"), F.col("sig").alias("a"), F.col("comp").alias("ac"), F.col("n").alias("an")))
    lead = live.groupBy("token", slot.alias("slot")).agg(first.alias("l")).select("token", "l.a", "l.ac", "l.an")
    pairs = (live.join(lead, "token").where((F.col("comp") != F.col("ac")) & _compatible("n", "an", percent))
             .groupBy(F.col("sig").alias("b"), "a").agg(F.count("*").alias("c")))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), F.xxhash64("a", "b", F.lit(turn))))
    return pairs.withColumn("_r", best).where(F.col("_r") <= LEADERS).select("a", "b")


def all_pairs(live: DataFrame, percent: int) -> DataFrame:
    """Every pair of classes in different components that can still be similar enough.

    A pair that needs an overlap of ``need`` and shares the smaller m of the two in its
    prefixes has those tokens among the first n - need + m places of both sets, so longer
    prefixes meet only where both sizes ask for it. At each shared token, what precedes
    it (without the shingles nobody else has) and what follows it must reach the need.
    """
    side = lambda x: [F.col("sig").alias(x), *[F.col(c).alias(x + c) for c in ("n", "m", "place", "unique", "comp")]]
    x, y = live.select("token", *side("a")), live.select("token", *side("b"))
    m = F.least("am", "bm")
    need = F.ceil((F.col("an") + F.col("bn")) * percent / (100 + percent))
    inside = lambda s: F.col(s + "place") <= F.col(s + "n") - need + m
    before = F.least(F.col("aplace") - F.col("aunique"), F.col("bplace") - F.col("bunique"))
    after = F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace"))
    a_less = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    met = x.join(y, "token").where(
        a_less & (F.col("acomp") != F.col("bcomp")) & _compatible("an", "bn", percent) & inside("a") & inside("b") & (before + after >= need))
    return (met.groupBy("a", "b", "am", "bm").agg(F.count("*").alias("c")).where(F.col("c") >= m).select("a", "b"))


def merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (node, root) after new links; links of known components join their roots."""
    if label is None:
        return components(found)
    at = lambda c, r: label.select(F.col("node").alias(c), F.col("root").alias(r))
    raised = found.join(at("a", "ar"), "a", "left").join(at("b", "br"), "b", "left").select(F.coalesce("ar", "a").alias("a"), F.coalesce("br", "b").alias("b"))
    top = components(raised)
    moved = label.join(top.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = top.join(label.select("node"), "node", "left_anti")
    return stored(moved.union(fresh), "labels")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, sig) for every row of documents (doc_id, text).

    component_id is the smallest doc_id reachable by links, its own included. Null and
    empty texts have no shingles and are linked with nothing, not even each other. Rows
    that repeat a doc_id each get their row. A null doc_id is never a component's
    smallest unless all are null. An empty table gives no rows.
    """
    rows = stored(classes(docs, k), "classes")
    members = rows.where("hot is null").select("doc_id", "sig", "n")
    each = stored(members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "class-sizes")
    size = each.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    groups = max(parallelism(docs), -(-size["shingles"] // GROUP))
    hot, hot_n = hot_shingles(rows, size["classes"], size["shingles"])
    tokens = shared(postings(docs, k, groups, hot), hot, hot_n)
    sets = stored(linkable(tokens, percent, groups), "sets")
    label = links(sets, percent)
    if label is None:
        least = each.select("sig", F.col("least").alias("component"))
    else:
        rooted = each.join(label.withColumnRenamed("node", "sig"), "sig").select("sig", "root", "least")
        top = rooted.groupBy("root").agg(F.min("least").alias("component"))
        joined = rooted.join(top, "root").select("sig", "component")
        least = stored(each.select("sig", "least").join(joined, "sig", "left").select("sig", F.coalesce("component", "least").alias("component")), "class-components")
    return members.join(least, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "sig")


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP1_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS node, x AS low FROM e UNION SELECT e.y, r.low FROM r JOIN e ON r.node = e.x WHERE r.low < e.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = w.doc_id
"""
