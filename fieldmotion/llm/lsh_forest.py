"""Near-duplicate documents by an LSH forest over MinHash signatures.

A class (all texts of one word sequence) has a label of DEPTH min-hashes in each of TREES
sorted orders. Classes whose labels agree in the first LEAST places form a region of that
order; inside it neighbours in sorted order share the longest prefixes. In a small region
every two classes are candidates. In a crowded one the depth adapts: only the next
neighbour in label order is, so that no region costs more than in proportion to its size.

Candidates whose bit sketches or sizes cannot belong to a link go at once; the others are
confirmed on the full sets. What the adapted depth may have missed, links between
components that meet in a crowded region, is searched exactly by a prefix join of those
classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmotion.llm.common import parallelism, stored
from fieldmotion.llm.ngram_jaccard import all_pairs, components, merged, verified
from fieldmotion.llm.shingles import mixed, shingle_hashes

#: A pair of Jaccard 0.8 meets in no order with chance (1 - 0.8 ** LEAST) ** TREES, 3e-8.
TREES, DEPTH, LEAST = 24, 6, 3
#: Regions of up to SMALL classes are compared in full, others over NEAR neighbours.
SMALL, NEAR = 32, 1
#: Regions of more classes than PART are dealt to parts by a hash of class and order.
PART = 1 << 16
#: Bits of a sketch, and how many may differ: a pair of 0.8 differs in more with chance 1e-6.
BITS, DIFFER = 128, 32
#: Bytes of a shingle's hash in a stored set; rows and bytes of one step inside a task.
WIDTH, SLICE_BYTES = 6, 2_000_000

_RNG = np.random.Generator(np.random.Philox(key=30_011))
_SALT = _RNG.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


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


def min_hashes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, TREES * DEPTH) least salted hashes of the shingles from each start to the next."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(starts), TREES * DEPTH), np.uint32)
    for i, (salt, factor) in enumerate(zip(_SALT, _FACTOR, strict=True)):
        out[:, i] = np.minimum.reduceat((low ^ salt) * factor, starts)
    return out


def labels(least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(regions, the rest of the label) for each order, and the bit sketch, of min-hashes."""
    short = (mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)
    tree = short.reshape(len(least), TREES, DEPTH)
    joined = lambda x: sum(x[:, :, k] << (16 * (x.shape[2] - 1 - k)) for k in range(x.shape[2]))
    regions = joined(tree[:, :, :LEAST]) | (np.arange(TREES, dtype=np.int64) << 48)
    bits = np.packbits((short[:, :BITS] & 1).astype(np.uint8), axis=1)
    return regions, joined(tree[:, :, LEAST:]), np.ascontiguousarray(bits).view(np.int64)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, sig, n, regions, deeps, k1, k2) per document; no label where the set is empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "sig", "n", "regions", "deeps", "k1", "k2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in _slices(b.column(1).to_pylist()):
                sig, shingles, starts, n = shingle_hashes(part, k)
                regions = np.zeros((len(part), TREES), np.int64)
                deeps, bits = regions.copy(), np.zeros((len(part), 2), np.int64)
                has = np.flatnonzero(np.diff(np.append(starts, len(shingles))) > 0)
                if len(has):
                    regions[has], deeps[has], bits[has] = labels(min_hashes(shingles, starts[has]))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, TREES, dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(part)), pa.array(sig, pa.binary()), pa.array(n), lists(regions), lists(deeps), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, sig binary, n long, regions array<long>, deeps array<long>, k1 long, k2 long")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(sig, set) of every text with words: its sorted distinct shingle hashes, byte by byte."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                sig, shingles, starts, _ = shingle_hashes(part, k)
                ends = np.append(starts[1:], len(shingles))
                seen: dict[bytes, bytes] = {}
                for g, s, e in zip(sig, starts, ends, strict=True):
                    if e > s and g not in seen:
                        seen[g] = packed_set(shingles[s:e])
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["sig", "set"])

    return docs.select("text").mapInArrow(run, "sig binary, set binary")


def packed_set(shingles: np.ndarray) -> bytes:
    """Sorted distinct numbers of WIDTH bytes, one byte place after another."""
    x = np.unique(shingles & np.uint64((1 << 8 * WIDTH) - 1))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].T).tobytes()


def unpacked_set(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(WIDTH, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :WIDTH] = planes.T
    return out.view("<u8").reshape(-1)


def met_in_region(region: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int, small: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j of candidate pairs, rows in crowded regions) of rows in sorted order."""
    first = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    count = np.diff(np.append(first, len(region)))
    crowd = np.repeat(count > small, count)
    left, right = [], []
    for off in range(1, min(max(small, near + 1), len(region))):
        i = np.flatnonzero((region[off:] == region[:-off]) & (~crowd[off:] | (off <= near)))
        if not len(i):
            break
        j = i + off
        less, more = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = 100 * less >= percent * more
        i, j = i[ok], j[ok]
        ok = np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum(axis=1) <= DIFFER
        left.append(i[ok])
        right.append(j[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.flatnonzero(crowd)


def forest(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, region, c): pairs a < b that met in c orders, and crowded classes (b null) by region."""
    rows = classes.select("sig", "n", "k1", "k2", F.explode(F.arrays_zip("regions", "deeps")).alias("z")).select("sig", "n", "k1", "k2", "z.regions", "z.deeps")
    rows = rows.withColumnsRenamed({"regions": "region", "deeps": "deep"})
    huge = rows.groupBy("region").agg(F.count("*").alias("_n")).where(F.col("_n") > PART)
    part = F.coalesce(F.pmod(F.xxhash64("sig", "region"), F.ceil(F.col("_n") / PART)), F.lit(0))
    dealt = rows.join(huge, "region", "left").select("region", part.alias("part"), "deep", "sig", "n", "k1", "k2")
    sorted_rows = dealt.repartition(parallelism(classes), "region", "part").sortWithinPartitions("region", "part", "deep", "sig")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> pa.RecordBatch:
            region, part, n, k1, k2 = (t.column(c).to_numpy() for c in ("region", "part", "n", "k1", "k2"))
            group = np.cumsum(np.concatenate([[False], (region[1:] != region[:-1]) | (part[1:] != part[:-1])]))
            i, j, crowd = met_in_region(group, n, np.stack([k1, k2], axis=1), percent, SMALL, NEAR)
            sig = np.array(t.column("sig").to_pylist(), dtype=object)
            a, b = sig[i], sig[j]
            swap = a > b
            a[swap], b[swap] = b[swap], a[swap]
            return pa.RecordBatch.from_arrays(
                [pa.array([*a, *sig[crowd]], pa.binary()), pa.array([*b, *[None] * len(crowd)], pa.binary()),
                 pa.array([*[None] * len(i), *region[crowd].tolist()], pa.int64())], names=["a", "b", "region"])

        held: list[pa.RecordBatch] = []  # ends with the region that may go on; no region part is much above PART
        for b in batches:
            if not b.num_rows:
                continue
            region, part = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.flatnonzero((region != region[-1]) | (part != part[-1]))
            cut = int(new[-1]) + 1 if len(new) else 0
            if not cut and held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (region[0], part[0]):
                yield emit(pa.Table.from_batches(held))
                held = []
            if cut:
                yield emit(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield emit(pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(run, "a binary, b binary, region long").groupBy("a", "b", "region").agg(F.count("*").alias("c"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("set").alias(c + "t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = unpacked_set(x), unpacked_set(y)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "at", "bt").mapInArrow(run, "a binary, b binary")


def prefix_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, n, base, m, tokens) as the exact join reads them: shingles of two classes or
    more, rarest first, with plain prefixes (m = 1)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [unpacked_set(x) for x in b.column(1).to_pylist()]
            n = np.array([len(x) for x in each], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(each)), n))), pa.array(np.repeat(n, n)),
                                              pa.array(np.concatenate([np.zeros(0, np.uint64), *each]).astype(np.int64))], names=["sig", "n", "token"])

    tokens = sets.select("sig", "set").mapInArrow(run, "sig binary, n long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    order = F.array_sort(F.collect_list(F.struct("df", "token")))
    need = F.ceil(F.col("n") * percent / 100)
    return (tokens.join(often, "token").groupBy("sig", "n").agg(F.transform(order, lambda s: s["token"]).alias("tokens"))
            .select("sig", F.col("n").cast("int").alias("n"), (F.size("tokens") - need + 1).cast("int").alias("base"), F.lit(1).alias("m"), "tokens").where("base > 0"))


def rest_links(sets: DataFrame, with_comp, percent: int) -> DataFrame:
    """All links (a, b) between different components, by an exact prefix join."""
    unique = F.col("n") - F.size("tokens")
    prefix = sets.select("sig", "n", "m", unique.alias("unique"), F.posexplode(F.slice("tokens", F.lit(1), F.least(F.size("tokens"), F.col("base")))).alias("pos", "token"))
    live = stored(with_comp(prefix.withColumn("place", F.col("unique") + F.col("pos") + 1)), "forest-live")
    several = live.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return verified(all_pairs(live.join(several, "token", "left_semi"), percent), sets, percent)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, sig) for every row of documents (doc_id, text).

    component_id is the smallest doc_id reachable by links, its own included; kept where
    it is the document's own. Null, empty and blank texts have no shingles and are linked
    with nothing. Rows that repeat a doc_id each get their row. A null doc_id is never a
    component's smallest unless all are null, and is kept only then. An empty table gives
    no rows. Other columns are not read.
    """
    rows = stored(profiles(docs, k), "forest-profiles")
    members = rows.select("doc_id", "sig", "n")
    every = lambda c: F.first(c).alias(c)
    classes = stored(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), *map(every, ("n", "regions", "deeps", "k1", "k2"))), "forest-classes")
    met = stored(forest(classes, percent), "forest-met")
    pairs, crowded = met.where("b is not null").select("a", "b", "c"), met.where("b is null").select(F.col("a").alias("sig"), "region")
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(crowded.select("sig")).distinct()
    sets = stored(full_sets(docs, k).join(wanted, "sig", "left_semi").groupBy("sig").agg(F.first("set").alias("set")), "forest-sets")

    linked = stored(confirmed(pairs, sets, percent), "forest-links")
    label = None if linked.isEmpty() else components(linked)

    def with_comp(rows: DataFrame) -> DataFrame:
        if label is None:
            return rows.withColumn("comp", F.col("sig"))
        return rows.join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("root", "sig")).drop("root")

    open_regions = with_comp(crowded).groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("region")
    rest = stored(crowded.join(open_regions, "region", "left_semi").select("sig").distinct(), "forest-rest")
    if not rest.isEmpty():
        found = stored(rest_links(stored(prefix_sets(sets.join(rest, "sig", "left_semi"), percent), "forest-rest-sets"), with_comp, percent), "forest-rest-links")
        if not found.isEmpty():
            label = merged(label, found)

    if label is None:
        component = classes.select("sig", F.col("least").alias("component"))
    else:
        rooted = classes.select("sig", "least").join(label.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
        component = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("sig", "component")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return members.join(component, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "sig")


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


OP13_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT DISTINCT x AS node, x AS low FROM e UNION SELECT e.y, r.low FROM r JOIN e ON r.node = e.x WHERE r.low < e.y),
o AS (SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id
      FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = w.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM o
"""
