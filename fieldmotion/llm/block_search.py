"""Ranked lexical search with per-term geometric blocking, exact.

Tasks index their documents in shards. Each posting list of a shard is clustered by the
documents' similarity into blocks, and a block stores the coordinatewise maximum of its
documents' term impacts. An item's sum over that summary bounds every score in the block,
so a block is skipped only where its bound stays below the item's 50th score so far.
All impacts and weights are whole numbers, so bounds and scores are exact.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmotion.llm.common import stored

TOP = 50
#: Postings in a block, about, and places of the sketch that documents are clustered by.
BLOCK, SKETCH = 64, 16
#: Documents of one shard at most, and numbers in its table of impacts.
SHARD, CELLS = 4096, 8_000_000
#: Bytes of items' texts searched in one pass over the documents.
ITEM_BYTES = 1 << 20

_SEPARATOR = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytearray(range(256))
for _c in _SEPARATOR:
    _FOLD[_c] = 0x20
for _c in range(0x41, 0x5B):
    _FOLD[_c] = _c + 0x20
_FOLD = bytes(_FOLD)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text: runs of letters, digits and whatever is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length and how often it
    holds which terms of the vocabulary."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n, found, often = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    hits = [(vocabulary[w], k) for w, k in Counter(words).items() if w in vocabulary]
                    rows.append(i)
                    n.append(len(words))
                    found.append([t for t, _ in hits])
                    often.append([k for _, k in hits])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score, before its weight; at most 1,000,000."""
    if len(n) and 50 * int(n.max()) * n_docs >= 2**63:
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 50 + 50 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Shard:
    """Impacts of some documents (rows) by term (columns), with posting lists in blocks."""

    def __init__(self, x: np.ndarray, w: np.ndarray, asked: list[np.ndarray]):
        self.x, self.w = x, w
        self.peak = x.max(axis=0).astype(np.int64) * w if len(x) else np.zeros(x.shape[1], np.int64)
        weighed = x * w.astype(np.float32)
        spread = np.random.Generator(np.random.Philox(key=12)).standard_normal((x.shape[1], SKETCH)).astype(np.float32)
        self.sketch = weighed @ spread
        self.sketch /= np.maximum(np.linalg.norm(weighed, axis=1), 1)[:, None]
        self.asked = asked
        self.lists: dict[int, tuple] = {}
        self.looked, self.skipped = 0, 0

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents by block, first of each block, place of each term in a summary, summaries)."""
        if t not in self.lists:
            members = np.flatnonzero(self.x[:, t])
            if len(members) > BLOCK:
                pivots = np.random.Generator(np.random.Philox(key=t)).permutation(members)[: -(-len(members) // BLOCK)]
                near = (self.sketch[members] @ self.sketch[pivots].T).argmax(axis=1)
                order = np.argsort(near, kind="stable")
                members, near = members[order], near[order]
                starts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            else:
                starts = np.zeros(1, np.int64)
            columns = self.asked[t]
            place = np.zeros(self.x.shape[1], np.int64)
            place[columns] = np.arange(len(columns))
            whole = self.x[members] if len(columns) * 2 > self.x.shape[1] else None
            rows = whole[:, columns] if whole is not None else self.x[members[:, None], columns]
            self.lists[t] = members, starts, place, np.maximum.reduceat(rows, starts, axis=0).astype(np.int64)
        return self.lists[t]

    def search(self, terms: np.ndarray, least: int, take) -> None:
        """Hand ``take`` all (rows, scores) that may reach ``least``; it returns the new least."""
        w = self.w[terms]
        by_peak = np.argsort(self.peak[terms], kind="stable")
        upto = np.cumsum(self.peak[terms][by_peak])
        seen = np.zeros(len(self.x), bool)
        for k in range(len(terms) - 1, -1, -1):
            if upto[k] < max(least, 1):  # documents with none but these terms stay below
                break
            members, starts, place, top = self.blocks(int(terms[by_peak[k]]))
            bound = top[:, place[terms]] @ w
            size = np.diff(np.append(starts, len(members)))
            self.looked += len(starts)
            order = np.argsort(-bound, kind="stable")
            first = int(np.searchsorted(np.cumsum(size[order]), 2 * TOP)) + 1  # the most promising blocks raise the bar
            for step in (order[:first], order[first:]):
                opened = np.zeros(len(starts), bool)
                opened[step[bound[step] >= least]] = True
                self.skipped += len(step) - int(opened.sum())
                docs = members[np.repeat(opened, size)]
                docs = docs[~seen[docs]]
                if len(docs):
                    seen[docs] = True
                    least = take(docs, self.x[docs[:, None], terms].astype(np.int64) @ w)


class Best:
    """The TOP nearest of one item: highest score first, then smallest doc_id, null last."""

    def __init__(self):
        self.rows: list[tuple] = []

    @property
    def least(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == TOP else 1

    def add(self, ids: list, docs: np.ndarray, scores: np.ndarray) -> int:
        least = self.least
        if len(scores) > TOP:
            least = max(least, int(np.partition(scores, len(scores) - TOP)[len(scores) - TOP]))
        ok = scores >= least
        new = [(-int(s), ids[d] is None, 0 if ids[d] is None else ids[d]) for d, s in zip(docs[ok], scores[ok], strict=True)]
        self.rows = heapq.nsmallest(TOP, [*self.rows, *new])
        return self.least


def _searched(found: DataFrame, items: list[list[int]], w: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of every item, by its place."""
    id_type = found.schema["doc_id"].dataType.simpleString()
    width = len(w)
    asked_sets: list[set] = [set() for _ in range(width)]
    for terms in items:
        for t in terms:
            asked_sets[t].update(terms)
    asked = [np.array(sorted(s), np.int64) for s in asked_sets]
    wanted = [np.array(t, np.int64) for t in items]
    at_once = max(64, min(SHARD, CELLS // max(1, width)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in wanted]
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for s in range(0, b.num_rows, at_once):
                part = b.slice(s, at_once)
                terms, tfs = part.column(2), part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(terms.offsets.to_numpy()))
                n = part.column(1).to_numpy()
                x = np.zeros((part.num_rows, width), np.float32)  # whole numbers up to 10 ** 6, which it holds exactly
                x[row, terms.flatten().to_numpy()] = impacts(tfs.flatten().to_numpy().astype(np.int64), n[row], n_docs, n_terms)
                shard, ids = Shard(x, w, asked), part.column(0).to_pylist()
                for q, t in enumerate(wanted):
                    if len(t):
                        shard.search(t, best[q].least, lambda d, v, q=q: best[q].add(ids, d, v))  # noqa: B023
        rows = [(q, None if r[1] else r[2], -r[0]) for q, x in enumerate(best) for r in x.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())],
                                             names=["item", "doc_id", "score"])

    return found.mapInArrow(run, f"item int, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the TOP documents of every item with a score above 0.

    ``docs``: (doc_id, text), ``items``: (item_id, text). Items are read in blocks of
    ITEM_BYTES, each in one pass over all documents; the driver holds one block's terms.
    Rows that repeat an item's id and text count once; other texts under its id are
    ranked on their own. Every row of documents is a document of its own; a null doc_id
    comes after all others of its score. Null, empty and term-less texts neither find nor
    are found. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    size = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    n_blocks = -(-size // ITEM_BYTES) or 1
    chosen = stored(items.select("item_id", "text").where("text is not null").distinct().withColumn("_b", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "search-items")
    out = None
    for block in range(n_blocks):
        rows = chosen.where(F.col("_b") == block).orderBy("item_id", "text").collect()  # about ITEM_BYTES
        vocabulary: dict[bytes, int] = {}
        asked = [[vocabulary.setdefault(t, len(vocabulary)) for t in dict.fromkeys(terms_of(r["text"]))] for r in rows]
        if not vocabulary:
            continue
        found = stored(vectors(docs, vocabulary), "search-vectors")
        whole = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not whole["n"]:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        w = np.array([weight(whole["n"], int(d)) for d in df], np.int64)
        best = _searched(found, asked, w, whole["n"], whole["terms"])
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = best.withColumn("rank", place).where(F.col("rank") <= TOP).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"item_id {kind(items, 'item_id')}, rank int, doc_id {kind(docs, 'doc_id')}, score long")


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s GROUP BY term),
v AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM f JOIN g USING (term) JOIN i USING (term), s GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM v WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
