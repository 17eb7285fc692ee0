import math
import re
from collections import Counter

import numpy as np

from fieldmotion.llm import block_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    each = [(d, split(t)) for d, t in docs]
    each = [(d, w) for d, w in each if w]
    n_docs, n_terms = len(each), sum(len(w) for _, w in each)
    df = Counter(t for _, w in each for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, w in each:
            tf, m = Counter(w), 100 - 50 + 50 * len(w) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(split(text)) if tf[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:50])]
    return out


def some(seed, n, words):
    r = np.random.default_rng(seed)
    pick = lambda k: " ".join(f"w{int(x)}" for x in r.zipf(1.3, k) % words)
    docs = [(i, pick(int(r.integers(1, 60)))) for i in range(n)]
    return docs + [(n, docs[0][1]), (None, docs[0][1]), (n + 1, docs[0][1])], [(i, pick(12)) for i in range(7)]


KEY = lambda x: (str(x[0]), x[1])


def found(spark, docs, items):
    got = block_search.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=KEY)


def test_search_against_brute_force(spark, monkeypatch):
    """Several shards and many blocks, ties and copies."""
    monkeypatch.setattr(block_search, "SHARD", 64)
    monkeypatch.setattr(block_search, "BLOCK", 4)
    docs, items = some(1, 400, 80)
    assert found(spark, docs, items) == sorted(brute(docs, items), key=KEY)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(block_search, "ITEM_BYTES", 100)
    docs, items = some(2, 60, 30)
    assert found(spark, docs, items) == sorted(brute(docs, items), key=KEY)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,-\n"), (4, "Ünï Straße 東京"), (5, "a_b A`B"), (None, "b"), (5, "a_b A`B"), (6, "x " * 50_000 + "東京")]
    items = [(1, "b A"), (1, "b A"), (1, "東京 ÜNÏ ünï Ünï"), (None, "b"), (2, None), (3, ""), (4, "zzz")]
    assert found(spark, docs, items) == sorted(brute(docs, [i for i in items if i[1]]), key=KEY)
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_blocks_are_skipped_only_below_the_bound():
    """Clustered documents: whole blocks are skipped, and no document that could be in the top is."""
    r = np.random.default_rng(4)
    x = np.zeros((2000, 40), np.float32)
    for i in range(2000):
        at = 10 * (i % 4) + r.integers(0, 10, 6)
        x[i, at] = r.integers(1, 1_000_000, 6)
        x[i, 39] = 500_000
    w = np.arange(1, 41)
    terms = np.array([1, 39])
    shard, best = block_search.Shard(x, w, [np.arange(40)] * 40), block_search.Best()
    shard.search(terms, best.least, lambda d, s: best.add(list(range(2000)), d, s))
    scores = x[:, terms].astype(np.int64) @ w[terms]
    want = sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:50]
    assert best.rows == want and shard.skipped > 0
    members, starts, place, top = shard.blocks(39)
    for b, s in enumerate(starts):
        inside = members[s : starts[b + 1] if b + 1 < len(starts) else None]
        assert (top[b] == x[inside].max(axis=0)).all()
