import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fieldmotion.llm import prefix_trie


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(original.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    below = defaultdict(list)
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    children = {k: sum(len(x) == len(k) + 1 for x in below[k]) for k in members}
    saved = lambda k: (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], sum(children[x] == 0 for x in below[k]), sum(map(saved, below[k])),
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def found(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth long, name string"))
    return sorted(tuple(r) for r in got.collect())


def some(seed, n, longest):
    r = np.random.default_rng(seed)
    rows = []
    for c in r.choice(1000, n, replace=False).tolist():
        for t in range(int(r.integers(1, longest))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"t{int(r.integers(0, 2))}é", 1, "n"))
    return rows


@pytest.mark.parametrize(("bits", "longest"), [(10, 9), (1, 14), (2, 40)])
def test_trie_against_brute_force(spark, monkeypatch, bits, longest):
    """One block a conversation, and blocks of two and four turns that the recursion names in tiers."""
    monkeypatch.setattr(prefix_trie, "BITS", bits)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = some(bits, 60, longest)
    assert found(spark, rows) == brute([r[:4] for r in rows])


def test_odd_conversations(spark):
    rows = [(0, None, None, None), (0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, None, "x"), (1, 5, "a", ""), (3, 0, "", ""), (-4, 0, "a", "x"), (-4, 2, "b", "y"),
            (None, 0, "a", "x"), (2**60 + 1, 0, "a", "long " * 50_000), (7, 3, "u", "q"), (7, 3, "u", "q"), (1002, None, None, "")]
    assert found(spark, [(*r, None, None) for r in rows]) == brute(rows)
    assert found(spark, []) == []


def test_names_depend_on_content_alone():
    r = np.random.default_rng(1)
    digests = [r.bytes(16) for _ in range(16)]
    full, whole = prefix_trie.cut_names(prefix_trie.ROOT, digests, 16)
    assert len(full) == 16 == len(set(full)) and whole is not None
    for n in range(16):
        names, part = prefix_trie.cut_names(prefix_trie.ROOT, digests[:n], 16)
        assert part is None and names == (full + [None])[: n + 1] and (n == 0 or names[-1] != full[n - 1])
