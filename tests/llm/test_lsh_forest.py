import numpy as np
import pytest

from fieldmotion.llm import lsh_forest
from fieldmotion.llm.shingles import shingle_hashes
from tests.llm.test_llm import empty, odd_docs, words


def brute(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def planted(seed, n, bases):
    r = np.random.default_rng(seed)
    base, rows = [[f"w{r.integers(400)}" for _ in range(r.integers(3, 80))] for _ in range(bases)], []
    for d in range(n):
        w = list(base[r.integers(bases)])
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = f"x{r.integers(30)}"
        rows.append((d, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "bases"), [(1, 20), (2, 2)])
def test_forest_against_brute_force(spark, seed, bases):
    """Many small regions, and few crowded ones whose depth adapts."""
    rows = planted(seed, 160, bases)
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x)[:4] for x in got.collect()) == brute(rows)


def test_crowded_regions_in_parts(spark, monkeypatch):
    """Regions cut in parts and compared over one neighbour lose no link."""
    for name, value in (("PART", 16), ("SMALL", 2), ("NEAR", 1)):
        monkeypatch.setattr(lsh_forest, name, value)
    rows = planted(3, 120, 3)
    got = lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(x)[:4] for x in got.collect()) == brute(rows)


def test_forest_odd_rows(spark):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.near_duplicates(odd_docs(spark)).collect())
    assert ("3", 0, 3, True) in got and ("5", 0, 5, True) in got and got.count(("2", 9, 1, False)) == 2 and ("None", 9, 1, False) in got
    assert ("8", 10, 1, False) in got
    assert lsh_forest.near_duplicates(empty(spark)).count() == 0


def test_shingle_hashes_count_sets():
    texts = ["A b\tc d e f a B c d e", "a b", "", "x " * 40, "a B"]
    sig, _, starts, n = shingle_hashes([t.encode() for t in texts], 4)
    assert n.tolist() == [6, 1, 0, 1, 1] and sig[1] == sig[4] and len(set(sig)) == 4 and starts[0] == 0


def test_sets_survive_packing():
    x = np.array([5, 1, 2**47, 5, 255, 256], np.uint64)
    assert lsh_forest.unpacked_set(lsh_forest.packed_set(x)).tolist() == [1, 5, 255, 256, 2**47]


def test_small_regions_meet_in_full_and_crowded_ones_by_neighbours():
    region = np.repeat([1, 2], [5, lsh_forest.SMALL + 8])
    i, j, crowd = lsh_forest.met_in_region(region, np.full(len(region), 10), np.zeros((len(region), 2), np.int64), 80, lsh_forest.SMALL, lsh_forest.NEAR)
    assert sum((a < 5) for a in i) == 10 and len(crowd) == lsh_forest.SMALL + 8
    assert max(b - a for a, b in zip(i, j, strict=True) if a >= 5) == lsh_forest.NEAR
