"""Ranking, assignment, sampling, lines, teams and sources."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog import QUERIES
from catalog.fixtures import Fixtures
from fieldmotion.operators import assign as A
from fieldmotion.operators import lines as L
from fieldmotion.operators import ranking as K
from fieldmotion.operators import rejects as X
from fieldmotion.operators import sampling as P
from fieldmotion.operators.histograms import histogram_1d
from fieldmotion.operators import teams
from fieldmotion.operators.planar import fit_similarity
from fieldmotion.operators.teams import split_at_median
from fieldmotion.plans import field_mapping as M
from fieldmotion.sources import files as IO


@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_matching_is_the_cheapest(n, m, rnd):
    cost = np.array([[float(rnd.randint(0, 20)) for _ in range(m)] for _ in range(n)])
    got = sum(cost[r, c] for r, c in A.cheapest_matching(cost))
    short, long_ = (n, m) if n <= m else (m, n)
    table = cost if n <= m else cost.T
    assert got == min(sum(table[i, p[i]] for i in range(short)) for p in itertools.permutations(range(long_), short))


def test_matching_beats_greedy_and_thresholds_after_solving(spark):
    d = spark.createDataFrame([("c", 0, 0, 1.0), ("c", 0, 1, 2.0), ("c", 1, 0, 2.0), ("c", 1, 1, 100.0)], "clip string, t int, p int, cost double")
    assert sorted((r.t, r.p) for r in A.assign_optimal(d, ["clip"], "t", "p").collect()) == [(0, 1), (1, 0)]
    assert A.assign_optimal(d, ["clip"], "t", "p", threshold=2.0).count() == 0


@pytest.mark.parametrize("shape", [(5, 6), (6, 4), (5, 5)])
def test_warm_matchings_are_cheapest(shape):
    """Every step of a drifting sequence, against all permutations."""
    r = np.random.default_rng(sum(shape))
    costs = np.cumsum(np.concatenate([r.random((1, *shape)) * 9, r.normal(size=(20, *shape))]), axis=0)
    few, many = sorted(range(2), key=lambda k: shape[k])
    for step, pairs in zip(costs, A.warm_matchings(costs), strict=True):
        assert len(pairs) == min(shape) == len({x for x, _ in pairs}) == len({y for _, y in pairs})
        table = step if few == 0 else step.T
        want = min(sum(table[i, p[i]] for i in range(shape[few])) for p in itertools.permutations(range(shape[many]), shape[few]))
        assert abs(sum(step[x, y] for x, y in pairs) - want) < 1e-9


def test_sweep_equals_fresh_solves(spark):
    r = np.random.default_rng(9)
    rows = [(c, o, t, p, float(abs(t - p + o / 5) + r.random())) for c in "ab" for o in range(8) for t in range(6) for p in range(7) if (t + p + o) % 11]
    d = spark.createDataFrame(rows, "clip string, offset int, track_id int, player_id int, cost double")
    total = lambda m: sorted((x["clip"], x["offset"], round(x["s"], 9)) for x in m.groupBy("clip", "offset").agg(F.sum("cost").alias("s")).collect())
    assert total(A.sweep(d)) == total(A.assign_optimal(d, ["clip", "offset"], "track_id", "player_id"))


def test_sweep_prices_every_candidate_offset(spark, tmp_path):
    """All 41 offsets of two seconds either way, each with the total of a matching of its own."""
    from catalog.q_assign import OFFSET, ours
    from fieldmotion.operators import scoring as S

    rows = [(u * 1000 + f, u, "click", float((u * 37 + f * 11) % 53), '{"k": %d}' % (u * 5 + f % 3)) for u in range(3) for f in range(160)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    t = Fixtures(spark, str(tmp_path))
    got = {x["offset"]: (x["n_matched"], x["total"]) for x in QUERIES["sweep_offsets"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(OFFSET - 60, OFFSET + 61, 3)) and len(got) == 41
    snaps = S.event_frame(t.truth)
    for offset in (OFFSET - 60, OFFSET, OFFSET + 60):
        want = A.assign_optimal(S.pair_costs(ours(t), t.truth, snaps, offset), ["clip"], "track_id", "player_id").agg(F.count("*"), F.sum("cost")).first()
        assert got[offset] == (want[0], pytest.approx(want[1], abs=1e-4))


def test_sweep_matches_pairs_of_any_cost(spark):
    """Costs over a million are costs; only unknown pairs are not matched."""
    d = spark.createDataFrame([("a", 0, 1, 1, 3e6), ("a", 0, 2, 1, 1e6), ("a", 0, 2, 2, 4e6), ("a", 0, 3, 3, None), ("b", 0, 1, 1, None)],
                              "clip string, offset int, track_id int, player_id int, cost double")
    assert sorted(tuple(x) for x in A.sweep(d).collect()) == [("a", 0, 1, 1, 3e6), ("a", 0, 2, 2, 4e6)]


def test_similarity_with_one_bad_point_in_three(spark):
    """Bad points change nothing; the order of rows neither."""
    r = np.random.default_rng(4)
    rows = []
    for f in range(6):
        p = r.random((12, 2)) * 500
        q = np.stack([1.1 * p[:, 0] - 0.02 * p[:, 1] + 7, 0.02 * p[:, 0] + 1.1 * p[:, 1] - 3], axis=1)
        q[: f // 2 * 2] += 300 + 90 * r.random((f // 2 * 2, 2))
        rows += [("c", f, *map(float, (*a, *b))) for a, b in zip(p, q)]
    rows += [("c", 9, 1.0, 1.0, 2.0, 2.0), ("c", 10, None, 1.0, 2.0, 2.0)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, pu double, pv double, u double, v double")
    got = {x["frame_idx"]: x for x in fit_similarity(d, ["clip", "frame_idx"]).collect()}
    assert sorted(got) == list(range(6))
    for f, x in got.items():
        assert np.allclose([x["a"], x["b"], x["tx"], x["ty"]], [1.1, 0.02, 7, -3]) and (x["n"], x["n_inliers"]) == (12, 12 - f // 2 * 2) and x["accepted"]


@pytest.mark.parametrize("most", [10_000, 30])
def test_exact_percentiles_of_a_skewed_group(spark, most):
    """Sorted as they are, and by histograms that narrow: ties, long tails, signs, few values, nulls."""
    r = np.random.default_rng(7)
    groups = {"flat": r.random(400), "ties": r.integers(0, 4, 300).astype(float), "tail": np.exp(r.normal(0, 40, 300)), "signs": -np.exp(r.normal(0, 9, 200)) * r.choice([-1, 1], 200),
              "one": np.array([3.5]), "same": np.full(90, -2.0), "wide": np.array([-1e308, 1e308, 0.0, 5.0] * 20)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("flat", None), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    probs = {"low": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "top": 1.0}
    got = {x.k: x for x in K.exact_percentiles(d, ["k"], F.col("v"), probs, most, 32).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        for name, p in probs.items():
            with np.errstate(over="ignore", invalid="ignore"):
                at = p * (len(x) - 1)
                s = np.sort(x)
                want = s[int(at)] if at == int(at) else s[int(at)] + (s[int(at) + 1] - s[int(at)]) * (at - int(at))
            assert got[k]["n"] == len(x) and got[k][name] == pytest.approx(want, rel=1e-12), (k, name)
    whole = K.exact_percentiles(d.where("k = 'flat'"), [], F.col("v"), {"m": 0.5}, most, 32)
    assert whole.columns == ["n", "m"] and whole.first()["m"] == pytest.approx(np.median(groups["flat"]))
    assert K.exact_percentiles(d.where("v is null"), [], F.col("v"), {"m": 0.5}, most).count() == 0


def test_top_per_group_and_first_fraction(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    top = K.top_per_group(d, ["g"], [F.col("id").desc()], 4)
    assert sorted(r.id for r in top.collect()) == list(range(988, 1000))
    split = P.split_fraction(d, 0.15).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"val": 150, "train": 850}


def test_round_robin(spark):
    d = spark.createDataFrame([(i, "A" if i < 3 else "B", 0) for i in range(4)], "id bigint, clip string, stratum int")
    got = P.clip_diverse_sample(d, 3).groupBy("clip").count().collect()
    assert {r.clip: r["count"] for r in got} == {"A": 2, "B": 1}


def test_histogram_edges(spark):
    d = spark.createDataFrame([(1, v) for v in (0.0, 1.0, 2.0, 3.0, 180.0, 179.9, 181.0)], "k int, v double")
    assert histogram_1d(d, ["k"], F.col("v"), 12, 0, 180).first().hist == [4.0] + [0.0] * 10 + [2.0]


def test_median_split_puts_the_middle_above(spark):
    d = spark.createDataFrame([("c", i, float(i)) for i in range(3)], "clip string, track_id bigint, proj double")
    assert {r.track_id: r.cluster for r in split_at_median(d).collect()} == {0: 0, 1: 1, 2: 1}


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    pts = [("c", 0, i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(60)]
    a = spark.createDataFrame(pts, "clip string, frame_idx int, a int, x double, y double")
    b = a.select("clip", "frame_idx", F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    got = {(r.a, r.b) for r in X.near_pairs(a, b, "x", "y", "x2", "y2", 1.5, ["clip", "frame_idx"]).collect()}
    assert got == {(p[2], q[2]) for p in pts for q in pts if np.hypot(p[3] - q[3], p[4] - q[4]) < 1.5}


def test_merged_moments_equal_those_of_pixels(spark):
    """Statistics, fits and line directions from merged component records, and by numpy; components of one pixel too."""
    r = np.random.default_rng(3)
    rows = [("c", f, comp, cls, int(x), int(2 * x + r.integers(9)), 0.5) for f in range(2) for comp in range(4) for cls in (0, 1)
            for x in r.integers(0, 1280, 1 if comp == 3 and cls else 25)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, comp int, cls int, px int, py int, prob double")
    fine = L.moments(d, ["clip", "frame_idx", "comp", "cls"])
    for keys in (["clip", "frame_idx", "comp"], ["clip", "frame_idx", "comp", "cls"]):
        for f in (L.component_stats, L.fit_lines, lambda x, k: L.line_params(x, k, 1.5, 2)):
            assert sorted(map(tuple, f(d, keys).collect())) == sorted(map(tuple, f(fine, keys).collect()))
    got = L.component_stats(fine, ["frame_idx", "comp"]).where("frame_idx = 0 and comp = 1").first()
    x, y = (np.array([p[k] for p in rows if p[1] == 0 and p[2] == 1], float) for k in (4, 5))
    w, v = np.linalg.eigh(np.cov(x, y))
    assert (got["cx"], got["cy"], got["area"]) == (pytest.approx(x.mean()), pytest.approx(y.mean()), len(x))
    assert abs(got["cos_t"] * v[0, 1] + got["sin_t"] * v[1, 1]) == pytest.approx(1)
    fit = L.fit_lines(fine, ["frame_idx", "comp"]).where("frame_idx = 0 and comp = 1").first()
    assert (fit["b"], fit["a"]) == pytest.approx(tuple(np.polyfit(y, x, 1)))


def test_single_link_follows_a_long_chain(spark):
    pts = [("c", 0, i, 10.0 * i, 0.0) for i in range(40)] + [("c", 0, 99, 999.0, 0.0)]
    d = spark.createDataFrame(pts, "clip string, frame_idx int, comp int, cx double, cy double")
    got = {r.comp: r.cluster for r in L.single_link(d, 10.0).collect()}
    assert set(got.values()) == {0, 99} and got[39] == 0


def test_outliers_and_duplicates(spark):
    fits = [("c", 0, k, 100.0 * k + (90 if k == 3 else 0), 0.0) for k in range(6)] + [("d", 0, 1, 5.0, 0.0)]
    d = spark.createDataFrame(fits, "clip string, frame_idx int, cls int, a double, b double")
    got = L.spacing_outliers(d)
    assert sorted(r.cls for r in got.where("clip = 'c'").collect()) == [0, 1, 2, 4, 5] and got.where("clip = 'd'").count() == 1
    tok = [("c", 0, i, x, n) for i, (x, n) in enumerate([(0.0, 5), (30.0, 9), (70.0, 1), (200.0, 1)])]
    t = spark.createDataFrame(tok, "clip string, frame_idx int, line int, cx double, area int")
    assert sorted(r.line for r in L.suppress_near_dups(t).collect()) == [1, 3]


def test_decisions_modes_and_manifests(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,)], "id bigint")
    with pytest.raises(ValueError):
        X.filter_decisions(d, d, y_only=True, n_only=True)
    path = str(tmp_path / "m")
    entries = spark.createDataFrame([("c", 1)], "clip string, frame_idx int")
    with pytest.raises(ValueError):
        IO.write_manifest(entries, path, {}, partial=True)
    IO.write_manifest(entries, path, {"seed": 1})
    with pytest.raises(Exception):
        IO.write_manifest(entries, path, {"seed": 1})


def test_text_sources(spark, tmp_path):
    (tmp_path / "ex.txt").write_text("# all\na.npz  # why\n\nb.npz\n")
    assert sorted(r.name for r in IO.read_exclusions(spark, str(tmp_path / "ex.txt")).collect()) == ["a.npz", "b.npz"]
    (tmp_path / "img_1.txt").write_text("0 0.5 0.5 0.1 0.2\n")
    (tmp_path / "img_2.txt").write_text("")
    assert [(r.image, r.cx, r.h) for r in IO.read_box_labels(spark, str(tmp_path / "img_*.txt")).collect()] == [("img_1", 0.5, 0.2)]
    (tmp_path / "l.json").write_text('{"n_total": 2, "decisions": {"c_1#7": "y", "c_1#9": "n"}}')
    assert sorted((r.clip, r.frame_idx, r.decision) for r in IO.read_ledger(spark, str(tmp_path / "l.json")).collect()) == [("c_1", 7, "y"), ("c_1", 9, "n")]


def test_tracking_sink_follows_bytes_and_needs_its_commit(spark, tmp_path):
    rows = [(f"c{i % 40}", i // 40, i % 3, i / 7, 1.0, "team_A", i % 2 == 0) for i in range(800)] + [("c0", 99, 1, float("nan"), 1.0, None, None)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, track_id long, x_yd double, y_yd double, team string, in_bad_run boolean")
    for name, size in (("one", 1 << 20), ("many", 4000)):
        IO.write_tracking(d, str(tmp_path / name), size)
        back = IO.read_tracking(spark, str(tmp_path / name))
        assert back.count() == 800
    files = lambda n: len(list((tmp_path / n / "data").glob("*.csv")))
    assert files("one") == 1 and 5 <= files("many") <= 12
    place = lambda x: (x["clip"], x["track_id"], x["frame_idx"])
    record = sorted(spark.read.json(str(tmp_path / "many" / "commit")).collect(), key=lambda r: place(r["first"]))
    assert sum(r["n_rows"] for r in record) == 800 and all(place(a["last"]) <= place(b["first"]) for a, b in zip(record, record[1:]))
    (tmp_path / "many" / "data" / "part-stray.csv").write_text("clip,frame_idx,track_id,x_yd,y_yd,team,in_bad_run\nz,1,1,1.0,1.0,u,0\n")
    assert IO.read_tracking(spark, str(tmp_path / "many")).count() == 800
    with pytest.raises(Exception, match="(?i)already exists"):
        IO.write_tracking(d, str(tmp_path / "one"))
    d.coalesce(1).write.csv(str(tmp_path / "torn" / "data"))
    with pytest.raises(Exception, match="(?i)not exist"):
        IO.read_tracking(spark, str(tmp_path / "torn"))


def test_field_points(spark):
    pts = IO.field_points(spark)
    assert pts.count() == 21 * 4 + 9 * 2
    assert {r.label for r in pts.where("slot = 1 and y = 0").collect()} == {"near_sideline_5+5yd"}
    assert {r.label for r in pts.where("slot = 10 and y = 13").collect()} == {"number_50"}


def test_min_spacing_draws_for_large_n(spark):
    from fieldmotion.operators.sampling import min_spacing

    frames = spark.range(20_000).selectExpr("'c' AS clip", "CAST(id AS INT) AS frame_idx")
    picks = min_spacing(frames, 200, 60).first()["picks"]
    assert len(picks) == 200 and min(b - a for a, b in zip(picks, picks[1:], strict=False)) >= 60


def test_consensus_with_half_the_points_wrong():
    from fieldmotion.operators.planar import consensus_fit, mapped

    rng = np.random.default_rng(5)
    h = np.array([[0.05, 0.01, 3.0], [0.002, 0.06, -4.0], [1e-5, 2e-4, 1.0]])
    src = rng.uniform(0, 1200, (30, 2))
    dst = mapped(h, src)
    dst[:15] += rng.uniform(20, 60, (15, 2))
    for seed in range(20):
        got, near = consensus_fit(src, dst, seed)
        assert near[15:].all() and np.abs(mapped(got, src[15:]) - dst[15:]).max() < 0.5


def brute_two_means(v, order):
    """Ten starts drawn by a hash, Lloyd's rounds to the end, least inertia."""
    best = None
    for j in range(10):
        first = min(range(len(v)), key=lambda i: hashlib.md5(f"{j}|{order[i]}".encode()).hexdigest())
        far = max(range(len(v)), key=lambda i: (((v[i] - v[first]) ** 2).sum(), -order[i]))
        c, label, n = [v[first], v[far]], None, 0
        while True:
            d = [((v - x) ** 2).sum(axis=1) for x in c]
            new = d[1] < d[0]
            if label is not None and (new == label).all():
                break
            label, n = new, n + 1
            c = [v[label == k].mean(axis=0) if (label == k).any() else c[k] for k in (False, True)]
        inertia = np.minimum(*d).sum()
        if best is None or round(inertia, 6) < best[0]:
            best = round(inertia, 6), label, n
    return best


@pytest.mark.parametrize("most", [50_000, 90])
def test_two_means_go_on_until_no_label_moves(spark, monkeypatch, most):
    """A long tail: the bound between the clusters moves a few points a round. One task a
    clip, and parts whose sums are merged."""
    monkeypatch.setattr(teams, "MOST", most)
    monkeypatch.setattr(teams.in_parts, "__defaults__", (most,))
    r = np.random.default_rng(1)
    rows, want = [], {}
    for clip, width in (("a", 1), ("b", 3)):
        v = np.array([(400 / (400 - i)) ** 0.4 * r.normal(1, 0.02, width) for i in range(400)])
        rows += [(clip, i, x.tolist()) for i, x in enumerate(v)]
        want[clip] = brute_two_means(v, list(range(400)))
    assert max(w[2] for w in want.values()) > 4
    df = spark.createDataFrame(rows, "clip string, track_id long, sig array<double>")
    got = {(x["clip"], x["track_id"]): x["cluster"] for x in teams.kmeans_split(df).collect()}
    for clip, (_, label, _) in want.items():
        assert [got[clip, i] for i in range(400)] == label.astype(int).tolist()


@pytest.mark.parametrize("most", [50_000, 7])
def test_principal_axis_merges_parts(spark, monkeypatch, most):
    monkeypatch.setattr(teams.in_parts, "__defaults__", (most,))
    x = np.random.default_rng(2).normal(size=(60, 5)) * [1, 3, 1, 2, 1]
    df = spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(x)], "clip string, track_id long, residual array<double>")
    v = np.linalg.eigh(x.T @ x)[1][:, -1]
    assert np.allclose(teams.principal_axis(df).first()["axis"], v * np.sign(v[np.argmax(np.abs(v))]))


def test_pca_split_reads_whole_vectors(spark):
    """The query projects as numpy does over all 64 values of each vector."""
    d = "/root/testdata/sf0.001"
    sigs = Fixtures(spark, d).sigs.where("sig is not null").select("clip", "track_id", "sig").toPandas()
    want = {}
    for _, g in sigs.groupby("clip"):
        x = np.stack(g["sig"])
        x = x - x.mean(axis=0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        proj = x @ (axis * np.sign(axis[np.argmax(np.abs(axis))]))
        want |= dict(zip(g["track_id"], proj))
    got = {r["track_id"]: r["proj"] for r in QUERIES["pca_split"](spark, d).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_tokens_take_their_values_from_a_labeller(spark):
    """Number groups by the majority of their pixels and by a known homography, inside the token pipeline."""
    pix = [("c", 0, 3, comp, 300 + 8 * comp + i, 200 + i % 7, 0.9, 40.0 if comp == 0 else 45.0 if i % 3 else 0.0) for comp in (0, 1) for i in range(40)]
    d = spark.createDataFrame(pix, "clip string, frame_idx int, ch int, comp int, px int, py int, prob double, raw double")
    value = lambda labeller: [(r["token"][13], r["token"][14]) for r in M.tokenise(d, labeller).where("type = 3").collect()]
    names = M.tokenise(d).where("type = 3").collect()
    assert len(names) == 1 and names[0]["area"] == 80
    groups = M.number_groups(d)
    voted = M.label_numbers(groups, M.majority_labeller(d, F.col("raw"))).collect()
    assert [(r["value"], r["has_value"], r["members"]) for r in voted] == [(40.0, True, [0, 1])] and voted[0]["conf"] == pytest.approx(0.9 * 40 / 66)
    frames = spark.createDataFrame([("c", 0, [0.1, 0.0, 8.0, 0.0, 0.1, 0.0, 0.0, 0.0, 1.0])], "clip string, frame_idx int, h array<double>")
    placed = M.label_numbers(groups, M.truth_labeller(frames)).collect()
    assert [(r["value"], r["has_value"]) for r in placed] == [(40.0, True)]
    assert M.label_numbers(groups, M.truth_labeller(frames.limit(0))).collect()[0]["has_value"] is False
    assert value(M.majority_labeller(d, F.col("raw"))) != value(None)


def generated(df):
    """Rows that the explodes of a collected frame gave, the last one first."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    todo = [plan.finalPhysicalPlan() if plan.nodeName().startswith("Adaptive") else plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "Generate":
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())] + ([p.plan()] if "QueryStage" in name else [])
    return out


def test_pairs_copy_few_rows(spark):
    rng = np.random.default_rng(5)
    n = 400
    xy = lambda k: [("c1", i % 8, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform((0, 0), (120, 53), (k, 2)))]
    left, right = spark.createDataFrame(xy(n), "clip string, frame_idx int, a int, x double, y double"), spark.createDataFrame(xy(n), "clip string, frame_idx int, b int, x2 double, y2 double")
    near = X.near_pairs(left, right, "x", "y", "x2", "y2", 8.0, ["clip", "frame_idx"])
    brute = left.join(right, ["clip", "frame_idx"]).where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) < 8.0)
    assert sorted((r.a, r.b) for r in near.collect()) == sorted((r.a, r.b) for r in brute.collect())
    assert 0 < max(generated(near)) < 3 * n
    box = [(F.lit(0.0) if c[1] == "1" else F.lit(9.0)).alias(c) for c in ("x1", "y1", "x2", "y2")]
    sig = F.array(F.lit(1.0), F.lit(2.0)).alias("sig")
    tracks = left.select("clip", "frame_idx", F.col("a").alias("track_id"), F.col("x").alias("x_yd"), F.col("y").alias("y_yd"), F.lit(12.0).alias("sxx"), F.lit(0.1).alias("sxy"), F.lit(8.0).alias("syy"), *box, F.lit(5).alias("n_obs"), sig)
    dets = right.select("clip", "frame_idx", F.col("b").alias("det_idx"), F.col("x2").alias("x_yd"), F.col("y2").alias("y_yd"), *box, sig)
    got = A.gated_candidates(tracks, dets, ["clip", "frame_idx"])
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    want = left.join(right, ["clip", "frame_idx"]).where((8.0 * dx * dx - 0.2 * dx * dy + 12.0 * dy * dy) / (96.0 - 0.01) <= 9.21)
    assert sorted((r.track_id, r.det_idx) for r in got.collect()) == sorted((r.a, r.b) for r in want.collect())
    assert 0 < max(generated(got)) < 3 * n


def test_homography_of_points_that_coincide(spark):
    from fieldmotion.operators.planar import fit_homography

    src = [(0.0, 0.0)] * 4 + [(5.0, 5.0), (7.0, 7.0)]
    dst = [(0.0, 0.0), (5.0, 0.0), (0.0, 5.0), (5.0, 5.0), (1.0, 2.0), (3.0, 9.0)]
    rows = [("a", f, f"{f}-{i}", *s, *d) for f in (0, 1) for i, (s, d) in enumerate(zip(src, dst))]
    good = [("a", 2, f"2-{i}", 20.0 * x, 12.0 * y, x, y) for i, (x, y) in enumerate(dst)] + [("a", 2, "2-n", None, 3.0, 4.0, 4.0)]
    got = {r["frame_idx"]: r for r in fit_homography(spark.createDataFrame(rows + good, "clip string, frame_idx int, corr_id string, u double, v double, fx double, fy double")).collect()}
    assert sorted(got) == [0, 1, 2] and got[2]["n_inliers"] == 6 and got[2]["rmse"] < 1e-6


def test_homographies_of_many_frames_equal_each_alone(spark):
    """Frames of one size are fitted at once, over the ends of Arrow batches; rows that share a corr_id count once for each of them."""
    import pyarrow as pa

    from fieldmotion.operators import planar

    rng = np.random.default_rng(11)
    rows, want = [], {}
    for clip in "ab":
        for f in range(40):
            n = int(rng.integers(4, 9))
            dst = np.stack([rng.permutation(11)[:n] * 10.0, rng.permutation(9)[:n] * 6.0], axis=1)
            src = dst @ np.array([[8.0, 0.3], [0.2, 11.0]]) + rng.normal(0, 2, (n, 2)) + 300 * (rng.random((n, 1)) < 0.2)
            if f == 7:
                src, dst = (np.repeat(x, 2, axis=0) for x in (src, dst))
            rows += [(clip, f, f"{i // (1 + (f == 7)):03d}", *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(src, dst))]
            h, inlier = planar.consensus_fit(src, dst, f)
            e = np.linalg.norm(planar.mapped(h, src) - dst, axis=1) if h is not None else None
            want[clip, f] = (n * 4, int(2 * inlier.sum())) if f == 7 else (n, 0 if h is None else int(inlier.sum())), None if h is None else float(np.sqrt((e[inlier] ** 2).mean()))
    d = spark.createDataFrame(rows, "clip string, frame_idx int, corr_id string, u double, v double, fx double, fy double")
    out = planar.fit_homography(d)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    got = {(r.clip, r.frame_idx): ((r.n_corrs, r.n_inliers), r.rmse) for r in out.collect()}
    assert len(got) > 60
    for k, (counts, rmse) in got.items():
        assert counts == want[k][0] and rmse == (None if want[k][1] is None else pytest.approx(want[k][1], rel=1e-3, abs=1e-6)), k
    whole = pa.Table.from_pandas(d.orderBy("clip", "frame_idx", "corr_id").toPandas(), preserve_index=False)
    chunk, planar.CHUNK = planar.CHUNK, 50
    try:
        parts = list(planar._whole_frames(whole.to_batches(max_chunksize=3)))
    finally:
        planar.CHUNK = chunk
    assert len(parts) > 5 and pa.concat_tables(parts).equals(whole)
    assert len({(c, f) for t in parts for c, f in set(zip(t["clip"].to_pylist(), t["frame_idx"].to_pylist()))}) == sum(len(set(zip(t["clip"].to_pylist(), t["frame_idx"].to_pylist()))) for t in parts)


def test_offset_sweep_sums_in_blocks(spark):
    from fieldmotion.operators import scoring as S

    rng = np.random.default_rng(3)
    mine = [(c, t, f, None if rng.random() < 0.05 else float(rng.uniform(0, 120)), float(rng.uniform(0, 53))) for c in "ab" for t in range(3) for f in range(200) for _ in range(1 + (f == 9))]
    truth = [(c, f, p, float(rng.uniform(0, 120)), float(rng.uniform(0, 53)), "ball_snap" if f == 1020 else None) for c in "abx" for p in (7, 8) for f in range(1000, 1060) for _ in range(1 + (f == 1021))]
    ours = spark.createDataFrame(mine, "clip string, track_id long, frame_idx int, x double, y double")
    theirs = spark.createDataFrame(truth, "clip string, frame int, player_id int, x double, y double, event string")
    theirs = theirs.withColumn("s", F.lit(0.0))
    snaps = S.event_frame(theirs)
    got = S.offset_costs(ours, theirs, snaps, 60, 6)
    rows = {(r["clip"], r["offset"], r["track_id"], r["player_id"]): (pytest.approx(r["cost"]), r["n_overlap"]) for r in got.collect()}
    want = {(r["clip"], o, r["track_id"], r["player_id"]): (r["cost"], r["n_overlap"]) for o in range(54, 67, 3) for r in S.pair_costs(ours, theirs, snaps, o).collect()}
    assert rows == want and len(rows) == 2 * 5 * 3 * 2
    assert max(generated(got)) < 3 * len(mine)


def test_similarity_tries_every_pair_of_a_crowded_frame():
    from fieldmotion.operators.planar import robust_similarity

    rng = np.random.default_rng(8)
    p = rng.uniform(0, 1000, (60, 2))
    q = rng.uniform(0, 1000, (60, 2))
    q[:31] = p[:31] * 1.01 + 4 + rng.normal(0, 0.5, (31, 2))
    middles = []
    for i, j in itertools.combinations(range(60), 2):
        d, e = complex(*(p[j] - p[i])), complex(*(q[j] - q[i]))
        z = e / d
        r = [abs(z * complex(*(x - p[i])) + complex(*q[i]) - complex(*y)) ** 2 for x, y in zip(p, q)]
        middles.append((round(float(np.median(r)), 9), r))
    least, r = min(middles, key=lambda m: m[0])
    reach = max(2.5 * 1.4826 * (1 + 5 / 58) * least**0.5, 1e-3)
    assert robust_similarity(p, q)[4].tolist() == [x <= reach * reach for x in r]


def test_mean_probability_does_not_depend_on_the_order(spark):
    prob = [0.95] * 7 + [0.5 + 5 * d for d in (0.01, 0.02, 0.03, 0.06, 0.07)] * 5
    for k in range(6):
        rows = spark.createDataFrame([("a", 0, 1, i, i, p) for i, p in enumerate(random.Random(k).sample(prob, 32))], "clip string, frame_idx int, comp int, px int, py int, prob double").coalesce(1)
        got = L.component_stats(rows, ["clip", "frame_idx", "comp"]).first()["conf"]
        assert got == round(sum(round(p * 100) for p in prob)) / 100 / 32


def test_percentiles_of_a_table_are_not_shuffled_to_one_task(spark, monkeypatch):
    plans, stage = [], K.stage
    monkeypatch.setattr(K, "stage", lambda df: plans.append(df._jdf.queryExecution().toString()) or stage(df))
    d = spark.range(30_000).select((F.col("id") * 7919 % 30_000).cast("double").alias("v"))
    got = K.exact_percentiles(d, [], F.col("v"), {"median": 0.5, "p90": 0.9})
    assert got.first().asDict() == {"n": 30_000, "median": 14_999.5, "p90": pytest.approx(26_999.1)}
    assert not any("SortMergeJoin" in p for p in plans + [got._jdf.queryExecution().toString()])
