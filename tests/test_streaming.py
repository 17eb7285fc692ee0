"""Streams and their batch twins give the same rows, frames split over micro-batches too; late rows are counted."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import q_assign
from catalog.fixtures import corr_id
from fieldmotion.operators import bank as B
from fieldmotion.operators import identity_walk as W
from fieldmotion.streaming import clips as C
from fieldmotion.operators import planar
from fieldmotion.streaming import steps
from fieldmotion.streaming.machine import END_FRAME, PROVIDER, Blocks, Walk, advance, closed, complete, drain
from fieldmotion.streaming.steps import streak_step
from fieldmotion.streaming import tracker as K
from fieldmotion.streaming.tracker import track_step

import pandas as pd


def detections(spark, n=30):
    rows = []
    for clip in ("a", "b"):
        for f in range(n):
            for d in range(3):
                if f % 7 == d:
                    continue
                x, y = 20.0 + 10 * d + 0.1 * f, 10.0 + 8 * d
                rows.append((clip, f, d, x * 10, y * 10, x * 10 + 40, y * 10 + 80, 0.2 if f == 9 else 0.9, x, y))
    return spark.createDataFrame(rows, "clip string, frame_idx int, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, x_yd double, y_yd double")


def live(spark, df, path, files=3):
    """Micro-batches that cut frames 10 and 20 in two, and the end of every clip."""
    part = F.least(F.lit(files - 1), F.floor((F.col("frame_idx") + F.abs(F.xxhash64(*[c for c in df.columns if c != "sig"])) % 2) / 11))
    for i in range(files):
        df.where(part == i).coalesce(1).write.mode("append").parquet(path)
    closed(df).where(F.col("frame_idx") == END_FRAME).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    key = lambda r: str(tuple(r))
    cols = a.columns
    return sorted(map(key, a.collect())) == sorted(map(key, b.select(cols).collect()))


def test_tracker_keeps_identities_and_marks_gaps(spark):
    out = C.track_players(detections(spark))
    ids = {(r.clip, r.track_id) for r in out.collect()}
    assert ids == {(c, i) for c in "ab" for i in (1, 2, 3)}
    gaps = out.where("det_idx is null")
    assert gaps.count() > 0 and gaps.where("not interrupted or confidence > 0").count() == 0
    assert out.where("frame_idx = 9 and det_idx is not null and not interrupted").count() == 0


def test_tracker_stream_equals_batch(spark, tmp_path):
    d = detections(spark)
    stream = drain(C.track_players(live(spark, d, str(tmp_path / "in"))), str(tmp_path / "run"))
    assert same(C.track_players(d), stream)


def test_streak_stream_equals_batch_and_finds_the_loss(spark, tmp_path):
    rows = [("a", f, "carry" if f in (3, 4, 8, 9, 10, 11) else "full") for f in range(30)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, method string")
    batch = C.carry_streak(d)
    stream = drain(C.carry_streak(live(spark, d, str(tmp_path / "in"))), str(tmp_path / "run"))
    assert same(batch, stream) and batch.agg(F.min("lost_from")).first()[0] == 8


def test_h_chain_falls_back(spark, tmp_path):
    rows = []
    for f in range(30):
        if f == 20:
            rows.append(("a", f, None, None, None, None, None, None, None))
            continue
        for slot in range(6):
            for kind, y in (("near_hash", 23.583), ("far_hash", 29.747), ("sideline_near", 0.0)):
                x = 10.0 + 5 * slot
                rows.append(("a", f, f"{slot}{kind}", kind, slot, x * 20 + 0.5 * f, y * 12 + 30, x, y))
    d = spark.createDataFrame(rows, "clip string, frame_idx int, corr_id string, kind string, slot int, u double, v double, fx double, fy double")
    batch = C.h_chain(d)
    got = {r.frame_idx: r for r in batch.collect()}
    assert got[5].method == "full" and got[5].rmse == pytest.approx(0, abs=1e-6) and got[20].method == "carry"
    assert same(batch, drain(C.h_chain(live(spark, d, str(tmp_path / "in"))), str(tmp_path / "run")))


def chained(n_frames=120, n_rows=14, seed=4):
    """Noisy correspondences of one clip in which all methods occur, some frames without any."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(n_frames):
        if f % 17 == 16:
            rows.append((f, None, None, np.nan, np.nan, np.nan, np.nan, np.nan))
        for k in range(rng.integers(1, n_rows)):
            slot, kind = int(rng.integers(0, 8)), ["near_hash", "far_hash", "sideline_near"][rng.integers(0, 3)]
            x, y = 10.0 + 5 * slot, {"near_hash": 23.583, "far_hash": 29.747, "sideline_near": 0.0}[kind]
            rows.append((f, f"{rng.integers(0, 1000)}-{k}", kind, slot, 20 * x + rng.normal(0, 1 + 12 * (f % 3 > 0)), 12 * y + rng.normal(0, 1 + 12 * (f % 3 > 0)), x, y))
    return pd.DataFrame(rows, columns=["frame_idx", "corr_id", "kind", "slot", "u", "v", "fx", "fy"])


def test_frames_are_judged_together_as_one_by_one(monkeypatch):
    d, names = chained(), ["frame_idx", "h", "method", "rmse", "n_corrs", "n_inliers", "n_late"]
    calls, judged = [], steps._judge_numbered
    monkeypatch.setattr(steps, "_judge_numbered", lambda *a: calls.append(1) or judged(*a))
    together = advance(Walk(steps.chain_walk), {}, "a", d, names)
    at_once = len(calls)
    plain = lambda out: out.astype(object).where(out.notna(), None).values.tolist()
    state, singly = {}, []
    for _, part in d.groupby("frame_idx"):
        singly += plain(advance(Walk(steps.chain_walk), state, "a", part, names))
    assert plain(together) == singly
    assert set(together["method"]) >= {"full", "delta", "carry"} and at_once < len(calls) - at_once == 120
    monkeypatch.setattr(steps, "AHEAD_ROWS", 1)
    assert plain(together) == plain(advance(Walk(steps.chain_walk), {}, "a", d, names))


def test_rows_judged_by_number_get_the_verdicts_of_judge():
    rng = np.random.default_rng(2)
    keys = [f"near_hash|{s}" for s in range(6)]
    codes = {"kept": steps.KEPT, "probationary": steps.PROBATIONARY, "self": steps.SELF, "cross": steps.CROSS}
    seen = set()
    for frame in range(12):
        bank = {k: {"first": int(rng.integers(0, 9)), "n": int(rng.integers(1, 6)), "last": frame, "at": rng.uniform(0, 150, 2).tolist()} for k in keys[1:] + ["far_hash|3"]}
        ids, at = rng.integers(0, 6, 40), rng.uniform(0, 150, (40, 2))
        said = steps.judge(bank, frame, {"key": np.array(keys, dtype=object)[ids], "at": at})
        got = steps._judge_numbered(bank, np.full(40, frame), ids, at, {k: i for i, k in enumerate(keys)})
        assert got.tolist() == [codes[v] for v in said]
        seen |= set(said)
    assert seen == set(codes)


def test_draws_that_cannot_win_are_left_out_without_changing_the_fit(monkeypatch):
    rng = np.random.default_rng(3)
    for case in range(6):
        n = 60 + case
        p = rng.uniform(0, 800, (n, 2))
        q = 1.01 * p + 3 + rng.normal(0, (4, 15, 0)[case % 3], (n, 2))
        q[: n // 4] = rng.uniform(0, 800, (n // 4, 2))
        p[30:34] = p[34]
        if case > 2:
            p, q = np.round(p / 20) * 20, np.round(q / 20) * 20
        whole = planar.robust_similarity(p, q)
        monkeypatch.setattr(planar, "FEW_POINTS", 10)
        measured, real = [], planar._least_median
        monkeypatch.setattr(planar, "_least_median", lambda *a: measured.append(len(a[2])) or real(*a))
        monkeypatch.setattr(planar, "FIRST_DRAWS", 200)
        few = planar.robust_similarity(p, q)
        monkeypatch.undo()
        assert whole[:4] == few[:4] and (whole[4] == few[4]).all()
        assert len(measured) == 2 and sum(measured) < n * (n - 1) // 2


def test_complete_input_ends_its_clips_without_a_row_more(spark, tmp_path):
    d = correspondences(spark).drop("h")
    assert complete(d).count() == d.count()
    d.write.parquet(str(tmp_path / "in"))
    arriving = complete(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    assert same(C.h_chain(d), drain(C.h_chain(arriving), str(tmp_path / "run"))) and same(C.h_chain(d), C.h_chain(complete(d)))


CORRS = "clip string, frame_idx int, corr_id string, kind string, slot int, u double, v double, fx double, fy double, h array<double>"


def correspondences(spark, n=30):
    rows = []
    for f in range(n):
        for slot in range(6):
            for kind, y in (("near_hash", 23.583), ("far_hash", 29.747)):
                jump = 200 * (slot == 2 and f % 9 == 8) + (f > 24) * 90
                rows.append(("ab"[slot % 2], f, f"{slot}{kind}{f:03}", kind, slot, 200.0 + 100 * slot + jump, y * 12 + 30, 10.0 + 5 * slot, y, [0.05, 0.0, 0.0, 0.0, 1 / 12, -2.5, 0.0, 0.0, 1.0] if f % 4 else None))
    return spark.createDataFrame(rows, CORRS)


def test_bank_stream_equals_batch_with_split_frames(spark, tmp_path):
    d = correspondences(spark)
    before = spark.conf.get(PROVIDER, None)
    batch, stream = C.keypoint_bank(d), drain(C.keypoint_bank(live(spark, d, str(tmp_path / "in"))), str(tmp_path / "run"))
    assert same(batch, stream) and batch.where("valid is not null").count() > 0 and spark.conf.get(PROVIDER, None) == before
    counts = W.judged_corrs(d).groupBy("clip", "frame_idx").agg(*[F.count_if(F.col("verdict") == v).cast("int").alias(f"n_{v}") for v in ("kept", "probationary", "self", "cross")])
    assert same(counts, batch) and counts.agg(F.sum("n_self")).first()[0] > 0


def test_banks_of_many_clips_are_walked_frame_by_frame():
    rng = np.random.default_rng(0)
    frames = [(c, i, p) for c, i, p in ((np.sort(rng.integers(0, 3, 12)), rng.integers(0, 5, 12), rng.uniform(0, 90, (12, 2))) for _ in range(30))]

    def walk(only):
        bank, said = W.IdentityBanks(), []
        bank.grow(3, 5)
        for f, (c, i, p) in enumerate(frames):
            at = np.isin(c, only)
            code = bank.judge(f, c[at], i[at], p[at])
            ok = code <= W.PROBATIONARY
            bank.observe(f, c[at][ok], i[at][ok], p[at][ok], np.unique(c[at]))
            said += zip([f] * at.sum(), c[at].tolist(), np.flatnonzero(at).tolist(), code.tolist(), strict=True)
        return said

    together = walk([0, 1, 2])
    assert sorted(together) == sorted(walk([0]) + walk([1]) + walk([2])) and len({code for *_, code in together}) == 4


def test_states_are_staged_only_for_two_readers(spark, monkeypatch):
    monkeypatch.setattr(q_assign, "stage", lambda df: pytest.fail("staged"))
    t = SimpleNamespace(corrs=correspondences(spark))
    assert q_assign.bank_stats(t).count() > 0 and q_assign.cross_conflicts(t).count() >= 0


def test_homographies_are_inverted_once_a_frame_and_medians_found_by_rank(spark):
    d = correspondences(spark)
    st = B.states_before(W.accepted_history(W.judged_corrs(d)))
    frames = d.select("clip", "frame_idx", "h").distinct().union(spark.createDataFrame([("z", 0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "clip string, frame_idx int, h array<double>"))
    gone = d.where("slot % 3 > 0 or frame_idx % 2 = 0")
    assert "_inverse" in B.coast(st, gone, frames)._jdf.queryExecution().analyzed().toString()
    checked = B.validate_h(gone, st, frames, 30.0)
    assert "percentile" not in checked._jdf.queryExecution().analyzed().toString()
    got = {(r.clip, r.frame_idx): r for r in checked.collect()}
    assert got["z", 0].n_checked == 0 and got["z", 0].median_residual is None and got["z", 0].valid
    trusted = {(r.clip, r.frame_idx, r.kind, r.slot): (r.last_u, r.last_v) for r in st.where("trusted").collect()}
    now = {(r.clip, r.frame_idx, r.kind, r.slot): (r.u, r.v) for r in gone.collect()}
    for f in frames.where("h is not null and clip <> 'z'").collect():
        home = {"near_hash": 23.583, "far_hash": 53.33 - 23.583}
        seen = [(k, now.get(k, p)) for k, p in trusted.items() if k[:2] == (f.clip, f.frame_idx)]
        r = [np.hypot(0.05 * u - 10 - 5 * k[3], v / 12 - 2.5 - home[k[2]]) for k, (u, v) in seen]
        mine = got[f.clip, f.frame_idx]
        assert mine.n_checked == len(r) and (mine.median_residual is None if not r else mine.median_residual == pytest.approx(np.median(r)))


def exchanges(df):
    """Shuffles of the plan, and those of them that move exploded rows."""
    lines = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip(" :+-")]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    at = [i for i, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    below = lambda i: next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
    return len(at), sum(any("Generate" in x for x in lines[i:below(i)]) for i in at)


def test_states_meet_correspondences_where_they_lie(spark, monkeypatch):
    """What each frame starts with is not shuffled; null rows, repeated ones and frames without points as by brute force."""
    rng = np.random.default_rng(12)
    rows = []
    for clip in "abc":
        for f in range(40):
            for i in range(int(rng.integers(0, 9))):
                kind, slot = str(rng.choice(["near_hash", "far_hash", "odd"])), int(rng.integers(0, 3))
                rows.append((clip, f, f"{f:03}-{i}", kind, slot, 30.0 * slot + float(rng.normal(0, 9)), 25.0 * len(kind) + float(rng.normal(0, 9)), 0.0, 0.0, None))
    rows += [("a", 20, "null", None, 1, 30.0, 220.0, 0.0, 0.0, None), ("a", 21, "nan", "near_hash", 1, float("nan"), 220.0, 0.0, 0.0, None),
             (None, 3, "no clip", "odd", 1, 30.0, 75.0, 0.0, 0.0, None), ("b", None, "no frame", "odd", 1, 30.0, 75.0, 0.0, 0.0, None), rows[50], rows[50]]
    d = spark.createDataFrame(rows, CORRS)
    judged = W.judged_corrs(d)
    assert judged.count() == len(rows) - 4
    accepted = judged.where("verdict in ('kept', 'probationary')")
    assert judged.where("seen").count() == accepted.select("clip", "kind", "slot", "frame_idx").distinct().count()
    last = accepted.groupBy("clip", "kind", "slot", "frame_idx").agg(F.max_by("u", "corr_id").alias("u"))
    assert same(last, judged.where("seen"))
    st = B.states_before(W.accepted_history(judged))
    trusted = [r for r in st.where("trusted").collect()]

    out = B.cross_conflicts(d, st)
    assert out.columns == d.columns and exchanges(out)[1] == 0 and 0 < exchanges(out)[0] <= 3
    other = lambda r, t: (r[3] is not None and r[3] != t.kind) or r[4] != t.slot
    want = [r for r in rows if any((r[0], r[1]) == (t.clip, t.frame_idx) and other(r, t) and np.hypot(r[5] - t.last_u, r[6] - t.last_v) < 20 for t in trusted)]
    assert sorted(r.corr_id for r in out.collect()) == sorted(r[2] for r in want) and len(want) > 20
    monkeypatch.setattr(B, "PAIRS", 10)
    assert same(B.cross_conflicts(d, st), out)  # a clip in many parts

    h = [[0.3 + 0.01 * k, 0.0, 1.0, 0.0, 0.2, 2.0, 0.0, 0.0, 1.0] for k in range(3)]
    frames = spark.createDataFrame([(c, f, h[f % 3]) for c in "abz" for f in range(0, 45)] + [("a", 30, h[2]), (None, 3, h[0]), (None, 3, h[0]), ("b", None, h[1]), ("c", 3, None)], "clip string, frame_idx int, h array<double>")
    now = [(r.clip, r.frame_idx, r.kind, r.slot, r.u, r.v) for r in accepted.where("slot > 0 or frame_idx % 2 = 0").collect()]
    got = B.validate_h(accepted.where("slot > 0 or frame_idx % 2 = 0"), st, frames, 6.0)
    assert exchanges(got)[1] == 0 and 0 < exchanges(got)[0] <= 4
    got = {(r.clip, r.frame_idx): r for r in got.collect()}
    held = frames.where("h is not null").collect()
    assert got.keys() == {(r.clip, r.frame_idx) for r in held}
    home = {"near_hash": 23.583, "far_hash": 53.33 - 23.583}
    known = {(t.clip, t.frame_idx, t.kind, t.slot): (t.last_u, t.last_v) for t in trusted}
    present = {x[:4] for x in now}
    for key, r in got.items():
        points = [(x[2:], "corr") for x in now if x[:2] == key and x[:4] in known] + [((*k[2:], *p), "track") for k, p in known.items() if k[:2] == key and k not in present]
        each = [f.h for f in held if (f.clip, f.frame_idx) == key]
        points = [] if None in key else points
        gaps = [np.hypot(m[0] * u + m[2] - 10 - 5 * slot, m[4] * v + m[5] - home[kind]) for m in each for (kind, slot, u, v), _ in points if kind in home]
        via = [sum(w == kind for _, w in points) * len(each) for kind in ("corr", "track")]
        assert (r.n_checked, r.n_via_corrs, r.n_via_track) == (sum(via), *via) and r.n_bad == sum(x > 6 for x in gaps), key
        assert (r.median_residual, r.mean_residual) == ((pytest.approx(np.median(gaps)), pytest.approx(np.mean(gaps))) if gaps else (None, None)), key
    assert sum(r.n_via_corrs > 0 for r in got.values()) > 20 and sum(r.n_bad > 0 for r in got.values()) > 5


def test_corr_id_is_the_formatted_text(spark):
    rows = [(1, 2, 3, 4, 5.0), (10**13, 1, 10**9, 10**7, 1234.565), (-5, -1, -2, -3, -0.25), (7, 1, 8, 9, 95949.5), (7, 1, 8, 9, 1e12), (0, 0, 0, 0, 0.0)]
    d = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, p double")
    text = F.format_string("%012d-%d-%08d-%06d-%.2f", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p")
    assert d.where(corr_id() != text).count() == 0


def test_late_rows_come_out_counted(spark, tmp_path):
    d = spark.createDataFrame([("a", f, "carry") for f in range(6)], "clip string, frame_idx int, method string")
    for part in (d.where("frame_idx < 4"), d.where("frame_idx = 4"), d.where("frame_idx in (1, 2)").union(d.where("frame_idx = 2")), closed(d.where("frame_idx = 5"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["frame_idx"], r["n_late"], r["streak"]) for r in drain(C.carry_streak(stream), str(tmp_path / "run")).collect()}
    assert got == {(f, 0, f + 1) for f in range(6)} | {(1, 1, None), (2, 2, None)}


def test_coloured_tracker_stream_equals_batch(spark, tmp_path):
    d = detections(spark).withColumn("sig", F.array(*[(F.col("det_idx") == k).cast("double") + 0.1 for k in range(3)]))
    stream = drain(C.track_players(live(spark, d, str(tmp_path / "in"))), str(tmp_path / "run"))
    assert same(C.track_players(d), stream)


def test_late_frames_are_counted_not_processed():
    state = {}
    rows = lambda fs: pd.DataFrame({"frame_idx": fs, "method": ["carry"] * len(fs)})
    names = ["clip", "frame_idx", "streak", "lost_from", "n_late"]
    advance(streak_step, state, "a", rows([0, 1]), names)
    out = advance(streak_step, state, "a", rows([1, 2]), names)
    assert out[["frame_idx", "n_late"]].values.tolist() == [[1, 1], [2, 0]]


def test_lost_track_is_revived_with_its_id():
    def frame(f, present):
        cols = ["frame_idx", "det_idx", "x1", "y1", "x2", "y2", "confidence", "x_yd", "y_yd"]
        row = [f, 0, 0.0, 0.0, 40.0, 80.0, 0.9, 50.0, 20.0] if present else [f, None] + [None] * 7
        return pd.DataFrame([row], columns=cols)

    state, seen = {}, set()
    for f in range(60):
        for r in track_step(state, f, frame(f, f < 10 or f > 40)):
            seen.add(r["track_id"])
    assert seen == {1}


def crowd(n=70):
    """Detections that wander, cross and vanish, some frames without any, with colours."""
    rng = np.random.default_rng(2)
    at, rows = rng.uniform(0, 40, (7, 2)), []
    for f in range(n):
        at += rng.normal(0, 0.3, at.shape)
        at[rng.random(7) < 0.03] = rng.uniform(0, 40, 2)
        here = [k for k in range(7) if rng.random() < 0.7] if f % 9 else []
        for k, i in enumerate(rng.permutation(here).tolist()):
            x, y = (at[i] * 10).tolist()
            rows.append((f, k, x, y, x + 30, y + 60, float(rng.uniform(0.1, 1)), *(at[i] + rng.normal(0, 0.2, 2)).tolist(), None if rng.random() < 0.2 else np.eye(7)[i] + rng.uniform(0, 0.3, 7)))
        if not here:
            rows.append((f, None, *[None] * 7, None))
    d = pd.DataFrame(rows, columns=["frame_idx", "det_idx", "x1", "y1", "x2", "y2", "confidence", "x_yd", "y_yd", "sig"])
    return d.astype(dict.fromkeys(d.columns[1:-1], float))


def test_tracked_frames_of_a_clip_equal_each_alone():
    """Many frames in one call, with a state that went through text, and late ones."""
    import json

    names = [x.split()[0] for x in K.TRACK_SCHEMA.split(", ")] + ["n_late"]
    d, state = crowd(), {}
    whole = advance(Blocks(K.track_walk), {}, "a", d.sample(frac=1, random_state=1), names)
    alone = []
    for f, rows in d.groupby("frame_idx"):
        alone += [{"frame_idx": f, **r} for r in track_step(state, f, rows)]
        state = json.loads(json.dumps(state, default=lambda v: v.tolist()))
    assert len(alone) > 300 and {"live", "lost"} == {r["state"] for r in alone} and max(r["track_id"] for r in alone) > 7
    plain = lambda r: {c: None if pd.isna(r[c]) else r[c] for c in names[1:-1]}
    assert [plain(r) for r in whole.to_dict("records")] == [plain(r) for r in alone]
    state = {}
    first = advance(Blocks(K.track_walk), state, "a", d[d.frame_idx <= 30], names)
    rest = advance(Blocks(K.track_walk), state, "a", d[d.frame_idx >= 29], names)
    late = rest[rest.n_late > 0]
    assert late.frame_idx.tolist() == [29, 30] and late.n_late.tolist() == d[d.frame_idx.isin([29, 30])].groupby("frame_idx").size().tolist()
    both = pd.concat([first, rest[rest.n_late == 0]])
    assert [plain(r) for r in both.to_dict("records")] == [plain(r) for r in alone]


def test_small_tables_are_matched_as_large_ones():
    from fieldmotion.operators.assign import MISSING, cheapest_matching

    rng = np.random.default_rng(6)
    for _ in range(300):
        table = rng.integers(0, 6, rng.integers(1, 7, 2)) * rng.choice([1.0, 0.37])
        table[rng.random(table.shape) < 0.3] = MISSING
        assert K.smallest_matching(table.tolist()) == cheapest_matching(table)
