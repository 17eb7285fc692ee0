"""Sequence operators, on one piece and cut into many small pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmotion.operators import ordered as O
from fieldmotion.operators import runs as R
from fieldmotion.operators import smoothing as S
from fieldmotion.operators.motion import ema, kalman_track

BITS = [2, 16]  # pieces of four positions, and one piece


def track(spark, values, cols="x double"):
    return spark.createDataFrame([("c", 1, i, *v) for i, v in enumerate(values)], f"clip string, track_id bigint, frame_idx int, {cols}")


@pytest.mark.parametrize("bits", BITS)
def test_running_matches_a_plain_window(spark, bits):
    rnd = random.Random(1)
    rows = [(k, p, rnd.choice([None, float(rnd.randint(0, 9))])) for k in ("a", "b") for p in rnd.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "k string, p int, v double")
    got = O.running(df, ["k"], "p", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))},
                    {"n": ("min", F.col("v")), "f": ("last", F.col("v"))}, bits)
    w = Window.partitionBy("k").orderBy("p")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = df.withColumns({"s": F.coalesce(F.sum("v").over(up), F.lit(0.0)), "m": F.max("v").over(up), "l": F.last("v", True).over(up),
                           "n": F.min("v").over(down), "f": F.first("v", True).over(down)})
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bits", BITS)
def test_islands(spark, bits):
    d = track(spark, [(v,) for v in (1, 1, 0, 1)], "v int")
    assert [tuple(r)[2:] for r in R.segments(d, F.col("v") == 1, bits=bits).orderBy("start").collect()] == [(0, 2), (3, 4)]


@pytest.mark.parametrize("bits", BITS)
def test_bad_runs_need_the_minimum(spark, bits):
    d = track(spark, [(v,) for v in [1] * 4 + [0] + [1] * 5], "v int")
    flags = [r.in_bad_run for r in R.bad_runs(d, F.col("v") == 1, 5, bits).orderBy("frame_idx").collect()]
    assert flags == [False] * 5 + [True] * 5


@pytest.mark.parametrize("bits", BITS)
def test_none_resets_the_carry_streak(spark, bits):
    m = ["carry", "carry", "none", "carry", "carry", "carry"]
    d = track(spark, [(v,) for v in m], "method string")
    assert R.carry_cutoff(d, bits=bits).first().cutoff == 3
    assert R.carry_cutoff(d.where("frame_idx < 5"), bits=bits).first().cutoff == 5


@pytest.mark.parametrize("bits", [3, 16])
def test_smoothing_keeps_a_quadratic(spark, bits):
    d = track(spark, [(float(t * t), 2.0 * t) for t in range(20)], "x double, y double")
    rows = S.smooth_track(d, bits=bits).orderBy("frame_idx").collect()
    assert [r.sx for r in rows] == pytest.approx([t * t for t in range(20)])
    short = S.smooth_track(d.where("frame_idx < 8").withColumn("x", F.col("x") + F.rand(3)), bits=bits).collect()
    assert all(r.sx == r.x for r in short)


def test_adaptive_window_skips_tracks_with_few_valid_frames(spark):
    d = track(spark, [(float(v),) for v in (0, 9, 1, 7, 3)], "x double").withColumn("y", F.col("x"))
    assert all(r.sx == r.x for r in S.smooth_track_adaptive(d).collect())


@pytest.mark.parametrize("bits", BITS)
def test_isolated_point_has_no_velocity_but_speed_zero(spark, bits):
    d = track(spark, [(1.0, 1.0), (None, None), (3.0, 1.0), (4.0, 1.0)], "x double, y double")
    r = R.derivatives(d, 10.0, bits=bits).orderBy("frame_idx").collect()
    assert (r[0].vx, r[0].speed, r[1].speed) == (None, 0.0, None) and r[3].vx == pytest.approx(10)


@pytest.mark.parametrize("bits", BITS)
def test_loo_of_a_quadratic_is_zero_and_short_clips_are_unknown(spark, bits):
    h = lambda i: [0.08 + 1e-4 * i, 0.002, 5 + 0.01 * i * i, 0.001, 0.07, -3.0, 0.0, 0.0, 1.0]
    rows = [("c", i, h(i)) for i in range(12)] + [("s", i, h(i)) for i in range(3)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, h array<double>")
    got = S.loo_residual(d, bits=bits).collect()
    assert max(r.loo for r in got if r.clip == "c") == pytest.approx(0, abs=1e-7)
    assert all(r.loo is None for r in got if r.clip == "s")


def test_fill_bad_refits_through_good_frames(spark):
    h = lambda i: [0.08, 0.0, 5 + 0.01 * i, 0.0, 0.07, -3.0, 0.0, 0.0, 1.0]
    rows = [("c", i, None if i == 6 else h(i), 0.1) for i in range(12)]
    d = S.fill_bad(spark.createDataFrame(rows, "clip string, frame_idx int, h array<double>, rmse double"), bits=2)
    assert d.where("frame_idx = 6").first().h_clean == pytest.approx(h(6))


def test_smoothing_of_homographies_leaves_short_clips(spark):
    rows = [("c", i, [float(i % 3)] * 8 + [1.0]) for i in range(6)]
    d = S.smooth_h(spark.createDataFrame(rows, "clip string, frame_idx int, h array<double>"), "h")
    assert all(r.h == r.h_smooth for r in d.collect())


@pytest.mark.parametrize("bits", BITS)
def test_majority_and_plays(spark, bits):
    d = spark.createDataFrame([("c", i, v, 1.0) for i, v in enumerate("abc")], "clip string, sec int, label string, conf double")
    assert [r.smooth for r in R.majority_smooth(d, "label", bits=bits).orderBy("sec").collect()] == ["a", "a", "b"]
    views = ["sideline", "sideline", "endzone", "endzone", "sideline"]
    segs = spark.createDataFrame([("c", 10.0 * i, 10.0 * i + 9, v, 10 * i) for i, v in enumerate(views)],
                                 "clip string, start_s double, end_s double, view string, start_pos int")
    plays = [(r.play_num, r.sideline_start, r.endzone_start, r.endzone_end) for r in R.group_plays(segs, bits=bits).orderBy("play_num").collect()]
    assert plays == [(1, 10.0, 20.0, 29.0), (2, 40.0, 0.0, 0.0)]


def test_homography_sums_are_no_interpreted_folds(spark):
    rows = [("c", i, [1.0 + 0.01 * i * i, 0.0, 2.0, 0.0, 1.0, 3.0, 0.0, 0.0, 1.0], 0.1 + (i == 4)) for i in range(12)]
    d = spark.createDataFrame(rows, "clip string, frame_idx int, h array<double>, rmse double")
    for out in (S.loo_residual(d), S.fill_bad(d), S.smooth_h(d, "h")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f in plan for f in ("aggregate(", "zip_with(", "transform("))
    filled = {r.frame_idx: r.h_clean for r in S.fill_bad(d).collect()}
    assert all(filled[i] == pytest.approx(rows[i][2], abs=1e-9) for i in filled)
    smooth = {r.frame_idx: r.h_smooth for r in S.smooth_h(d, "h").collect()}
    assert all(smooth[i] == pytest.approx(rows[i][2], abs=1e-9) for i in range(3, 9))


@pytest.mark.parametrize("bits", BITS)
def test_spaced_samples(spark, bits):
    d = track(spark, [(0.0,)] * 10)
    got = sorted(r.frame_idx for r in R.spaced_samples(d, 8, bits=bits).collect())
    assert got == [0, 1, 2, 3, 5, 6, 7, 9]


@pytest.mark.parametrize("bits", [2, 4, 10])
def test_kalman_pieces_equal_one_pass(spark, bits):
    rnd = np.random.default_rng(0)
    rows = [(float(v[0]), float(v[1]), bool(v[2] > -0.5)) for v in rnd.normal(size=(40, 3))]
    d = track(spark, rows, "x double, y double, measured boolean")
    got = kalman_track(d, bits=bits).orderBy("frame_idx").collect()
    dt, f = 1 / 30, np.array([[1, 1 / 30], [0, 1]])
    g = np.array([[dt * dt / 2], [dt]])
    born = next(i for i, r in enumerate(rows) if r[2])
    m, p = np.array([rows[born][0], 0.0]), np.diag([0.25, 25.0])
    for r, (x, _, ok) in zip(got, rows[born:]):
        if r.frame_idx > born:
            m, p = f @ m, f @ p @ f.T + g @ g.T * 64
            if ok:
                k = p[:, 0] / (p[0, 0] + 0.25)
                m, p = m + k * (x - m[0]), p - np.outer(k, p[0])
        assert (r.fx, r.vx, r.var) == pytest.approx((m[0], m[1], p[0, 0]), abs=1e-7)


def test_kalman_tracks_side_by_side_equal_each_alone(spark):
    rnd = np.random.default_rng(1)
    rows = [("c", t, i, float(v[0]), float(v[1]), bool(v[2] > -0.5)) for t, n in enumerate((1, 9, 3, 14)) for i, v in enumerate(rnd.normal(size=(n, 3)))]
    schema = "clip string, track_id bigint, frame_idx int, x double, y double, measured boolean"
    filtered = kalman_track(spark.createDataFrame(rows, schema), bits=2)
    got = sorted(map(tuple, filtered.collect()))
    alone = [tuple(r) for t in range(4) for r in kalman_track(spark.createDataFrame([r for r in rows if r[1] == t], schema), bits=10).collect()]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(alone)]
    assert [v for r in got for v in r[3:]] == pytest.approx([v for r in sorted(alone) for v in r[3:]], abs=1e-9)
    # the frames themselves are no pandas group per piece
    assert "MapInArrow _filtered" in filtered._jdf.queryExecution().analyzed().toString()


def test_ema_seeds_with_the_first(spark):
    d = track(spark, [([2.0],), (None,), ([4.0],)], "sig array<double>")
    assert ema(d, "sig", F.lit(True), 0.9).first().ema == pytest.approx([2.2])
