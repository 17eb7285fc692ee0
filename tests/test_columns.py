"""Hand-worked cases for column functions."""

import math

import pytest
from pyspark.sql import functions as F

from fieldmotion.functions import arrays as A
from fieldmotion.functions import field as D
from fieldmotion.functions import geometry as G
from fieldmotion.sources.files import three_decimals


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lits(values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_projection_of_vanishing_weight_and_identity(spark):
    flat, eye = lits([1, 0, 0, 0, 1, 0, 0, 0, 0]), lits([1, 0, 0, 0, 1, 0, 0, 0, 1])
    x, _ = G.project(flat, F.lit(3.0), F.lit(4.0))
    u, v = G.project(eye, F.lit(3.0), F.lit(4.0))
    assert one(spark, x, u, v) == (None, 3.0, 4.0)


def test_project_then_unproject_returns_the_pixel(spark):
    h = lits([0.08, 0.002, 5, 0.001, 0.07, -3, 1e-5, 2e-5, 1])
    x, y = G.project(h, F.lit(640.0), F.lit(300.0))
    u, v = one(spark, *G.unproject(h, x, y))
    assert u == pytest.approx(640) and v == pytest.approx(300)


def test_distort_undistort(spark):
    k, d = lits([1100, 0, 640, 0, 1100, 360, 0, 0, 1]), lits([-0.05, 0.01, 0, 0, 0])
    u, v = one(spark, *G.undistort(*G.distort(F.lit(700.0), F.lit(400.0), k, d), k, d))
    assert u == pytest.approx(700, abs=1e-3) and v == pytest.approx(400, abs=1e-3)


def test_class_snaps(spark):
    # ties go to the even class; the -1 variant rejects instead of clamping
    assert one(spark, *[D.yard_class(F.lit(x), "minus") for x in (12.5, 17.5, 9.0, 7.4, 112.0, 113.0)]) == (0, 2, 0, -1, 20, -1)
    assert one(spark, *[D.number_class(F.lit(x)) for x in (25.0, 25.1, 14.9)]) == (2, 4, -1)
    assert one(spark, *[D.yard_slot(F.lit(x)) for x in (-5.0, 12.5, 12.6, 130.0)]) == (0, 0, 1, 20)


def test_painted_labels_and_rows(spark):
    assert one(spark, *[D.number_label(F.lit(x)) for x in (20.0, 60.0, 100.0)]) == ("10L", "50", "10R")
    mid = (14.0 + 39.33) / 2
    assert one(spark, D.number_row(F.lit(mid)), D.side_row(F.lit(53.33 / 2))) == (1, 1)


def test_stratum_edges(spark):
    e = [10.0, 30.0, 50.0, 70.0, 90.0, 110.0]
    assert one(spark, *[D.stratum(F.lit(x), e) for x in (9.9, 10.0, 30.0, 110.0, 110.1)]) == (-1, 0, 1, 4, -1)


def test_arrays(spark):
    a = lits([1, 3, 3])
    assert one(spark, A.argmax(a), A.kth_extreme(a, 5, F.lit(False)), A.cosine_distance(a, lits([0, 0, 0]))) == (1, 3.0, None)
    assert list(one(spark, A.pad_to(a, F.lit(5), F.lit(0.0)))[0]) == [1, 3, 3, 0, 0]
    assert one(spark, A.softmax_expectation(lits([1000, 1000]), lits([0, 1])))[0] == pytest.approx(0.5)
    assert list(one(spark, A.scatter(F.array(F.lit(1)), lits([7]), F.lit(3), F.lit(-1.0)))[0]) == [-1, 7, -1]


def test_three_decimals_follow_the_binary_value(spark):
    values = [13.3325, 0.0005, 0.0015, 2.5, 1.0005, 99.9995, 1 / 3, 12.3455, 26.665, 0.1235]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(three_decimals(F.col("v"))).collect()]
    assert got == [f"{v:.3f}" for v in values]


def test_hue_circle_round_trip(spark):
    from fieldmotion.functions.boxes import features_hue, hue_features

    a, b, _, _ = hue_features(F.lit(135), F.lit(1), F.lit(1))
    assert one(spark, features_hue(a, b))[0] == pytest.approx(135)
    assert math.isclose(one(spark, a)[0], 720 * math.cos(135 / 180 * 2 * math.pi), abs_tol=1e-9)
