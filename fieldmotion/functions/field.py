"""Snapping field coordinates to painted markings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmotion.functions.constants import (
    FIELD_LENGTH, FIELD_WIDTH, GOAL_LEFT, GOAL_RIGHT, HASH_FAR_Y, HASH_NEAR_Y, KIND_Y,
    NUMBER_FAR_INSIDE_Y, NUMBER_FAR_Y, NUMBER_NEAR_INSIDE_Y, NUMBER_NEAR_Y,
    PAINTED_LABELS, PAINTED_TO_LINE,
)


def _between(x, lo, hi):
    return (x >= lo) & (x <= hi)


def yard_slot(x: Column) -> Column:
    """Index 0..20 of the nearest yard line, the lower one on a tie."""
    return F.least(F.greatest(F.ceil((x - 10) / 5 - 0.5), F.lit(0)), F.lit(20)).cast("int")


def slot_x(slot: Column) -> Column:
    return 10.0 + 5 * slot


def yard_class(x: Column, outside: str = "clamp") -> Column:
    """Half-even class of x; outside 0..20 it is clamped or, with ``minus``, -1."""
    c = F.rint((x - 10) / 5).cast("int")
    if outside == "clamp":
        return F.least(F.greatest(c, F.lit(0)), F.lit(20))
    return F.when(_between(c, 0, 20), c).otherwise(-1)


def class_yards(c: Column) -> Column:
    return 10.0 + 5.0 * c


def class_share(c: Column) -> Column:
    return class_yards(c) / FIELD_LENGTH


def number_class(x: Column) -> Column:
    """Even class 2..18 of a painted number; odd classes move towards x, ties down."""
    c = F.rint((x - 10) / 5).cast("int")
    even = F.when(c % 2 == 0, c).when(x > 10 + c * 5, c + 1).otherwise(c - 1)
    return F.when(_between(c, 2, 18) & _between(even, 2, 18), even).otherwise(-1).cast("int")


def side_row(y: Column) -> Column:
    return F.when(y < FIELD_WIDTH * 0.5, 0).otherwise(1)


def _nearer(y, near, far):
    return F.when(F.abs(y - near) < F.abs(y - far), 0).otherwise(1)


def hash_row(y: Column) -> Column:
    return _nearer(y, HASH_NEAR_Y, HASH_FAR_Y)


def number_row(y: Column) -> Column:
    return _nearer(y, NUMBER_NEAR_INSIDE_Y, NUMBER_FAR_INSIDE_Y)


def field_number(x: Column) -> Column:
    """The number painted at x: yards to the nearer goal line, truncated."""
    return F.least(x - GOAL_LEFT, GOAL_RIGHT - x).cast("int")


def number_label(x: Column) -> Column:
    n = field_number(x)
    return F.when(n == 50, F.lit("50")).otherwise(
        F.concat(n.cast("string"), F.when(x < 60, F.lit("L")).otherwise(F.lit("R"))))


def line_of_painted(p: Column) -> Column:
    """Painted class 0..8 to its class among the 21 lines."""
    return F.element_at(F.array(*[F.lit(v) for v in PAINTED_TO_LINE]), p + 1)


def painted_of_line(c: Column) -> Column:
    """Line class to painted class 0..8, -1 where nothing is painted."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in PAINTED_TO_LINE]), c), F.lit(0)).cast("int") - 1


def to_field_order(values: Column, trained: list[str]) -> Column:
    """Reorder an array given in ``trained`` label order into painted field order."""
    at = [trained.index(label) + 1 for label in PAINTED_LABELS]
    return F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.element_at(values, i))


def keypoint_kind(y: Column, channel: Column) -> Column:
    """Kind of a marking from its y; channel 1 is a hash, otherwise a sideline."""
    far_hash = F.abs(y - HASH_FAR_Y) < F.abs(y - HASH_NEAR_Y)
    return (F.when(channel == 1, F.when(far_hash, F.lit("far_hash")).otherwise(F.lit("near_hash")))
            .when(y > FIELD_WIDTH * 0.5, F.lit("sideline_far")).otherwise(F.lit("sideline_near")))


def kind_y(kind: Column) -> Column:
    pairs = [F.lit(v) for item in KIND_Y.items() for v in item]
    return F.create_map(*pairs)[kind]


def canonical_point(kind: Column, slot: Column) -> tuple[Column, Column]:
    return slot_x(slot), kind_y(kind)


def stratum(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bucket holding x, the last edge included; -1 outside."""
    expr = F.when(x.isNull() | (x < edges[0]) | (x > edges[-1]), -1)
    for i, right in enumerate(edges[1:-1]):
        expr = expr.when(x < right, i)
    return expr.otherwise(len(edges) - 2)


def painted_bucket(x: Column, y: Column) -> dict[str, Column]:
    """Nearest painted number of a point: bucket, row and distance, NULL when rejected."""
    bucket = (F.rint(x / 10) * 10).cast("int")
    near, far = F.abs(y - NUMBER_NEAR_Y), F.abs(y - NUMBER_FAR_Y)
    dy = F.least(near, far)
    ok = (_between(x, 10, 110) & _between(bucket, 20, 100) & (F.abs(x - bucket) <= 5) & (dy <= 6))
    return {
        "bucket": F.when(ok, bucket),
        "label": F.when(ok, number_label(bucket.cast("double"))),
        "side": F.when(ok, F.when(near < far, F.lit("near")).otherwise(F.lit("far"))),
        "distance": F.when(ok, F.sqrt((x - bucket) * (x - bucket) + dy * dy)),
    }


def allowed_region(x: Column, y: Column) -> dict[str, Column]:
    """Where pixels of each mask channel may lie on the field."""
    line, ten = F.rint(x / 5) * 5, F.rint(x / 10) * 10
    return {
        "yard": (F.abs(x - line) <= 1.0) & _between(y, -1.0, FIELD_WIDTH + 1.0),
        "side": ((F.abs(y) <= 2.0) | (F.abs(y - FIELD_WIDTH) <= 2.0)) & _between(x, 0.0, 120.0),
        "hash": (((F.abs(y - HASH_NEAR_Y) <= 0.5) | (F.abs(y - HASH_FAR_Y) <= 0.5))
                 & (F.abs(x - F.rint(x)) <= 1.0) & _between(x, 10.0, 110.0)),
        "number": ((_between(y, NUMBER_NEAR_Y - 1.5, NUMBER_NEAR_Y + 1.5)
                    | _between(y, NUMBER_FAR_Y - 1.5, NUMBER_FAR_Y + 1.5))
                   & (F.abs(x - ten) <= 3.5) & _between(ten, 20.0, 100.0)),
    }


def quantise_conf(x: Column) -> dict[str, Column]:
    """Snap a projected x to five yards with a confidence falling to 0 at 2.5 yards."""
    q = F.rint(x / 5) * 5
    dev = F.abs(x - q)
    ok = _between(q, 10.0, 110.0) & (dev < 3.0)
    share = F.least(F.greatest(1 - dev / 2.5, F.lit(0.0)), F.lit(1.0))
    return {"value": F.when(ok, q).otherwise(0.0), "has_value": ok,
            "conf": F.when(ok, share).otherwise(0.0)}


def to_canvas(x: Column, y: Column) -> tuple[Column, Column]:
    """Yards to display pixels, 8 per yard, y pointing down."""
    height = int(FIELD_WIDTH * 8)
    return x * 8, height - y * 8
