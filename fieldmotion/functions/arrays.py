"""Array expressions for signatures, logits and padded batches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(a: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax_expectation(logits: Column, values: Column) -> Column:
    """Expected value under the softmax of the logits, shifted by their maximum."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return dot(e, values) / total(e)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, clamped to [0, 1]; NULL when a side is missing or nearly zero."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    d = 1 - dot(a, b) / (na * nb)
    return F.when((na > 1e-9) & (nb > 1e-9), F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)))


def gather(a: Column, idx: Column) -> Column:
    """Elements at 0-based positions."""
    return F.transform(idx, lambda i: F.element_at(a, i + 1))


def scatter(idx: Column, values: Column, n: Column, default: Column) -> Column:
    """Array of length n holding values at 0-based positions and default elsewhere."""
    m = F.map_from_arrays(idx, values)
    whole = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(m[i], default))
    return F.when(n > 0, whole).otherwise(F.slice(whole, 1, 0))


def pad_to(a: Column, n: Column, fill: Column) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def pad_mask(a: Column, n: Column) -> Column:
    """True where the padded array holds fill."""
    return F.concat(F.array_repeat(F.lit(False), F.size(a)),
                    F.array_repeat(F.lit(True), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def kth_extreme(values: Column, k: int, from_top: Column) -> Column:
    """k-th value in from the smallest (or, from_top, the largest); k is clamped."""
    s = F.sort_array(values)
    at = F.least(F.lit(k), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0,
                  F.when(from_top, F.element_at(s, F.size(values) - at)).otherwise(F.element_at(s, at + 1)))


def normalise_sum(a: Column) -> Column:
    t = F.greatest(total(a), F.lit(1.0))
    return F.transform(a, lambda x: x / t)


def token_features(type_: Column, cx, cy, x_min, y_min, x_max, y_max, area, cos_t, sin_t,
                   value, has_value, conf) -> Column:
    """The 16-number token: one-hot type, geometry over image size, orientation, label."""
    import math

    from fieldmotion.functions.constants import FIELD_LENGTH, IMAGE_H, IMAGE_W

    one_hot = [F.when(type_ == i, 1.0).otherwise(0.0) for i in range(4)]
    log_area = F.log(F.greatest(area, F.lit(1)).cast("double")) / math.log(IMAGE_W * IMAGE_H)
    rest = [cx / IMAGE_W, cy / IMAGE_H, x_min / IMAGE_W, y_min / IMAGE_H, x_max / IMAGE_W,
            y_max / IMAGE_H, log_area, cos_t, sin_t, value / FIELD_LENGTH,
            F.when(has_value, 1.0).otherwise(0.0), conf]
    return F.array(*one_hot, *[c.cast("double") for c in rest])


def token_type(token: Column) -> Column:
    return argmax(F.slice(token, 1, 4))
