"""Detection boxes as column quadruples (x1, y1, x2, y2) in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmotion.functions.constants import IMAGE_H, IMAGE_W

Box = tuple[Column, Column, Column, Column]


def foot_point(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where the player stands: mid-width, 95 % of the way down."""
    return (x1 + x2) * 0.5, y1 + 0.95 * (y2 - y1)


def _keep(ok: Column, sides) -> Box:
    return tuple(F.when(ok, s) for s in sides)


def clamp_box(x1, y1, x2, y2, width=IMAGE_W, height=IMAGE_H) -> Box:
    """Round half-even into the image; NULL when under 4 x 8 pixels."""
    a, b = (F.greatest(F.rint(c).cast("int"), F.lit(0)) for c in (x1, y1))
    c = F.least(F.rint(x2).cast("int"), F.lit(width))
    d = F.least(F.rint(y2).cast("int"), F.lit(height))
    return _keep((c - a >= 4) & (d - b >= 8), (a, b, c, d))


def jersey_box(x1, y1, x2, y2, width=IMAGE_W, height=IMAGE_H) -> Box:
    """The shirt: 15-50 % of the height, 20 % off each side."""
    bw, bh = x2 - x1, y2 - y1
    a = F.greatest(F.rint(x1 + 0.2 * bw).cast("int"), F.lit(0))
    c = F.least(F.rint(x2 - 0.2 * bw).cast("int"), F.lit(width))
    b = F.greatest(F.rint(y1 + 0.15 * bh).cast("int"), F.lit(0))
    d = F.least(F.rint(y1 + 0.5 * bh).cast("int"), F.lit(height))
    return _keep((bw > 4) & (bh > 8) & (c - a >= 3) & (d - b >= 3), (a, b, c, d))


def inner_box(x1, y1, x2, y2, margin=0.2, width=IMAGE_W, height=IMAGE_H) -> Box:
    """The box without a share of each side, rounded outwards."""
    bw, bh = x2 - x1, y2 - y1
    a = F.greatest(F.floor(x1 + bw * margin).cast("int"), F.lit(0))
    b = F.greatest(F.floor(y1 + bh * margin).cast("int"), F.lit(0))
    c = F.least(F.ceil(x2 - bw * margin).cast("int"), F.lit(width))
    d = F.least(F.ceil(y2 - bh * margin).cast("int"), F.lit(height))
    return _keep((bw > 1) & (bh > 1) & (c - a >= 2) & (d - b >= 2), (a, b, c, d))


def centre_to_corners(cx, cy, w, h, width=IMAGE_W, height=IMAGE_H) -> Box:
    """Normalised centre box to pixel corners."""
    return ((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def expanded_iou(a: Box, b: Box, factor: float = 0.0) -> Column:
    """Overlap over union after growing both boxes about their centres; 0 if degenerate."""
    def grown(lo, hi):
        mid, half = (lo + hi) * 0.5, (hi - lo) * 0.5 * (1.0 + factor)
        return mid - half, mid + half

    ax1, ax2 = grown(a[0], a[2])
    ay1, ay2 = grown(a[1], a[3])
    bx1, bx2 = grown(b[0], b[2])
    by1, by2 = grown(b[1], b[3])
    iw = F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), F.lit(0.0))
    ih = F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), F.lit(0.0))
    inter = iw * ih
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    solid = (a[2] > a[0]) & (a[3] > a[1]) & (b[2] > b[0]) & (b[3] > b[1])
    return F.when(solid & (inter > 0) & (union > 0), inter / union).otherwise(0.0)


def chromatic_rules(h: Column, s: Column, v: Column) -> dict[str, Column]:
    """Which background rule a pixel meets, and whether it is kept as shirt colour."""
    rules = {
        "grass": (h >= 35) & (h <= 85) & (s > 60),
        "white": (s < 40) & (v > 150),
        "dark": v < 50,
        "glare": (s < 60) & (v > 220),
    }
    dropped = rules["grass"] | rules["white"] | rules["dark"] | rules["glare"]
    rules["keep"] = ~dropped & (s > 60) & (v >= 50) & (v <= 220)
    return rules


def hue_features(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    """Hue on a circle of radius 720 (so it outweighs saturation and value)."""
    angle = h / 180.0 * 2.0 * F.pi()
    return F.cos(angle) * 720.0, F.sin(angle) * 720.0, s.cast("double"), v.cast("double")


def features_hue(fc: Column, fs: Column) -> Column:
    """Back from the circle to hue 0..180."""
    return F.pmod(F.degrees(F.atan2(fs, fc)), F.lit(360.0)) / 2.0
