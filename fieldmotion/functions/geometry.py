"""Homography and lens arithmetic on columns. ``h`` is a row-major array of nine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmotion.functions.constants import FIELD_WIDTH, GOAL_LEFT, GOAL_RIGHT, IMAGE_H, IMAGE_W


def _cells(h):
    return [h[i] for i in range(9)]


def safe_denominator(w: Column, policy: str = "null") -> Column:
    """How a vanishing projective weight is treated.

    ``null`` drops the point below 1e-12, ``clamp`` uses +1e-10 below 1e-10,
    ``clamp9`` uses +1e-9 below 1e-9, ``floor9`` raises anything under 1e-9 to it.
    """
    if policy == "null":
        return F.when(F.abs(w) >= 1e-12, w)
    if policy == "clamp":
        return F.when(F.abs(w) < 1e-10, F.lit(1e-10)).otherwise(w)
    if policy == "clamp9":
        return F.when(F.abs(w) < 1e-9, F.lit(1e-9)).otherwise(w)
    if policy == "floor9":
        return F.greatest(w, F.lit(1e-9))
    raise ValueError(policy)


def project(h: Column, u: Column, v: Column, policy: str = "null") -> tuple[Column, Column]:
    """Pixel to yards (or any plane to plane): the pair of projected coordinates."""
    a = _cells(h)
    w = safe_denominator(a[6] * u + a[7] * v + a[8], policy)
    return (a[0] * u + a[1] * v + a[2]) / w, (a[3] * u + a[4] * v + a[5]) / w


def h_inverse(h: Column) -> Column:
    """Inverse by the adjugate; NULL when singular."""
    a, b, c, d, e, f, g, i, j = _cells(h)
    co = [e * j - f * i, c * i - b * j, b * f - c * e,
          f * g - d * j, a * j - c * g, c * d - a * f,
          d * i - e * g, b * g - a * i, a * e - b * d]
    det = a * co[0] + b * co[3] + c * co[6]
    return F.when(det != 0, F.array(*[x / det for x in co]))


def h_multiply(p: Column, q: Column) -> Column:
    return F.array(*[
        p[3 * r] * q[c] + p[3 * r + 1] * q[3 + c] + p[3 * r + 2] * q[6 + c]
        for r in range(3) for c in range(3)
    ])


def unproject(h: Column, x: Column, y: Column, policy: str = "clamp") -> tuple[Column, Column]:
    """Yards to pixel through the inverse homography."""
    return project(h_inverse(h), x, y, policy)


def probe_corners(margin: int = 100) -> list[tuple[float, float]]:
    """Four interior image corners used to compare homographies."""
    r, b = float(IMAGE_W - margin), float(IMAGE_H - margin)
    m = float(margin)
    return [(m, m), (r, m), (r, b), (m, b)]


def corners(h: Column) -> Column:
    """The eight projected probe coordinates x0, y0, ..., x3, y3; NULL without h."""
    flat = []
    for u, v in probe_corners():
        flat += list(project(h, F.lit(u), F.lit(v), "clamp9"))
    return F.when(h.isNotNull(), F.array(*flat))


def corner_gap(a: Column, b: Column) -> Column:
    """Largest distance between two ``corners`` arrays (pass columns, not expressions)."""
    return F.greatest(*[F.hypot(a[2 * i] - b[2 * i], a[2 * i + 1] - b[2 * i + 1]) for i in range(4)])


def corner_residual(h_a: Column, h_b: Column) -> Column:
    """Largest distance, in yards, of the projected probe corners."""
    gaps = []
    for u, v in probe_corners():
        xa, ya = project(h_a, F.lit(u), F.lit(v), "clamp9")
        xb, yb = project(h_b, F.lit(u), F.lit(v), "clamp9")
        gaps.append(F.hypot(xa - xb, ya - yb))
    return F.when(h_a.isNotNull() & h_b.isNotNull(), F.greatest(*gaps))


def _radial(x, y, k):
    r2 = x * x + y * y
    return r2, 1 + k[0] * r2 + k[1] * r2 * r2 + k[4] * r2 * r2 * r2


def distort(u: Column, v: Column, k: Column, dist: Column) -> tuple[Column, Column]:
    """Ideal pixel to lens pixel (radial k1, k2, k3 and tangential p1, p2).

    ``k`` is the 3x3 camera matrix row-major, ``dist`` is [k1, k2, p1, p2, k3].
    """
    x, y = (u - k[2]) / k[0], (v - k[5]) / k[4]
    r2, rad = _radial(x, y, dist)
    xd = x * rad + 2 * dist[2] * x * y + dist[3] * (r2 + 2 * x * x)
    yd = y * rad + dist[2] * (r2 + 2 * y * y) + 2 * dist[3] * x * y
    return xd * k[0] + k[2], yd * k[4] + k[5]


def undistort(u: Column, v: Column, k: Column, dist: Column, steps: int = 5) -> tuple[Column, Column]:
    """Lens pixel to ideal pixel by fixed-point steps; identity when |k1| <= 1e-6.

    The iteration is a fold over a fixed sequence, so the expression stays small.
    """
    x0, y0 = (u - k[2]) / k[0], (v - k[5]) / k[4]

    def step(acc, _):
        x, y = acc["x"], acc["y"]
        r2, rad = _radial(x, y, dist)
        dx = 2 * dist[2] * x * y + dist[3] * (r2 + 2 * x * x)
        dy = dist[2] * (r2 + 2 * y * y) + 2 * dist[3] * x * y
        return F.struct(((x0 - dx) / rad).alias("x"), ((y0 - dy) / rad).alias("y"))

    start = F.struct(x0.alias("x"), y0.alias("y"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    bent = F.abs(dist[0]) > 1e-6
    return (F.when(bent, p["x"] * k[0] + k[2]).otherwise(u),
            F.when(bent, p["y"] * k[4] + k[5]).otherwise(v))


def on_field(x: Column, y: Column, margin: float = 2.0) -> Column:
    return ((x >= GOAL_LEFT - margin) & (x <= GOAL_RIGHT + margin)
            & (y >= -margin) & (y <= FIELD_WIDTH + margin))
