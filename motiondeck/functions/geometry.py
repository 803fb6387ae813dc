"""Scalar geometry as Column expressions. NULL in, NULL out; nothing yields NaN or infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def finite(x: Column) -> Column:
    """x, NULL where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b, NULL where the size of b is not above ``least``."""
    return F.when(F.abs(b) > least, a / b)


def point(prefix: str, names: str = "xyz") -> Point:
    return tuple(F.col(f"{prefix}_{c}") for c in names)


def minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    first, *rest = (p * q for p, q in zip(a, b, strict=True))
    for x in rest:
        first = first + x
    return first


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def angle_at_vertex(a: Point, b: Point, c: Point) -> Column:
    """Degrees at b between the arms to a and c; NULL if an arm has no length."""
    u, v = minus(a, b), minus(c, b)
    size = norm(u) * norm(v)
    return F.when(size > 1e-12, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.when(size > 1e-12, size))))))


def finger_flexion(a: Point, b: Point, c: Point, d: Point) -> Column:
    """The bend over four landmarks of a finger: what both inner joints lack to a straight line, 2 decimals."""
    return F.round((180 - angle_at_vertex(a, b, c)) + (180 - angle_at_vertex(b, c, d)), 2)


def bilateral(left: Column, right: Column) -> dict[str, Column]:
    """symmetry_ratio, dominance_index and abs_diff of two sides, NULL unless both are known."""
    a, b = F.abs(left), F.abs(right)
    total = a + b
    some = total > 1e-12
    return {
        "symmetry_ratio": F.when(some, F.least(a, b) / F.when(some, F.greatest(a, b))),
        "dominance_index": F.when(some, (b - a) / F.when(some, total)),
        "abs_diff": F.abs(right - left),
    }


def _middle(a: Point, b: Point) -> Point:
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def _turn(a: Column, b: Column) -> Column:
    return F.degrees(F.atan2(F.sin(a - b), F.cos(a - b)))


def trunk_2d(ls: Point, rs: Point, lh: Point, rh: Point) -> dict[str, Column]:
    """Lean, lateral lean, rotation and posture symmetry in image coordinates (y down)."""
    s, h = _middle(ls[:2], rs[:2]), _middle(lh[:2], rh[:2])
    dx, dy = s[0] - h[0], s[1] - h[1]
    width = norm(minus(rs[:2], ls[:2]))
    return {
        "trunk_lean_deg": F.degrees(F.atan2(F.abs(dx), F.abs(dy))),
        "trunk_lean_lateral_deg": F.degrees(F.atan2(dx, -dy)),
        "trunk_lean_sagittal_deg": F.when(dx.isNull(), None).otherwise(F.lit(None)).cast("double"),
        "trunk_rotation_deg": _turn(F.atan2(rs[1] - ls[1], rs[0] - ls[0]), F.atan2(rh[1] - lh[1], rh[0] - lh[0])),
        "posture_symmetry": ratio(ls[1] - rs[1], width, 1e-6),
    }


def trunk_3d(ls: Point, rs: Point, lh: Point, rh: Point) -> dict[str, Column]:
    """The same in metric space, with the sagittal lean."""
    dx, dy, dz = minus(_middle(ls, rs), _middle(lh, rh))
    return {
        "trunk_lean_deg": F.degrees(F.atan2(F.sqrt(dx * dx + dz * dz), -dy)),
        "trunk_lean_lateral_deg": F.degrees(F.atan2(dx, -dy)),
        "trunk_lean_sagittal_deg": F.degrees(F.atan2(dz, -dy)),
        "trunk_rotation_deg": _turn(F.atan2(rs[2] - ls[2], rs[0] - ls[0]), F.atan2(rh[2] - lh[2], rh[0] - lh[0])),
        "posture_symmetry": ratio(ls[1] - rs[1], distance(rs, ls), 1e-6),
    }


def body_anchor(left: Point, right: Point, median: Point) -> Point:
    """The middle of the shoulders, else the known shoulder, else the median of all points."""
    return tuple(F.coalesce((a + b) / 2, a, b, m) for a, b, m in zip(left, right, median, strict=True))


def safe_fps(fps: Column) -> Column:
    """A believable frame rate (1 to 240), else 30."""
    return F.when(fps.between(1, 240) & ~F.isnan(fps), fps).otherwise(F.lit(30.0))


def nominal_duration(frames: Column, fps: Column) -> Column:
    return F.when((frames > 0) & (fps > 0) & (fps < float("inf")), frames / F.when(fps > 0, fps))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(F.least(x, F.lit(0.0))) / (1 + F.exp(F.least(x, F.lit(0.0)))))


def minimum_jerk(u: Column) -> Column:
    return 10 * F.pow(u, 3) - 15 * F.pow(u, 4) + 6 * F.pow(u, 5)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union, 0 if neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    areas = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
    union = areas - w * h
    return F.when(union > 0, w * h / F.when(union > 0, union)).otherwise(0.0)


def anchor_box(x: Column, y: Column, grid: int, dx: Column, dy: Column, scale: float, logit: Column) -> Point:
    """Centre of a detection decoded from its anchor cell, and its score from a logit."""
    return (x + 0.5) / grid + dx / scale, (y + 0.5) / grid + dy / scale, sigmoid(logit)


def unletterbox(x: Column, y: Column, scale: Column, pad_x: Column, pad_y: Column) -> tuple[Column, Column]:
    """Image coordinates of a point found in a letterboxed picture."""
    return ratio(x - pad_x, scale), ratio(y - pad_y, scale)


def rotated_crop_to_image(u: Column, v: Column, centre: Point, size: Column, angle: Column, crop: float) -> tuple[Column, Column]:
    """Image coordinates of a crop's pixel (u, v): scale about its middle, rotate, shift to the centre."""
    x, y = (u / crop - 0.5) * size, (v / crop - 0.5) * size
    return centre[0] + x * F.cos(angle) - y * F.sin(angle), centre[1] + x * F.sin(angle) + y * F.cos(angle)


def catmull_rom(p: list[Column], t: Column) -> Column:
    """The spline through the middle two of four control values at t in 0..1."""
    a, b, c, d = p
    return 0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t * t + (3 * b - a - 3 * c + d) * t * t * t)
