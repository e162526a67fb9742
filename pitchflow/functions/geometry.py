"""Column expressions over boxes, points and polygons. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "struct<x:double,y:double>"


def ninth(c: Column) -> Column:
    """A double to nine digits. ``F.round`` goes through decimals, at many times the cost."""
    return F.rint(c * 1e9) / 1e9


def width(p: str = "") -> Column:
    return F.col(f"{p}x2") - F.col(f"{p}x1")


def height(p: str = "") -> Column:
    return F.col(f"{p}y2") - F.col(f"{p}y1")


def area(p: str = "") -> Column:
    return F.greatest(width(p), F.lit(0.0)) * F.greatest(height(p), F.lit(0.0))


def cx(p: str = "") -> Column:
    return (F.col(f"{p}x1") + F.col(f"{p}x2")) / 2


def cy(p: str = "") -> Column:
    return (F.col(f"{p}y1") + F.col(f"{p}y2")) / 2


def point_to_box(x: Column, y: Column, p: str = "") -> Column:
    """Distance of a point from a rectangle, 0 inside."""
    dx = F.greatest(F.col(f"{p}x1") - x, x - F.col(f"{p}x2"), F.lit(0.0))
    dy = F.greatest(F.col(f"{p}y1") - y, y - F.col(f"{p}y2"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 for an empty union."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def own_overlap(a: str, b: str) -> Column:
    """Share of box a that box b covers; 0 without area."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def time_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    both = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def in_heights(distance: Column, h1: Column, h2: Column) -> Column:
    """A distance in mean box heights; infinite without a height."""
    mean = (h1 + h2) / 2
    return F.when(mean > 0, distance / mean).otherwise(F.lit(float("inf")))


def crossing(ax, ay, bx, by, cx_, cy_, dx, dy) -> Column:
    """Where segment AB meets segment CD, ends included; null if they don't or are parallel."""
    denom = (bx - ax) * (dy - cy_) - (by - ay) * (dx - cx_)
    s = ((cx_ - ax) * (dy - cy_) - (cy_ - ay) * (dx - cx_)) / denom
    u = ((cx_ - ax) * (by - ay) - (cy_ - ay) * (bx - ax)) / denom
    inside = (F.abs(denom) >= 1e-9) & s.between(0, 1) & u.between(0, 1)
    return F.when(inside, F.struct((ax + s * (bx - ax)).alias("x"), (ay + s * (by - ay)).alias("y")))


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over the polygon's edges; polygon is array<struct<x, y>>."""
    n = F.size(polygon)
    steps = F.sequence(F.lit(1), n)

    def cross(i: Column) -> Column:
        a = F.element_at(polygon, i)
        b = F.element_at(polygon, F.when(i == 1, n).otherwise(i - 1))
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + 1e-12) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.when(n >= 3, F.aggregate(steps, F.lit(False), lambda acc, i: acc != cross(i))).otherwise(F.lit(False))


def to_pitch(x: Column, y: Column, m: Column) -> Column:
    """Perspective transform by a 3 x 3 matrix (array of arrays)."""
    row = [m[i][0] * x + m[i][1] * y + m[i][2] for i in range(3)]
    return F.struct((row[0] / row[2]).alias("x"), (row[1] / row[2]).alias("y"))


def warped(a, b, tx, c, d, ty, p: str = "") -> Column:
    """The box round the four corners of a box after a 2 x 3 affine."""
    corners = [(F.col(f"{p}{u}"), F.col(f"{p}{v}")) for u in ("x1", "x2") for v in ("y1", "y2")]
    xs = [a * x + b * y + tx for x, y in corners]
    ys = [c * x + d * y + ty for x, y in corners]
    return F.struct(F.least(*xs).alias("x1"), F.least(*ys).alias("y1"), F.greatest(*xs).alias("x2"), F.greatest(*ys).alias("y2"))


def scaled_size(w: Column, h: Column, scale_width: int) -> Column:
    """(width, height) of the frame that detectors see: never wider than ``scale_width``, of even height."""
    small = F.struct(F.lit(scale_width).alias("width"), (F.floor(F.bround(h * scale_width / w) / 2) * 2).cast("int").alias("height"))
    return F.when(w > scale_width, small).otherwise(F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def expanded(fx: float, fy: float, frame_w: Column, frame_h: Column, p: str = "") -> Column:
    """The box grown by fractions of its size, rounded half to even and kept in the frame."""
    w, h = width(p), height(p)

    def keep(v: Column, most: Column) -> Column:
        return F.least(F.greatest(F.bround(v), F.lit(0.0)), most.cast("double"))

    return F.struct(
        keep(F.col(f"{p}x1") - fx * w, frame_w).alias("x1"),
        keep(F.col(f"{p}y1") - fy * h, frame_h).alias("y1"),
        keep(F.col(f"{p}x2") + fx * w, frame_w).alias("x2"),
        keep(F.col(f"{p}y2") + fy * h, frame_h).alias("y2"),
    )


def native_crop(scale_x: float, scale_y: float, expand: float, frame_w: int, frame_h: int, p: str = "") -> Column:
    """A box of the scaled frame in pixels of the full one, grown by ``expand`` on each side, rounded half to even and cut
    at the frame: left and top at 0, right and bottom at its size. It may be empty."""
    w, h = width(p) * scale_x * expand, height(p) * scale_y * expand
    near = lambda v: F.greatest(F.lit(0), F.bround(v).cast("int"))
    far = lambda v, most: F.least(F.lit(most), F.bround(v).cast("int"))
    return F.struct(
        near(F.col(f"{p}x1") * scale_x - w).alias("x1"), near(F.col(f"{p}y1") * scale_y - h).alias("y1"),
        far(F.col(f"{p}x2") * scale_x + w, frame_w).alias("x2"), far(F.col(f"{p}y2") * scale_y + h, frame_h).alias("y2"),
    )


def large_enough(crop: Column, frame_h: int, least: float = 0.05556) -> Column:
    """Whether a crop has an area and at least that share of the frame's height."""
    return (crop["y2"] - crop["y1"] >= least * frame_h) & (crop["x2"] > crop["x1"]) & (crop["y2"] > crop["y1"])


def band(top: float, bottom: float, left: float, right: float, p: str = "") -> Column:
    """A part of a box between shares of its height, less shares of its width at the sides: torso, number, shorts or socks.
    A band without an area is the whole box."""
    w, h = width(p), height(p)
    x1, x2 = F.col(f"{p}x1") + left * w, F.col(f"{p}x2") - right * w
    y1, y2 = F.col(f"{p}y1") + top * h, F.col(f"{p}y1") + bottom * h
    whole = F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))).otherwise(whole)


def cielab(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Colours in the 8-bit scale of image libraries as CIELAB."""
    return F.struct((l * 100 / 255).alias("l"), (a - 128).alias("a"), (b - 128).alias("b"))


def goal_line(posts: Column) -> Column:
    """struct<left, right> of the outermost post feet (array of boxes); null with fewer than two posts."""
    feet = F.array_sort(F.transform(posts, lambda b: F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y"))))
    return F.when(F.size(posts) >= 2, F.struct(F.element_at(feet, 1).alias("left"), F.element_at(feet, -1).alias("right")))
