"""Axis-aligned boxes as struct(x0, y0, x1, y1) of doubles: geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0, y0, x1, y1) -> Column:
    """A box of four columns or numbers."""
    part = lambda v, n: (F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n)
    return F.struct(part(x0, "x0"), part(y0, "y0"), part(x1, "x1"), part(y1, "y1"))


def _b(b: str | Column) -> Column:
    return F.col(b) if isinstance(b, str) else b


def area(b) -> Column:
    """0 for boxes without extent."""
    b = _b(b)
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a, b) -> Column:
    a, b = _b(a), _b(b)
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def hull(a, b) -> Column:
    a, b = _b(a), _b(b)
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_area(a, b) -> Column:
    return area(a) + area(b) - area(intersection(a, b))


def iou(a, b) -> Column:
    """Intersection over union; 0 where both are empty."""
    return F.coalesce(F.try_divide(area(intersection(a, b)), union_area(a, b)), F.lit(0.0))


def iou_hull(a, b) -> Column:
    """Intersection over the hull's area."""
    return F.coalesce(F.try_divide(area(intersection(a, b)), area(hull(a, b))), F.lit(0.0))


def giou(a, b) -> Column:
    """Generalised IoU: less by the share of the hull that neither covers."""
    h = area(hull(a, b))
    return iou(a, b) - F.coalesce(F.try_divide(h - union_area(a, b), h), F.lit(0.0))


def covered(inner, outer) -> Column:
    """The share of *inner* that lies within *outer*."""
    return F.coalesce(F.try_divide(area(intersection(inner, outer)), area(inner)), F.lit(0.0))


def touches(a, b) -> Column:
    """Whether boxes overlap or touch."""
    a, b = _b(a), _b(b)
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def offset(a, b, axis: str) -> Column:
    """The least distance between edges of two boxes along x or y."""
    a, b = _b(a), _b(b)
    return F.least(*[F.abs(a[f"{axis}{i}"] - b[f"{axis}{j}"]) for i in (0, 1) for j in (0, 1)])


def adjacent(a, b, dx: float, dy: float) -> Column:
    return (offset(a, b, "x") <= dx) & (offset(a, b, "y") <= dy)


def direction(a, b) -> Column:
    """Where *b* lies from *a*: one of eight directions, or 'overlap'."""
    a, b = _b(a), _b(b)
    v = F.when(b["y1"] <= a["y0"], "n").when(b["y0"] >= a["y1"], "s").otherwise("")
    h = F.when(b["x1"] <= a["x0"], "w").when(b["x0"] >= a["x1"], "e").otherwise("")
    return F.when((v == "") & (h == ""), "overlap").otherwise(F.concat(v, h))


def normalise(b, width, height) -> Column:
    """Whole numbers from 0 to 1000 of the page's extent, clamped and truncated."""
    b = _b(b)
    to = lambda v, of: F.greatest(F.lit(0), F.least(F.lit(1000), (v * 1000 / of).cast("int"))).cast("double")
    return box(to(b["x0"], width), to(b["y0"], height), to(b["x1"], width), to(b["y1"], height))


def denormalise(b, width, height) -> Column:
    b = _b(b)
    to = lambda v, of: (v * of / 1000).cast("int").cast("double")
    return box(to(b["x0"], width), to(b["y0"], height), to(b["x1"], width), to(b["y1"], height))


def image_to_page(b, scale, page_height) -> Column:
    """Image pixels, y down, to page units, y up."""
    b = _b(b)
    return box(b["x0"] * scale, page_height - b["y1"] * scale, b["x1"] * scale, page_height - b["y0"] * scale)


def clip(b, width, height) -> Column:
    b = _b(b)
    into = lambda v, of: F.greatest(F.lit(0.0), F.least(v, F.lit(of).cast("double")))
    return box(into(b["x0"], width), into(b["y0"], height), into(b["x1"], width), into(b["y1"], height))


def scale(b, sx, sy) -> Column:
    b = _b(b)
    return box(b["x0"] * sx, b["y0"] * sy, b["x1"] * sx, b["y1"] * sy)


def to_xywh(b) -> Column:
    b = _b(b)
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def from_centre(cx, cy, w, h) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def to_centre(b) -> Column:
    b = _b(b)
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"))


def rotated_hull(cx, cy, w, h, degrees) -> Column:
    """The axis-aligned hull of a box turned about its centre."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return from_centre(cx, cy, c * w + s * h, c * h + s * w)


def flip(b, width) -> Column:
    """Left and right turned about the middle of *width*."""
    b = _b(b)
    return box(width - b["x1"], b["y0"], width - b["x0"], b["y1"])


def encode_delta(src, dst, weights=(1.0, 1.0, 1.0, 1.0)) -> Column:
    """How far *dst* is from *src*: shifts in extents, scales as logs; null for empty boxes."""
    a, b = to_centre(src), to_centre(dst)
    return F.struct(
        (F.try_divide(b["cx"] - a["cx"], a["w"]) * weights[0]).alias("dx"), (F.try_divide(b["cy"] - a["cy"], a["h"]) * weights[1]).alias("dy"),
        (F.log(F.try_divide(b["w"], a["w"])) * weights[2]).alias("dw"), (F.log(F.try_divide(b["h"], a["h"])) * weights[3]).alias("dh"),
    )


def decode_delta(src, delta, weights=(1.0, 1.0, 1.0, 1.0)) -> Column:
    a, d = to_centre(src), _b(delta)
    return from_centre(a["cx"] + d["dx"] / weights[0] * a["w"], a["cy"] + d["dy"] / weights[1] * a["h"], a["w"] * F.exp(d["dw"] / weights[2]), a["h"] * F.exp(d["dh"] / weights[3]))


def point_distance(x, y, b) -> Column:
    """From a point to the nearest point of a box; 0 within."""
    b = _b(b)
    dx = F.greatest(b["x0"] - x, F.lit(0.0), x - b["x1"])
    dy = F.greatest(b["y0"] - y, F.lit(0.0), y - b["y1"])
    return F.sqrt(dx * dx + dy * dy)


def polygon_area(xs, ys) -> Column:
    """By the shoelace formula over arrays of coordinates."""
    xs, ys = _b(xs), _b(ys)
    turn = lambda a: F.concat(F.slice(a, 2, F.size(a) - 1), F.slice(a, 1, 1))
    cross = F.zip_with(F.zip_with(xs, turn(ys), lambda a, b: a * b), F.zip_with(turn(xs), ys, lambda a, b: a * b), lambda a, b: a - b)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def inside(inner, outer) -> Column:
    """Whether *inner* lies wholly within *outer*, edges included."""
    a, b = _b(inner), _b(outer)
    return (a["x0"] >= b["x0"]) & (a["y0"] >= b["y0"]) & (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"])


def relative(b, width, height) -> Column:
    """Coordinates as shares of the page's extent."""
    return scale(b, 1.0 / width, 1.0 / height)


def from_crop(b, sx: float, sy: float, left: float, top: float) -> Column:
    """A box of a crop in coordinates of its page: scaled, then moved to where the crop begins."""
    s = scale(b, sx, sy)
    return box(s["x0"] + left, s["y0"] + top, s["x1"] + left, s["y1"] + top)


def on_edge(b, most: float = 1000.0) -> Column:
    """Whether any normalised coordinate lies at the page's edge or beyond."""
    b = _b(b)
    return (b["x0"] <= 0) | (b["y0"] <= 0) | (b["x1"] >= most) | (b["y1"] >= most)
