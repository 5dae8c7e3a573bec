"""Boxes as struct<x0, y0, x1, y1> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.functions.text import _c


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*(_c(v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))


def width(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def is_empty(b: Column) -> Column:
    return (b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"])


def shared_width(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))


def shared_height(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    return shared_width(a, b) * shared_height(a, b)


def overlap(a: Column, b: Column) -> Column:
    """Of the smaller box, the share inside the other."""
    return shared_area(a, b) / F.greatest(F.lit(1.0), F.least(area(a), area(b)))


def coverage(subject: Column, cover: Column) -> Column:
    """Of the subject, the share under the cover."""
    return shared_area(subject, cover) / F.greatest(F.lit(1.0), area(subject))


def same_line(a: Column, b: Column, rotation: Column) -> Column:
    """Much overlap, or boxes side by side along the reading direction."""
    w = shared_width(a, b) / F.greatest(F.lit(1.0), F.least(width(a), width(b)))
    h = shared_height(a, b) / F.greatest(F.lit(1.0), F.least(height(a), height(b)))
    level = rotation.isin(0, 180)
    cross, along = F.when(level, h).otherwise(w), F.when(level, w).otherwise(h)
    return (overlap(a, b) >= 0.45) | ((shared_area(a, b) > 0) & (cross >= 0.72) & (along >= 0.12))


def collides(a: Column, b: Column) -> Column:
    return shared_area(a, b) > F.greatest(F.lit(0.5), F.least(area(a), area(b)) * 0.08)


def to_page(b: Column, page_width, page_height) -> Column:
    """A box in thousandths of the page as one in page units."""
    w, h = _c(page_width) / 1000.0, _c(page_height) / 1000.0
    return box(b["x0"] * w, b["y0"] * h, b["x1"] * w, b["y1"] * h)


def from_tile(b: Column, clip: Column) -> Column:
    """A box in thousandths of a tile as one in the units of the page that the tile is cut from."""
    w, h = F.greatest(F.lit(1.0), clip["x1"] - clip["x0"]), F.greatest(F.lit(1.0), clip["y1"] - clip["y0"])
    return box(
        clip["x0"] + b["x0"] / 1000.0 * w,
        clip["y0"] + b["y0"] / 1000.0 * h,
        clip["x0"] + b["x1"] / 1000.0 * w,
        clip["y0"] + b["y1"] / 1000.0 * h,
    )


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def holds(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["x0"]) & (x <= b["x1"]) & (y >= b["y0"]) & (y <= b["y1"])


def cardinal_rotation(dx, dy) -> Column:
    """0, 90, 180 or 270 where the direction is within 1.5 degrees of it; else null."""
    angle = F.pmod(F.degrees(F.atan2(_c(dy), _c(dx))), F.lit(360.0))
    turn = F.pmod(F.round(angle / 90.0) * 90, F.lit(360.0))
    away = F.abs(F.pmod(angle - turn + 180, F.lit(360.0)) - 180)
    return F.when(away <= 1.5, turn.cast("int"))


def transform_point(matrix: Column, x: Column, y: Column) -> Column:
    """A point under the matrix array (a, b, c, d, e, f)."""
    return F.struct(
        (matrix[0] * x + matrix[2] * y + matrix[4]).alias("x"), (matrix[1] * x + matrix[3] * y + matrix[5]).alias("y")
    )


def multiply_matrices(m: Column, n: Column) -> Column:
    """The matrix that applies m and then n."""
    return F.array(
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def union_of_points(points: Column) -> Column:
    """The box of an array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def offset_points(points: Column, dx, dy) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + _c(dx)).alias("x"), (p["y"] + _c(dy)).alias("y")))


def touches_inner_edge(points: Column, tile: Column, image_w, image_h, margin: float = 8) -> Column:
    """Whether a polygon touches an edge of its tile that isn't an edge of the image."""
    b = union_of_points(points)
    return (
        ((tile["x0"] > 0) & (b["x0"] <= tile["x0"] + margin))
        | ((tile["y0"] > 0) & (b["y0"] <= tile["y0"] + margin))
        | ((tile["x1"] < _c(image_w)) & (b["x1"] >= tile["x1"] - margin))
        | ((tile["y1"] < _c(image_h)) & (b["y1"] >= tile["y1"] - margin))
    )


def tile_offsets(length, side, overlap_) -> Column:
    """Starts of the tiles of ``side`` that cover ``length``, the last flush with the end."""
    size, extent = F.greatest(F.lit(1), _c(side).cast("int")), F.greatest(F.lit(0), _c(length).cast("int"))
    stride = F.greatest(F.lit(1), size - F.greatest(F.lit(0), F.least(size - 1, _c(overlap_).cast("int"))))
    last = extent - size
    return F.when(extent <= size, F.array(F.lit(0))).otherwise(
        F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride), F.array(last))
    )


def ink_scale(ratio: Column, font_size: Column, fitted: Column) -> Column:
    """How far text over ink of this share of its box is shrunk, not below six units."""
    step = F.when(ratio < 0.20, 0.85).when(ratio < 0.40, 0.75).otherwise(0.65)
    size = F.greatest(F.lit(0.01), font_size) * F.greatest(F.lit(0.01), fitted)
    floor = F.least(F.lit(1.0), F.lit(6.0) / size)
    return F.when(ratio < 0.08, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(step, floor)))
