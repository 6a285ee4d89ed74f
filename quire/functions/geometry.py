"""Boxes and polygons as Column expressions; a polygon is array<struct<x,y>>, half-open boxes are (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_to_rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(x, y, w, h) as struct(y0, y1, x0, x1)."""
    return F.struct(y.alias("y0"), (y + h).alias("y1"), x.alias("x0"), (x + w).alias("x1"))


def crop(rows: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The part of an array of rows that a box covers."""
    return F.transform(F.slice(rows, y + 1, h), lambda r: F.slice(r, x + 1, w))


def _around(p: Column, fields: dict[str, Column], step, finish=None) -> Column:
    """One walk around the polygon: step(acc, ax, ay, bx, by) gives the fields after each edge, from the last point to the first and on."""
    last = F.get(p, F.size(p) - 1)
    zero = F.struct(last["x"].cast("double").alias("px"), last["y"].cast("double").alias("py"), *(c.alias(n) for n, c in fields.items()))

    def merge(acc: Column, q: Column) -> Column:
        x, y = q["x"].cast("double"), q["y"].cast("double")
        made = step(acc, acc["px"], acc["py"], x, y)
        return F.struct(x.alias("px"), y.alias("py"), *(made[n].alias(n) for n in fields))

    return F.aggregate(p, zero, merge, finish)


def _moments(p: Column, finish) -> Column:
    """finish of struct(a, mx, my): twice the signed area and six times the first moments."""

    def step(acc: Column, ax: Column, ay: Column, bx: Column, by: Column) -> dict[str, Column]:
        c = ax * by - bx * ay
        return {"a": acc["a"] + c, "mx": acc["mx"] + (ax + bx) * c, "my": acc["my"] + (ay + by) * c}

    return _around(p, {n: F.lit(0.0) for n in ("a", "mx", "my")}, step, finish)


def signed_area(p: Column) -> Column:
    return _around(p, {"a": F.lit(0.0)}, lambda acc, ax, ay, bx, by: {"a": acc["a"] + (ax * by - bx * ay)}, lambda m: m["a"] / 2)


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def area_and_centroid(p: Column) -> Column:
    """struct(area, x, y) from one walk; polygons without area give 0 or what the tiny divisor makes of them."""
    m = lambda s: 6 * (s["a"] / 2 + 1e-32)
    return _moments(p, lambda s: F.struct(F.abs(s["a"] / 2).alias("area"), (s["mx"] / m(s)).alias("x"), (s["my"] / m(s)).alias("y")))


def centroid(p: Column) -> Column:
    """struct(x, y); see area_and_centroid."""
    c = area_and_centroid(p)
    return F.struct(c["x"].alias("x"), c["y"].alias("y"))


def bbox(p: Column) -> Column:
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def y_at_left(p: Column) -> Column:
    """y of the first point with the smallest x."""
    xs = F.transform(p, lambda q: q["x"])
    return F.get(p, (F.array_position(xs, F.array_min(xs)) - 1).cast("int"))["y"]


def point_in_polygon(x: Column, y: Column, p: Column) -> Column:
    """1 inside, 0 on the edge, -1 outside."""

    def step(acc: Column, ax: Column, ay: Column, bx: Column, by: Column) -> dict[str, Column]:
        edge = ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by == ay, F.lit(1.0)).otherwise(by - ay) + ax)
        return {"odd": acc["odd"] != crossed, "edge": acc["edge"] | edge}

    return _around(p, {"odd": F.lit(False), "edge": F.lit(False)}, step, lambda s: F.when(s["edge"], F.lit(0)).when(s["odd"], F.lit(1)).otherwise(F.lit(-1)))


def translate(p: Column, dx: Column, dy: Column) -> Column:
    return F.transform(p, lambda q: F.struct((q["x"] + dx).alias("x"), (q["y"] + dy).alias("y")))


def scale(p: Column, fx: Column, fy: Column) -> Column:
    return F.transform(p, lambda q: F.struct((q["x"] * fx).alias("x"), (q["y"] * fy).alias("y")))


def to_ints(p: Column) -> Column:
    """Coordinates truncated and clipped at 0."""
    return F.transform(p, lambda q: F.struct(F.greatest(F.lit(0), q["x"].cast("int")).alias("x"), F.greatest(F.lit(0), q["y"].cast("int")).alias("y")))


def points_string(p: Column) -> Column:
    """'x,y x,y ...'."""
    return F.array_join(F.transform(p, lambda q: F.concat_ws(",", q["x"].cast("string"), q["y"].cast("string"))), " ")


def parse_points(s: Column) -> Column:
    """The polygon of a points string; null for a null or unreadable one."""
    parts = F.transform(F.split(F.trim(s), r"\s+"), lambda t: F.split(t, ","))
    return F.when(F.length(F.trim(s)) > 0, F.transform(parts, lambda t: F.struct(F.get(t, F.lit(0)).try_cast("double").cast("int").alias("x"), F.get(t, F.lit(1)).try_cast("double").cast("int").alias("y"))))


def orientation(mu20: Column, mu02: Column, mu11: Column) -> Column:
    """Degrees of the main axis from central moments; 90 with the sign of mu11 when the spreads are equal."""
    return F.when(mu20 == mu02, F.when(mu11 < 0, F.lit(-90.0)).otherwise(F.lit(90.0))).otherwise(F.degrees(F.atan2(2 * mu11, mu20 - mu02)) / 2)


def line_class(slope: Column) -> Column:
    """0 lying, 1 standing, 2 slanted, by 180/pi times the ratio vy/vx."""
    s = F.abs(slope / F.lit(3.141592653589793) * 180)
    return F.when(s < 10, 0).when(s > 200, 1).otherwise(2)


def largest_rotated(w: Column, h: Column, radians: Column) -> Column:
    """struct(w, h) of the largest upright rectangle in a turned w x h one."""
    s, c = F.abs(F.sin(radians)), F.abs(F.cos(radians))
    long, short = F.greatest(w, h), F.least(w, h)
    half = (short <= 2 * s * c * long) | (F.abs(s - c) < 1e-10)
    x, d = short / 2, c * c - s * s
    wide = w >= h
    safe = F.when(F.abs(d) < 1e-10, F.lit(1.0)).otherwise(d)
    w1 = F.when(half, F.when(wide, x / F.greatest(s, F.lit(1e-300))).otherwise(x / F.greatest(c, F.lit(1e-300)))).otherwise((w * c - h * s) / safe)
    h1 = F.when(half, F.when(wide, x / F.greatest(c, F.lit(1e-300))).otherwise(x / F.greatest(s, F.lit(1e-300)))).otherwise((h * c - w * s) / safe)
    return F.when((w <= 0) | (h <= 0), F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))).otherwise(F.struct(w1.alias("w"), h1.alias("h")))


def by_area(df: DataFrame, poly: str, size: Column, least: float, most: float, parent: str | None = None) -> DataFrame:
    """Rows whose polygon has at least three corners, no parent (if that column is given) and an area within shares of a size; with `area`."""
    t = df.withColumn("area", area(F.col(poly))).where((F.size(poly) >= 3) & F.col("area").between(least * size, most * size))
    return t if parent is None else t.where(F.col(parent).isNull())
