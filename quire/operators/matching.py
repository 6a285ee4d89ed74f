"""Joins and filters between boxes, points, polygons and values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import point_in_polygon
from quire.operators.grouped import by_key, together


def with_cells(df: DataFrame, low: str, high: str, width: float, cell: str = "cell") -> DataFrame:
    """One row for each grid cell that [low, high] touches: turns a range condition into an equi-join."""
    return df.withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))


def contained_in_interval(points: DataFrame, at: str, boxes: DataFrame, low: str, high: str, width: float, keys: list[str] | None = None, closed: bool = False, fine: int = 8, most: int = 1024) -> DataFrame:
    """Points with every interval that holds them (half open unless closed), joined on grid cells (and keys), not by nested loops.

    Intervals with equal ends meet their points as one, in lists of at most `most`, and
    are told apart at the end; so the same list stands again and again in the result,
    point after point, and takes next to no room where it is written. Cells are a
    `fine`-th of the width, so that the pairs of a crowded place are several tasks' work.
    """
    keys = keys or []
    same, cell = [*keys, low, high], width / fine
    rest = [c for c in boxes.columns if c not in same]
    n = F.row_number().over(Window.partitionBy(*same).orderBy(*(rest or same)))
    lists = boxes.withColumn("__n", F.floor((n - 1) / most)).groupBy(*same, "__n").agg(F.collect_list(F.struct(*rest) if rest else F.struct(F.lit(0).alias("__0"))).alias("__l"))
    if len(rest) == 1:
        lists = lists.withColumn("__l", F.transform("__l", lambda x: x[rest[0]]))  # quicker to go through
    right = F.col(at) <= F.col(high) if closed else F.col(at) < F.col(high)
    p = points.withColumn("cell", F.floor(F.col(at) / cell))
    # lists are the side that is gone through, points the side that is held: merged, never broadcast
    both = with_cells(lists, low, high, cell).hint("merge").join(p, [*keys, "cell"]).where((F.col(low) <= F.col(at)) & right)
    own = [c for c in points.columns if c not in keys]
    each = F.explode("__l").alias(rest[0]) if len(rest) == 1 else F.inline("__l")
    return both.select(*keys, *own, low, high, each).select(*keys, *own, *[c for c in boxes.columns if c not in keys])


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def match_boxes(regions: DataFrame, boxes: DataFrame, page: str = "page_id", centers: bool = False, grid: int = 256) -> DataFrame:
    """regions(page, region_idx, x0, y0, x1, y1) with box_idx: the first box that holds the region (or its centre), else of the boxes that hold the centre the one with the nearest centre; null if none.

    A box that holds a region holds its centre, so regions meet boxes on the grid rows of their centres.
    """
    b = boxes.select(page, "box_idx", F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1")).where("bx0 < bx1 and by0 < by1")
    b = with_cells(b, "by0", "by1", grid)
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    r = regions.withColumn("cx", cx).withColumn("cy", cy).withColumn("cell", F.floor(F.col("cy") / grid))
    r, b = together([r, b], [page, "cell"])
    both = r.join(b, [page, "cell"])
    holds = lambda x0, y0, x1, y1: (F.col("bx0") <= x0) & (x1 < F.col("bx1")) & (F.col("by0") <= y0) & (y1 < F.col("by1"))
    whole = F.lit(False) if centers else holds(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    middle = holds(F.col("cx"), F.col("cy"), F.col("cx"), F.col("cy"))
    far = F.pow((F.col("bx0") + F.col("bx1")) / 2 - F.col("cx"), 2) + F.pow((F.col("by0") + F.col("by1")) / 2 - F.col("cy"), 2)
    rank = F.when(whole, F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("d"), F.col("box_idx").alias("i"))).when(middle, F.struct(F.lit(1).alias("k"), (F.lit(0.0) if centers else far).alias("d"), F.col("box_idx").alias("i")))
    found = both.select(page, "region_idx", rank.alias("r")).where("r is not null")
    all_, found = together([regions, found], [page, "region_idx"])
    best = found.groupBy(page, "region_idx").agg(F.min("r").alias("r"))
    return all_.join(best.select(page, "region_idx", F.col("r.i").alias("box_idx")), [page, "region_idx"], "left")


def points_in_polygons(points: DataFrame, polygons: DataFrame, page: str = "page_id", edge: bool = True, grid: int = 256) -> DataFrame:
    """points(page, x, y, ..) joined to polygons(page, poly, ..) that hold them; bounding boxes meet on grid rows first, then the exact test runs."""
    flat = polygons.schema["poly"].dataType.elementType.names == ["x", "y"]  # numbers alone travel lighter than structs, and boxes are found again
    xs, ys = (F.col(f"__{c}s") for c in "xy") if flat else (F.col("poly")["x"], F.col("poly")["y"])
    sent = polygons
    if flat:
        others = [c for c in polygons.columns if c != "poly"]
        sent = polygons.select(*others, *[F.col("poly")[c].alias(f"__{c}s") for c in "xy"])
    cells = sent.where(F.array_min(xs).isNotNull()).withColumn("cell", F.explode(F.sequence(F.floor(F.array_min(ys) / grid), F.floor(F.array_max(ys) / grid))))
    near, cells = together([points.withColumn("cell", F.floor(F.col("y") / grid)), cells], [page, "cell"])
    near = near.join(cells, [page, "cell"]).where(F.col("x").between(F.array_min(xs), F.array_max(xs)) & F.col("y").between(F.array_min(ys), F.array_max(ys)))
    poly = F.arrays_zip(xs.alias("x"), ys.alias("y")) if flat else F.col("poly")
    near = near.where(point_in_polygon(F.col("x"), F.col("y"), poly) >= (0 if edge else 1))
    own = [c for c in polygons.columns if c != page]
    return near.select(page, *[c for c in points.columns if c != page], *[poly.alias("poly") if c == "poly" else c for c in own])


def without_inside(df: DataFrame, low: str, high: str, keys: list[str]) -> DataFrame:
    """Rows whose interval lies in no longer interval of the same keys.

    By rising start and falling end, an interval that holds another comes before it, and
    equal ones stand together: the furthest end before tells, no pairs are made.
    """
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(low, F.col(high).desc()))
    before = F.max(high).over(Window.partitionBy(*keys).orderBy("__n").rangeBetween(Window.unboundedPreceding, -1))
    t = df.withColumn("__n", place).withColumn("__b", before)
    return t.where(F.col("__b").isNull() | (F.col("__b") < F.col(high)) | F.col(low).isNull() | F.col(high).isNull()).drop("__n", "__b")


def with_children(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents that have a child."""
    return parents.join(children.select(*keys), keys, "left_semi")


def skip_existing(work: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """What has no output yet."""
    return work if overwrite else work.join(done.select(*keys), keys, "left_anti")


def nearest(left: DataFrame, right: DataFrame, at: str, to: str, row: str, keys: list[str]) -> DataFrame:
    """left with the right row of equal keys whose `to` is nearest to `at`; ties go to the smaller `row`.

    Sorts of both sides by key and value, up and down, find the neighbours below and
    above; no pairs are made.
    """
    tag = F.struct(F.col(to).alias("v"), F.col(row).alias("r"))
    r = right.groupBy(*keys, to).agg(F.min(row).alias(row))  # of equal values only the smallest row can be nearest
    both = left.withColumn("__at", F.col(at).cast("double")).withColumn("__t", F.lit(None).cast(r.select(tag.alias("t")).schema["t"].dataType)).unionByName(
        r.select(*keys, F.col(to).cast("double").alias("__at"), tag.alias("__t")), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy("__at")
    below = F.last("__t", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # downwards, so that this frame grows from row to row too
    above = F.last("__t", True).over(Window.partitionBy(*keys).orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("__b", below).withColumn("__a", above).where("__t is null")
    d = lambda c: F.abs(F.col(f"{c}.v") - F.col("__at"))
    pick = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull(), F.col("__b")).when(
        (d("__a") < d("__b")) | ((d("__a") == d("__b")) & (F.col("__a.r") < F.col("__b.r"))), F.col("__a")
    ).otherwise(F.col("__b"))
    return found.withColumn("__p", pick).select(*left.columns, F.col("__p.r").alias(row), F.col("__p.v").alias(to))


def by_rank(left: DataFrame, right: DataFrame, keys: list[str], size: str, to_size: str, row: str, to_row: str, rank: str = "k") -> DataFrame:
    """Rows of equal keys paired by rank of size (largest first, ties by row): the prefix that both sides have."""
    n = lambda v, r: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(v).desc(), r)).cast("bigint")
    return left.withColumn(rank, n(size, row)).join(right.withColumn(rank, n(to_size, to_row)), [*keys, rank])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows to rows, to nine places; infinite where a number is missing."""
    d = a - b
    d = np.floor(np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2) * 1e9 + 0.5) / 1e9
    return np.where(np.isnan(d), np.inf, d)


def _within(a: np.ndarray, b: np.ndarray, far: float, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distances) of all pairs up to `far` apart and some more, about `most` at a time: rows meet those of the grid cells around theirs. If `far` is infinite, all pairs."""
    if not np.isfinite(far):
        step = max(1, most // len(b))
        for k in range(0, len(a), step):
            i, j = (v.ravel() for v in np.indices((min(step, len(a) - k), len(b))))
            yield i + k, j, _distances(a[i + k], b[j])
        return
    ia, ib = (np.flatnonzero(~np.isnan(v).any(1)) for v in (a, b))
    if not len(ia) or not len(ib):
        return
    low = b[ib].min(0)
    wide = max(far + 2e-9, float(np.ptp(b[ib], axis=0).max()) / 1e5)
    p, q = np.floor((a[ia] - low) / wide), np.floor((b[ib] - low) / wide).astype(np.int64)
    size = q.max(0) + 1
    p = np.clip(p, -2, size + 1).astype(np.int64)
    cell = (q[:, 0] * size[1] + q[:, 1]) * size[2] + q[:, 2]
    by = np.argsort(cell, kind="stable")
    cell, ib = cell[by], ib[by]
    bottom, top = np.maximum(p[:, 2] - 1, 0), np.minimum(p[:, 2] + 1, size[2] - 1)
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            x, y = p[:, 0] + dx, p[:, 1] + dy
            own = np.flatnonzero((x >= 0) & (x < size[0]) & (y >= 0) & (y < size[1]) & (bottom <= top))
            base = (x[own] * size[1] + y[own]) * size[2]
            first, stop = np.searchsorted(cell, base + bottom[own], "left"), np.searchsorted(cell, base + top[own], "right")
            n = stop - first
            sums = np.cumsum(n)
            k = 0
            while k < len(own):
                z = max(k + 1, int(np.searchsorted(sums, (sums[k - 1] if k else 0) + most, "right")))
                m = n[k:z]
                i = np.repeat(ia[own[k:z]], m)
                j = ib[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[k:z], m)]
                if len(i):
                    yield i, j, _distances(a[i], b[j])
                k = z


def _nearest_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a to b: looked for in cells that grow until one lies no further away than the cells are sure to reach."""
    best = np.full(len(a), np.inf)
    whole = [v[~np.isnan(v).any(1)] for v in (a, b)]
    todo = np.flatnonzero(~np.isnan(a).any(1))
    if not len(todo) or not len(whole[1]):
        return best
    reach = float(np.ptp(np.concatenate(whole), axis=0).max())
    far = reach / max(1.0, len(whole[1]) ** (1 / 3))
    while len(todo):
        for i, _, d in _within(a[todo], b, far):
            np.minimum.at(best, todo[i], d)
        if far > reach:
            break
        todo = todo[best[todo] > far]
        far = 2 * far + 1e-9
    return best


def _last_first_met(idx: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, best: np.ndarray, far: float) -> list[tuple]:
    """(idx, smallest other) at distance `far` of the rows first met there, of equal idx together."""
    ids, group = np.unique(idx, return_inverse=True)
    low = _lowest(idx, best)
    rows = np.flatnonzero((low[group] == far) & (best == far))
    partners, rank = np.unique(other, return_inverse=True)
    first = np.full(len(ids), len(partners))
    for i, j, d in _within(a[rows], b, far):
        hit = d == far
        np.minimum.at(first, group[rows[i[hit]]], rank[j[hit]])
    return [(ids[k], partners[first[k]]) for k in np.flatnonzero(first < len(partners)).tolist()]


def nearest_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, d) of two sides (keys, idx, cx, cy, area): pairs in rising distance until every row of both sides has one.

    Pairs are only ever added in rising distance, so the result is a prefix of them; it
    ends where the last row of either side is first met. Ties go by i, then j; pairs whose
    distance is unknown come last. The pair where it ends is found from each row's nearest
    partner, and only pairs up to that distance are made, a part at a time; a task holds
    the rows of a key, never its pairs.
    """
    names, numbers = [*keys, "i", "j", "d"], ["cx", "cy", "area"]
    kinds = dict(a.select(*keys, F.col("idx").alias("i")).dtypes) | {"j": dict(b.dtypes)["idx"], "d": "double"}

    def side(df: DataFrame, mine: str, other: str, n: int) -> DataFrame:
        return df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])).select(*keys, F.lit(n).alias("side"), F.col("idx").alias(mine), F.lit(None).cast(kinds[other]).alias(other), *[F.col(c).cast("double").alias(c) for c in numbers])

    def kernel(t: pa.Table) -> Iterator[pa.Table]:
        sides = [t.filter(pc.equal(t.column("side"), k)) for k in (0, 1)]
        if not sides[0].num_rows or not sides[1].num_rows:
            return
        p, q = (np.stack([s.column(c).to_numpy() for c in numbers], 1) for s in sides)
        i_, j_ = (s.column(c).combine_chunks() for s, c in zip(sides, ("i", "j")))
        i, j = (v.to_numpy(zero_copy_only=False) for v in (i_, j_))
        near = _nearest_distance(p, q), _nearest_distance(q, p)
        far = max(float(low.max()) for low in (_lowest(i, near[0]), _lowest(j, near[1])))
        last = max([*_last_first_met(i, j, p, q, near[0], far), *[(x, y) for y, x in _last_first_met(j, i, q, p, near[1], far)]])
        met = False
        for k, m, d in _within(p, q, far):
            end = (d == far) & (i[k] == last[0]) & (j[m] == last[1])
            keep = (d < far) | ((d == far) & ((i[k] < last[0]) | ((i[k] == last[0]) & (j[m] < last[1]))))
            if not met and end.any():  # of equal pairs the first is the end
                keep[np.argmax(end)] = met = True
            k, m, d = k[keep], m[keep], d[keep]
            row = t.slice(0, 1).select(keys).take(pa.array(np.zeros(len(k), np.int64)))
            for c, v in (("i", i_.take(pa.array(k))), ("j", j_.take(pa.array(m))), ("d", pa.array(d, mask=np.isinf(d)))):
                row = row.append_column(c, v)
            yield row

    both = side(a, "i", "j", 0).unionByName(side(b, "j", "i", 1))
    return by_key(both, keys, ["side"], kernel, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def _lowest(idx: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least distance of the rows of each idx."""
    ids, group = np.unique(idx, return_inverse=True)
    low = np.full(len(ids), np.inf)
    np.minimum.at(low, group, best)
    return low


def main_or_head(main: Column, head: Column, w: Column, h: Column) -> Column:
    """Whether a region is a heading by its share of heading pixels and its shape."""
    return ((head >= 0.6 * main) & (w >= 1.3 * h) & (w <= 3 * h)) | ((head >= 0.3 * main) & (w >= 3 * h))


def pair_classes(df: DataFrame, key: str, idx: str, order: str) -> DataFrame:
    """All ordered pairs i <> j of a key's rows; class 1 where i comes before j."""
    a = df.select(key, F.col(idx).alias("i"), F.col(order).alias("oi"))
    b = df.select(key, F.col(idx).alias("j"), F.col(order).alias("oj"))
    return a.join(b, key).where("i <> j").select(key, "i", "j", (F.col("oi") < F.col("oj")).cast("int").alias("cls"))


def robust_mean(df: DataFrame, keys: list[str], ratio: str, angle: str, least: float = 2.5) -> DataFrame:
    """(keys, slope): mean angle of long rows whose ratio is within a third of the median and whose angle within two deviations of its median; null if none are left."""
    w = Window.partitionBy(*keys)
    long = df.where(F.col(ratio) > least).withColumn("m", F.median(ratio).over(w)).where((F.col(ratio) >= 0.67 * F.col("m")) & (F.col(ratio) <= 1.33 * F.col("m")))
    dev = long.withColumn("med", F.median(angle).over(w)).withColumn("dev", F.round(F.abs(F.col(angle) - F.col("med")), 9)).withColumn("mad", F.median("dev").over(w))
    return dev.where("dev <= 2 * mad").groupBy(*keys).agg(F.avg(angle).alias("slope"))


def slopes(df: DataFrame, keys: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """(keys, n, slope, r2, stderr) of a regression of y on x for keys with more than `least` rows."""
    t = df.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("__x"), F.regr_syy(y, x).alias("__y"))
    error = F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("__y"), F.col("__x") * (F.col("n") - 2)))
    return t.where(F.col("n") > least).withColumn("stderr", error).drop("__x", "__y")
