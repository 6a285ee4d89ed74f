"""Outlines of masks with their holes, and polygons as masks: fill, grow, join, cut, clip; page-local kernels in numpy.

A polygon is a list of (x, y) corners on the pixel grid; it covers the pixels whose
centres lie in it or on its edge, as a traced outline does.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.operators import raster
from quire.operators.columns import grow, labelled, mask_runs
from quire.operators.grouped import by_key, by_keys, local_roots

Polygon = list[tuple[int, int]]
POLY = "array<struct<x:int,y:int>>"
_KIND = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def shoelace(p: Polygon) -> float:
    """The signed area."""
    a = np.asarray(p, float)
    if len(a) < 3:
        return 0.0
    b = np.roll(a, -1, 0)
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)


def fill(polygons: list[Polygon], box: tuple[int, int, int, int]) -> np.ndarray:
    """The mask of polygons in a box (x0, x1, y0, y1): even-odd inside each, and all edges."""
    x0, x1, y0, y1 = box
    out = np.zeros((max(0, y1 - y0), max(0, x1 - x0)), bool)
    for p in polygons:
        a = np.asarray(p, float) - (x0, y0)
        if not len(a):
            continue
        b = np.roll(a, -1, 0)
        for y in range(max(0, int(np.ceil(a[:, 1].min()))), min(out.shape[0], int(np.floor(a[:, 1].max())) + 1)):
            crossed = (a[:, 1] > y) != (b[:, 1] > y)
            at = np.sort(a[crossed, 0] + (y - a[crossed, 1]) * (b[crossed, 0] - a[crossed, 0]) / (b[crossed, 1] - a[crossed, 1]))
            for left, right in zip(at[::2], at[1::2]):
                out[y, max(0, int(np.ceil(left - 1e-9))) : max(0, int(np.floor(right + 1e-9)) + 1)] = True
        for (ax, ay), (bx, by) in zip(a, b):
            n = int(np.ceil(max(abs(bx - ax), abs(by - ay))))
            x, y = np.rint(np.linspace(ax, bx, n + 1)).astype(int), np.rint(np.linspace(ay, by, n + 1)).astype(int)
            ok = (x >= 0) & (x < out.shape[1]) & (y >= 0) & (y < out.shape[0])
            out[y[ok], x[ok]] = True
    return out


def outlines(mask: np.ndarray) -> list[tuple[Polygon, int]]:
    """(outline, parent) of each component (parent -1) and of each hole (parent: the number of the component's outline), components by their first pixel."""
    label, boxes = labelled(mask > 0)
    out: list[tuple[Polygon, int]] = []
    for i, (x0, x1, y0, y1) in enumerate(boxes.tolist(), 1):
        own = label[y0:y1, x0:x1] == i
        number = len(out)
        out.append(([(x + x0, y + y0) for x, y in raster.trace(own)], -1))
        for hole in _holes(own):
            out.append(([(x + x0, y + y0) for x, y in raster.trace(hole)], number))
    return out


def _holes(mask: np.ndarray) -> list[np.ndarray]:
    """The parts of the background that don't reach the border over straight neighbours."""
    if mask.all() or min(mask.shape) < 3:
        return []
    from quire.operators.runs import touching

    empty = np.pad(~mask, 1, constant_values=True)
    y, x0, x1 = mask_runs(empty)
    root = local_roots(len(y), *touching(y, x0, x1, corners=False))
    found = []
    for r in np.unique(root[root != root[0]]):
        hole = np.zeros(empty.shape, bool)
        for k in np.flatnonzero(root == r):
            hole[y[k], x0[k] : x1[k]] = True
        found.append(hole[1:-1, 1:-1])
    return found


def _box(polygons: list[Polygon], margin: int = 0) -> tuple[int, int, int, int]:
    a = np.concatenate([np.asarray(p, float).reshape(-1, 2) for p in polygons])
    low, high = np.floor(a.min(0)).astype(int) - margin, np.ceil(a.max(0)).astype(int) + margin
    return int(low[0]), int(high[0]) + 1, int(low[1]), int(high[1]) + 1


def _largest(mask: np.ndarray, box: tuple[int, int, int, int]) -> Polygon:
    """The outline of the largest component, by area, then by its first pixel."""
    label, _ = labelled(mask)
    if not label.any():
        return []
    best = int(np.argmax(np.bincount(label.ravel())[1:])) + 1
    return [(x + box[0], y + box[2]) for x, y in raster.trace(label == best)]


def dilate(p: Polygon, by: int) -> Polygon:
    """The outline grown by a disc of this radius."""
    if not p or by <= 0:
        return list(p)
    box = _box([p], by)
    m = fill([p], box)
    out = m.copy()
    for dy in range(-by, by + 1):
        dx = int((by * by - dy * dy) ** 0.5)
        row = grow(m, dx, 0)
        a, z = max(0, dy), m.shape[0] + min(0, dy)
        out[a:z] |= row[a - dy : z - dy]
    return _largest(out, box)


def valid(p: Polygon) -> Polygon:
    """An outline that doesn't cross itself: that of the largest part the polygon covers; fewer than three corners are none."""
    if len(p) < 3:
        return []
    box = _box([p])
    return _largest(fill([p], box), box)


def intersection(a: Polygon, b: Polygon) -> Polygon | None:
    """What two polygons share, parts joined; null if they share no area."""
    if len(a) < 3 or len(b) < 3:
        return None
    box = _box([a, b])
    m = fill([a], box) & fill([b], box)
    parts = [[(x + box[0], y + box[2]) for x, y in o] for o, parent in outlines(m) if parent < 0]
    parts = [o for o in parts if abs(shoelace(o)) > 0]
    return join(parts) if parts else None


def nearest_points(a: Polygon, b: Polygon) -> tuple[float, tuple, tuple]:
    """(distance, point of a, point of b) of the nearest points of two outlines; one of them is a corner."""

    def to_edges(p: np.ndarray, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s, d = q, np.roll(q, -1, 0) - q
        length = np.maximum((d * d).sum(1), 1e-12)
        t = np.clip(((p[:, None] - s) * d).sum(2) / length, 0, 1)
        foot = s + t[..., None] * d
        far = ((p[:, None] - foot) ** 2).sum(2)
        i, j = np.unravel_index(np.argmin(far), far.shape)
        return float(far[i, j] ** 0.5), p[i], foot[i, j]

    p, q = np.asarray(a, float), np.asarray(b, float)
    one, two = to_edges(p, q), to_edges(q, p)
    return (one[0], tuple(one[1]), tuple(one[2])) if one[0] <= two[0] else (two[0], tuple(two[2]), tuple(two[1]))


def join(polygons: list[Polygon], scale: float = 20) -> Polygon:
    """One outline of all polygons: those apart are bridged along a minimum spanning tree of their distances, by bars of width max(1, scale / 5) to each side."""
    some = [p for p in polygons if p]
    if len(some) < 2:
        return list(some[0]) if some else []
    wide = max(1, int(scale / 5))
    bridges: list[tuple] = []
    reached, best = {0}, {k: (*nearest_points(some[0], some[k]),) for k in range(1, len(some))}
    while best:
        k = min(best, key=lambda i: (best[i][0], i))
        far, p, q = best.pop(k)
        reached.add(k)
        if far > 1:
            bridges.append((p, q))
        for i in best:
            new = nearest_points(some[k], some[i])
            if new[0] < best[i][0]:
                best[i] = new
    box = _box(some, wide + 1)
    m = fill(some, box)
    for p, q in bridges:
        m |= grow(fill([[p, q]], box), wide, wide)
    return _largest(m, box)


def clip(p: Polygon, x0: float, y0: float, x1: float, y1: float) -> Polygon:
    """The part of a polygon in a rectangle, edge after edge of it (Sutherland and Hodgman)."""
    out = [tuple(map(float, q)) for q in p]
    for axis, at, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        got: list[tuple] = []
        for a, b in zip([*out[-1:], *out[:-1]], out):
            in_a, in_b = sign * (a[axis] - at) >= 0, sign * (b[axis] - at) >= 0
            if in_a != in_b:
                t = (at - a[axis]) / (b[axis] - a[axis])
                got.append(tuple(a[k] + t * (b[k] - a[k]) for k in (0, 1)))
            if in_b:
                got.append(b)
        out = got
    return [(int(round(x)), int(round(y))) for x, y in out]


def min_area_box(p: Polygon) -> tuple[float, float, float]:
    """(width, height, degrees in (0, 90] of the width's side) of the smallest rectangle around a polygon."""
    a = np.unique(np.asarray(p, float), axis=0)
    if len(a) < 3:
        return (float(np.hypot(*(a[-1] - a[0]))), 0.0, 90.0) if len(a) else (0.0, 0.0, 90.0)
    by = a[np.lexsort((a[:, 1], a[:, 0]))]

    def half(points: np.ndarray) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array([*half(by), *half(by[::-1])])
    d = np.roll(hull, -1, 0) - hull
    angle = np.arctan2(d[:, 1], d[:, 0]) % (np.pi / 2)
    best = None
    for t in np.unique(np.round(angle, 12)):
        x, y = hull @ (np.cos(t), np.sin(t)), hull @ (-np.sin(t), np.cos(t))
        w, h = np.ptp(x), np.ptp(y)
        if best is None or w * h < best[0] - 1e-9:
            best = w * h, w, h, np.degrees(t)
    _, w, h, t = best
    return (float(h), float(w), 90.0) if t == 0 else (float(w), float(h), float(t))


def skew(polygons: list[Polygon]) -> float | None:
    """The mean slope of long shapes that agree: sides at least 2.5 to 1, within a third of the median ratio and two deviations of the median angle; null if there are none."""
    boxes = []
    for p in polygons:
        w, h, t = min_area_box(p)
        boxes.append((h, w, t - 90) if h > w else (w, h, t))
    long = [(w / h if h else np.inf, t) for w, h, t in boxes if w > 2.5 * h]
    if not long:
        return None
    ratio = np.median([r for r, _ in long])
    angle = np.array([t for r, t in long if r == ratio or 0.67 * ratio <= r <= 1.33 * ratio])
    if len(angle) < 2:
        return float(angle[0]) if len(angle) else None
    if np.median(np.abs(angle)) >= 45:
        angle = angle % 180
    off = np.abs(angle - np.median(angle))
    keep = angle[off <= 2 * np.median(off)]
    return float(keep.mean()) if len(keep) else None


def contours(runs: DataFrame, keys: list[str], comp: str = "comp") -> DataFrame:
    """(keys, comp, poly, parent) of labelled runs: the outline of each component (parent null) and of its holes (parent: the component)."""

    def kernel(t: pa.Table) -> pa.Table:
        y, x0, x1, c = (t.column(n).to_numpy() for n in ("y", "x0", "x1", comp))
        rows: list[tuple] = []
        for i in np.unique(c).tolist():
            k = c == i
            box = int(x0[k].min()), int(x1[k].max()), int(y[k].min()), int(y[k].max()) + 1
            m = np.zeros((box[3] - box[2], box[1] - box[0]), bool)
            for yy, a, z in zip((y[k] - box[2]).tolist(), (x0[k] - box[0]).tolist(), (x1[k] - box[0]).tolist()):
                m[yy, a:z] = True
            for o, parent in outlines(m):
                rows.append((i, [{"x": px + box[0], "y": py + box[2]} for px, py in o], None if parent < 0 else i))
        out = t.slice(0, 1).select(keys).take(pa.array([0] * len(rows), pa.int64()))
        for n, kind, v in ((comp, pa.int32(), [r[0] for r in rows]), ("poly", _KIND, [r[1] for r in rows]), ("parent", pa.int32(), [r[2] for r in rows])):
            out = out.append_column(n, pa.array(v, kind))
        return out

    kinds = dict(runs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{comp}` int", f"poly {POLY}", "parent int"])
    return by_key(runs.select(*keys, "y", "x0", "x1", comp), keys, [comp, "y", "x0"], kernel, schema)


def _rectangles(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners of each, x, y) of the traced outlines of filled boxes, ends included; one pixel wide or high they have two corners, or one."""
    wide, high = x1 > x0, y1 > y0
    keep = np.stack([np.ones(len(x0), bool), wide, wide & high, high], 1)
    return keep.sum(1), np.stack([x0, x1, x1, x0], 1)[keep], np.stack([y0, y0, y1, y1], 1)[keep]


def _polygon_array(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Polygons of n corners each, none where n is negative."""
    at = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int32)
    corners = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(n < 0, False)), corners)


def box_contours(boxes: DataFrame, keys: list[str], dx: int = 0, dy: int = 0) -> DataFrame:
    """(keys, poly, hole, area): outlines and holes of what the boxes (x0, y0, x1, y1, half open) of each key cover, grown by a rectangle, and the pixels of it.

    As `contours` of `runs.dilate` of `runs.from_boxes`, but boxes stay boxes: one alone
    has its corners for an outline, only several of a key are painted. Boxes may be keys.
    """
    names = ["x0", "y0", "x1", "y1"]

    def painted(b: np.ndarray) -> tuple[int, list[tuple[Polygon, bool]]]:
        ox, oy = b[:, 0].min(), b[:, 1].min()
        m = np.zeros((b[:, 3].max() - oy, b[:, 2].max() - ox), bool)
        for x0, y0, x1, y1 in (b - (ox, oy, ox, oy)).tolist():
            m[y0:y1, x0:x1] = True
        return int(m.sum()), [([(x + ox, y + oy) for x, y in p], parent >= 0) for p, parent in outlines(m)]

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        b = np.stack([t.column(c).to_numpy().astype(np.int64) for c in names], 1) + (-dx, -dy, dx, dy)
        stop = np.append(starts[1:], len(b))
        low, high = np.minimum.reduceat(b, starts), np.maximum.reduceat(b, starts)
        alone = (low == high).all(1)
        one = low[alone]
        n, x, y = _rectangles(one[:, 0], one[:, 1], one[:, 2] - 1, one[:, 3] - 1)
        rows, area, hole = starts[alone], (one[:, 2] - one[:, 0]) * (one[:, 3] - one[:, 1]), np.zeros(len(one), bool)
        polys = [_polygon_array(n, x, y)]
        for k in np.flatnonzero(~alone).tolist():
            size, found = painted(np.unique(b[starts[k] : stop[k]], axis=0))
            rows, area, hole = np.append(rows, [starts[k]] * len(found)), np.append(area, [size] * len(found)), np.append(hole, [h for _, h in found])
            polys.append(pa.array([[{"x": int(px), "y": int(py)} for px, py in p] for p, _ in found], _KIND))
        out = t.select(keys).take(pa.array(rows, pa.int64()))
        return out.append_column("poly", pa.chunked_array(polys, _KIND)).append_column("hole", pa.array(hole.astype(bool))).append_column("area", pa.array(area, pa.int64())).combine_chunks()

    kinds = dict(boxes.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"poly {POLY}, hole boolean, area bigint"])
    return by_keys(boxes.where("x0 < x1 and y0 < y1").select(*keys, *[c for c in names if c not in keys]), keys, [], kernel, schema)


def map_polygons(df: DataFrame, column: str, kernel: Callable[[Polygon], Polygon | None]) -> DataFrame:
    """The column's polygons replaced by what the kernel makes of each; null stays null."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            new = []
            for p in b.column(at).to_pylist():
                got = None if p is None else kernel([(q["x"], q["y"]) for q in p])
                new.append(None if got is None else [{"x": int(x), "y": int(y)} for x, y in got])
            yield pa.RecordBatch.from_arrays([pa.array(new, _KIND) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    schema = ", ".join(f"`{n}` {POLY if n == column else k}" for n, k in df.dtypes)
    return df.mapInArrow(run, schema)


def join_by(df: DataFrame, keys: list[str], column: str = "poly", scale: float = 20) -> DataFrame:
    """(keys, poly): the polygons of each key joined into one outline."""

    def kernel(t: pa.Table) -> pa.Table:
        own = [[(q["x"], q["y"]) for q in p] for p in t.column(column).to_pylist() if p]
        got = [{"x": x, "y": y} for x, y in join(own, scale)]
        return t.slice(0, 1).select(keys).append_column(column, pa.array([got], _KIND))

    kinds = dict(df.dtypes)
    return by_key(df.select(*keys, column), keys, [], kernel, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{column}` {POLY}"]))


def _corners(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(corners of each, 0 for null; the first four of each as x and y; bounding boxes x0, y0, x1, y1 on whole pixels) of a column of polygons."""
    n = pc.fill_null(pc.list_value_length(polygons), 0).to_numpy().astype(np.int64)
    flat = polygons.flatten()
    x, y = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    some = np.flatnonzero(n)
    start = np.cumsum(n) - n
    box = np.zeros((len(n), 4))
    for k, (v, f) in enumerate(((x, np.minimum), (y, np.minimum), (x, np.maximum), (y, np.maximum))):
        if len(some):
            box[some, k] = f.reduceat(v, start[some])
    box[:, :2], box[:, 2:] = np.floor(box[:, :2]), np.ceil(box[:, 2:])
    four = np.zeros((2, len(n), 4))
    quads = np.flatnonzero(n == 4)
    for k, v in enumerate((x, y)):
        four[k, quads] = v[start[quads, None] + np.arange(4)]
    return n, four[0], four[1], box


def _upright(n: np.ndarray, x: np.ndarray, y: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which polygons are rectangles along the axes, as they are traced."""
    as_traced = (x == box[:, [0, 2, 2, 0]]).all(1) & (y == box[:, [1, 1, 3, 3]]).all(1)
    return (n == 4) & as_traced


def intersect_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """The polygons of column a cut with those of b; null where they share no area or either is null.

    Only pairs whose bounding boxes share an area are looked at; of two upright
    rectangles the share is their boxes', all others are painted.
    """

    def run(batches):
        for batch in batches:
            at, with_ = batch.schema.get_field_index(a), batch.schema.get_field_index(b)
            p, q = _corners(batch.column(at)), _corners(batch.column(with_))
            low, high = np.maximum(p[3][:, :2], q[3][:, :2]), np.minimum(p[3][:, 2:], q[3][:, 2:])
            near = (p[0] >= 3) & (q[0] >= 3) & (low < high).all(1)
            plain = near & _upright(*p) & _upright(*q)
            new: list = [None] * batch.num_rows
            for i in np.flatnonzero(near & ~plain).tolist():
                new[i] = intersection(*([(c["x"], c["y"]) for c in batch.column(k)[i].as_py()] for k in (at, with_)))
            for i, (x0, y0), (x1, y1) in zip(np.flatnonzero(plain).tolist(), low[plain].tolist(), high[plain].tolist()):
                new[i] = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
            got = pa.array([None if v is None else [{"x": int(x), "y": int(y)} for x, y in v] for v in new], _KIND)
            yield pa.RecordBatch.from_arrays([got if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, ", ".join(f"`{n}` {POLY if n == a else k}" for n, k in df.dtypes))
