"""Page-local raster kernels: numpy over a column of images in Arrow batches.

An image is struct<h int, w int, c int, data binary>, rows first, bytes. Images are
never joined or shuffled pixel by pixel; each kernel maps one image to one or many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])


def unpack(v: dict | None) -> np.ndarray | None:
    return None if v is None else np.frombuffer(v["data"], np.uint8).reshape(v["h"], v["w"], v["c"])


def pack(a: np.ndarray | None) -> dict | None:
    if a is None:
        return None
    a = a if a.ndim == 3 else a[:, :, None]
    return {"h": a.shape[0], "w": a.shape[1], "c": a.shape[2], "data": np.ascontiguousarray(a, np.uint8).tobytes()}


def map_images(df: DataFrame, column: str, kernel: Callable[[np.ndarray], np.ndarray], out: str | None = None) -> DataFrame:
    """The column replaced (or `out` added) by the kernel's image; null stays null."""
    out = out or column
    fields = [f for f in df.schema if f.name != out] + [T.StructField(out, IMAGE)]
    schema = T.StructType(fields)
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            made = [pack(None if (x := unpack(v)) is None else kernel(x)) for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in fields[:-1]), pa.array(made, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def expand_images(df: DataFrame, column: str, kernel: Callable[[np.ndarray], Iterator[tuple[str, np.ndarray]]], keys: list[str]) -> DataFrame:
    """(keys, variant, image): what the kernel yields for each image."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("variant", T.StringType()), T.StructField("image", IMAGE)])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in enumerate(b.column(b.schema.get_field_index(column)).to_pylist()):
                got = [] if v is None else list(kernel(unpack(v)))
                row = pa.array([i] * len(got), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(row) for k in keys), pa.array([n for n, _ in got], pa.string()), pa.array([pack(x) for _, x in got], kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest neighbour."""
    return a[np.arange(h) * a.shape[0] // h][:, np.arange(w) * a.shape[1] // w]


def turn(a: np.ndarray, degrees: float, fill: int = 0, enlarge: bool = False) -> np.ndarray:
    """Rotation about the middle, counter-clockwise, bilinear; optionally on a canvas that holds all of it."""
    t = np.deg2rad(degrees)
    h, w = a.shape[:2]
    cos, sin = np.cos(t), np.sin(t)
    nh, nw = (int(np.ceil(abs(h * cos) + abs(w * sin) - 1e-9)), int(np.ceil(abs(h * sin) + abs(w * cos) - 1e-9))) if enlarge else (h, w)
    y, x = np.mgrid[:nh, :nw].astype(float)
    y, x = y - (nh - 1) / 2, x - (nw - 1) / 2
    sx, sy = cos * x - sin * y + (w - 1) / 2, sin * x + cos * y + (h - 1) / 2
    x0, y0 = np.floor(sx + 1e-9).astype(int), np.floor(sy + 1e-9).astype(int)
    fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
    b = np.pad(a.astype(float), ((1, 2), (1, 2), (0, 0))[: a.ndim], constant_values=fill)
    outside = (x0 < -1) | (y0 < -1) | (x0 > w - 1) | (y0 > h - 1)
    x0, y0 = np.clip(x0 + 1, 0, w), np.clip(y0 + 1, 0, h)
    fx, fy = (fx[..., None], fy[..., None]) if a.ndim == 3 else (fx, fy)
    out = (b[y0, x0] * (1 - fx) + b[y0, x0 + 1] * fx) * (1 - fy) + (b[y0 + 1, x0] * (1 - fx) + b[y0 + 1, x0 + 1] * fx) * fy
    out[outside] = fill
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def otsu_mask(a: np.ndarray) -> np.ndarray:
    """0 or 255 by the threshold of greatest variance between classes, from the first channel."""
    g = a[..., 0] if a.ndim == 3 else a
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(all="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, -1)
    return np.repeat(((g > between.argmax()) * 255).astype(np.uint8)[:, :, None], a.shape[2] if a.ndim == 3 else 1, 2)


def pad(a: np.ndarray, top: int, bottom: int, left: int, right: int, fill: int = 255) -> np.ndarray:
    return np.pad(a, ((top, bottom), (left, right), (0, 0)), constant_values=fill)


def center_pad(a: np.ndarray, h: int, w: int, fill: int = 255) -> np.ndarray:
    dy, dx = max(0, h - a.shape[0]), max(0, w - a.shape[1])
    return pad(a, dy // 2, dy - dy // 2, dx // 2, dx - dx // 2, fill)


def fit_line(a: np.ndarray, h: int = 32, w: int = 512) -> np.ndarray:
    """Height h, width by the same factor up to w, white on the right; white alone for an empty image."""
    if not a.size:
        return np.full((h, w, 3), 255, np.uint8)
    nw = min(w, max(1, int(a.shape[1] * h / a.shape[0])))
    return pad(resize(a, h, nw), 0, 0, 0, w - nw)


def tile_starts(n: int, size: int, margin: int = 0) -> list[int]:
    """Starts of tiles that cover n with stride size - 2 margin; the last is moved back to fit."""
    if n <= size:
        return [0]
    stride = max(1, size - 2 * margin)
    starts = list(range(0, n - size, stride))
    return [*starts, n - size]


def tiles(a: np.ndarray, h: int, w: int, margin: int = 0) -> Iterator[tuple[str, np.ndarray]]:
    a = center_pad(a, h, w) if a.shape[0] < h or a.shape[1] < w else a
    for y in tile_starts(a.shape[0], h, margin):
        for x in tile_starts(a.shape[1], w, margin):
            yield f"{y}_{x}", a[y : y + h, x : x + w]


def blend(parts: list[tuple[int, int, np.ndarray]], h: int, w: int, margin: int) -> np.ndarray:
    """Class scores [h, w, classes] from overlapping tiles, weighted by a sigmoid towards their edges."""
    out = total = None
    for y, x, p in parts:
        def edge(n: int) -> np.ndarray:
            k = np.minimum(np.arange(n), np.arange(n)[::-1])
            return 1 / (1 + np.exp(5 - 5 * np.minimum(k, 2 * margin) / margin)) if margin else np.ones(n)

        weight = np.outer(edge(p.shape[0]), edge(p.shape[1]))
        if out is None:
            out, total = np.zeros((h, w, p.shape[2])), np.zeros((h, w))
        out[y : y + p.shape[0], x : x + p.shape[1]] += weight[..., None] * p
        total[y : y + p.shape[0], x : x + p.shape[1]] += weight
    return out / np.maximum(total, 1e-12)[..., None]


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(a.astype(float), r, "symmetric"), k / k.sum(), "valid")


def skew_angle(mask: np.ndarray, angles: np.ndarray | None = None, sigma: float = 2.0, n: int = 40) -> float:
    """The angle at which the rows' ink profile varies most, coarse then fine; 0 for an empty mask."""
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    if not m.any():
        return 0.0
    side = int(np.ceil(1.1 * np.hypot(*m.shape))) + 2
    y, x = np.nonzero(m)
    y, x = y - (m.shape[0] - 1) / 2, x - (m.shape[1] - 1) / 2

    def best(tried: np.ndarray) -> float:
        spread = []
        for t in np.deg2rad(tried):  # where each pixel of ink lies after the turn; no image is made
            row = np.rint(np.cos(t) * y - np.sin(t) * x + side / 2).astype(np.int64)
            spread.append(smooth(np.bincount(row, minlength=side), sigma).std())
        return float(tried[int(np.argmax(spread))]) if max(spread) > 0 else 0.0

    if angles is None:
        angles = np.concatenate([np.linspace(-12, -7, n // 4), np.linspace(-6, 6, n // 2), np.linspace(7, 12, n // 4)])
    coarse = best(angles)
    return best(np.linspace(coarse - 2.5, coarse + 2.5, n // 2))


def text_columns(mask: np.ndarray, sigma: float = 25.0) -> int:
    """Columns of text from the deep valleys of the smoothed column profile."""
    z = smooth((mask[..., 0] if mask.ndim == 3 else mask).astype(bool).sum(0), sigma)
    ink = np.flatnonzero(z > 10)
    if not len(ink):
        return 1
    inner = z[ink[0] : ink[-1] + 1]
    low = np.flatnonzero((inner[1:-1] < inner[:-2]) & (inner[1:-1] <= inner[2:])) + 1
    margin = max(1, len(inner) * 6 // 100)
    return 1 + int(((low > margin) & (low < len(inner) - margin) & (inner[low] < inner.max() / 3)).sum())


def line_rows(mask: np.ndarray, sigma: float = 3.0) -> list[tuple[int, int]]:
    """(top, bottom) of text lines: from valley to valley of the smoothed row profile around each peak."""
    z = smooth((mask[..., 0] if mask.ndim == 3 else mask).astype(bool).sum(1), sigma)
    if z.max(initial=0) <= 0:
        return []
    low = [0, *(np.flatnonzero((z[1:-1] < z[:-2]) & (z[1:-1] <= z[2:]) & (z[1:-1] < 0.42 * z.max())) + 1).tolist(), len(z)]
    return [(a, b) for a, b in zip(low, low[1:]) if z[a:b].max(initial=0) > 0.24 * z.max()]


def trace(mask: np.ndarray) -> list[tuple[int, int]]:
    """The outer outline (x, y) of the component that holds the first pixel, clockwise, corners of straight runs only (Moore neighbours)."""
    m = np.pad(mask.astype(bool), 1)
    ys, xs = np.nonzero(m)
    if not len(ys):
        return []
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    start = (int(ys[0]), int(xs[0]))
    out, at, came, first = [start], start, 6, None
    for _ in range(8 * m.size):
        for k in range(1, 9):
            d = (came + k) % 8
            y, x = at[0] + ring[d][0], at[1] + ring[d][1]
            if m[y, x]:
                break
        else:
            break
        if at == start and first is None:
            first = d
        elif at == start and d == first:
            break
        at, came = (y, x), (d + 4) % 8
        out.append(at)
    pts = out[:-1] if len(out) > 1 else out
    keep = [p for a, p, b in zip([pts[-1], *pts], pts, [*pts[1:], pts[0]]) if len(pts) < 3 or (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
    return [(x - 1, y - 1) for y, x in keep]


def to_runs(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1, label): the runs of equal non-zero labels of each image's first channel."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("y", "x0", "x1", "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in enumerate(b.column(b.schema.get_field_index(column)).to_pylist()):
                if v is None:
                    continue
                a = unpack(v)[..., 0]
                edge = np.ones((a.shape[0], a.shape[1] + 1), bool)
                edge[:, 1:-1] = a[:, 1:] != a[:, :-1]
                y, x = np.nonzero(edge)
                last = np.append(y[1:] != y[:-1], True)
                x1 = np.append(x[1:], 0)
                keep = ~last
                y, x0, x1 = y[keep], x[keep], x1[keep]
                some = a[y, x0] > 0
                row = pa.array(np.full(int(some.sum()), i))
                ints = [pa.array(c[some].astype(np.int32)) for c in (y, x0, x1, a[y, x0])]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(row) for k in keys), *ints], names=schema.names)

    return df.select(*keys, column).mapInArrow(run, schema)


def painted(t: pa.Table, h: int, w: int, label: str | None = None, scale: int = 1) -> np.ndarray:
    """The image of runs (y, x0, x1) of h x w in 255 or their label, each pixel `scale` times as wide and high; what lies outside is cut off."""
    a = np.zeros((h, w), np.uint8)
    for y, x0, x1, *k in zip(*(t.column(c).to_pylist() for c in ("y", "x0", "x1", *([label] if label else [])))):
        if 0 <= y < h:
            a[y, max(0, x0) : max(0, x1)] = k[0] if k else 255
    return a if scale == 1 else a.repeat(scale, 0).repeat(scale, 1)


def from_runs(runs: DataFrame, keys: list[str], h: int, w: int, label: str | None = None) -> DataFrame:
    """(keys, image) of h x w: runs (keys, y, x0, x1) painted in 255 or their label; what lies outside is cut off."""
    from quire.operators.grouped import by_key

    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def kernel(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(keys).append_column("image", pa.array([pack(painted(t, h, w, label))], kind))

    schema = T.StructType([*(runs.schema[k] for k in keys), T.StructField("image", IMAGE)])
    return by_key(runs.select(*keys, "y", "x0", "x1", *([label] if label else [])), keys, ["y", "x0"], kernel, schema)


def pair_counts(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, a, b, n): how often two label images of a row have which labels at one pixel; the second is brought to the size of the first."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in (a, b)] + [T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (u, v) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist())):
                if u is None or v is None:
                    continue
                x = unpack(u)[..., 0]
                pair, n = np.unique(x.astype(np.int32) * 256 + resize(unpack(v)[..., 0], *x.shape), return_counts=True)
                row = pa.array(np.full(len(n), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in range(len(keys))), pa.array(pair // 256, pa.int32()), pa.array(pair % 256, pa.int32()), pa.array(n)], names=schema.names)

    return df.select(*keys, a, b).mapInArrow(run, schema)


def from_raw(df: DataFrame, data: str, h: str, w: str, c: str, out: str = "image") -> DataFrame:
    """An image column from raw bytes and sizes."""
    return df.withColumn(out, F.struct(F.col(h).cast("int").alias("h"), F.col(w).cast("int").alias("w"), F.col(c).cast("int").alias("c"), F.col(data).alias("data")))
