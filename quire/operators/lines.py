"""Text lines of a region: bands of its row profile, slanted strips, curved lines cut into straight pieces; page-local kernels in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import raster
from quire.operators.columns import grow, labelled, peaks, shrink
from quire.operators.grouped import by_key
from quire.operators.polygons import _KIND, POLY, Polygon, _largest, fill


def profile_sigma(profile: np.ndarray) -> float:
    """Seven fortieths of the mean distance of lines, 3 at least; 12 where there is no distance."""
    tops = peaks(raster.smooth(profile, 12.0))
    return max(3.0, 7 / 40 * float(np.diff(tops).mean())) if len(tops) > 1 else 12.0


def peaks_and_valleys(profile: np.ndarray, sigma: float, shallow: float = 0.42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(peaks, the valleys between them, smoothed profile); peaks about a valley of less than a share of the greatest depth are one, half-way."""
    z = raster.smooth(np.pad(profile, 20), sigma)[20:-20]
    tops = peaks(np.pad(z, 1, constant_values=-1)) - 1
    if len(tops) < 2:
        return tops, tops[:0], z
    low = np.array([a + int(np.argmin(z[a : b + 1])) for a, b in zip(tops, tops[1:])])
    depth = z.max() - z[low]
    merged, valleys = [float(tops[0])], []
    for top, v, d in zip(tops[1:], low, depth):
        if d < shallow * depth.max():
            merged[-1] = (merged[-1] + top) / 2
        else:
            merged.append(float(top))
            valleys.append(int(v))
    return np.array(merged).astype(int), np.array(valleys, int), z


def line_bands(mask: np.ndarray) -> list[tuple[int, int]]:
    """(top, bottom) of each line of a region's text mask.

    One line takes the whole height and two meet at their valley. Of three and more each
    reaches 1.1 times as far as the valley above and below it, weak ones (half a deviation
    under the mean) 1.23 and 1.33 times, and the last 1.3 times up and to the bottom.
    """
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    height = len(m)
    profile = m.sum(1)
    if not profile.any():
        return []
    tops, valleys, z = peaks_and_valleys(profile, profile_sigma(profile))
    if len(tops) < 2:
        return [(0, height)]
    if len(tops) == 2:
        return [(0, int(valleys[0])), (int(valleys[0]), height)]
    heights = z[tops]
    weak = heights <= heights.mean() - heights.std() / 2
    edges = np.concatenate([[0], valleys, [height]])
    out = []
    for k, t in enumerate(tops.tolist()):
        last = k == len(tops) - 1
        up, down = (1.3, 1.4) if last else (1.23, 1.33) if weak[k] else (1.1, 1.1)
        out.append((max(0, int(t - up * (t - edges[k]))), height if last else min(height, int(t + down * (edges[k + 1] - t)))))
    return out


def turned(p: Polygon, degrees: float, about: tuple[float, float]) -> Polygon:
    """A polygon turned counter-clockwise (as pixels are, y downwards) about a point, cut off at 0."""
    t = np.deg2rad(degrees)
    q = np.asarray(p, float) - about
    x, y = np.cos(t) * q[:, 0] + np.sin(t) * q[:, 1], -np.sin(t) * q[:, 0] + np.cos(t) * q[:, 1]
    return [(max(0, int(round(a))), max(0, int(round(b)))) for a, b in zip(x + about[0], y + about[1])]


def line_boxes(mask: np.ndarray, slope: float = 0.0, offset: tuple[int, int] = (0, 0)) -> list[Polygon]:
    """Line boxes of a region's text mask that stands at a slope: found upright, as wide as their ink, and turned back."""
    m = ((mask[..., 0] if mask.ndim == 3 else mask) > 0).astype(np.uint8) * 255
    flat = m if slope == 0 else raster.turn(m, -slope, enlarge=True)
    dy, dx = (flat.shape[0] - m.shape[0]) / 2, (flat.shape[1] - m.shape[1]) / 2
    out = []
    for a, z in line_bands(flat > 127):
        x = np.flatnonzero((flat[a:z] > 127).any(0))
        if len(x):
            p = [(x[0], a), (x[-1], a), (x[-1], z - 1), (x[0], z - 1)]
            centre = (flat.shape[1] - 1) / 2, (flat.shape[0] - 1) / 2
            back = [(q - (dx, dy)) for q in np.asarray(turned(p, slope, centre) if slope else p, float)]
            out.append([(max(0, int(px)) + offset[0], max(0, int(py)) + offset[1]) for px, py in back])
    return out


def separated(mask: np.ndarray, shallow: tuple[float, float] = (0.3, 0.24), clear: int = 6) -> np.ndarray:
    """A mask whose lines touch no more: rows about valleys emptied, rows about peaks filled where there is ink, and thinned.

    The first pass finds the distance of the lines, the second their valleys.
    """
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    profile = m.sum(1)
    if not profile.any():
        return m
    tops, _, _ = peaks_and_valleys(profile, 3.0, shallow[0])
    sigma = max(3.0, 7 / 40 * float(np.diff(tops).mean())) if len(tops) > 1 else 3.0
    tops, valleys, _ = peaks_and_valleys(profile, sigma, shallow[1])
    out = m.copy()
    inked = m.any(0)
    for t in tops.tolist():
        rows = slice(max(0, t - clear), t + clear)
        out[rows] |= m[rows].any(0) & inked
    for v in valleys.tolist():
        out[max(0, v - clear) : v + clear] = False
    return shrink(out, 2, 2)


def separated_strips(mask: np.ndarray, columns: int = 1, share: float = 0.04) -> np.ndarray:
    """As `separated`, for lines that bend: in strips of a 200th (one column) or 140th of 30 000 pixels of width, each upright on its own, of which the middle is kept."""
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    h, w = m.shape
    wide = min(w, 200 if columns == 1 else 140)
    margin = int(share * wide)
    out = np.zeros_like(m)
    for x in raster.tile_starts(w, wide, margin):
        part = m[:, x : x + wide]
        if not part.any():
            continue
        slope = raster.skew_angle(part.astype(np.uint8) * 255, n=20)
        flat = raster.turn(part.astype(np.uint8) * 255, slope) > 127 if slope else part
        made = separated(flat)
        back = raster.turn(made.astype(np.uint8) * 255, -slope) > 127 if slope else made
        a, z = (0 if x == 0 else margin), (part.shape[1] if x + wide >= w else part.shape[1] - margin)
        out[:, x + a : x + z] = back[:, a:z] & part[:, a:z]
    return out


def curved_lines(mask: np.ndarray, slope: float, columns: int = 1, offset: tuple[int, int] = (0, 0), least: float = 1e-5) -> list[Polygon]:
    """Outlines of a region's lines, downwards: separated in strips and grown again below 45 degrees, else boxes of the turned region."""
    if abs(slope) >= 45:
        return line_boxes(mask, slope, offset)
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    label, boxes = labelled(separated_strips(m, columns))
    found = []
    for i, (x0, x1, y0, y1) in enumerate(boxes.tolist(), 1):
        own = np.pad(label[y0:y1, x0:x1] == i, 4)
        if own.sum() < max(least * m.size, 4):
            continue
        outline = _largest(grow(own, 2, 4), (x0 - 4, x1 + 4, y0 - 4, y1 + 4))
        found.append((y0, x0, [(max(0, x) + offset[0], max(0, y) + offset[1]) for x, y in outline]))
    return [p for _, _, p in sorted(found, key=lambda f: f[:2])]


def moments_angle(mask: np.ndarray) -> float:
    """Degrees of the main axis of the largest component; 90 with the sign of the mixed moment where the spreads are equal."""
    label, _ = labelled(mask > 0)
    if not label.any():
        return 0.0
    y, x = np.nonzero(label == int(np.argmax(np.bincount(label.ravel())[1:])) + 1)
    mu20, mu02, mu11 = x.var(), y.var(), ((x - x.mean()) * (y - y.mean())).mean()
    if mu20 == mu02:
        return -90.0 if mu11 < 0 else 90.0
    return float(np.degrees(np.arctan2(2 * mu11, mu20 - mu02)) / 2)


def split_points(mask: np.ndarray, pieces: int = 5, margin: float = 0.03) -> list[int]:
    """x of the thinnest places of a line, at most pieces - 1, away from its ends."""
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    z = raster.smooth(m.sum(0), 10.0)
    low = peaks(-z)
    low = low[(low > margin * len(z)) & (low < (1 - margin) * len(z))]
    return sorted(low[np.argsort(z[low], kind="stable")[: pieces - 1]].tolist())


def straightened(image: np.ndarray, mask: np.ndarray, height: int = 32) -> np.ndarray:
    """A curved line as one straight strip: cut at its thinnest places, each piece turned upright by its moments (below 45 degrees) and cropped to its ink, brought to one height and put together again."""
    m = (mask[..., 0] if mask.ndim == 3 else mask) > 0
    cuts = [0, *split_points(m), m.shape[1]]
    pieces = []
    for a, z in zip(cuts, cuts[1:]):
        part, ink = image[:, a:z], m[:, a:z]
        if not ink.any():
            continue
        angle = moments_angle(ink)
        if 0 < abs(angle) < 45:
            part = raster.turn(part, angle, 255, True)
            ink = raster.turn(ink.astype(np.uint8) * 255, angle, 0, True) > 127
        y, x = np.nonzero(ink)
        if len(y):
            part = part[y.min() : y.max() + 1, x.min() : x.max() + 1]
            pieces.append(raster.resize(part, height, max(1, round(part.shape[1] * height / part.shape[0]))))
    if not pieces:
        return raster.resize(image, height, max(1, round(image.shape[1] * height / max(1, image.shape[0]))))
    return np.concatenate(pieces, 1)


def lines_of_regions(regions: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, tuple[int, int]], list[Polygon]] = lambda m, o: line_boxes(m, 0.0, o)) -> DataFrame:
    """(keys, line_idx, poly) of regions(keys, y, x0, x1): the runs of text in each region as a mask, and the kernel's lines of it."""

    def run(t: pa.Table) -> pa.Table:
        y, x0, x1 = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        top, left = int(y.min()), int(x0.min())
        m = np.zeros((int(y.max()) - top + 1, int(x1.max()) - left), bool)
        for yy, a, z in zip((y - top).tolist(), (x0 - left).tolist(), (x1 - left).tolist()):
            m[yy, a:z] = True
        got = kernel(m, (left, top))
        out = t.slice(0, 1).select(keys).take(pa.array([0] * len(got), pa.int64())).append_column("line_idx", pa.array(range(len(got)), pa.int32()))
        return out.append_column("poly", pa.array([[{"x": int(x), "y": int(y_)} for x, y_ in p] for p in got], _KIND))

    kinds = dict(regions.dtypes)
    return by_key(regions.select(*keys, "y", "x0", "x1"), keys, ["y", "x0"], run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "line_idx int", f"poly {POLY}"]))


def inside(p: Polygon, shape: tuple[int, int]) -> np.ndarray:
    """The mask of a polygon on a page of this shape."""
    return fill([p], (0, shape[1], 0, shape[0]))
