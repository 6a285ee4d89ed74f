"""Columns of a page, its separators, and the boxes they cut it into in reading order; page-local kernels in numpy.

A page is a text mask and a separator mask. Boxes and separators are half-open in
pixels: (x0, x1, y0, y1).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import raster
from quire.operators.grouped import by_key, local_roots
from quire.operators.runs import touching


def peaks(a: np.ndarray) -> np.ndarray:
    """Places of strict local maxima, ends excluded; of a plateau the middle, rounded down."""
    if len(a) < 3:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    end = np.append(start[1:], len(a)) - 1
    level = a[start]
    inner = np.zeros(len(start), bool)
    inner[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (start[inner] + end[inner]) // 2


def _lopsided(cuts: list[int], width: int) -> bool:
    """Whether one or two cuts leave all columns on one side of the page."""
    if len(cuts) == 1:
        return not 0.25 * width <= cuts[0] <= 0.75 * width
    if len(cuts) != 2:
        return False
    a, b = cuts
    left, right = 0.5 * width - 200, 0.5 * width + 200
    return (a > 0.75 * width and b > 0.75 * width) or (a < 0.25 * width and b < 0.25 * width) or (a < left and b < 0.5 * width) or (a > right and b > 0.5 * width)


def column_cuts(text: np.ndarray, expected: int = 1, multiplier: float = 3.8, separators: np.ndarray | None = None, tables: bool = False, unbalanced: bool = False, sigma: float = 25.0) -> list[int]:
    """x of the gaps between columns of a text mask, or of its column sums.

    Valleys of the smoothed sums count where they are 50 pixels inside the text and 170
    inside the page, and lower than a cut: a share of the lowest column, and no more than
    `multiplier` times the lowest valley and five. Ink of vertical separators deepens
    them. If three or more columns of the `expected` number are missing, the deepest are
    taken (not with tables). Of valleys within 300 pixels the lowest stays. Cuts that
    leave the columns on one side of the page are given up unless `unbalanced`.
    """
    sums = (text > 0).sum(0) if text.ndim > 1 else np.asarray(text)
    width = len(sums)
    if not sums.any():
        return []
    z = raster.smooth(sums, sigma)
    deep = np.zeros(width) if separators is None else raster.smooth((separators > 0).sum(0) if separators.ndim > 1 else separators, sigma)
    tops = peaks(z)
    heights = z[tops[(tops > 0.06 * width) & (tops < 0.94 * width)]]
    heights = heights[heights > 10]
    if not len(heights):
        return []
    ink = np.flatnonzero(sums)
    # mirrored and padded, so that the page's edges don't make valleys of their own
    mirrored = raster.smooth(np.pad(sums.max() - np.pad(sums, 10), 10), sigma)
    low = peaks(mirrored) - 20
    low = low[(low > max(ink[0] + 50, 170)) & (low < min(ink[-1] + 1 - 50, width - 170))]
    if not len(low) or not z[low].any():
        return []
    least = heights.mean() if heights.max() >= 35 * max(heights.min(), 1e-9) else heights.min()
    cut = min(least * (1 - 1 / multiplier), multiplier * (5 + z[low].min()))
    depth = z[low] - deep[low]
    found = low[depth < cut]
    if not tables and expected - (len(found) + 1) >= 3:
        found = np.sort(low[np.argsort(depth, kind="stable")[:expected]])
    if not unbalanced and _lopsided(found.tolist(), width):
        found = found[:0]
    groups = np.split(found, np.flatnonzero(np.diff(found) > 300) + 1) if len(found) else []
    cuts = [int(g[np.argmin(z[g])]) for g in groups]
    if unbalanced:
        return cuts
    if _lopsided(cuts, width):
        return []
    if len(cuts) == 2:  # a sliver at the margin is no column
        a, b = (c / width for c in cuts)
        if 0.25 < a < 0.75 and b > 0.80:
            return cuts[:1]
        if 0.25 < b < 0.75 and a < 0.20:
            return cuts[1:]
    return cuts


def cuts_by_lines(separators: np.ndarray, sigma: float = 35.0) -> list[int]:
    """x of vertical separators: peaks of their column sums."""
    return peaks(raster.smooth((separators > 0).sum(0), sigma)).tolist()


def column_count(text: np.ndarray, expected: int, least: int | None = None, most: int | None = None, multiplier: float = 6.0) -> int:
    """Columns of a page, held between bounds."""
    n = len(column_cuts(text, expected, multiplier)) + 1
    n = n if most is None else min(n, most)
    return n if least is None else max(n, least)


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of the runs of a mask, by row."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(edge == 1)
    return y, x0, np.nonzero(edge == -1)[1]


def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component of each pixel, 0 outside; boxes (x0, x1, y0, y1) of components 1, 2, ...), diagonal neighbours joined."""
    y, x0, x1 = mask_runs(mask)
    out = np.zeros(mask.shape, np.int32)
    if not len(y):
        return out, np.zeros((0, 4), np.int64)
    _, comp = np.unique(local_roots(len(y), *touching(y, x0, x1)), return_inverse=True)
    size = x1 - x0
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(x0, size)
    out[np.repeat(y, size), at] = np.repeat(comp, size) + 1
    boxes = np.stack([np.full(comp.max() + 1, mask.size), np.zeros(comp.max() + 1, int), np.full(comp.max() + 1, mask.size), np.zeros(comp.max() + 1, int)], 1)
    np.minimum.at(boxes[:, 0], comp, x0)
    np.maximum.at(boxes[:, 1], comp, x1)
    np.minimum.at(boxes[:, 2], comp, y)
    np.maximum.at(boxes[:, 3], comp, y + 1)
    return out, boxes


def grow(mask: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Dilation by a (2 dx + 1) x (2 dy + 1) rectangle."""
    out = mask
    for axis, n in ((1, dx), (0, dy)):
        if n:
            pad = [(0, 0), (0, 0)]
            pad[axis] = (n + 1, n)
            sums = np.cumsum(np.pad(out.astype(np.int32), pad), axis)
            size = out.shape[axis]
            out = (sums.take(range(2 * n + 1, 2 * n + 1 + size), axis) - sums.take(range(size), axis)) > 0
    return out


def shrink(mask: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Erosion by the rectangle; beyond the border counts as inside."""
    return ~grow(~mask.astype(bool), dx, dy)


@dataclass(frozen=True)
class Separator:
    x0: int
    x1: int
    y0: int
    y1: int
    kind: str  # horizontal, vertical, heading

    @property
    def cy(self) -> int:
        return (self.y0 + self.y1) // 2


def separators(mask: np.ndarray, columns: int, headings: list[tuple[int, int, int, int]] = (), top: int = 110, bottom: int = 150) -> tuple[list[Separator], list[int]]:
    """(separators, y of those that split the page) of a separator mask and heading boxes.

    Flat components (up to 50 high, three times as wide) are horizontal; of the rest,
    bars of a thirtieth of the page's width or height in a row or column are, where they
    stand. Horizontal ones end at vertical ones. Neighbours on one horizon that nearly
    fill their common span are one, and split the page if that is nearly all of it.
    Horizontal ones count from a tenth of the width and lose 50 pixels at each end, so as
    not to reach into the next column; those and headings from 16 % to 84 % split the page.
    """
    height, width = mask.shape
    m = mask.astype(bool).copy()
    m[:top] = False
    m[max(0, height - bottom) :] = False
    found, vertical, splits = _lines_of(m, columns) if m.any() else ([], [], [])
    heads = [Separator(max(0, x0), min(width, x1), max(0, y0), min(height, y1), "heading") for x0, x1, y0, y1 in headings]
    across = lambda s, slack: s.x0 - slack <= 0.16 * width and s.x1 + slack >= 0.84 * width
    splits += [s.cy for s in found if across(s, 50)]
    splits += [y for s in heads if across(s, 0) for y in (s.y0, s.y1)]
    return [*found, *vertical, *heads], sorted(splits)


def _lines_of(m: np.ndarray, columns: int) -> tuple[list[Separator], list[Separator], list[int]]:
    """(horizontal separators, vertical ones, y of merged ones that split the page) of a mask."""
    height, width = m.shape
    m = shrink(grow(m, 2, 2), 2, 2)
    label, boxes = labelled(m)
    w, h = boxes[:, 1] - boxes[:, 0], boxes[:, 3] - boxes[:, 2]
    flat = np.append(False, (h - 1 <= 50) & (w - 1 >= 3 * (h - 1)))
    rest = m & ~flat[label]
    bar = width // 30 // 2
    wide = grow(shrink(np.pad(rest, bar), bar, 0), bar, 0)[bar : bar + height, bar : bar + width] if bar else rest
    tall_ = height // 30 // 2
    tall = grow(shrink(np.pad(rest, tall_), 0, tall_), 0, tall_)[tall_ : tall_ + height, tall_ : tall_ + width] if tall_ else rest
    tall = grow(tall, 2, 2)
    hor = (flat[label] | wide) & ~tall
    vertical = [Separator(*b, "vertical") for b in labelled(tall)[1].tolist() if b[3] - b[2] > b[1] - b[0]]
    found = [Separator(*b, "horizontal") for b in labelled(hor)[1].tolist() if b[1] - b[0] > b[3] - b[2]]
    splits: list[int] = []
    if sum(s.x1 - s.x0 >= width / (columns + 1) for s in found) < 10 * columns:
        found, splits = _merged(found, vertical, width)
    found = [replace(s, x0=s.x0 + 50, x1=max(s.x1 - 50, s.x0 + 51)) for s in found if s.x1 - s.x0 >= width / 10]
    return found, vertical, splits


def _merged(found: list[Separator], vertical: list[Separator], width: int) -> tuple[list[Separator], list[int]]:
    """Neighbours on one horizon (centres within 30 pixels) made one where no vertical separator stands between and their spans fill 85 % of the common one."""
    by = sorted(found, key=lambda s: (s.cy, s.x0))
    roots, splits = list(range(len(by))), []
    for i, (a, b) in enumerate(zip(by, by[1:])):
        if b.cy - a.cy > 30:
            continue
        left, right = sorted((a, b), key=lambda s: s.x0)
        y0, y1 = min(a.y0, b.y0), max(a.y1, b.y1)
        if any(v.x0 < right.x0 and v.x1 > left.x1 and v.y0 < y1 and v.y1 > y0 for v in vertical):
            continue
        spans, whole = [s.x1 - s.x0 for s in (a, b)], max(a.x1, b.x1) - min(a.x0, b.x0)
        if not sum(spans) < whole or sum(spans) <= 0.85 * whole:
            continue
        roots = [roots[i] if r == roots[i + 1] else r for r in roots]
        if whole > 0.85 * width and np.std(spans) / np.mean(spans) < 0.55:
            splits.append((a.cy + b.cy) // 2)
    out = []
    for r in sorted(set(roots)):
        own = [s for s, q in zip(by, roots) if q == r]
        mid = round(sum(s.cy for s in own) / len(own))
        out.append(own[0] if len(own) == 1 else Separator(min(s.x0 for s in own), max(s.x1 for s in own), mid - 5, mid + 5, "horizontal"))
    return out, splits


def page_columns(text: np.ndarray, seps: list[Separator], splits: list[int], expected: int, tables: bool = False) -> list[int]:
    """Column cuts of the part of the page that has most, among parts of at least 22 % of its height; by vertical separators where the one part has too few."""
    height, width = text.shape
    lines = paint(seps, text.shape)
    edges = [0, *splits, height]
    parts = [(a, z) for a, z in zip(edges, edges[1:]) if z - a >= 0.22 * height]
    best: list[int] = []
    for a, z in parts:
        best = max(best, column_cuts(text[a:z], expected, 7.0, lines[a:z], tables), key=len)
    if len(parts) == 1 and len(best) + 1 < expected:
        by_lines = [x for x in cuts_by_lines(lines) if 500 <= x <= width - 500]
        best = by_lines or best
    return best


def paint(seps: list[Separator], shape: tuple[int, int]) -> np.ndarray:
    """The boxes of vertical separators."""
    out = np.zeros(shape, bool)
    for s in seps:
        if s.kind == "vertical":
            out[s.y0 : s.y1, s.x0 : s.x1] = True
    return out


@dataclass
class Bar:
    """A horizontal border over columns first to last (exclusive)."""

    first: int
    last: int
    y0: int
    y: int
    y1: int


def bars(text: np.ndarray, edges: np.ndarray, top: int, lines: list[tuple[int, int, int, int, int]]) -> list[Bar]:
    """The borders over several columns, downwards, the page part's top first; lines are (x0, x1, y0, y, y1).

    A border with no text between it and the next one above that it shares a column with
    goes into that one, which then reaches as far as both; one with no text between it and
    the next one below that covers it goes too.
    """
    found = [Bar(0, len(edges) - 1, top, top, top + 2)]
    for x0, x1, y0, y, y1 in lines:
        first, last = int(np.searchsorted(edges, x0, "right")) - 1, int(np.searchsorted(edges, x1, "left"))
        if last - first >= 2:
            found.append(Bar(first, last, y0, y, y1))
    order = sorted(range(len(found)), key=lambda i: found[i].y)
    gone: set[int] = set()
    for i, b in enumerate(found):
        above = [j for j in order if j != i and j not in gone and found[j].y <= b.y and b.first < found[j].last and b.last > found[j].first]
        if not above:
            continue
        a = found[above[-1]]
        if not text[a.y1 : b.y0, edges[min(a.first, b.first)] : edges[max(a.last, b.last)]].any():
            gone.add(i)
            a.first, a.last = min(a.first, b.first), max(a.last, b.last)
            continue
        below = [j for j in order if j != i and j not in gone and found[j].y >= b.y and b.first >= found[j].first and b.last <= found[j].last]
        if below and not text[b.y1 : found[below[0]].y0, edges[b.first] : edges[b.last]].any():
            gone.add(i)
    return [found[i] for i in order if i not in gone]


def _reaching(edges: np.ndarray, sep_mask: np.ndarray, s: Separator) -> Separator:
    """A separator over several columns drawn out to the furthest column borders that no separator pixel keeps it from."""
    first, last = int(np.searchsorted(edges, s.x0, "right")) - 1, int(np.searchsorted(edges, s.x1, "left"))
    if last - first <= 1:
        return s
    rows = sep_mask[s.y0 : s.y1]
    x0 = next((int(edges[j]) + 1 for j in range(first) if not rows[:, edges[j] : s.x0].any()), s.x0)
    x1 = next((int(edges[j]) - 1 for j in range(len(edges) - 1, last, -1) if not rows[:, s.x1 : edges[j]].any()), s.x1)
    return replace(s, x0=x0, x1=x1)


def reading_boxes(text: np.ndarray, sep_mask: np.ndarray, seps: list[Separator], splits: list[int], expected: int, eroded: bool = False, tables: bool = False, right_to_left: bool = False) -> tuple[list[tuple[int, int, int, int]], list[list[int]]]:
    """(boxes (x0, x1, y0, y1) in reading order, column borders of each part of the page).

    Each part between splits has columns of its own. Borders over several columns come
    from horizontal separators, from tops and bottoms of headings, and from those of text
    that crosses column borders. From each border downwards, column by column, a box goes
    on to the next border below, as wide as text that mustn't be cut; a border inside the
    one above is entered where its last column is done.
    """
    height, width = text.shape
    if right_to_left:
        text, sep_mask = text[:, ::-1], sep_mask[:, ::-1]
        seps = [replace(s, x0=width - s.x1, x1=width - s.x0) for s in seps]
    label, stats = labelled(text > 0)
    lines = paint(seps, text.shape) & (sep_mask > 0)
    out: list[tuple[int, int, int, int]] = []
    borders: list[list[int]] = []
    for top, bot in zip([0, *splits], [*splits, height]):
        if bot <= top:
            continue
        edges = np.array([0, *_cuts_of_part(text[top:bot], lines[top:bot], expected, (bot - top) >= 0.22 * height, eroded, tables), width])
        borders.append(edges.tolist())
        own = [_reaching(edges, sep_mask, s) if s.kind != "vertical" else s for s in seps if s.y0 >= top and s.y1 < bot]
        found = [(s.x0, s.x1, s.y0, s.cy, s.y1) for s in own if s.kind == "horizontal"]
        for s in own:
            if s.kind == "heading":  # its top and its bottom; a little narrower, so as not to touch the next column
                found += [(s.x0 + 30, s.x1 - 30, s.y0 - 2, s.y0 - 1, s.y0), (s.x0 + 30, s.x1 - 30, s.y1, s.y1 + 1, s.y1 + 2)]
        crossing = _crossing(label[top:bot], stats, edges)
        for x0, x1, y0, y1, *_ in crossing:
            found += [(x0, x1, y0 - 2, y0 - 1, y0), (x0, x1, y1, y1 + 1, y1 + 2)]
        found = [(*np.clip(b[:2], 0, width).tolist(), *np.clip(b[2:], 0, height).tolist()) for b in found]
        out += _walk(bars(text, edges, top, found), edges, bot, crossing, text)
    if right_to_left:
        out = [(width - x1, width - x0, y0, y1) for x0, x1, y0, y1 in out]
        borders = [[width - x for x in e[::-1]] for e in borders]
    return out, borders


def _cuts_of_part(text: np.ndarray, lines: np.ndarray, expected: int, big: bool, eroded: bool, tables: bool) -> list[int]:
    """Column cuts of a part; a big one with too few is searched again, first with a laxer cut, then inside each of its columns."""
    width = text.shape[1]
    cuts = column_cuts(text, expected if big else 1, 6.0 if eroded else 7.0, lines, tables, True)
    if not big or len(cuts) + 1 >= expected and expected != 6:
        return cuts
    wider = cuts or column_cuts(text, expected, 7.0 if eroded else 8.0, lines, tables, True)
    inner: list[int] = []
    edges = [0, *wider, width - 1]
    for a, z in zip(edges, edges[1:]):
        n = round((z - a) / width * expected)
        tried = [column_cuts(text[:, a:z], n, m, lines[:, a:z], tables) for m in (7.0, 5.0)]
        inner += [x + a for x in max(tried, key=len)]
        if z < width - 1:
            inner.append(z)
    return inner if len(inner) >= len(cuts) else cuts


def _crossing(label: np.ndarray, stats: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int, int, np.ndarray]]:
    """Components (x0, x1, y0, y1, first column, last, pixels by column) of some size with a tenth of their pixels in each of several columns."""
    by_column = np.stack([np.bincount(label[:, a:z].ravel(), minlength=len(stats) + 1) for a, z in zip(edges, edges[1:])])
    total = by_column.sum(0)
    usual = np.median(total[: np.flatnonzero(total)[-1] + 1]) if total.any() else 0
    out = []
    for i in np.flatnonzero(total[1:]) + 1:
        x0, x1, y0, y1 = stats[i - 1].tolist()
        first, last = int(np.searchsorted(edges, x0, "right")) - 1, int(np.searchsorted(edges, x1, "left"))
        if total[i] >= 0.5 * usual and last - first >= 2 and (by_column[:, i] > 0.1 * total[i]).sum() >= 2:
            out.append((x0, x1, y0, y1, first, last, by_column[:, i]))
    return out


def _walk(found: list[Bar], edges: np.ndarray, bot: int, crossing: list[tuple], text: np.ndarray) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    waiting = list(range(len(found)))

    def span(column: int, y0: int, y1: int) -> int:
        """The end of the box that begins at a column: past all borders that would cut text."""
        near = [(last, c_y0, c_y1, int(n[column:last].sum())) for _, _, c_y0, c_y1, first, last, n in crossing if first <= column < last and y0 < c_y1 and y1 > c_y0]
        most = max((n for *_, n in near), default=0)
        best = column + 1
        for last, c_y0, c_y1, n in near:
            shared = (min(y1, c_y1) - max(y0, c_y0)) * (edges[last] - edges[column])
            if last > best and n > 0.1 * most and shared > 0.1 * n and (text[y0:y1, edges[column + 1]] > 0).sum() > 0.1 * (y1 - y0):
                best = last
        return best

    def fill(i: int) -> None:
        b, column = found[i], found[i].first
        while column < b.last:
            j = next((j for j, o in enumerate(found) if o.y > b.y and o.first <= column < o.last), None)
            if j is None:
                last = span(column, b.y1, bot)
                out.append((int(edges[column]), int(edges[last]), b.y, bot))
                column = last
                continue
            o = found[j]
            last = min(span(column, b.y1, o.y0), o.last, b.last)
            out.append((int(edges[column]), int(edges[last]), b.y, o.y))
            column = last
            if last == o.last <= b.last and o.first >= b.first and j in waiting:
                waiting.remove(j)
                fill(j)

    while waiting:
        fill(waiting.pop(0))
    return out


def _boxes_of(key: pa.Array, mask: np.ndarray | None, lines: np.ndarray | None, n: int, headings: list[tuple[int, int, int, int]], right_to_left: bool) -> list[pa.Array]:
    """The columns key, box_idx, x0, x1, y0, y1 of a page; no rows without a text mask."""
    boxes: list = []
    if mask is not None:
        lines = np.zeros_like(mask) if lines is None else lines
        found, splits = separators(lines, n, headings)
        boxes, _ = reading_boxes(mask, lines, found, splits, n, right_to_left=right_to_left)
    return [key.take(pa.array([0] * len(boxes), pa.int64())), pa.array(range(len(boxes)), pa.int32()), *(pa.array([x[k] for x in boxes], pa.int32()) for k in range(4))]


def page_boxes(pages: DataFrame, key: str = "page_id", text: str = "text", seps: str = "seps", columns: str = "num_col", headings: str = "headings", right_to_left: bool = False) -> DataFrame:
    """(key, box_idx, x0, x1, y0, y1) of pages(key, masks as images, expected columns, heading boxes as array<struct<x0,x1,y0,y1>>)."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one page at a time, for a batch of images is large
                t, s, n, heads = (b.column(k)[i].as_py() for k in range(1, 5))
                mask, lines = (None if v is None else raster.unpack(v)[..., 0] > 0 for v in (t, s))
                cols = _boxes_of(b.column(0).slice(i, 1), mask, lines, n or 1, [(h["x0"], h["x1"], h["y0"], h["y1"]) for h in heads or []], right_to_left)
                yield pa.RecordBatch.from_arrays(cols, names=[key, "box_idx", "x0", "x1", "y0", "y1"])

    return pages.select(key, text, seps, columns, headings).mapInArrow(run, f"{key} {kind}, box_idx int, x0 int, x1 int, y0 int, y1 int")


def page_boxes_of_runs(runs: DataFrame, key: str, h: int, w: int, columns: int, scale: int = 1) -> DataFrame:
    """As `page_boxes`, of pages without separators and headings whose text mask is given as runs (key, y, x0, x1) of h x w, blown up `scale` times; the image is only ever in the task that reads it."""

    def kernel(t: pa.Table) -> pa.Table:
        mask = raster.painted(t, h, w, scale=scale) > 0
        return pa.Table.from_arrays(_boxes_of(t.column(key).combine_chunks(), mask, None, columns, [], False), names=[key, "box_idx", "x0", "x1", "y0", "y1"])

    kind = dict(runs.dtypes)[key]
    return by_key(runs.select(key, "y", "x0", "x1"), [key], ["y", "x0"], kernel, f"{key} {kind}, box_idx int, x0 int, x1 int, y0 int, y1 int")
