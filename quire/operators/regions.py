"""Regions of label rasters and their reading order; one page at a time, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators import columns, raster
from quire.operators.ordering import pairwise_order
from quire.operators.polygons import _KIND, POLY, fill, skew

_BOX = ("x0", "y0", "x1", "y1")
REGION = f"region_idx int, label int, x0 int, y0 int, x1 int, y1 int, area int, conf double, poly {POLY}"


def of_raster(labels: np.ndarray, conf: np.ndarray | None = None, least: float = 0.0002, most: float = 1.0, owner: np.ndarray | None = None) -> list[dict]:
    """The components of each label but 0 that cover a share of the page, by label, top and left: box, pixels, mean confidence, outline. `owner` gets the number (from 1) of the region at each pixel."""
    out: list[dict] = []
    at: list[tuple] = []
    for k in np.unique(labels[labels > 0]).tolist():
        comp, boxes = columns.labelled(labels == k)
        area = np.bincount(comp.ravel(), minlength=len(boxes) + 1)[1:]
        mean = np.bincount(comp.ravel(), conf.ravel(), len(boxes) + 1)[1:] / np.maximum(area, 1) / 255 if conf is not None else [None] * len(boxes)
        for i in np.flatnonzero((area >= least * labels.size) & (area <= most * labels.size)).tolist():
            x0, x1, y0, y1 = boxes[i].tolist()
            outline = [{"x": x + x0, "y": y + y0} for x, y in raster.trace(comp[y0:y1, x0:x1] == i + 1)]
            out.append({"label": k, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "area": int(area[i]), "conf": mean[i], "poly": outline})
            at.append((comp, i + 1))
    order = sorted(range(len(out)), key=lambda i: (out[i]["label"], out[i]["y0"], out[i]["x0"]))
    if owner is not None:
        for n, i in enumerate(order, 1):
            r, (comp, k) = out[i], at[i]
            part = (slice(r["y0"], r["y1"]), slice(r["x0"], r["x1"]))
            owner[part][comp[part] == k] = n
    return [out[i] for i in order]


def found(seg: DataFrame, keys: list[str], least: float = 0.0002, label: str = "label", conf: str | None = "conf") -> DataFrame:
    """(keys, region_idx from 1, label, x0, y0, x1, y1, area, conf, poly) of label rasters; a null raster has no regions."""
    schema = T.StructType([*(seg.schema[k] for k in keys), *T._parse_datatype_string(REGION)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            confs = [None] * b.num_rows if conf is None else b.column(len(keys) + 1).to_pylist()
            for i, (v, c) in enumerate(zip(b.column(len(keys)).to_pylist(), confs)):
                rows = [] if v is None else of_raster(raster.unpack(v)[..., 0], None if c is None else raster.unpack(c)[..., 0], least)
                ints = [pa.array([r[n] for r in rows], pa.int32()) for n in ("label", *_BOX, "area")]
                cols = [pa.array(range(1, len(rows) + 1), pa.int32()), *ints, pa.array([r["conf"] for r in rows], pa.float64()), pa.array([r["poly"] for r in rows], _KIND)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array([i] * len(rows), pa.int64())) for k in range(len(keys))), *cols], names=schema.names)

    return seg.select(*keys, label, *([conf] if conf else [])).mapInArrow(run, schema)


def largest_frame(mask: np.ndarray) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(x0, x1, y0, y1, outline) of the largest component, the first of equal ones; the whole page without one."""
    h, w = mask.shape
    comp, boxes = columns.labelled(mask > 0)
    if not len(boxes):
        return 0, w, 0, h, [(0, 0), (w, 0), (w, h), (0, h)]
    k = int(np.argmax(np.bincount(comp.ravel())[1:])) + 1
    x0, x1, y0, y1 = boxes[k - 1].tolist()
    return x0, x1, y0, y1, [(x + x0, y + y0) for x, y in raster.trace(comp[y0:y1, x0:x1] == k)]


def frames(seg: DataFrame, key: str = "page_id", label: str = "label", spread: int = 0) -> DataFrame:
    """(key, x0, y0, x1, y1, border) of page masks, grown first by some pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if v is None else largest_frame(columns.grow(raster.unpack(v)[..., 0] > 0, spread, spread)) for v in b.column(1).to_pylist()]
            ints = [pa.array([None if g is None else g[k] for g in got], pa.int32()) for k in (0, 2, 1, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ints, pa.array([None if g is None else [{"x": x, "y": y} for x, y in g[4]] for g in got], _KIND)], names=[key, *_BOX, "border"])

    return seg.select(key, label).mapInArrow(run, f"{key} {dict(seg.dtypes)[key]}, x0 int, y0 int, x1 int, y1 int, border {POLY}")


def bands(mask: np.ndarray, pad: int = 20, sigma: float = 8.0) -> np.ndarray:
    """y of the valleys of a mask's row sums."""
    if not mask.any():
        return np.zeros(0, np.int64)
    z = raster.smooth(np.pad(mask.sum(1), pad), sigma)
    return columns.peaks(z.max() - z) - pad


def order_in_boxes(regions: list[tuple[int, int, int, int]], boxes: list[tuple[int, int, int, int]], text: np.ndarray) -> list[int]:
    """Regions (x0, y0, x1, y1) by box, by band of the box's rows from the top, then from the left.

    A region goes to the first box that holds it, else to that of those holding its centre
    whose centre is nearest, else to the one whose centre is nearest.
    """
    if not regions:
        return []
    r = np.asarray(regions, float)
    b = np.asarray(boxes or [(0, text.shape[1], 0, text.shape[0])], float)
    cx, cy = np.floor((r[:, 0] + r[:, 2]) / 2), np.floor((r[:, 1] + r[:, 3]) / 2)
    whole = (b[:, 0] <= r[:, None, 0]) & (r[:, None, 2] <= b[:, 1]) & (b[:, 2] <= r[:, None, 1]) & (r[:, None, 3] <= b[:, 3])
    middle = (b[:, 0] <= cx[:, None]) & (cx[:, None] < b[:, 1]) & (b[:, 2] <= cy[:, None]) & (cy[:, None] < b[:, 3])
    far = ((b[:, 0] + b[:, 1]) / 2 - cx[:, None]) ** 2 + ((b[:, 2] + b[:, 3]) / 2 - cy[:, None]) ** 2
    inside = np.where(middle.any(1), np.argmin(np.where(middle, far, np.inf), 1), np.argmin(far, 1))
    home = np.where(whole.any(1), np.argmax(whole, 1), inside)
    out: list[int] = []
    for k in np.unique(home).tolist():
        x0, x1, y0, y1 = b[k].astype(int).tolist()
        edges = bands(text[y0:y1, x0:x1] > 0) + y0
        own = np.flatnonzero(home == k)
        band = np.searchsorted(edges, cy[own], "right")
        out += own[np.lexsort((own, cy[own], cx[own], band))].tolist()
    return out


def pair_raster(layout: np.ndarray, mask_i: np.ndarray, mask_j: np.ndarray, h: int, w: int) -> np.ndarray:
    """[h, w, 3]: the first region, the layout, the second; separators and headings stand in both outer channels. A model says how likely the first comes before the second."""
    marks = np.where(layout == 5, 2.0, np.where(layout == 2, 3.0, 0.0))
    outer = [np.where(m, 1.0, marks) / 3 for m in (mask_i, mask_j)]
    return np.stack([raster.resize(x, h, w) for x in (outer[0], layout / 5.0, outer[1])], -1).astype(np.float32)


def order_by_model(layout: np.ndarray, regions: list[list[tuple[int, int]]], model: Callable[[np.ndarray], np.ndarray], size: tuple[int, int] = (672, 448), scale: int = 6, batch: int = 3) -> list[int]:
    """Regions (outlines) in the order of a pairwise model: one that the pivot comes before with p of 0.5 or more goes after it, as in a quicksort with the first as pivot."""
    small = raster.resize(layout, max(1, layout.shape[0] // scale), max(1, layout.shape[1] // scale))
    masks = [fill([[(x / scale, y / scale) for x, y in p]], (0, small.shape[1], 0, small.shape[0])) for p in regions]
    scored: dict[tuple[int, int], float] = {}

    def before(pivot: int, i: int) -> float:
        if (pivot, i) not in scored:  # all of a pivot at once
            todo = [k for k in range(len(regions)) if k != pivot]
            for a in range(0, len(todo), batch):
                own = todo[a : a + batch]
                got = np.asarray(model(np.stack([pair_raster(small, masks[pivot], masks[k], *size) for k in own]))).reshape(len(own), -1)[:, 0]
                scored.update({(pivot, k): float(p) for k, p in zip(own, got)})
        return scored[pivot, i]

    return pairwise_order(len(regions), before)


def reading_order(pages: DataFrame, model: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None, key: str = "page_id", right_to_left: bool = False, sizes: tuple[int, int] = (672, 448)) -> DataFrame:
    """(key, region_idx, ord from 0) of pages(key, label raster, num_col, regions as array<struct<region_idx, kind, x0, y0, x1, y1, poly>>).

    Labels as everywhere: text 1, headings 2, separators 5. Without a model the page is cut
    into boxes by columns, separators and headings; with one its pairwise scores decide.
    """
    schema = f"{key} {dict(pages.dtypes)[key]}, region_idx int, ord int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = None if model is None else model()
        for b in batches:
            for i, (v, n, own) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                own = sorted(own or [], key=lambda r: r["region_idx"])
                order: list[int] = []
                if v is not None and own:
                    a = raster.unpack(v)[..., 0]
                    if scores is not None:
                        order = order_by_model(a, [[(q["x"], q["y"]) for q in r["poly"]] for r in own], scores, sizes)
                    else:
                        text, lines = (a == 1) | (a == 2), a == 5
                        heads = [(r["x0"], r["x1"], r["y0"], r["y1"]) for r in own if r["kind"] == "heading"]
                        seps, splits = columns.separators(lines, n or 1, heads)
                        boxes, _ = columns.reading_boxes(text, lines, seps, splits, n or 1, right_to_left=right_to_left)
                        order = order_in_boxes([tuple(r[c] for c in _BOX) for r in own], boxes, text)
                rows = b.column(0).take(pa.array([i] * len(order), pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([own[k]["region_idx"] for k in order], pa.int32()), pa.array(range(len(order)), pa.int32())], names=[key, "region_idx", "ord"])

    return pages.select(key, "label", "num_col", "regions").mapInArrow(run, schema)


def early_layout(regions: np.ndarray, tables: np.ndarray | None = None, lines: np.ndarray | None = None, conf: np.ndarray | None = None, table_conf: np.ndarray | None = None, least: float = 1e-5) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(labels, lines, confidence): separators, images, text (a pixel fatter) and tables painted one after another, specks left out; lines only in text, tables with their own confidence."""

    def big(m: np.ndarray) -> np.ndarray:
        comp, boxes = columns.labelled(m)
        keep = np.append(False, np.bincount(comp.ravel(), minlength=len(boxes) + 1)[1:] >= least * m.size)
        return keep[comp]

    text = regions == 1
    fat = text.copy()
    fat[1:] |= text[:-1]
    fat[:, 1:] |= fat[:, :-1].copy()
    out = np.zeros(regions.shape, np.uint8)
    out[big(regions == 5)] = 5
    out[regions == 4] = 4
    out[big(fat)] = 1
    for k in (2, 3, 7):
        out[regions == k] = k
    if tables is not None:
        m = big(tables > 0)
        out[m] = 6
        conf = np.where(m, table_conf, conf) if conf is not None and table_conf is not None else conf
    return out, None if lines is None else lines & np.isin(out, TEXT), conf


def full_layout(early: np.ndarray, full: np.ndarray, keep_separators: bool = False) -> np.ndarray:
    """Early labels with the separators and drop capitals of a fuller model: drop capitals that fill 60 % of their box, three tenths of it text before, become the box, others what is not text; headings stay with the region that has them."""
    out = early.copy()
    if not keep_separators:
        out[full == 5] = 5
    comp, boxes = columns.labelled(columns.shrink(full == 7, 2, 2))
    for i, (x0, x1, y0, y1) in enumerate(boxes.tolist(), 1):
        part = np.s_[y0:y1, x0:x1]
        n, size = int((comp[part] == i).sum()), (x1 - x0) * (y1 - y0)
        if n <= 1e-5 * early.size:
            continue
        if n > 0.6 * size and (early[part] == 1).sum() >= 0.3 * size:
            out[part] = 7
        else:
            out[part][np.isin(full[part], (0, 4, 7))] = 7
    text = (out == 1) & (full == 2)
    out[text] = 2
    return out


def relabel_headings(labels: np.ndarray, regions: list[dict], full: np.ndarray) -> list[str]:
    """The kind of each text region by its share of heading pixels in a fuller model and its shape: mostly heading and somewhat wide, or partly heading and very wide."""
    out = []
    for r in regions:
        part = np.s_[r["y0"] : r["y1"], r["x0"] : r["x1"]]
        head, main = int((full[part] == 2).sum()), int((full[part] == 1).sum()) + int((full[part] == 2).sum())
        w, h = r["x1"] - r["x0"], r["y1"] - r["y0"]
        is_head = (head >= 0.6 * main and 1.3 * h <= w <= 3 * h or head >= 0.3 * main and w >= 3 * h) and head > 0
        out.append("heading" if is_head else "paragraph")
    return out


KINDS = {1: "paragraph", 2: "heading", 3: "marginalia", 4: "image", 5: "separator", 6: "table", 7: "drop-capital"}
TEXT = (1, 2, 3, 7)
LAYOUT = (
    f"h int, w int, num_col int, slope double, border {POLY}, regions array<struct<region_idx:int,kind:string,ord:int,conf:double,slope:double,x0:int,y0:int,x1:int,y1:int,area:int,poly:{POLY},"
    f"lines:array<struct<line_idx:int,x0:int,y0:int,x1:int,y1:int,poly:{POLY}>>>>"
)


def analyse(labels: np.ndarray, conf: np.ndarray | None, line_mask: np.ndarray, page_mask: np.ndarray | None = None, expected: int | None = None, model: Callable[[np.ndarray], np.ndarray] | None = None, least: float = 0.0002, right_to_left: bool = False, angles: np.ndarray | None = None, tables: np.ndarray | None = None, table_conf: np.ndarray | None = None, full: np.ndarray | None = None) -> dict:
    """A page's frame, columns, slope, and regions with their lines and order, from the rasters of its models.

    What lies outside the frame is nothing. A line belongs to the text region at its centre;
    text regions without a line go. Marginal regions are left or right of the middle of the
    text; a region stands at the slope of its lines, else at the page's. Tables of a model
    of their own are painted over; a fuller model gives drop capitals and headings.
    """
    h, w = labels.shape
    if tables is not None or full is not None:
        labels, line_mask, conf = early_layout(labels, tables, line_mask, conf, table_conf)
        labels = labels if full is None else full_layout(labels, full)
    border = None
    if page_mask is not None:
        *_, outline = largest_frame(page_mask)
        border = [{"x": x, "y": y} for x, y in outline]
        inside = fill([outline], (0, w, 0, h))
        labels, line_mask = np.where(inside, labels, 0), line_mask & inside
    text = (labels == 1) | (labels == 2)
    slope = raster.skew_angle(columns.shrink(line_mask, 2, 2).astype(np.uint8) * 255, angles) if line_mask.any() else 0.0
    slope = 0.0 if abs(slope) > 45 and text.sum() <= 0.3 * text.size else slope
    owner = np.zeros((h, w), np.int32)
    rows = of_raster(labels, conf, least, owner=owner)
    comp, boxes = columns.labelled(line_mask)
    for r in rows:
        r["lines"] = []
    for i, (x0, x1, y0, y1) in enumerate(boxes.tolist(), 1):
        k = owner[(y0 + y1 - 1) // 2, (x0 + x1 - 1) // 2]
        if k and rows[k - 1]["label"] in TEXT:
            outline = [{"x": x + x0, "y": y + y0} for x, y in raster.trace(comp[y0:y1, x0:x1] == i)]
            rows[k - 1]["lines"].append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "poly": outline})
    rows = [r for r in rows if r["lines"] or r["label"] not in TEXT]
    ink = np.flatnonzero(text.any(0))
    middle = (ink[0] + ink[-1]) / 2 if len(ink) else w / 2
    for n, r in enumerate(rows, 1):
        r["region_idx"], r["kind"] = n, KINDS.get(r["label"], "paragraph")
        if r["kind"] == "marginalia":
            r["kind"] += "-left" if (r["x0"] + r["x1"]) / 2 < middle else "-right"
        tall = sum(q["y1"] - q["y0"] > q["x1"] - q["x0"] for q in r["lines"]) * 2 > len(r["lines"])
        r["lines"].sort(key=lambda q: (q["x0"], q["y0"]) if tall else (q["y0"] + q["y1"], q["x0"]))
        for i, q in enumerate(r["lines"]):
            q["line_idx"] = i
        own = skew([[(q["x"], q["y"]) for q in line["poly"]] for line in r["lines"]])
        r["slope"], r["ord"] = slope if own is None else own, None
    if full is not None:
        some = [r for r in rows if r["kind"] == "paragraph"]
        for r, kind in zip(some, relabel_headings(labels, some, full)):
            r["kind"] = kind
    main = [r for r in rows if r["kind"] in ("paragraph", "heading", "drop-capital")]
    num_col = columns.column_count(text, expected or 1)
    if model is not None:
        order = order_by_model(labels, [[(q["x"], q["y"]) for q in r["poly"]] for r in main], model)
    else:
        lines = labels == 5
        seps, splits = columns.separators(lines, max(num_col, expected or 1), [(r["x0"], r["x1"], r["y0"], r["y1"]) for r in main if r["kind"] == "heading"])
        found_, _ = columns.reading_boxes(text, lines, seps, splits, max(num_col, expected or 1), right_to_left=right_to_left)
        order = order_in_boxes([tuple(r[c] for c in _BOX) for r in main], found_, text)
    for place, k in enumerate(order):
        main[k]["ord"] = place
    return {"h": h, "w": w, "num_col": num_col, "slope": slope, "border": border, "regions": rows}


def layout(rasters: DataFrame, keys: list[str], model: Callable[[], Callable] | None = None, least: float = 0.0002, right_to_left: bool = False, angles: np.ndarray | None = None) -> DataFrame:
    """(keys, h, w, num_col, slope, border, regions) of pages(keys, label, conf, line, page, expected, table, table_conf, full): rasters of regions, their scores and lines, and (or null) of the page's frame, the expected columns, rasters of tables with their scores and of a fuller model."""
    schema = T.StructType([*(rasters.schema[k] for k in keys), *T._parse_datatype_string(LAYOUT)])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, n = None if model is None else model(), len(keys)
        for b in batches:
            got = []
            for v, c, t, p, e, *more in zip(*(b.column(n + k).to_pylist() for k in range(8))):
                one = lambda x: None if x is None else raster.unpack(x)[..., 0]
                a = one(v)
                got.append(None if a is None else analyse(a, one(c), one(t) == 1 if t is not None else a > 0, None if p is None else one(p) > 0, e, scores, least, right_to_left, angles, *map(one, more)))
            cols = [pa.array([None if g is None else g[f.name] for g in got], f.type) for f in list(kinds)[n:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], names=schema.names)

    return rasters.select(*keys, "label", "conf", "line", "page", "expected", "table", "table_conf", "full").mapInArrow(run, schema)


def page_features(seg: DataFrame, expected: str | None = None, key: str = "page_id", angles: np.ndarray | None = None) -> DataFrame:
    """(key, num_col, slope) of label rasters: columns of text, and the angle at which its rows stand out most; 0 without text, or where text stands upright on a nearly empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, slopes = [], []
            for v, n in zip(b.column(1).to_pylist(), [1] * b.num_rows if expected is None else b.column(2).to_pylist()):
                if v is None:
                    counts.append(None)
                    slopes.append(None)
                    continue
                a = raster.unpack(v)[..., 0]
                text = (a == 1) | (a == 2)
                slope = raster.skew_angle(columns.shrink(text, 2, 2).astype(np.uint8) * 255, angles) if text.any() else 0.0
                slopes.append(0.0 if abs(slope) > 45 and text.sum() <= 0.3 * text.size else slope)
                counts.append(columns.column_count(text, n or 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int32()), pa.array(slopes, pa.float64())], names=[key, "num_col", "slope"])

    return seg.select(key, "label", *([expected] if expected else [])).mapInArrow(run, f"{key} {dict(seg.dtypes)[key]}, num_col int, slope double")
