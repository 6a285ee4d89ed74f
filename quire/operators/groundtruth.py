"""Training data from annotated pages: label rasters, line crops with their text, reading-order pairs, degraded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.geometry import area, bbox
from quire.operators import raster
from quire.operators.columns import grow, labelled, shrink
from quire.operators.polygons import fill
from quire.operators.regions import pair_raster

#: Kinds in the order in which they are painted, later ones over earlier ones.
PAINT = ("graphic", "image", "table", "map", "noise", "paragraph", "heading", "header", "marginalia", "drop-capital", "signature-mark", "catch-word", "page-number", "footnote", "separator")
#: (erosion, boundary) in steps of two pixels of the artificial boundary around each kind.
EDGES = {"paragraph": (2, 4), "marginalia": (2, 4), "drop-capital": (1, 3), "header": (1, 4), "heading": (1, 4), "signature-mark": (1, 4), "catch-word": (0, 3), "page-number": (0, 3), "footnote": (0, 2), "table": (0, 3), "map": (0, 3)}
_IMAGE = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])


def _largest(mask: np.ndarray) -> np.ndarray:
    label, _ = labelled(mask)
    return label == int(np.argmax(np.bincount(label.ravel())[1:])) + 1 if label.any() else mask


def with_boundary(mask: np.ndarray, erosion: int, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(the mask thinned, its largest part; the ring around it), both in steps of two pixels."""
    thin = shrink(np.pad(mask, 1), 2 * erosion, 2 * erosion)[1:-1, 1:-1] if erosion else mask
    ring = grow(thin, 2 * boundary, 2 * boundary) & ~thin
    return (_largest(thin) if thin.any() else mask), ring


def label_raster(h: int, w: int, regions: list[dict], config: dict, frame: tuple[int, int, int, int] | None = None, num_col: int | None = None) -> np.ndarray:
    """The label of each pixel of a page.

    config: `labels` of kinds (those without one are nothing, or `rest_as_paragraph`, or
    graphics `rest_as_decoration`), `artificial_class_label` of the boundaries between
    regions, `printspace_label` of what lies outside the frame, `columns_width` to which a
    page of so many columns is brought.
    """
    labels, out, ring = config["labels"], np.zeros((h, w), np.uint8), np.zeros((h, w), bool)

    def label_of(kind: str) -> int:
        if kind in labels:
            return labels[kind]
        if config.get("rest_as_decoration") and kind in ("graphic", "image"):
            return labels.get("decoration", 0)
        return labels.get("paragraph", 0) if config.get("rest_as_paragraph") and kind not in ("graphic", "image", "table", "map", "noise", "separator") else 0

    rank = {k: i for i, k in enumerate(PAINT)}
    edge = config.get("artificial_class_label")
    for r in sorted(regions, key=lambda r: rank.get(r["kind"], rank["paragraph"])):
        k = label_of(r["kind"])
        if not k or not r["poly"]:
            continue
        m = fill([[(p["x"], p["y"]) for p in r["poly"]]], (0, w, 0, h))
        if edge and r["kind"] in EDGES:
            m, around = with_boundary(m, *EDGES[r["kind"]])
            ring |= around
        if r["kind"] == "separator" and edge:
            out[ring] = edge
        out[m] = k
    if edge:
        sep = labels.get("separator")
        out[ring if sep is None else ring & (out != sep)] = edge
    if frame is not None and config.get("printspace_label"):
        outside = np.ones((h, w), bool)
        outside[frame[1] : frame[3], frame[0] : frame[2]] = False
        out[outside] = config["printspace_label"]
    width = config.get("columns_width", {}).get(str(num_col))
    return raster.resize(out, max(1, int(h * width / w)), width) if width else out


def colours(n: int) -> np.ndarray:
    """A colour for each of n labels; 0 is black."""
    hue = np.arange(max(n - 1, 0)) / max(n - 1, 1) * 6
    parts = np.stack([np.clip(np.abs((hue + k) % 6 - 3) - 1, 0, 1) for k in (0, 4, 2)], 1)
    return np.concatenate([np.zeros((1, 3)), np.rint(parts * 255)]).astype(np.uint8)[:n]


def label_rasters(pages: DataFrame, config: dict, key: str = "page_id", colour: bool = False, crop: bool = False) -> DataFrame:
    """(key, image) of pages(key, h, w, num_col, frame struct<x0,y0,x1,y1>, regions array<struct<kind, poly>>): label index or colours, whole or the frame alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for h, w, n, f, own in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                box = None if f is None else (f["x0"], f["y0"], f["x1"], f["y1"])
                a = label_raster(h, w, own or [], config if not crop else {k: v for k, v in config.items() if k != "columns_width"}, box, n)
                if crop and box is not None:
                    a = a[box[1] : box[3], box[0] : box[2]]
                    width = config.get("columns_width", {}).get(str(n))
                    a = raster.resize(a, max(1, int(a.shape[0] * width / max(1, a.shape[1]))), width) if width else a
                made.append(raster.pack(colours(max(256, a.max(initial=0) + 1))[a] if colour else a))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, _IMAGE)], names=[key, "image"])

    schema = T.StructType([pages.schema[key], T.StructField("image", raster.IMAGE)])
    return pages.select(key, "h", "w", "num_col", "frame", "regions").mapInArrow(run, schema)


def usable_regions(regions: DataFrame, size: Column, least: float = 0.0, early: float = 0.0) -> DataFrame:
    """Regions with at least three corners and a share of the page, numbered in their order (`step`), small ones flagged (`early`)."""
    t = regions.withColumn("__a", area(F.col("poly"))).where((F.size("poly") >= 3) & (F.col("__a") >= least * size))
    return t.withColumn("early", F.col("__a") < early * size).drop("__a")


def line_crops(images: DataFrame, lines: DataFrame, prefix: str = "", mask: bool = True) -> DataFrame:
    """(name, text, image) of images(page_id, stem, image) and lines(page_id, region_id, line_idx, poly, text): each line with a text, white outside its outline unless not masked; its number counts all lines of the page."""
    n = F.size(F.col("__l"))
    listed = lines.where(F.col("poly").isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "line_idx", "poly", "text"))).alias("__l"))
    both = images.select("page_id", "stem", "image").join(listed, "page_id").where(n > 0)
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()), T.StructField("image", raster.IMAGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, v, own in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
                a = raster.unpack(v)
                names, texts, cuts = [], [], []
                for i, line in enumerate(own if a is not None else []):
                    x, y = [p["x"] for p in line["poly"]], [p["y"] for p in line["poly"]]
                    box = max(0, min(x)), min(a.shape[1], max(x) + 1), max(0, min(y)), min(a.shape[0], max(y) + 1)
                    if not line["text"] or box[0] >= box[1] or box[2] >= box[3]:
                        continue
                    cut = a[box[2] : box[3], box[0] : box[1]].copy()
                    if mask:
                        cut[~fill([list(zip(x, y))], box)] = 255
                    names.append(f"{stem}_line_{i}" + (f"_{prefix}" if prefix else "") + ("_masked" if mask else ""))
                    texts.append(line["text"])
                    cuts.append(raster.pack(cut))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(cuts, _IMAGE)], names=schema.names)

    return both.select("page_id", "stem", "image", "__l").mapInArrow(run, schema)


def order_pairs(pages: DataFrame, height: int = 672, width: int = 448, least: float = 0.0, early: float | None = None, scale: int = 6, key: str = "page_id") -> DataFrame:
    """(key, i, j, cls, image) of pages(key, h, w, regions array<struct<label, ord, poly>>): every ordered pair of text regions as a raster, class 1 where the first comes before.

    With `early` only regions below that share of the page are first. A page where a text
    region has no place in the order gives none.
    """
    schema = T.StructType([pages.schema[key], *(T.StructField(c, T.IntegerType()) for c in ("i", "j", "cls")), T.StructField("image", raster.IMAGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (h, w, own) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))):
                sh, sw = max(1, h // scale), max(1, w // scale)
                outline = [[(p["x"] / scale, p["y"] / scale) for p in r["poly"]] for r in own or []]
                masks = [fill([p], (0, sw, 0, sh)) for p in outline]
                a = np.zeros((sh, sw), np.uint8)
                for k in np.argsort([r["label"] for r in own or []], kind="stable").tolist():
                    a[masks[k]] = own[k]["label"]
                main = [k for k, r in enumerate(own or []) if r["label"] in (1, 2) and masks[k].sum() >= least * a.size]
                if any(own[k]["ord"] is None for k in main):
                    main = []
                first = [k for k in main if early is None or masks[k].sum() < early * a.size]
                for i in first:
                    rest = [j for j in main if j != i]
                    made = pa.array([raster.pack(np.rint(pair_raster(a, masks[i], masks[j], height, width) * 255)) for j in rest], _IMAGE)
                    cls = [int(own[i]["ord"] < own[j]["ord"]) for j in rest]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([row] * len(rest), pa.int64())), pa.array([i] * len(rest), pa.int32()), pa.array(rest, pa.int32()), pa.array(cls, pa.int32()), made], names=schema.names)

    return pages.select(key, "h", "w", "regions").mapInArrow(run, schema)


def degraded(images: DataFrame, scales: list[float], keys: list[str]) -> DataFrame:
    """(keys, variant, image): each image brought down by each scale and up again, and as it is."""

    def kernel(a: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        yield "original", a
        for s in scales:
            yield f"{s}", raster.resize(raster.resize(a, max(1, int(a.shape[0] * s)), max(1, int(a.shape[1] * s))), *a.shape[:2])

    return raster.expand_images(images, "image", kernel, keys)


def boxes_of(lines: DataFrame) -> DataFrame:
    """Lines with x0, y0, x1, y1."""
    return lines.withColumn("__b", bbox(F.col("poly"))).select(*lines.columns, *[F.col(f"__b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
