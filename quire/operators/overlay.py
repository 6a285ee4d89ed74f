"""Pictures of what was found: labels over a page, outlines, reading order, matrices; numpy kernels for raster.map_images and sources.images.as_png."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.operators import raster
from quire.operators.columns import grow
from quire.operators.groundtruth import _IMAGE, colours
from quire.operators.polygons import fill

#: Colours of the usual labels: paragraph, heading, marginalia, image, separator, table, drop capital.
PALETTE = np.array([[255, 255, 255], [255, 0, 0], [255, 125, 0], [255, 0, 125], [0, 0, 255], [0, 255, 0], [125, 125, 0], [0, 125, 255]], np.uint8)


def painted(labels: np.ndarray, palette: np.ndarray | None = None) -> np.ndarray:
    """Labels as colours; labels beyond the palette have colours of their own."""
    own = PALETTE if palette is None else palette
    most = int(labels.max(initial=0))
    return (own if most < len(own) else colours(most + 1))[labels]


def gray(labels: np.ndarray) -> np.ndarray:
    return np.repeat(labels[..., None].astype(np.uint8), 3, 2)


def over(labels: np.ndarray, image: np.ndarray, share: float = 0.5, palette: np.ndarray | None = None) -> np.ndarray:
    """The colours of labels laid over an image; where the label is 0 it shows through."""
    a = raster.resize(image, *labels.shape)[..., :3].astype(float)
    mix = np.where((labels > 0)[..., None], share * painted(labels, palette) + (1 - share) * a, a)
    return np.clip(np.rint(mix), 0, 255).astype(np.uint8)


def outlined(image: np.ndarray, polygons: list[tuple[list, tuple[int, int, int]]], width: int = 2, filled: bool = False) -> np.ndarray:
    """Polygons (corners, colour) drawn or filled on an image."""
    out, (h, w) = image[..., :3].copy(), image.shape[:2]
    for p, colour in polygons:
        if not p:
            continue
        m = fill([p], (0, w, 0, h)) if filled else np.zeros((h, w), bool)
        if not filled:
            for a, b in zip(p, [*p[1:], p[0]]):
                m |= fill([[a, b]], (0, w, 0, h))
            m = grow(m, width // 2, width // 2)
        out[m] = colour
    return out


def arrows(image: np.ndarray, points: list[tuple[float, float]], colour: tuple[int, int, int] = (0, 0, 255), width: int = 3) -> np.ndarray:
    """From each point to the next, with a head."""
    parts = []
    for (ax, ay), (bx, by) in zip(points, points[1:]):
        length = max(1e-9, ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5)
        ux, uy, n = (bx - ax) / length, (by - ay) / length, min(20.0, length / 3)
        parts += [([(ax, ay), (bx, by)], colour), ([(bx, by), (bx - n * ux + n / 2 * uy, by - n * uy - n / 2 * ux), (bx - n * ux - n / 2 * uy, by - n * uy + n / 2 * ux)], colour)]
    return outlined(image, parts, width)


def matrix(counts: np.ndarray, cell: int = 24) -> np.ndarray:
    """A matrix of counts as gray cells, dark for high shares of a row."""
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.repeat(np.repeat(np.rint(255 * (1 - share)).astype(np.uint8), cell, 0), cell, 1)[:, :, None].repeat(3, 2)


def profile(values: np.ndarray, marks: list[int] = (), height: int = 100) -> np.ndarray:
    """A profile as a curve of columns, marked places red."""
    top = max(float(np.max(values, initial=0)), 1e-9)
    bar = np.rint(np.asarray(values) / top * (height - 1)).astype(int)
    out = np.where(np.arange(height)[::-1, None] <= bar, 0, 255).astype(np.uint8)[:, :, None].repeat(3, 2)
    out[:, list(marks)] = (255, 0, 0)
    return out


def page_overlays(pages: DataFrame, key: str = "page_id", order: bool = True) -> DataFrame:
    """(key, image) of pages(key, image, regions array<struct<label, ord, poly>>): outlines in their colours, arrows in reading order."""
    schema = T.StructType([pages.schema[key], T.StructField("image", raster.IMAGE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for v, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = raster.unpack(v)
                if a is None:
                    made.append(None)
                    continue
                a = np.repeat(a, 3, 2) if a.shape[2] == 1 else a
                parts = [([(p["x"], p["y"]) for p in r["poly"]], tuple(PALETTE[min(r["label"], len(PALETTE) - 1)].tolist())) for r in own or []]
                a = outlined(a, parts)
                if order:
                    placed = sorted((r for r in own or [] if r["ord"] is not None and r["poly"]), key=lambda r: r["ord"])
                    a = arrows(a, [tuple(np.mean([(p["x"], p["y"]) for p in r["poly"]], 0)) for r in placed])
                made.append(raster.pack(a))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, _IMAGE)], names=schema.names)

    return pages.select(key, "image", "regions").mapInArrow(run, schema)


def text_size(width: int, height: int, characters: int, sizes: range = range(50, 8, -2), ratio: float = 0.55) -> int:
    """The largest font size at which so many characters fit a box, taking each as wide as a share of the size; the smallest if none does."""
    return next((s for s in sizes if s <= height and s * ratio * characters <= width + 1e-9), sizes[-1])
