"""Training variants of images: one row in, one row for each enabled variant out. Every random draw is seeded by the row."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import raster


def salt_and_pepper(a: np.ndarray, salt: float, pepper: float, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), a.copy()
    for share, value in ((salt, 255), (pepper, 0)):
        n = int(share * a.shape[0] * a.shape[1])
        out[rng.integers(0, a.shape[0], n), rng.integers(0, a.shape[1], n)] = value
    return out


def white_strips(a: np.ndarray, seed: int) -> np.ndarray:
    rng, out = np.random.default_rng(seed), a.astype(float)
    for _ in range(max(1, rng.binomial(9, 0.3))):
        w = int(rng.integers(10, 51))
        x = int(rng.integers(0, max(1, a.shape[1] - w)))
        out[:, x : x + w] += rng.normal(0, 50, out[:, x : x + w].shape)
    return np.clip(out, 0, 255).astype(np.uint8)


def wave(a: np.ndarray, amplitude: float, period: float = 300.0) -> np.ndarray:
    shift = np.rint(amplitude * np.sin(2 * np.pi * np.arange(a.shape[1]) / period)).astype(int)
    y = np.arange(a.shape[0])[:, None] - shift
    out = a[np.clip(y, 0, a.shape[0] - 1), np.arange(a.shape[1])]
    out[(y < 0) | (y >= a.shape[0])] = 255
    return out


def shift(a: np.ndarray, dy: int, dx: int, fill: int) -> np.ndarray:
    out = np.full_like(a, fill)
    h, w = a.shape[:2]
    out[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = a[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
    return out


def on_background(binary: np.ndarray, background: np.ndarray, ink: tuple[int, int, int] | None = None) -> np.ndarray:
    """Ink (0) of a black and white image on another image, in its own or a given colour."""
    back = raster.resize(background, *binary.shape[:2])
    dark = binary[..., :1] == 0
    return np.where(dark, binary if ink is None else np.array(ink, np.uint8), back).astype(np.uint8)


def red_ink(a: np.ndarray, binary: np.ndarray) -> np.ndarray:
    return np.where(binary[..., :1] == 0, np.array([0, 0, 255], np.uint8), a).astype(np.uint8)


def red_ink_on_background(binary: np.ndarray, background: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """A colour image where there is ink, a background where there is none."""
    return np.where(binary != 0, raster.resize(background, *binary.shape[:2]), colour).astype(np.uint8)


def crop_turned(a: np.ndarray, degrees: float, size: tuple[int, int] | None = None) -> np.ndarray:
    """The largest upright rectangle without border of an image that was turned by some degrees; size: height and width before the turn."""
    h, w = size or a.shape[:2]
    s, c = abs(np.sin(np.deg2rad(degrees))), abs(np.cos(np.deg2rad(degrees)))
    long, short = max(h, w), min(h, w)
    if short <= 2 * s * c * long or abs(s - c) < 1e-10:
        wr, hr = (short / 2 / s, short / 2 / c) if w >= h else (short / 2 / c, short / 2 / s)
    else:
        wr, hr = (w * c - h * s) / (c * c - s * s), (h * c - w * s) / (c * c - s * s)
    y, x = a.shape[0] // 2 - int(hr / 2), a.shape[1] // 2 - int(wr / 2)
    return a[max(0, y) : y + int(hr), max(0, x) : x + int(wr)]


def turned(a: np.ndarray, degrees: float, label: bool = False) -> np.ndarray:
    """Turned on its own canvas and cropped to what has no border; labels take the nearest pixel."""
    if not label:
        return crop_turned(raster.turn(a, degrees), degrees)
    t, (h, w) = np.deg2rad(degrees), a.shape[:2]
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    sy, sx = np.rint(np.sin(t) * x + np.cos(t) * y + (h - 1) / 2).astype(int), np.rint(np.cos(t) * x - np.sin(t) * y + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.zeros_like(a)
    out[inside] = a[sy[inside], sx[inside]]
    return crop_turned(out, degrees)


def elastic(a: np.ndarray, alpha: float, sigma: float, seed: int) -> np.ndarray:
    """Pixels moved by smoothed noise of a strength, bilinear, mirrored at the border."""
    rng, (h, w) = np.random.default_rng(seed), a.shape[:2]

    def field() -> np.ndarray:
        noise = rng.random((h, w)) * 2 - 1
        r = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        for axis in (0, 1):
            noise = np.apply_along_axis(lambda v: np.convolve(np.pad(v, r), k / k.sum(), "valid"), axis, noise)
        return noise * alpha

    dx, dy = field(), field()
    fold = lambda v, n: np.abs((v + n) % (2 * n) - n) if n > 0 else v * 0
    y, x = fold(np.arange(h)[:, None] + dy, h - 1), fold(np.arange(w) + dx, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def pair_variants(a: np.ndarray, label: np.ndarray, config: dict) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The variants that move pixels, of an image and its labels alike; those that change colours leave the labels."""
    yield "original", a, label
    for name in config.get("flip", []):
        f = {"h": np.s_[:, ::-1], "v": np.s_[::-1], "hv": np.s_[::-1, ::-1]}[name]
        yield f"flip_{name}", a[f], label[f]
    if config.get("rotate_90"):
        yield "rotate_90", a.transpose(1, 0, 2), label.transpose(1, 0, 2)
    for t in config.get("rotate", []):
        yield f"rotate_{t}", turned(a, t), turned(label, t, True)
    for d in config.get("shift", []):
        dy, dx = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "up_left": (-1, -1), "down_right": (1, 1)}[d]
        by = int(dy * 0.03 * a.shape[0]), int(dx * 0.03 * a.shape[1])
        yield f"shift_{d}", shift(a, *by, 255), shift(label, *by, 0)
    for s in config.get("scale", []):
        small = np.zeros_like(label)
        part = raster.resize(label, max(1, int(label.shape[0] * s)), max(1, int(label.shape[1] * s)))[: label.shape[0], : label.shape[1]]
        y, x = (label.shape[0] - part.shape[0]) // 2, (label.shape[1] - part.shape[1]) // 2
        small[y : y + part.shape[0], x : x + part.shape[1]] = part
        yield f"scale_{s}", scaled_on_canvas(a, s), small
    colours = {k: v for k, v in config.items() if k in ("degrade", "brighten", "blur", "channels", "invert", "noise", "binary")}
    for name, x in variants(a, colours, zlib.crc32(a.tobytes())):
        if name != "original":
            yield name, x, label


def augment_pairs(df: DataFrame, image: str, label: str, config: dict, keys: list[str], tile: tuple[int, int] | None = None) -> DataFrame:
    """(keys, variant, image, label): every variant of an image with its labels, cut into tiles if wished (the last ones moved back, small ones padded)."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("variant", T.StringType()), T.StructField("image", raster.IMAGE), T.StructField("label", raster.IMAGE)])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (u, v) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist())):
                got = [] if u is None or v is None else list(pair_variants(raster.unpack(u), raster.unpack(v), config))
                if tile is not None:
                    cut = []
                    for name, x, y in got:
                        y = raster.pad(y, 0, max(0, tile[0] - y.shape[0]), 0, max(0, tile[1] - y.shape[1]), 0)
                        x = raster.pad(x, 0, max(0, tile[0] - x.shape[0]), 0, max(0, tile[1] - x.shape[1]), 255)
                        cut += [(f"{name}_{p}", s, t) for (p, s), (_, t) in zip(raster.tiles(x, *tile), raster.tiles(y, *tile))]
                    got = cut
                row = pa.array([i] * len(got), pa.int64())
                images = [pa.array([raster.pack(g[k]) for g in got], kind) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(len(keys))), pa.array([g[0] for g in got], pa.string()), *images], names=schema.names)

    return df.select(*keys, image, label).mapInArrow(run, schema)


def scaled_on_canvas(a: np.ndarray, factor: float) -> np.ndarray:
    """Scaled down inside a canvas of the mean colour."""
    h, w = a.shape[:2]
    small = raster.resize(a, max(1, int(h * factor)), max(1, int(w * factor)))
    out = np.broadcast_to(a.reshape(-1, a.shape[2]).mean(0).astype(np.uint8), a.shape).copy()
    y, x = (h - min(h, small.shape[0])) // 2, (w - min(w, small.shape[1])) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small[:h, :w]
    return out


def blur(a: np.ndarray, kind: str) -> np.ndarray:
    """'blur', 'gauss' or 'median' over 5 x 5."""
    r = 2
    b = np.pad(a, ((r, r), (r, r), (0, 0)), "edge")
    views = np.lib.stride_tricks.sliding_window_view(b, (5, 5), (0, 1)).astype(float)
    if kind == "median":
        return np.median(views, (3, 4)).astype(np.uint8)
    if kind == "gauss":
        k = np.array([1, 4, 6, 4, 1]) / 16
        return np.rint(np.einsum("yxcij,i,j->yxc", views, k, k)).astype(np.uint8)
    if kind == "blur":
        return np.rint(views.mean((3, 4))).astype(np.uint8)
    raise ValueError(f"no blur is called {kind!r}")


def in_depth(a: np.ndarray, direction: str, share: float = 0.1) -> np.ndarray:
    """Perspective: the named side is made smaller, linearly."""
    if direction not in ("left", "right", "up", "down"):
        raise ValueError(f"no direction is called {direction!r}")
    t = a if direction in ("left", "right") else a.transpose(1, 0, 2)
    h, w = t.shape[:2]
    s = np.linspace(1 - 2 * share, 1, w)
    s = s if direction in ("left", "up") else s[::-1]
    y = np.rint((np.arange(h)[:, None] - (h - 1) / 2) / s + (h - 1) / 2).astype(int)
    out = t[np.clip(y, 0, h - 1), np.arange(w)]
    out[(y < 0) | (y >= h)] = 255
    return out if direction in ("left", "right") else out.transpose(1, 0, 2)


def variants(a: np.ndarray, config: dict, seed: int) -> Iterator[tuple[str, np.ndarray]]:
    """The original, then each enabled family in a fixed order."""
    yield "original", a
    for name in config.get("flip", []):
        yield f"flip_{name}", {"h": a[:, ::-1], "v": a[::-1], "hv": a[::-1, ::-1]}[name]
    if config.get("rotate_90"):
        yield "rotate_90", a.transpose(1, 0, 2)
    for t in config.get("rotate", []):
        yield f"rotate_{t}", raster.turn(a, t, 255)
    for s in config.get("scale", []):
        yield f"scale_{s}", scaled_on_canvas(a, s)
    for s in config.get("degrade", []):
        h, w = a.shape[:2]
        yield f"degrade_{s}", raster.resize(raster.resize(a, max(1, int(h * s)), max(1, int(w * s))), h, w)
    for f in config.get("brighten", []):
        yield f"brighten_{f}", np.clip(a.astype(float) * f, 0, 255).astype(np.uint8)
    for k in config.get("blur", []):
        yield f"blur_{k}", blur(a, k)
    for alpha, sigma in config.get("elastic", []):
        yield f"elastic_{alpha}_{sigma}", elastic(a, alpha, sigma, seed)
    for p in config.get("padding", []):
        n = int(a.shape[0] * p / 2)
        yield f"padding_{p}", raster.pad(a, n, n, n, n, config.get("padding_fill", 255))
    for d in config.get("shift", []):
        dy, dx = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "up_left": (-1, -1), "down_right": (1, 1)}[d]
        yield f"shift_{d}", shift(a, int(dy * 0.03 * a.shape[0]), int(dx * 0.03 * a.shape[1]), 255)
    for o in config.get("channels", []):
        yield "channels_" + "".join(map(str, o)), a[..., list(o)]
    for d in config.get("depth", []):
        yield f"depth_{d}", in_depth(a, d)
    for m in config.get("wave", []):
        yield f"wave_{m}", wave(a, m)
    if config.get("invert"):
        yield "invert", 255 - a
    if config.get("noise"):
        yield "noise", salt_and_pepper(a, *config["noise"], seed)
    if config.get("strips"):
        yield "strips", white_strips(a, seed)
    if config.get("binary"):
        yield "binary", raster.otsu_mask(a)


def augment(df: DataFrame, column: str, config: dict, keys: list[str]) -> DataFrame:
    """(keys, variant, image); the seed of a row's noise is its pixels' checksum, so a retried task makes the same rows."""
    return raster.expand_images(df, column, lambda a: variants(a, config, zlib.crc32(a.tobytes())), keys)


def grid(df: DataFrame, params: dict[str, list], keys: list[Column]) -> DataFrame:
    """Each row with every combination of parameters (a generator, no join)."""
    out = df.select(*keys)
    for name, values in params.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out
