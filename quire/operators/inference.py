"""Models as plug-ins: a registry, batched prediction, tiled segmentation, line recognition."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import raster

Model = Callable[[np.ndarray], np.ndarray]  # [n, h, w, c] in 0..1 -> [n, h, w, classes] or [n, classes] or [n, steps, symbols]


_made: dict[str, Model] = {}


def _once(name: str, make: Callable[[], Model]) -> Model:
    if name not in _made:
        _made[name] = make()
    return _made[name]


@dataclass(frozen=True)
class Spec:
    category: str
    variant: str = ""
    filename: str = ""
    dist_url: str = ""
    type: str = "function"
    help: str = ""


@dataclass
class Registry:
    """Specifications by (category, variant), the last of equal ones; loaders make a model on an executor, once a process."""

    base: str = "."
    specs: dict[tuple[str, str], Spec] = field(default_factory=dict)
    loaders: dict[tuple[str, str], Callable[[str], Model]] = field(default_factory=dict)

    def add(self, spec: Spec, loader: Callable[[str], Model]) -> None:
        self.specs[spec.category, spec.variant] = spec
        self.loaders[spec.category, spec.variant] = loader

    def override(self, category: str, variant: str, path: str) -> None:
        s = self.get(category, variant)
        self.specs[category, variant] = Spec(s.category, s.variant, path, s.dist_url, s.type, s.help)

    def get(self, category: str, variant: str = "") -> Spec:
        if not any(c == category for c, _ in self.specs):
            raise ValueError(f"no model category {category!r}")
        if (category, variant) not in self.specs:
            raise ValueError(f"model category {category!r} has no variant {variant!r}")
        return self.specs[category, variant]

    def path(self, category: str, variant: str = "") -> str:
        name = self.get(category, variant).filename
        return name if name.startswith("/") else f"{self.base}/{name}"

    def loader(self, category: str, variant: str = "") -> Callable[[], Model]:
        """What gives the model in a task: made once in each Python process, whatever the number of tasks."""
        self.get(category, variant)
        make, path, name = self.loaders[category, variant], self.path(category, variant), uuid.uuid4().hex
        return lambda: _once(name, lambda: make(path))

    def asdict(self) -> dict[str, str]:
        """The file of each category; of several variants that of the last."""
        return {c: s.filename for (c, _), s in sorted(self.specs.items())}

    def table(self, spark) -> DataFrame:
        """The registry as rows, by category and variant."""
        rows = [(s.category, s.variant, s.filename, s.dist_url, s.type, s.help) for _, s in sorted(self.specs.items(), key=lambda x: x[0][0] + "0" + x[0][1])]
        return spark.createDataFrame(rows, "category string, variant string, filename string, dist_url string, type string, help string")


def segment(df: DataFrame, column: str, load: Callable[[], Model], keys: list[str | Column], tile: tuple[int, int] | None = None, margin: float = 0.1, batch: int = 4) -> DataFrame:
    """(keys, label, conf): label raster by the best class and its score in 1/255, at the image's size.

    Without a tile the image goes in whole; with one, tiles overlap by the margin and
    their scores are blended by sigmoid weights.
    """
    kept = df.select(*keys)
    df, keys = df.select(*keys, F.col(column).alias("__image")), kept.columns
    column = "__image"
    schema = T.StructType([kept.schema[k] for k in keys] + [T.StructField("label", raster.IMAGE), T.StructField("conf", raster.IMAGE)])
    kind = pa.struct([("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("data", pa.binary())])

    def scores(model: Model, a: np.ndarray) -> np.ndarray:
        x = a.astype(np.float32) / 255
        if tile is None:
            return model(x[None])[0]
        m = int(margin * tile[0])
        big = raster.center_pad(a, *tile) if a.shape[0] < tile[0] or a.shape[1] < tile[1] else a
        x = big.astype(np.float32) / 255
        at = [(y, c) for y in raster.tile_starts(x.shape[0], tile[0], m) for c in raster.tile_starts(x.shape[1], tile[1], m)]
        out = []
        for i in range(0, len(at), batch):
            got = model(np.stack([x[y : y + tile[0], c : c + tile[1]] for y, c in at[i : i + batch]]))
            out += [(y, c, p) for (y, c), p in zip(at[i : i + batch], got)]
        whole = raster.blend(out, *x.shape[:2], m)
        dy, dx = (x.shape[0] - a.shape[0]) // 2, (x.shape[1] - a.shape[1]) // 2
        return whole[dy : dy + a.shape[0], dx : dx + a.shape[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            labels, confs = [], []
            for v in b.column(b.schema.get_field_index(column)).to_pylist():
                a = raster.unpack(v)
                if a is None or not a.size:
                    labels.append(None)
                    confs.append(None)
                    continue
                p = scores(model, a)
                p = p if p.shape[:2] == a.shape[:2] else raster.resize(p, *a.shape[:2])
                labels.append(raster.pack(p.argmax(-1).astype(np.uint8)))
                confs.append(raster.pack(np.clip(np.rint(p.max(-1) * 255), 0, 255)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(labels, kind), pa.array(confs, kind)], names=schema.names)

    return df.mapInArrow(run, schema)


def classify(df: DataFrame, column: str, load: Callable[[], Model], keys: list[str], size: tuple[int, int], batch: int = 8) -> DataFrame:
    """(keys, scores): one score array for each image, resized to the model's size."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            images = [raster.unpack(v) for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            out: list = [None] * len(images)
            there = [i for i, a in enumerate(images) if a is not None and a.size]
            for s in range(0, len(there), batch):
                own = there[s : s + batch]
                for i, p in zip(own, model(np.stack([raster.resize(images[i], *size) for i in own]).astype(np.float32) / 255)):
                    out[i] = p.astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return df.select(*keys, column).mapInArrow(run, schema)


def split_wide(a: np.ndarray) -> list[np.ndarray]:
    """A wide line as two halves, cut at the emptiest smoothed column within 6 % of its middle; else itself."""
    if a.shape[1] < 750:
        return [a]
    z = raster.smooth(a[..., 0].astype(float).mean(0), 3)
    low, high = int(0.44 * len(z)), int(0.56 * len(z))
    at = low + int(np.argmax(z[low:high]))
    return [a[:, :at], a[:, at:]] if at else [a]


def voted(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, conf) of two readings of the same lines (in colour and binary, upright and turned): the surer one; equal ones the first."""
    a, b = df.select(*keys, F.struct("conf", F.lit(1).alias("k"), "text").alias("s")), others.select(*keys, F.struct("conf", F.lit(0).alias("k"), "text").alias("s"))
    best = a.unionByName(b).groupBy(*keys).agg(F.max("s").alias("s"))
    return best.select(*keys, F.col("s.text").alias("text"), F.col("s.conf").alias("conf"))


def recognise(df: DataFrame, column: str, load: Callable[[], Model], charset: list[str], keys: list[str], batch: int = 8, least: float = 0.3) -> DataFrame:
    """(keys, text, conf) of line images: resize, batch, greedy CTC, mean score of the steps that aren't blank; doubtful text is ''."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("text", T.StringType()), T.StructField("conf", T.DoubleType())])

    def read(p: np.ndarray) -> tuple[str, float]:
        best, blank = p.argmax(-1), p.shape[-1] - 1
        keep = (best != blank) & np.append(True, best[1:] != best[:-1])
        live = p.max(-1)[best != blank]
        return "".join(charset[i] for i in best[keep] if i < len(charset)), float(live.mean()) if len(live) else float("nan")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            images = [raster.unpack(v) for v in b.column(b.schema.get_field_index(column)).to_pylist()]
            parts = [(i, raster.fit_line(half)) for i, a in enumerate(images) if a is not None for half in split_wide(a)]
            got: dict[int, list] = {}
            for s in range(0, len(parts), batch):
                own = parts[s : s + batch]
                for (i, _), p in zip(own, model(np.stack([x for _, x in own]).astype(np.float32) / 255)):
                    got.setdefault(i, []).append(read(p))
            texts, confs = [], []
            for i in range(len(images)):
                conf = float(np.mean([c for _, c in got.get(i, [("", float("nan"))])]))
                sure = conf >= least
                texts.append(" ".join(t for t, _ in got[i]) if sure else "")
                confs.append(conf if sure else 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(texts, pa.string()), pa.array(confs, pa.float64())], names=schema.names)

    return df.select(*keys, column).mapInArrow(run, schema)


def binarise(df: DataFrame, column: str, load: Callable[[], Model], keys: list[str], tile: tuple[int, int] | None = None) -> DataFrame:
    """(keys, image): ink black, the rest white; class 0 of the model is the background."""
    out = segment(df, column, load, keys, tile)
    return raster.map_images(out.select(*keys, F.col("label").alias("image")), "image", lambda a: np.where(a == 0, 255, 0))


def failures(results: DataFrame, ok: str, most: float) -> None:
    """Raises when more than a share (below 1) or a number of rows failed."""
    n, bad = results.agg(F.count("*"), F.sum((~F.col(ok)).cast("int"))).first()
    if bad and bad > (most * n if most < 1 else most):
        raise RuntimeError(f"{bad} of {n} failed")
