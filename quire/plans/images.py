"""Queries on small images: every vector of the embeddings as eight rows of eight gray pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import augment, raster, regions
from quire.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_PIXELS = "SELECT vec_id, label, (i // 8)::INT AS y, (i % 8)::INT AS x, floor(abs(embedding[i + 1]::DOUBLE) * 997)::INT % 256 AS v FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i)"


def images(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, image)."""
    t = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda e: (F.floor(F.abs(e.cast("double")) * 997) % 256).cast("int")).alias("v"))
    data = F.unhex(F.array_join(F.transform("v", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return raster.from_raw(t.withColumn("data", data).withColumn("n", F.lit(8)).withColumn("one", F.lit(1)), "data", "n", "n", "one").select("vec_id", "label", "image")


def pixels(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, v) of one-channel images."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in enumerate(b.column(len(keys)).to_pylist()):
                a = raster.unpack(v)[..., 0]
                y, x = np.indices(a.shape).reshape(2, -1)
                row = pa.array(np.full(a.size, i))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(row) for k in range(len(keys))), *(pa.array(c.astype(np.int32)) for c in (y, x, a.ravel()))], names=[*keys, "y", "x", "v"])

    return df.select(*keys, "image").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y int, x int, v int"]))


@query(f"""
WITH p AS MATERIALIZED ({_PIXELS})
SELECT vec_id, 'original' AS variant, y, x, v FROM p UNION ALL SELECT vec_id, 'flip_h', y, 7 - x, v FROM p UNION ALL SELECT vec_id, 'flip_v', 7 - y, x, v FROM p UNION ALL SELECT vec_id, 'flip_hv', 7 - y, 7 - x, v FROM p
UNION ALL SELECT vec_id, 'rotate_90', x, y, v FROM p UNION ALL SELECT vec_id, 'invert', y, x, 255 - v FROM p UNION ALL SELECT vec_id, 'brighten_1.5', y, x, least(255, floor(v * 1.5))::INT FROM p
UNION ALL SELECT q.vec_id, 'degrade_0.5', q.y, q.x, p.v FROM p JOIN p q ON q.vec_id = p.vec_id AND p.y = q.y * 4 // 8 * 8 // 4 AND p.x = q.x * 4 // 8 * 8 // 4
UNION ALL SELECT vec_id, 'padding_0.5', y + 2, x + 2, v FROM p UNION ALL SELECT vec_id, 'padding_0.5', yy, xx, 255 FROM (SELECT DISTINCT vec_id FROM p) CROSS JOIN (SELECT unnest(range(12))::INT AS yy) CROSS JOIN (SELECT unnest(range(12))::INT AS xx) WHERE yy NOT BETWEEN 2 AND 9 OR xx NOT BETWEEN 2 AND 9
UNION ALL SELECT vec_id, 'channels_0', y, x, v FROM p
""")
def image_variants(spark: SparkSession, sf: str) -> DataFrame:
    config = {"flip": ["h", "v", "hv"], "rotate_90": True, "invert": True, "brighten": [1.5], "degrade": [0.5], "padding": [0.5], "channels": [(0,)]}
    return pixels(augment.augment(images(spark, sf), "image", config, ["vec_id"]), ["vec_id", "variant"])


@query(f"""
WITH p AS ({_PIXELS}), s AS (SELECT unnest([0, 2, 4]) AS s)
SELECT vec_id, a.s || '_' || b.s AS variant, (y - a.s)::INT AS y, (x - b.s)::INT AS x, v FROM p JOIN s a ON y BETWEEN a.s AND a.s + 3 JOIN s b ON x BETWEEN b.s AND b.s + 3
""")
def image_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of four pixels with a margin of one: a step of two, the last moved back."""
    return pixels(raster.expand_images(images(spark, sf), "image", lambda a: raster.tiles(a, 4, 4, 1), ["vec_id"]), ["vec_id", "variant"])


@query(f"""
WITH p AS ({_PIXELS}), l AS (SELECT vec_id, y, x, v // 64 AS label FROM p), g AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id, y, label ORDER BY x) AS g FROM l)
SELECT vec_id, y, min(x)::INT AS x0, (max(x) + 1)::INT AS x1, label::INT AS label FROM g WHERE label > 0 GROUP BY vec_id, y, label, g
""")
def label_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of gray levels in four steps."""
    return raster.to_runs(raster.map_images(images(spark, sf), "image", lambda a: a // 64), "image", ["vec_id"])


@query(f"""
WITH p AS ({_PIXELS}) SELECT p.vec_id, (p.v // 128)::INT AS truth, (q.v // 64)::INT AS pred, count(*) AS n FROM p JOIN p q ON q.vec_id = p.vec_id AND q.y = p.x AND q.x = p.y GROUP BY ALL
""")
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How levels in two steps meet those in four of the image turned over."""
    a = raster.map_images(images(spark, sf), "image", lambda a: a // 128, "truth")
    b = raster.map_images(a, "image", lambda a: a.transpose(1, 0, 2) // 64, "pred")
    return raster.pair_counts(b, "truth", "pred", ["vec_id"])


@query(f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, y, x FROM ({_PIXELS}) WHERE v >= 128), c AS (
  SELECT vec_id, y, x, y * 8 + x AS comp FROM p UNION SELECT p.vec_id, p.y, p.x, c.comp FROM c JOIN p ON p.vec_id = c.vec_id AND abs(p.y - c.y) <= 1 AND abs(p.x - c.x) <= 1 AND c.comp < p.y * 8 + p.x),
m AS (SELECT vec_id, y, x, min(comp) AS comp FROM c GROUP BY ALL), b AS (SELECT vec_id, comp, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM m GROUP BY vec_id, comp HAVING count(*) >= 2)
SELECT vec_id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, area::INT AS area FROM b
""")
def bright_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Components of bright pixels of at least two pixels, from label rasters."""
    seg = raster.map_images(images(spark, sf), "image", lambda a: a // 128, "label")
    return regions.found(seg.select("vec_id", F.col("label")), ["vec_id"], 2 / 64, conf=None).select("vec_id", "x0", "y0", "x1", "y1", "area")


@query(f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT vec_id, y, x FROM ({_PIXELS}) WHERE v >= 128), c AS (
  SELECT vec_id, y, x, y * 8 + x AS comp FROM p UNION SELECT p.vec_id, p.y, p.x, c.comp FROM c JOIN p ON p.vec_id = c.vec_id AND abs(p.y - c.y) <= 1 AND abs(p.x - c.x) <= 1 AND c.comp < p.y * 8 + p.x),
m AS (SELECT vec_id, y, x, min(comp) AS comp FROM c GROUP BY ALL), b AS (SELECT vec_id, comp, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n FROM m GROUP BY vec_id, comp),
f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, comp) AS k FROM b)
SELECT e.vec_id, coalesce(x0, 0)::INT AS x0, coalesce(y0, 0)::INT AS y0, coalesce(x1, 8)::INT AS x1, coalesce(y1, 8)::INT AS y1 FROM embeddings e LEFT JOIN f ON f.vec_id = e.vec_id AND k = 1
""")
def page_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The box of the largest component of bright pixels, the whole image without one."""
    seg = raster.map_images(images(spark, sf), "image", lambda a: a // 128, "label")
    return regions.frames(seg, "vec_id").select("vec_id", "x0", "y0", "x1", "y1")


@query(f"""
WITH p AS MATERIALIZED ({_PIXELS}), n AS (SELECT vec_id, v, count(*) AS k FROM p GROUP BY vec_id, v),
c AS (SELECT vec_id, v, sum(k) OVER (PARTITION BY vec_id ORDER BY v) AS w0, sum(k * v) OVER (PARTITION BY vec_id ORDER BY v) AS s0, 64 AS w, sum(k * v) OVER (PARTITION BY vec_id) AS s FROM n),
t AS (SELECT vec_id, arg_max(v, (w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2, -v)) AS cut FROM c WHERE w0 < w GROUP BY vec_id)
SELECT vec_id, count(*) FILTER (WHERE v > cut) AS ink FROM p JOIN t USING (vec_id) GROUP BY vec_id
""")
def otsu_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels above each image's threshold of greatest variance between classes."""
    return pixels(raster.map_images(images(spark, sf), "image", raster.otsu_mask), ["vec_id"]).where("v = 255").groupBy("vec_id").agg(F.count("*").alias("ink"))
