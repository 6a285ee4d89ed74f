"""Masks as runs (keys, y, x0, x1, label), x half open: algebra without pixels.

Operators keep work local to (keys, y), so a mask of any size is spread over its rows;
only components follow neighbours across rows, page by page or spread.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.grouped import by_key, dealt, local_roots, together


def area(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def normalise(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching runs of a row merged."""
    return merged(dealt(runs, [*keys, "y"]), keys)


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """As `normalise`, of runs whose rows are together."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("x0") > reach, 1).otherwise(0)
    t = runs.withColumn("__n", new).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy(*keys, "y", "__g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__g")


def ends(runs: DataFrame, keys: list[str], others: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, y, others, x, c): where runs begin (1) and end (-1)."""
    end = lambda x, c: F.struct(F.col(x).alias("x"), F.lit(c).alias("c"))
    return runs.select(*keys, "y", *others, F.inline(F.array(end("x0", 1), end("x1", -1))))


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "y", "x0", "x1"]
    return normalise(a.select(*cols).unionByName(b.select(*cols)), keys)


def _coverage(sides: list[DataFrame], keys: list[str], keep) -> DataFrame:
    """Sweeps each row's run ends; keep(list of cover counts) says which stretches stay."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, "y", "x0", "x1", F.lit(i).alias("__i")) for i, s in enumerate(sides)])
    points = ends(dealt(every, [*keys, "y"]), keys, ["__i"]).groupBy(*keys, "y", "x").agg(*[F.sum(F.when(F.col("__i") == j, F.col("c")).otherwise(0)).alias(f"c{j}") for j in range(len(sides))])
    w = Window.partitionBy(*keys, "y").orderBy("x")
    t = points
    for j in range(len(sides)):
        t = t.withColumn(f"n{j}", F.sum(f"c{j}").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("x1", F.lead("x").over(w)).where(F.col("x1").isNotNull() & keep([F.col(f"n{j}") > 0 for j in range(len(sides))]))
    return merged(t.select(*keys, "y", F.col("x").alias("x0"), "x1"), keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _coverage([a, b], keys, lambda on: on[0] & on[1])


def subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _coverage([a, b], keys, lambda on: on[0] & ~on[1])


def overlap(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(keys, left, right, n): pixels that two sets of labelled runs share."""
    p, q = a.select(*keys, "y", left, "x0", "x1"), b.select(*keys, "y", right, F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    n = F.least("x1", "u1") - F.greatest("x0", "u0")
    p, q = together([p, q], [*keys, "y"])
    return p.join(q, [*keys, "y"]).where((F.col("x0") < F.col("u1")) & (F.col("u0") < F.col("x1"))).groupBy(*keys, left, right).agg(F.sum(n).alias("n"))


def dilate(runs: DataFrame, keys: list[str], dx: int, dy: int) -> DataFrame:
    """Grown by a (2 dx + 1) x (2 dy + 1) rectangle; not clipped."""
    grown = runs.select(*keys, F.explode(F.sequence(F.col("y") - dy, F.col("y") + dy)).alias("y"), (F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1"))
    return normalise(grown, keys)


def erode(runs: DataFrame, keys: list[str], dx: int, dy: int) -> DataFrame:
    """Shrunk by the rectangle: what stays in all 2 dy + 1 rows above and below."""
    thin = normalise(runs, keys).select(*keys, "y", (F.col("x0") + dx).alias("x0"), (F.col("x1") - dx).alias("x1")).where("x0 < x1")
    moved = thin.select(*keys, F.explode(F.sequence(F.col("y") - dy, F.col("y") + dy)).alias("y"), "x0", "x1")
    points = ends(dealt(moved, [*keys, "y"]), keys).groupBy(*keys, "y", "x").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "y").orderBy("x")
    t = points.withColumn("n", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("x1", F.lead("x").over(w))
    return merged(t.where(F.col("n") == 2 * dy + 1).select(*keys, "y", F.col("x").alias("x0"), "x1"), keys)


def opened(runs: DataFrame, keys: list[str], dx: int, dy: int) -> DataFrame:
    return dilate(erode(runs, keys, dx, dy), keys, dx, dy)


def closed(runs: DataFrame, keys: list[str], dx: int, dy: int) -> DataFrame:
    return erode(dilate(runs, keys, dx, dy), keys, dx, dy)


def row_profile(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys, "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"))


def column_profile(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of each column, from the changes at run ends."""
    ends = runs.select(*keys, F.col("x0").alias("x"), F.lit(1).alias("c")).unionByName(runs.select(*keys, F.col("x1").alias("x"), F.lit(-1).alias("c")))
    points = ends.groupBy(*keys, "x").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys).orderBy("x")
    t = points.withColumn("n", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("x").over(w))
    return t.where("n > 0").select(*keys, F.explode(F.sequence(F.col("x"), F.col("to") - 1)).alias("x"), "n")


def from_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of boxes (x0, y0, x1, y1), half open."""
    rows = boxes.where("y0 < y1 and x0 < x1").select(*keys, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")
    return normalise(rows, keys)


def clip(runs: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """What lies in a box."""
    t = runs.where((F.col("y") >= y0) & (F.col("y") < y1))
    return t.withColumn("x0", F.greatest("x0", x0)).withColumn("x1", F.least("x1", x1)).where("x0 < x1")


def paint(layers: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """Labelled runs of layers painted one after another; later ones cover earlier ones."""
    out = None
    for i, (label, runs) in enumerate(layers):
        over = [r for _, r in layers[i + 1 :]]
        left = normalise(runs, keys) if not over else runs.select(*keys, "y", "x0", "x1")
        if over:
            left = subtract(left, reduce(DataFrame.unionByName, [o.select(*keys, "y", "x0", "x1") for o in over]), keys)
        left = left.withColumn("label", F.lit(label))
        out = left if out is None else out.unionByName(left)
    return out


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, corners: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that touch; runs are sorted by y and x0."""
    n = len(y)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    y, x0, x1 = (v.astype(np.int64) for v in (y, x0, x1))
    low = min(int(x0.min()), int(x1.min()))
    x0, x1, y = x0 - low, x1 - low, y - int(y.min())
    wide = int(max(x0.max(), x1.max())) + 2
    far = np.maximum.accumulate(y * wide + x1)  # the furthest end so far in each row
    first = np.searchsorted(far, (y + 1) * wide + x0, "left" if corners else "right")
    first = np.maximum(first, np.searchsorted(y, y + 1, "left"))
    stop = np.searchsorted(y * wide + x0, (y + 1) * wide + x1, "right" if corners else "left")
    count = np.maximum(stop - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    ok = x1[b] >= x0[a] if corners else x1[b] > x0[a]
    return a[ok], b[ok]


def components(runs: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """Runs with `comp`, the smallest run number of its component (numbers by y, x0 in each key).

    Runs of neighbouring rows that touch belong together. One exchange by the keys (a
    page, a label of it), then union-find over each key's runs where they are; a mask
    that is too large for one task goes to `components_spread`.
    """
    out = T.StructType([*(runs.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1", "comp"))])

    def kernel(t: pa.Table) -> pa.Table:
        y, x0, x1 = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        one = np.append(True, (y[1:] != y[:-1]) | (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1]))
        y, x0, x1 = y[one], x0[one], x1[one]
        comp = local_roots(len(y), *touching(y, x0, x1, corners)) + 1
        rows = t.slice(0, 1).select(keys).take(pa.array(np.zeros(len(y), np.int64)))
        for c, v in zip(("y", "x0", "x1", "comp"), (y, x0, x1, comp)):
            rows = rows.append_column(c, pa.array(v.astype(np.int32)))
        return rows

    return by_key(runs.select(*keys, "y", "x0", "x1"), keys, ["y", "x0", "x1"], kernel, out)


def components_spread(runs: DataFrame, keys: list[str], corners: bool = True) -> DataFrame:
    """As `components`, for masks of any size: nothing but neighbours need meet in a task.

    In each round a run takes the lowest label of its neighbours, hands it to the run its
    label names, and everything with that label follows: labels meet as whole groups, so
    rounds grow with the logarithm of a component's length. It goes on until nothing
    changes. Each round is checkpointed: lost executors lose nothing.
    """
    w = Window.partitionBy(*keys).orderBy("y", "x0", "x1")
    t = runs.select(*keys, "y", "x0", "x1").distinct().withColumn("run", F.row_number().over(w)).transform(_kept)
    o = t.select(*keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("run").alias("other"))
    touch = (F.col("x0") <= F.col("u1")) & (F.col("u0") <= F.col("x1")) if corners else (F.col("x0") < F.col("u1")) & (F.col("u0") < F.col("x1"))
    e = t.join(o, [*keys, "y"]).where(touch).select(*keys, F.col("run").alias("a"), F.col("other").alias("b"))
    edges = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).transform(_kept)
    label = t.select(*keys, "run", F.col("run").alias("comp"))
    before = None
    while True:
        near = edges.join(label.select(*keys, F.col("run").alias("b"), "comp"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("run")).agg(F.min("comp").alias("__m"))
        low = label.join(near, [*keys, "run"], "left").select(*keys, "run", "comp", F.least("comp", "__m").alias("__low"))
        up = low.select(*keys, F.explode(F.array_distinct(F.array("comp", "run"))).alias("comp"), "__low").groupBy(*keys, "comp").agg(F.min("__low").alias("__up"))
        label = low.select(*keys, "run", "comp").join(up, [*keys, "comp"]).select(*keys, "run", F.col("__up").alias("comp")).transform(_kept)
        total = label.agg(F.sum("comp")).first()[0]  # labels only fall
        if total == before:
            break
        before = total
    return t.join(label, [*keys, "run"]).drop("run")


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a folder of this machine's own only for a local master."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            at = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


def component_boxes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, comp, x0, y0, x1, y1, area) of labelled runs."""
    return parts.groupBy(*keys, "comp").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
