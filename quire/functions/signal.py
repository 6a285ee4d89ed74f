"""Profiles as arrays: smoothing, peaks, valleys and windows with higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaussian_kernel(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(a: Column, sigma: float) -> Column:
    """Gaussian filter over four sigma, the border mirrored with its last sample repeated."""
    k = gaussian_kernel(sigma)
    r = len(k) // 2
    n = F.size(a)
    kernel = F.array(*[F.lit(x) for x in k])

    def at(i: Column) -> Column:
        m = F.pmod(i, 2 * n)
        return F.get(a, F.when(m < n, m).otherwise(2 * n - 1 - m)).cast("double")

    one = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * r)), F.lit(0.0), lambda acc, j: acc + F.get(kernel, j) * at(i + j - r))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<double>"))


def find_peaks(a: Column, height: float | None = None) -> Column:
    """Places of strict local maxima, ends excluded; of a plateau the middle, rounded down."""
    n = F.size(a)
    at = lambda i: F.get(a, i)
    rises = F.filter(F.sequence(F.lit(1), n - 2), lambda i: (at(i) > at(i - 1)) & (F.lit(True) if height is None else at(i) >= height))
    # the end of the plateau that begins at i
    end = lambda i: F.coalesce(F.get(F.filter(F.sequence(i, n - 1), lambda j: at(j) != at(i)), F.lit(0)) - 1, n - 1)
    spans = F.transform(rises, lambda i: F.struct(i.alias("l"), end(i).alias("r")))
    falls = F.filter(spans, lambda s: (s["r"] < n - 1) & (at(s["r"] + 1) < at(s["l"])))
    return F.when(n > 2, F.transform(falls, lambda s: F.floor((s["l"] + s["r"]) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))


def find_valleys(a: Column) -> Column:
    return find_peaks(F.transform(a, lambda x: -x))


def top_peaks(a: Column, k: int, margin: float = 0.03) -> Column:
    """Places of the k highest peaks inside the margins, by place; ties to the left."""
    n = F.size(a)
    inside = F.filter(find_peaks(a), lambda i: (i > margin * n) & (i < (1 - margin) * n))
    by_height = F.array_sort(F.transform(inside, lambda i: F.struct((-F.get(a, i)).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(by_height, 1, k), lambda s: s["i"]))


def spread(a: Column) -> Column:
    """Population standard deviation."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)


def blend_window(margin: int) -> Column:
    """Sigmoid weights 1 / (1 + exp(5 - 5 k / m)) for k below 2 m."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 * margin - 1)), lambda k: 1 / (1 + F.exp(5 - 5 * k / margin)))


def nearest_index(n_in: Column, n_out: Column) -> Column:
    """The source place of each of n_out samples."""
    return F.transform(F.sequence(F.lit(0), n_out - 1), lambda i: F.floor(i * n_in / n_out).cast("int"))


def nearest_resize(a: Column, n_out: Column) -> Column:
    return F.transform(nearest_index(F.size(a), n_out), lambda i: F.get(a, i))


def argmax(a: Column) -> Column:
    """The first place of the maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: (c == x).cast("int"))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def with_ends(a: Column, first: Column, last: Column) -> Column:
    return F.concat(F.array(first), a, F.array(last))


def valleys(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows lower than both their neighbours. Without keys all rows meet in one task: for profiles, which are short."""
    w = Window.partitionBy(*keys).orderBy(at)
    t = df.withColumn("__p", F.lag(value).over(w)).withColumn("__q", F.lead(value).over(w))
    return t.where((F.col(value) < F.col("__p")) & (F.col(value) < F.col("__q"))).drop("__p", "__q")
