"""Class scores, losses and size rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.signal import argmax


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def column_class(scores: Column, lower: int | None = None, upper: int | None = None) -> Column:
    """struct(num_col, conf) of column scores; a count moved to a bound has confidence 1."""
    n, conf = argmax(scores) + 1, F.array_max(scores).cast("double")
    bound = n if upper is None else F.least(n, F.lit(upper))
    bound = bound if lower is None else F.greatest(bound, F.lit(lower))
    return F.struct(bound.alias("num_col"), F.when(bound != n, F.lit(1.0)).otherwise(conf).alias("conf"))


def line_confidence(steps: Column, end: int) -> Column:
    """Mean of each step's best score over the steps whose class isn't `end`; NaN without such steps."""
    live = F.filter(steps, lambda p: argmax(p) != end)
    return F.when(F.size(live) > 0, _sum(F.transform(live, lambda p: F.array_max(p).cast("double"))) / F.size(live)).otherwise(F.lit(float("nan")))


_LADDER = {1: (1100, 2500, 2000), 2: (2000, 3500, 2400), 3: (2000, 4000, 3000), 4: (2500, 5000, 4000), 5: (3700, 7000, 5000), 6: (4500, None, 6500)}


def ladder_width(num_col: Column, width: Column) -> Column:
    """The working width for a number of columns; widths inside a column's range stay."""
    out = width
    for n, (low, high, to) in _LADDER.items():
        outside = (width < low) if high is None else (width < low) | (width >= high)
        out = F.when((num_col == n) & outside, F.lit(to)).otherwise(out)
    return out


def working_size(num_col: Column, conf: Column, width: Column, height: Column) -> Column:
    """struct(w, h); doubtful counts never shrink a page, and heights from 8000 stay as they were."""
    w = ladder_width(num_col, width)
    h = F.floor(w * height / width).cast("int")
    keep = ((conf < 0.9) & (w < width)) | (h >= 8000)
    return F.struct(F.when(keep, width).otherwise(w).cast("int").alias("w"), F.when(keep, height).otherwise(h).cast("int").alias("h"))


def small_working_size(num_col: Column, conf: Column, width: Column, height: Column) -> Column:
    """As working_size with 1000 for one column and 1300 for more."""
    w = F.when(num_col == 1, 1000).otherwise(1300)
    h = F.floor(w * height / width).cast("int")
    keep = ((conf < 0.9) & (w < width)) | (h >= 8000)
    return F.struct(F.when(keep, width).otherwise(w).cast("int").alias("w"), F.when(keep, height).otherwise(h).cast("int").alias("h"))


def early_width(num_col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (1000, 1500, 2000, 2500, 3000, 4000)]), F.least(F.greatest(num_col, F.lit(1)), F.lit(6)))


def extractor_width(num_col: Column) -> Column:
    """Widths of image extraction; other counts are an error."""
    ok = num_col.between(1, 6)
    return F.when(ok, F.get(F.array(*[F.lit(x) for x in (700, 900, 1500, 1800, 2200, 2500)]), num_col - 1)).otherwise(F.raise_error(F.concat(F.lit("no width for columns: "), num_col.cast("string"))).cast("int"))


def cross_entropy(y: Column, p: Column, weights: Column | None = None, eps: float = 1e-7) -> Column:
    """-sum w y ln p over classes, p brought to a sum of 1 and clipped."""
    total = _sum(p)
    q = F.transform(p, lambda x: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x / total)))
    terms = F.zip_with(y, q, lambda a, b: a * F.log(b))
    return -_sum(terms if weights is None else F.zip_with(weights, terms, lambda w, t: w * t))


def focal_loss(y: Column, p: Column, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-6) -> Column:
    q = F.transform(p, lambda x: F.greatest(F.lit(eps), F.least(F.lit(1 - eps), x)))
    return F.array_max(F.zip_with(y, q, lambda a, b: -alpha * a * F.pow(1 - b, F.lit(gamma)) * F.log(b)))


def soft_dice_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    return 1 - 2 * _sum(F.zip_with(y, p, lambda a, b: a * b)) / (_sum(F.transform(y, lambda a: a * a)) + _sum(F.transform(p, lambda b: b * b)) + eps)


def tversky(tp: Column, fn: Column, fp: Column) -> Column:
    return (tp + 1) / (tp + 0.2 * fn + 0.8 * fp + 1)


def focal_tversky(indexes: Column) -> Column:
    return _sum(F.transform(indexes, lambda t: F.pow(1 - t, F.lit(1.3))))


def generalized_dice(y: Column, p: Column) -> Column:
    """Classes as elements: weights 1 / (y^2 + 1e-6)."""
    w = F.transform(y, lambda a: 1 / (a * a + 1e-6))
    top = _sum(F.zip_with(w, F.zip_with(y, p, lambda a, b: a * b), lambda a, b: a * b))
    return 2 * top / _sum(F.zip_with(w, F.zip_with(y, p, lambda a, b: a + b), lambda a, b: a * b))


def jaccard_distance(y: Column, p: Column, smooth: float = 100.0) -> Column:
    i = _sum(F.zip_with(y, p, lambda a, b: F.abs(a * b)))
    s = _sum(F.zip_with(y, p, lambda a, b: F.abs(a) + F.abs(b)))
    return (1 - (i + smooth) / (s - i + smooth)) * smooth


def superposition(metrics: list[Column], weights: list[float]) -> Column:
    total = metrics[0] * weights[0]
    for m, w in zip(metrics[1:], weights[1:]):
        total = total + m * w
    return total / len(metrics)
