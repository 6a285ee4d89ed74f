"""Agreement of predictions with truth, class weights, ensembles, text error rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.grouped import by_key
from quire.operators.runs import overlap


def confusion(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, truth, pred, n): rows, or the sum of their weights (pixels counted before)."""
    return df.groupBy(*(keys or []), truth, pred).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def normalised(cm: DataFrame, truth: str, pred: str, mode: str = "all") -> DataFrame:
    """Shares of the total ('all'), of a truth ('true'), of a prediction ('pred') or counts ('none'); 0 where the base is 0."""
    w = {"all": Window.partitionBy(), "true": Window.partitionBy(truth), "pred": Window.partitionBy(pred)}.get(mode)
    share = F.col("n").cast("double") if w is None else F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(w)), F.lit(0.0))
    return cm.withColumn("share", share)


def per_class(df: DataFrame, truth: str, pred: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, cls, tp, fp, fn, iou, dice) for each class that occurs, from one pass over the rows."""
    keys = keys or []
    n = confusion(df, truth, pred, keys, weight)
    sides = n.select(*keys, "n", F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.lit(0).alias("side")), F.struct(F.col(pred).alias("cls"), F.lit(1).alias("side")))).alias("s"), (F.col(truth) == F.col(pred)).alias("hit"))
    t = sides.groupBy(*keys, F.col("s.cls").alias("cls")).agg(
        F.sum(F.when(F.col("hit") & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("s.side") == 1), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("s.side") == 0), F.col("n")).otherwise(0)).alias("fn"),
    )
    return t.withColumn("iou", F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("dice", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def mean_iou(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    """(mean_iou) over all classes that occur in the truth."""
    return per_class(df, truth, pred, weight=weight).where("tp + fn > 0").agg(F.avg("iou").alias("mean_iou"))


def image_metric(df: DataFrame, truth: str, pred: str, image: str, metric: str = "iou", smooth: float = 0.001) -> DataFrame:
    """(cls, value): a class's smoothed IoU or Dice, averaged over the images whose truth has it."""
    t = per_class(df, truth, pred, [image]).where("tp + fn > 0")
    top, base = (F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")) if metric == "iou" else (2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return t.groupBy("cls").agg(F.avg((top + smooth) / (base + smooth)).alias("value"))


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """(cls, n, weight): inverse counts, brought to the sum, then the minimum, then the sum of 1."""
    t = df.groupBy(F.col(cls).alias("cls")).agg(F.count("*").alias("n")).withColumn("w", 1 / F.col("n"))
    every = Window.partitionBy()
    t = t.withColumn("w", F.col("w") / F.sum("w").over(every)).withColumn("w", F.col("w") / F.min("w").over(every))
    return t.select("cls", "n", (F.col("w") / F.sum("w").over(every)).alias("weight"))


def ensemble(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, pos, mean): element-wise mean of arrays."""
    return df.select(*keys, F.posexplode(values).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("mean"))


def error_rates(df: DataFrame, truth: Column, pred: Column, keys: list[Column]) -> DataFrame:
    """(keys, cer): edits over truth length, micro-averaged."""
    t = df.select(*keys, F.levenshtein(pred, truth).alias("d"), F.length(truth).alias("n"))
    return t.groupBy(*[c for c in t.columns if c not in ("d", "n")]).agg(F.sum("d").alias("edits"), F.sum("n").alias("chars"), (F.sum("d") / F.sum("n")).alias("cer"))


def otsu(hist: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(threshold): the value whose split (up to it, above it) has the greatest variance between classes; the first of equal ones."""
    w = Window.orderBy(value)  # one row for each grey value
    every = Window.partitionBy()
    t = (
        hist.withColumn("w0", F.sum(n).over(w).cast("double")).withColumn("s0", F.sum(F.col(n) * F.col(value)).over(w).cast("double"))
        .withColumn("w", F.sum(n).over(every).cast("double")).withColumn("s", F.sum(F.col(n) * F.col(value)).over(every).cast("double")).where("w0 < w")
    )
    d = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * d * d
    return t.withColumn("b", F.round(between / (F.col("w") * F.col("w")), 6)).agg(F.max_by(F.col(value), F.struct("b", (-F.col(value)).alias("v"))).alias("threshold"))


def _as_characters(words: Column, all_: Column) -> Column:
    """Words as characters from U+0100 on, by their place in a list."""
    code = lambda w: F.lpad(F.hex(F.array_position(all_, w) + 256), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


def edits(a: str, b: str) -> int:
    """Levenshtein's distance of characters; a whole column of the table at once, as the bits of a number (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or not b:
        return 0 if a == b else len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, n = every, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        x = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | (every & ~(h | up)), up & h
        n += bool(more & last) - bool(less & last)
        more, less = (more << 1) | 1, less << 1
        up, down = (less | ~(x | more)) & every, more & x & every
    return n


def with_edits(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """A column of the edits between two columns of texts; null where one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(t.schema.get_field_index(c)).to_pylist() for c in (a, b))
            n = [None if p is None or q is None else edits(p, q) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(n, pa.int64())], names=[*t.schema.names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{out}` bigint"]))


def line_rates(df: DataFrame, truth: Column, read: Column, keys: list[str]) -> DataFrame:
    """(keys, edits, chars, cer, word_edits, words, wer): edits of characters and of blank-separated words against the truth's number of each; lines of fewer than 50 000 different words."""
    t = with_edits(df.select(*keys, truth.alias("__t"), read.alias("__r")), "__t", "__r", "__e")
    t = t.withColumn("__a", F.split("__t", " ")).withColumn("__b", F.split("__r", " ")).withColumn("__d", F.array_distinct(F.concat("__a", "__b")))
    t = t.withColumn("word_edits", F.levenshtein(_as_characters(F.col("__a"), F.col("__d")), _as_characters(F.col("__b"), F.col("__d"))).cast("bigint"))
    edits, chars, words = F.col("__e"), F.length("__t").cast("bigint"), F.size("__a").cast("bigint")
    return t.select(*keys, edits.alias("edits"), chars.alias("chars"), F.round(F.try_divide(edits, chars), 6).alias("cer"), "word_edits", words.alias("words"), F.round(F.try_divide(F.col("word_edits"), words), 6).alias("wer"))


def component_loss(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loss) of component runs (keys, y, x0, x1, comp): 1 - sum of singular values / pixels of the matrix of shared pixels, 0 where components of both sides match one to one."""
    n = overlap(truth.withColumnRenamed("comp", "ct"), pred.withColumnRenamed("comp", "cp"), keys, "ct", "cp")

    def kernel(t: pa.Table) -> pa.Table:
        a, b = (np.unique(t.column(c).to_numpy(), return_inverse=True)[1] for c in ("ct", "cp"))
        m = np.zeros((a.max() + 1, b.max() + 1))
        m[a, b] = t.column("n").to_numpy()
        loss = 1 - np.linalg.svd(m, compute_uv=False).sum() / m.sum()
        return t.slice(0, 1).select(keys).append_column("loss", pa.array([float(loss)]))

    kinds = dict(n.dtypes)
    return by_key(n, keys, ["ct", "cp"], kernel, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "loss double"]))
