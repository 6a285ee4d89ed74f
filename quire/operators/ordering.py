"""Clusters of neighbours, reading order, identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import line_id, region_id
from quire.operators.grouped import dealt


def gap_clusters(df: DataFrame, keys: list[str], at: str, gap: Column | float, ties: list[str], name: str = "cluster") -> DataFrame:
    """Numbers runs of rows (from 0 in each key) whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    step = F.col(at) - F.lag(at).over(w)
    return df.withColumn(name, F.sum(F.when(step > gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def neighbours(df: DataFrame, keys: list[str], at: str, ties: list[str], row: str, most: float) -> DataFrame:
    """(keys, a, b): rows next to each other by `at`, at most `most` apart."""
    w = Window.partitionBy(*keys).orderBy(at, *ties)
    return df.withColumn("b", F.lead(row).over(w)).withColumn("d", F.lead(at).over(w) - F.col(at)).where(F.col("d") <= most).select(*keys, F.col(row).alias("a"), "b")


def line_order(df: DataFrame, keys: list[str], cx: str, cy: str, w: str, h: str, row: str) -> DataFrame:
    """Lines of a region in order: mostly tall lines go in rows, else in columns; a row or column ends where the gap is over the median gap / 1.5 (10 if that is 0)."""
    by = Window.partitionBy(*keys)
    tall = dealt(df, keys).withColumn("tall", F.sum((F.col(h) > F.col(w)).cast("int")).over(by) * 2 > F.count("*").over(by))
    first, second = F.when(F.col("tall"), F.col(cy)).otherwise(F.col(cx)), F.when(F.col("tall"), F.col(cx)).otherwise(F.col(cy))
    t = tall.withColumn("__f", first).withColumn("__s", second)
    win = by.orderBy("__f", "__s", row)
    t = t.withColumn("__g", F.col("__f") - F.lag("__f").over(win))
    t = t.withColumn("__m", F.median("__g").over(by) / 1.5).withColumn("__m", F.when(F.col("__m") > 0, F.col("__m")).otherwise(F.lit(10.0)))
    t = t.withColumn("band", F.sum(F.when(F.col("__g") > F.col("__m"), 1).otherwise(0)).over(win.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return t.withColumn("ord", F.row_number().over(by.orderBy("band", "__s", row))).drop("__f", "__s", "__g", "__m", "tall")


def band_order(df: DataFrame, keys: list[str], band: Column, across: str, ties: list[str], name: str = "ord") -> DataFrame:
    """Numbers rows from 1, bands from the top, inside a band from the left."""
    t = df.withColumn("band", band)
    return t.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("band", across, *ties)))


def split_marginals(df: DataFrame, keys: list[str], cx: str, mid: Column, cy: str, ties: list[str]) -> DataFrame:
    """Side of each marginal and its place on that side from the top."""
    t = df.withColumn("side", F.when(F.col(cx) < mid, "left").otherwise("right"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(cy, *ties)))


def reading_order(df: DataFrame, page: str, group: Column, order: list[str], name: str = "ref") -> DataFrame:
    """Index from 0 over left marginals, text, right marginals, each in its own order."""
    return df.withColumn("grp", group).withColumn(name, (F.row_number().over(Window.partitionBy(page).orderBy("grp", *order)) - 1).cast("int"))


def number_lines(df: DataFrame, page: str, region: str, line: str, cut: bool = False) -> DataFrame:
    """region_0001 and region_0001_line_0001 identifiers; numbers begin at 1. From 10000 on they stay whole unless `cut` to four digits, which leaves them ambiguous."""
    r = F.dense_rank().over(Window.partitionBy(page).orderBy(region))
    n = F.row_number().over(Window.partitionBy(page, region).orderBy(line))
    return df.withColumn("region_id", region_id(r, cut)).withColumn("line_id", line_id(r, n, cut))


def merge_halves(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Lines cut in two (merge_flag 1, then -1) become one, its confidence the mean."""
    w = Window.partitionBy(*keys).orderBy(row)
    left = F.col("merge_flag") == 1
    return (
        df.withColumn("__t", F.lead("text").over(w)).withColumn("__c", F.lead("conf").over(w)).where("merge_flag <> -1")
        .withColumn("text", F.when(left, F.concat_ws(" ", "text", "__t")).otherwise(F.col("text")))
        .withColumn("conf", F.when(left, (F.col("conf") + F.col("__c")) / 2).otherwise(F.col("conf"))).drop("__t", "__c")
    )


def pairwise_order(n: int, before: Callable[[int, int], float]) -> list[int]:
    """Quicksort with the first item as pivot; before(pivot, i) of 0.5 or more puts i after the pivot."""
    done: list[int] = []
    todo = [list(range(n))]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            done += items
            continue
        pivot, rest = items[0], items[1:]
        after = [i for i in rest if before(pivot, i) >= 0.5]
        todo += [after, [pivot], [i for i in rest if i not in set(after)]]
    return done


def xy_cut(boxes: np.ndarray, gap: int = 1) -> list[int]:
    """Order of boxes (x0, y0, x1, y1): cut at every empty band across, else between all columns, each part again; else by y and x."""
    order: list[int] = []

    def gaps(low: np.ndarray, high: np.ndarray) -> list[float]:
        by = np.argsort(low, kind="stable")
        reach = np.maximum.accumulate(high[by])
        return [(reach[i] + low[by][i + 1]) / 2 for i in range(len(by) - 1) if low[by][i + 1] - reach[i] >= gap]

    def cut(own: np.ndarray) -> None:
        b = boxes[own]
        for axis in (1, 0):
            at = gaps(b[:, axis], b[:, axis + 2])
            if at:
                part = np.searchsorted(at, b[:, axis])
                for k in range(len(at) + 1):
                    cut(own[part == k])
                return
        order.extend(own[np.lexsort((own, b[:, 0], b[:, 1]))].tolist())

    if len(boxes):
        cut(np.arange(len(boxes)))
    return order


def xy_cut_order(df: DataFrame, page: str = "page_id", row: str = "region_idx", gap: int = 1) -> DataFrame:
    """(page, row, ord): recursive XY-cut of each page's boxes; a page is never split, and a task streams through its pages."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def ordered(t: pa.Table) -> pa.RecordBatch:
            p = t.column(0)
            boxes_ = np.stack([t.column(i).to_numpy().astype(float) for i in range(2, 6)], 1)
            code = pc.rank(p, "ascending", tiebreaker="dense").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            take, place = [], []
            for a, z in zip(edges, edges[1:]):
                take += [a + i for i in xy_cut(boxes_[a:z], gap)]
                place += range(1, z - a + 1)
            got = t.select([0, 1]).take(pa.array(take, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns), pa.array(place, pa.int32())], names=[page, row, "ord"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            same = pc.fill_null(pc.equal(t.column(0), t.column(0)[-1]), False).to_numpy() if t.column(0)[-1].is_valid else ~t.column(0).is_valid().to_numpy()
            last = int(np.argmax(same))  # the last page may go on in the next batch
            if last:
                yield ordered(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None and rest.num_rows:
            yield ordered(rest)

    pages = df.select(page, row, "x0", "y0", "x1", "y1").repartition(page).sortWithinPartitions(page, row)
    return pages.mapInArrow(run, f"{page} {kinds[page]}, {row} {kinds[row]}, ord int")
