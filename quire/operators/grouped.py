"""Kernels over the rows of a key, whole and in order, streamed through Arrow: no Python process and no Spark group for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


#: Bytes of input files for each partition of `dealt`.
SHARE = 4 << 20


def _input_bytes(df: DataFrame) -> int:
    """Bytes of what the plan reads; 0 where that isn't known."""
    if df.isStreaming or not hasattr(df, "_jdf"):
        return 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 50)  # rows that are no table count as 2**63


def parts(*frames: DataFrame) -> int:
    """Partitions for what these read, so that a task's share stays the same however large they are; 0 where Spark's own number does."""
    n = -(-sum(map(_input_bytes, frames)) // SHARE)
    return n if n > frames[0].sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Rows of equal keys brought together, for windows, groups and joins by them (and more columns).

    Left to itself, Spark joins partitions until there is one for each core, and what a
    task holds grows with the table; here partitions grow in number. Frames to be joined
    take one number, `parts` of all of them.
    """
    n = parts(df) if n is None else n
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def together(sides: list[DataFrame], keys: list[str]) -> list[DataFrame]:
    """Sides of a join by the keys, dealt to the same partitions."""
    n = parts(*sides)
    return [dealt(s, keys, n) for s in sides]


def _starts(batch: pa.RecordBatch, n_keys: int) -> list[int]:
    """Where a key begins in a batch that is sorted by its first columns."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in range(n_keys):
        code = pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new).tolist()


def by_key(df: DataFrame, keys: list[str], order: list[str | Column], kernel: Callable[[pa.Table], pa.Table | Iterator[pa.Table]], schema: str, flush: int = 1 << 16, most: int = 8 << 20) -> DataFrame:
    """What the kernel makes of each key's rows (all columns, keys first, sorted by `order`).

    One exchange by the keys; a task holds the rows of one key at a time, so a key must
    be something of bounded size: a page, a region. What the kernel makes goes on from
    `flush` rows or `most` bytes on, for one row can be an image; what is more than a
    task should hold it yields piece by piece.
    """
    others = [c for c in df.columns if c not in keys]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[pa.Table] = []
        rows = size = 0

        def key(b: pa.RecordBatch, i: int) -> list:
            return [b.column(k)[i].as_py() for k in range(n)]

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal made, rows, size
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()
            made, rows, size = [], 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, size
            got = kernel(pa.Table.from_batches(held).combine_chunks())
            held = []
            for t in [got] if isinstance(got, pa.Table) else got:
                if t.num_rows:
                    made.append(t)
                    rows += t.num_rows
                    size += t.nbytes
                if rows >= flush or size >= most:
                    yield from send()

        for b in batches:
            if not b.num_rows:
                continue
            if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
                yield from close()
            cuts = [*_starts(b, n), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                held.append(b.slice(a, z - a))
                if z < b.num_rows:
                    yield from close()
        if held:
            yield from close()
        yield from send()

    return dealt(df.select(*keys, *others), keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_keys(df: DataFrame, keys: list[str], order: list[str | Column], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """As `by_key` for many small keys: the kernel gets the rows of all keys that end in a batch, and where each begins."""
    others = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            starts = _starts(t.to_batches()[0], len(keys))
            last = starts.pop()  # the last key may go on in the next batch
            if last:
                yield from kernel(t.slice(0, last), np.array(starts)).to_batches()
            rest = t.slice(last)
        if rest is not None:
            yield from kernel(rest, np.zeros(1, np.int64)).to_batches()

    return dealt(df.select(*keys, *others), keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (a, b)."""
    p = np.arange(n)
    while True:
        a, b = p[a], p[b]
        a, b = np.maximum(a, b), np.minimum(a, b)
        live = a != b
        if not live.any():
            return p
        a, b = a[live], b[live]
        np.minimum.at(p, a, b)
        while not np.array_equal(q := p[p], p):
            p = q
