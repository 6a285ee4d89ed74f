"""Exact n-gram Jaccard join: the product of the document by n-gram incidence with its transpose, in blocks.

A document is the set of its word 5-grams (64-bit hashes). Documents with equal sets
are one row of the matrix. Columns are gathered in blocks by hash; there columns of one
row fall away, and the others are dealt again by their first row, so that the columns
that the same rows share (a passage, a group of copies) mostly meet in one block. A
block holds its columns whole, so each gives partial overlap counts of the pairs of
rows that meet in it, and a sum over blocks gives the overlap. There are as many blocks
as leave each about `Config.block` bytes of text; a partition takes its blocks one
after another. Two bounds follow from the set sizes a and b and a threshold p/q: the overlap
is at most min(a, b), so pairs with (p+q) min(a, b) < p (a+b) are never counted, and
at the end pairs with (p+q) overlap < p (a+b) are discarded.

A column of more than `Config.dense` rows (a passage that many documents share)
would alone give dense**2 / 2 pairs. Such columns are left out of the first product;
they go into a list for each row. A pair whose other columns already meet is
completed from the two lists. A pair that can reach the bound by dense columns alone
needs q * dense columns >= p * size in both rows; only such rows take part in a
second product over the dense columns. Its rows are cut into tiles of about
`Config.tile` entries and a task takes two tiles, so no group of rows is ever held
whole; it counts the pairs of a strip of rows at a time, each pair once. So nothing is
cut and every pair is counted exactly.

Each partition of qualifying pairs is folded where it is into link counts and a
spanning forest, so that pairs themselves go no further, and documents with equal sets
are never paired with each other. The pairs of a large group of near copies, whose
number grows with the square of the group, are mostly settled in the task that counts
them, where both rows have most of their dense columns: if the columns there make a
link and all others could not, the link is counted there and nowhere else; if not even
all others could make one, there is none. Only pairs in between are sent on and summed.

`classes`: (doc_id, class_id, links) for each document that has a link: links is the
number of other documents at or over the threshold (those with an equal set too),
class_id the smallest doc_id that can be reached over links. `pairs`: (doc_id,
other_id, overlap, jaccard) between the smallest ids of two different sets; `classes`
tells who else has a set. A document without links is in neither.

Results for odd input: texts that are null, empty or without words have no links; a
text of fewer than five words has one n-gram, all its words; a text of any length is
taken whole; documents without id have no links (`one_of_each` keeps them); rows of
equal doc_id and text are one document (`one_of_each` keeps or drops them together),
rows of equal doc_id and different texts are documents of their own; of documents that
tie for the smallest id the one with the smallest hash of its text leads; an empty
table gives no rows; extra columns are left out here and kept by `one_of_each`,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Blocks, Seen, binary, blocks_for, by_block, drop, exchange, free_names, need, pack_arrays, part_of, release, squeezed, unpack_arrays, unsqueezed, written
from quire.llm.tokens import WORD_RE, gram_hashes, mix, pieces, word_hashes


@dataclass(frozen=True)
class Config:
    n: int = 5
    p: int = 2  # the threshold is p / q
    q: int = 5
    dense: int = 32
    buffer: int = 1_000_000  # n-grams that a task gathers before it sends them
    block: int = 8 << 20  # bytes of text whose columns make a block
    tile: int = 250_000  # entries of dense columns in a tile


PART = "kind int, x bigint, y bigint, c int, sx int, sy int, part int, blob binary"
PAIR = "x bigint, y bigint, c int, sx int, sy int"


def distinct_grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, document of each, hash of each document's set, its size); the grams of a document are distinct."""
    g, ptr = gram_hashes(*word_hashes(texts), n)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.argsort(g)
    # few documents: a stable sort of small integers takes one pass
    order = order[np.argsort(doc[order].astype(np.uint16) if len(ptr) < 1 << 16 else doc[order], kind="stable")]
    g, doc = g[order], doc[order]
    if len(g):
        keep = np.append(True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1]))
        g, doc = g[keep], doc[keep]
    size = np.bincount(doc, minlength=len(ptr) - 1)
    sums = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        sums[full] = np.add.reduceat(mix(g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), (np.cumsum(size) - size)[full])
    return g, doc, mix(sums + size.astype(np.uint64)), size


def _incidence(docs: DataFrame, config: Config, blocks: Blocks) -> DataFrame:
    """(part, blob): the entries of each block of columns, and which documents have which set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, seen = 0, Seen()

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if not held:
                return
            base = np.cumsum([0, *(len(h[2]) for h in held)])
            g = np.concatenate([h[0] for h in held])
            row = np.concatenate([h[1] + b for h, b in zip(held, base)])
            sets, size = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.uint32)
            owner = np.concatenate([h[4] + b for h, b in zip(held, base)])
            ids, texts = np.concatenate([h[5] for h in held]), np.concatenate([h[6] for h in held])
            held, count = [], 0
            order = np.argsort(g)
            g, row = g[order], row[order]
            part = part_of(g, blocks.all)
            # who has a set is told anywhere, so that copies in any number are spread
            home = part_of(mix(texts ^ ids.view(np.uint64)), blocks.all)
            by_home = np.argsort(home, kind="stable")
            which = np.union1d(part, home)
            cut, home_cut = ([*np.searchsorted(x, which), len(x)] for x in (part, home[by_home]))
            blobs = []
            for i in range(len(which)):
                e, o = slice(cut[i], cut[i + 1]), by_home[home_cut[i] : home_cut[i + 1]]
                used, local = np.unique(row[e], return_inverse=True)
                blobs.append(squeezed(pack_arrays(np.diff(g[e], prepend=np.uint64(0)), local.astype(np.uint32), sets[used], size[used], sets[owner[o]], size[owner[o]], ids[o], texts[o])))
            for a in range(0, len(which), 64):
                yield pa.RecordBatch.from_arrays([pa.array(which[a : a + 64].astype(np.int32)), binary(blobs[a : a + 64])], names=["part", "blob"])

        for b in pieces(batches, "text", 2 << 20):
            g, doc, sets, size = distinct_grams(b.column(1), config.n)
            some = np.flatnonzero(size)
            new, first = np.unique(sets[some], return_index=True)
            rows = some[first[seen.new(new)]]  # one document of each set not yet seen
            number = np.full(len(size), -1)
            number[rows] = np.arange(len(rows))
            take = number[doc] >= 0
            g, row = g[take], number[doc[take]]
            # every document with words is listed under its set, also under a set seen before
            all_sets = np.concatenate([sets[rows], sets[some]])
            ids, texts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((g, row, all_sets, np.concatenate([size[rows], size[some]]), len(rows) + np.arange(len(some)), ids[some], texts[some]))
            count += len(g)
            if count >= config.buffer:
                yield from send()
                release()
        yield from send()
        release()

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("r"))
    return rows.mapInArrow(run, "part int, blob binary")


def column_pairs(col: np.ndarray, row: np.ndarray, size: np.ndarray, config: Config, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, count) of the rows that meet in columns, x < y; entries are sorted by column and row, a pair can come several times."""
    if not len(col):
        return
    n = len(size)
    start = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    df = np.diff(np.append(start, len(col)))
    held, count = [], 0
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the sums so far

    def add() -> None:
        """Takes what is held into the sums."""
        nonlocal keys, times, held, count
        k = np.concatenate(held)
        k.sort()
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        k, t = np.concatenate([keys, k[at]]), np.concatenate([times, np.diff(np.append(at, len(k)))])
        order = np.argsort(k, kind="stable")
        k, t = k[order], t[order]
        at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        keys, times, held, count = k[at], np.add.reduceat(t, at), [], 0

    for d in np.unique(df[df > 1]).tolist():
        starts = start[df == d]
        for i in range(d - 1):  # one diagonal of the triangle at a time, all columns of this size at once
            step = max(1, most // (d - 1 - i))
            for a in range(0, len(starts), step):
                s = starts[a : a + step]
                x = np.repeat(row[s + i], d - 1 - i)
                y = row[(s[:, None] + np.arange(i + 1, d)).ravel()]
                sx, sy = size[x], size[y]
                ok = (config.p + config.q) * np.minimum(sx, sy) >= config.p * (sx + sy)
                if not ok.any():
                    continue
                held.append(x[ok] * n + y[ok])
                count += len(held[-1])
                if count >= most:
                    add()
                    if len(keys) > most:
                        yield keys // n, keys % n, times
                        keys, times = keys[:0], times[:0]
    if count:
        add()
    if len(keys):
        yield keys // n, keys % n, times


def _gathered(blobs: DataFrame, config: Config, blocks: Blocks) -> DataFrame:
    """kind 1: (row, dense column); 2: (row, doc_id, size, text hash in two halves); 3: (part, blob), the other columns of two rows or more for the block of their first row."""
    names = [x.split()[0] for x in PART.split(", ")]

    def out(kind: int, x, y, c=None, sx=None, sy=None) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), 1 << 16):
            cut = slice(a, a + (1 << 16))
            n = len(x[cut])
            ints = [pa.nulls(n, pa.int32()) if v is None else pa.array(v[cut].astype(np.int32)) for v in (c, sx, sy)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(x[cut].view(np.int64)), pa.array(y[cut].view(np.int64)), *ints, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)

    def deal(name: np.ndarray, size: np.ndarray, row: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Columns of df rows each, one after another in `row`, ascending."""
        start = np.cumsum(df) - df
        part = part_of(mix(name[row[start]]), blocks.all)
        order = np.argsort(part, kind="stable")
        which, cut = np.unique(part[order], return_index=True)
        for p, own in zip(which.tolist(), np.split(order, cut[1:])):
            d = df[own]
            at = np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(start[own], d)
            used, local = np.unique(row[at], return_inverse=True)
            blob = pack_arrays(d.astype(np.uint32), local.astype(np.uint32), name[used], size[used].astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(2)), *(pa.nulls(1, pa.int32()) for _ in range(3)), pa.array([p], pa.int32()), binary([blob])], names=names)

    def block(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        cols, rows, sets, sizes, base = [], [], [], [], 0
        for raw in blobs:
            g, local, s, z, own, own_size, ids, texts = unpack_arrays(unsqueezed(raw), np.uint64, np.uint32, np.uint64, np.uint32, np.uint64, np.uint32, np.int64, np.uint64)
            cols.append(np.cumsum(g, dtype=np.uint64))
            rows.append(local.astype(np.int64) + base)
            base += len(s)
            sets.append(s)
            sizes.append(z)
            halves = texts.view(np.int32).reshape(-1, 2)
            yield from out(2, own, ids, own_size, halves[:, 0], halves[:, 1])
        if not base:
            return
        name, first, number = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first].astype(np.int64)
        col, row = np.concatenate(cols), number[np.concatenate(rows)]
        del cols, rows, sets, sizes
        order = np.argsort(col)
        col, row = col[order], row[order]
        same = col[1:] == col[:-1]  # most columns have one row and fall away before the slower sort
        some = np.append(same, False) | np.append(False, same)
        col, row = col[some], row[some]
        if not len(col):
            return
        order = np.lexsort((row, col))
        col, row = col[order], row[order]
        keep = np.append(True, (col[1:] != col[:-1]) | (row[1:] != row[:-1]))
        col, row = col[keep], row[keep]
        start = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
        d = np.diff(np.append(start, len(col)))
        df = np.repeat(d, d)
        hot = df > config.dense
        yield from out(1, name[row[hot]], col[hot])
        yield from deal(name, size, row[(df > 1) & ~hot], d[(d > 1) & (d <= config.dense)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in by_block(batches):
            yield from block(blobs)

    return blobs.select("part", "blob").mapInArrow(run, PART)


def _products(blobs: DataFrame, config: Config) -> DataFrame:
    """(x, y, partial overlap, sizes) of the rows that meet in each block's columns."""
    names = [x.split()[0] for x in PAIR.split(", ")]

    def block(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        df, rows, sets, sizes, base = [], [], [], [], 0
        for raw in blobs:
            d, local, s, z = unpack_arrays(raw, np.uint32, np.uint32, np.uint64, np.uint32)
            df.append(d)
            rows.append(local.astype(np.int64) + base)
            base += len(s)
            sets.append(s)
            sizes.append(z)
        name, first, number = np.unique(np.concatenate(sets), return_index=True, return_inverse=True)
        size, d = np.concatenate(sizes)[first].astype(np.int64), np.concatenate(df)
        for x, y, c in column_pairs(np.repeat(np.arange(len(d)), d), number[np.concatenate(rows)], size, config):
            for a in range(0, len(x), 1 << 16):
                cut = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([*(pa.array(name[v[cut]].view(np.int64)) for v in (x, y)), *(pa.array(v.astype(np.int32)) for v in (c[cut], size[x[cut]], size[y[cut]]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in by_block(batches):
            yield from block(blobs)

    return blobs.select("part", "blob").mapInArrow(run, PAIR)


def row_pairs(col: np.ndarray, row: np.ndarray, size: np.ndarray, config: Config, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, count) of the rows that meet in columns, x < y, each pair once with its whole count; entries are sorted by column and row.

    Rows are taken in strips of about `most` meetings. Columns of an eighth of all rows or more are multiplied as a matrix, of at most 32 bytes an entry.
    """
    n = len(size)
    if not len(col):
        return
    start = np.flatnonzero(np.append(True, col[1:] != col[:-1]))
    df = np.diff(np.append(start, len(col)))
    wide = 8 * df >= n
    matrix = np.zeros((n, int(wide.sum())), np.float32)
    inside = np.repeat(wide, df)
    matrix[row[inside], np.repeat(np.cumsum(wide) - 1, df)[inside]] = 1
    later = np.where(inside, 0, np.repeat(start + df, df) - np.arange(len(col)) - 1)  # entries of the column after this one
    at = np.argsort(row, kind="stable")
    later = later[at]
    meet = np.concatenate([[0], np.cumsum(np.bincount(row[at], later, n).astype(np.int64))])
    ends = np.searchsorted(row[at], np.arange(n + 1))
    a = 0
    while a < n:
        span = n - a  # y runs from a
        tall = max(1, 2 * most // span)
        b = max(a + 1, int(np.searchsorted(meet, meet[a] + most, side="right")) - 1)
        b = min(b, n, a + tall) if matrix.shape[1] or b == a + 1 else min(b, n)
        full = matrix.shape[1] > 0 or b == a + 1 or (b - a) * span <= 2 * most
        counts = (matrix[a:b] @ matrix[a:].T).astype(np.int32).ravel() if matrix.shape[1] else np.zeros((b - a) * span, np.int32) if full else None
        lo, keys, times = ends[a], np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = np.cumsum(later[lo : ends[b]])
        while lo < ends[b]:  # one turn, but for a row of very many meetings
            base = sums[lo - ends[a] - 1] if lo > ends[a] else 0
            hi = max(lo + 1, ends[a] + int(np.searchsorted(sums, base + most, side="right")))
            w = later[lo:hi]
            y = row[np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(at[lo:hi] + 1, w)]
            k = np.repeat((row[at[lo:hi]] - a) * span - a, w) + y
            if full:
                if len(k):
                    counts += np.bincount(k, minlength=len(counts)).astype(np.int32)
            else:
                keys, times = np.unique(k, return_counts=True)
            lo = hi
        if full:
            keys = np.flatnonzero(counts)
            times = counts[keys]
        x, y = keys // span + a, keys % span + a
        ok = (y > x) & ((config.p + config.q) * np.minimum(size[x], size[y]) >= config.p * (size[x] + size[y]))
        if ok.any():
            yield x[ok], y[ok], times[ok].astype(np.int64)
        a = b


def _dealt(dense: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(dense columns (x, col, size, n) with their tiles, once for each task that takes them; home of each row: the group that holds most of its columns, and these columns)."""
    # columns with the same first row go together: those of a group of near copies mostly do, so its pairs meet in few tasks
    first = dense.groupBy("col").agg(F.min("x").alias("first"), F.count("*").alias("k"))
    groups = first.groupBy("first").agg(F.sum("k").alias("k")).withColumn("tiles", F.ceil(F.col("k") / config.tile).cast("int"))
    total = int(groups.agg(F.sum("k")).first()[0] or 0)
    bins = -(-total // config.tile) or 1
    one = F.col("tiles") == 1
    own = first.select("col", "first").join(groups.select("first", "tiles"), "first")
    own = own.select("col", "tiles", one.alias("one"), F.when(one, F.pmod(F.xxhash64("first"), F.lit(bins))).otherwise(F.col("first")).alias("g"))
    placed = dense.join(own, "col")
    part = placed.groupBy("x", "one", "g").agg(F.collect_list("col").alias("own"))  # no longer than its document
    homes = written(part.groupBy("x").agg(F.max(F.struct(F.size("own").alias("k"), "one", "g", "own")).alias("h")).select("x", F.struct("h.one", "h.g").alias("home"), "h.own"), "homes")
    dealt = placed.join(homes.select("x", "home"), "x").withColumn("home", F.struct("one", "g") == F.col("home")).withColumn("tile", F.pmod(F.xxhash64("x"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("i", F.least("tile", "k")).withColumn("j", F.greatest("tile", "k"))
    return dealt.select("x", "col", "size", "n", "home", "tile", "one", "g", "i", "j"), homes


def settled(c, least, both, config: Config):
    """Whether an overlap of c in the group of columns that is the home of both rows makes a link, and what other columns can add makes none."""
    p, q = config.p, config.q
    return ((p + q) * c >= p * both) & ((p + q) * (least - c) < p * both)


def _dense_products(dealt: DataFrame, config: Config, settle: bool) -> DataFrame:
    """Over dense columns: (x, y, partial overlap, sizes) of pairs that may still become links; with n, what settled pairs are folded to: node x, its leader y, its linked documents n."""
    kinds = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("c", pa.int32()), ("sx", pa.int32()), ("sy", pa.int32()), ("n", pa.int64())])
    p, q = config.p, config.q

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, two = [], False
        for b in batches:
            if b.num_rows:
                two = b.column("i")[0].as_py() != b.column("j")[0].as_py()
                held.append([b.column(k).to_numpy(zero_copy_only=False) for k in ("x", "col", "size", "n", "tile", "home")])
        if not held:
            return
        xs, col, sizes, ns, tiles, homes = (np.concatenate([h[i] for h in held]) for i in range(6))
        del held
        name, at, row = np.unique(xs, return_index=True, return_inverse=True)
        size, number, tile, home = sizes[at].astype(np.int64), ns[at].astype(np.int64), tiles[at], homes[at].astype(bool)
        del xs, sizes, ns, tiles, homes
        order = np.lexsort((row, col))
        col, row = col[order], row[order]
        del order
        other = size - np.bincount(row, minlength=len(name))  # a row's columns that are not in this group
        root, links = np.arange(len(name)), np.zeros(len(name), np.int64)
        for x, y, c in row_pairs(col, row, size, config):
            both, least = size[x] + size[y], np.minimum(size[x], size[y])
            keep = (p + q) * np.minimum(c + np.minimum(other[x], other[y]), least) >= p * both
            if two:  # pairs inside a tile are counted where it meets itself
                keep &= tile[x] != tile[y]
            if settle:
                done = keep & home[x] & home[y] & settled(c, least, both, config)
                u, v = x[done], y[done]
                if len(u):
                    links += np.bincount(u, number[v], len(name)).astype(np.int64) + np.bincount(v, number[u], len(name)).astype(np.int64)
                    new = root[u] != root[v]
                    root = local_roots(len(name), np.concatenate([np.arange(len(name)), u[new]]), np.concatenate([root, v[new]])) if new.any() else root
                keep &= ~done
            x, y, c = x[keep], y[keep], c[keep]
            for a in range(0, len(x), 1 << 16):
                u, v = x[a : a + (1 << 16)], y[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[v]), *(pa.array(k.astype(np.int32)) for k in (c[a : a + (1 << 16)], size[u], size[v])), pa.nulls(len(u), pa.int64())], schema=kinds)
        some = np.flatnonzero(links)
        for a in range(0, len(some), 1 << 16):
            u = some[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(name[u]), pa.array(name[root[u]]), *(pa.nulls(len(u), pa.int32()) for _ in range(3)), pa.array(links[u])], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from group(batches)
        release()

    return dealt.groupBy("one", "g", "i", "j").applyInArrow(run, PAIR + ", n bigint")


def _counted(docs: DataFrame, config: Config, settle: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(pairs of sets with overlap, sizes and numbers of documents; settled pairs, folded; sets with first document, number and size; set, id and text of every document; tables to drop)."""
    need(docs, "doc_id", "text")
    p, q = config.p, config.q
    blocks = blocks_for(docs, "text", config.block)
    made = written(_gathered(exchange(_incidence(docs, config, blocks), blocks), config, blocks), "columns")
    few = _products(exchange(made.where("kind = 3").select("part", "blob"), blocks), config)
    r = F.shiftleft(F.col("sy").cast("bigint"), 32).bitwiseOR(F.col("sx").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    members = made.where("kind = 2").select("x", F.struct(F.col("y").alias("id"), r.alias("r")).alias("doc"), F.col("c").alias("size")).distinct()
    sets = members.groupBy("x").agg(F.min("doc").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"))
    dense = made.where("kind = 1").select("x", F.col("y").alias("col"))
    heavy = (
        dense.groupBy("x").agg(F.count("*").alias("k"))
        .join(sets.select("x", "size", "n"), "x").where(F.col("k") * q >= F.col("size") * p).select("x", "size", "n")
    )
    strong = written(dense.join(heavy, "x"), "dense")
    dealt, homes = _dealt(strong, config)
    done = written(_dense_products(dealt, config, settle), "products")
    more = done.where("n is null")
    lists = dense.groupBy("x").agg(F.collect_list("col").alias("cols"))  # no longer than its document
    info = sets.select("x", "n", "size").join(lists, "x", "left").join(homes, "x", "left")
    of = lambda k: info.select(F.col("x").alias(k), *(F.col(c).alias(c + k) for c in ("n", "size", "cols", "home", "own")))
    both = (
        few.select("x", "y", "c", F.lit(False).alias("d"), (F.col("sx") + F.col("sy")).alias("both"))
        .unionByName(more.select("x", "y", "c", F.lit(True).alias("d"), (F.col("sx") + F.col("sy")).alias("both")))
    )
    # x and y come in any order of their hashes; dealt by x, the sum needs no exchange of its own and neither does the join to the lists
    sums = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "c", "d", "both").repartition(blocks.parts, "x")
    pairs = sums.groupBy("x", "y").agg(F.sum(F.when(~F.col("d"), F.col("c")).otherwise(0)).alias("few"), F.sum(F.when(F.col("d"), F.col("c"))).alias("many"), F.max("both").alias("both"))
    reaches = lambda n: (p + q) * n >= p * F.col("both")
    known = F.col("few") + F.coalesce("many", F.lit(0))
    may = pairs.join(of("x"), "x").where(reaches(known) | F.col("many").isNull() & reaches(F.col("few") + F.coalesce(F.size("colsx"), F.lit(0))))
    may = may.withColumns({c: F.when(F.col("many").isNull(), F.col(c)) for c in ("colsx", "homex", "ownx")})  # the others have their dense overlap: no need to send the lists on
    kept = (
        may.join(of("y"), "y")
        .withColumn("total", F.col("few") + F.coalesce("many", F.size(F.array_intersect("colsx", "colsy")), F.lit(0))).where(reaches(F.col("total")))
    )
    if settle:  # a pair whose partial dense overlap came on cannot be one of the settled; those without any are looked up in their lists
        before = (F.col("homex") == F.col("homey")) & settled(F.size(F.array_intersect("ownx", "owny")), F.least("sizex", "sizey"), F.col("both"), config)
        kept = kept.where(~F.coalesce(before, F.lit(False)))
    return kept.select("x", "y", F.col("total").alias("overlap"), "both", "nx", "ny"), done.where("n is not null").select(F.col("x").alias("u"), F.col("y").alias("v"), "n"), sets, members, [made, strong, homes, done]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges."""
    p = np.arange(n)
    while True:
        a, b = p[a], p[b]
        a, b = np.maximum(a, b), np.minimum(a, b)
        open_ = a != b
        if not open_.any():
            return p
        a, b = a[open_], b[open_]
        np.minimum.at(p, a, b)
        while not np.array_equal(q := p[p], p):
            p = q


def fold(pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(u, v, n) from (x, y, nx, ny): of each partition, its nodes u with the node v that leads their component there, and the documents n that they are linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root, times = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[list[np.ndarray]] = []
        count = 0

        def take() -> None:
            nonlocal node, root, times, held, count
            x, y, nx, ny = (np.concatenate([h[i] for h in held]) for i in range(4))
            held, count = [], 0
            name, at = np.unique(np.concatenate([node, root, x, y]), return_inverse=True)
            k = len(node)
            own, to, a, b = at[:k], at[k : 2 * k], at[2 * k : 2 * k + len(x)], at[2 * k + len(x) :]
            sums = np.zeros(len(name), np.int64)
            for i, w in ((own, times), (a, ny), (b, nx)):
                sums += np.bincount(i, w, len(name)).astype(np.int64)
            node, times = name, sums
            root = name[local_roots(len(name), np.concatenate([own, a]), np.concatenate([to, b]))]

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(times)], names=["u", "v", "n"])

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            count += b.num_rows
            if count >= most:
                take()
                if len(node) >= most:
                    yield send()
                    node, root, times = node[:0], root[:0], times[:0]
        if count:
            take()
        if len(node):
            yield send()

    return pairs.select("x", "y", "nx", "ny").mapInArrow(run, "u bigint, v bigint, n bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the smallest node of its component.

    Large-star and small-star steps; each step is written, so lineage stays short.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "stars")
        drop(before)
        after = tuple(now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())
        if after == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after


def _classified(docs: DataFrame, config: Config) -> DataFrame:
    """(doc, lead, links): id and text hash of every document with a link, those of its class's first document, the number of links."""
    pairs, done, sets, members, old = _counted(docs, config, True)
    folded = written(fold(pairs).unionByName(done), "links")
    sets, members = written(sets, "sets"), written(members.select("x", "doc"), "members")
    drop(*old)
    links = folded.groupBy("u").agg(F.sum("n").alias("l")).select(F.col("u").alias("x"), "l")
    found = components(folded.select("u", "v")).select(F.col("node").alias("x"), "root")
    known = sets.select("x", "first", "n").join(links, "x", "left").join(found, "x", "left").where("n > 1 or l is not null")
    known = known.withColumn("root", F.coalesce("root", "x"))
    lead = known.groupBy("root").agg(F.min("first").alias("lead"))
    own = known.join(lead, "root").select("x", "lead", (F.coalesce("l", F.lit(0)) + F.col("n") - 1).alias("links"))
    return members.join(own, "x").select("doc", "lead", "links")


def classes(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, class_id, links); see above."""
    return _classified(docs, config).select(F.col("doc.id").alias("doc_id"), F.col("lead.id").alias("class_id"), "links")


def pairs(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, other_id, overlap, jaccard) between the first documents of different sets; see above."""
    found, _, sets, _, _ = _counted(docs, config, False)
    first = sets.select("x", F.col("first.id").alias("id"))
    both = found.join(first.withColumnRenamed("id", "i"), "x").join(first.select(F.col("x").alias("y"), F.col("id").alias("j")), "y")
    return both.select(F.least("i", "j").alias("doc_id"), F.greatest("i", "j").alias("other_id"), "overlap", F.round(F.col("overlap") / (F.col("both") - F.col("overlap")), 6).alias("jaccard"))


def one_of_each(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The documents without those of a class but its first one."""
    i, r = free_names(docs, "__gone_id", "__gone_text")
    gone = _classified(docs, config).where("doc <> lead").select(F.col("doc.id").alias(i), F.col("doc.r").alias(r))
    return docs.join(gone, (F.col("doc_id").cast("bigint") == F.col(i)) & (F.xxhash64("text") == F.col(r)), "left_anti")


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) ELSE [array_to_string(ws, ' ')] END)) AS gs
  FROM w WHERE len(ws) > 0
), u AS (SELECT gs, min(doc_id) AS first, count(*) AS n FROM s GROUP BY gs),
v AS MATERIALIZED (SELECT row_number() OVER () AS k, gs, first, n, len(gs) AS size FROM u),
e AS (SELECT k, unnest(gs) AS g FROM v),
o AS (SELECT a.k AS x, b.k AS y, count(*) AS overlap FROM e a JOIN e b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN v a ON a.k = x JOIN v b ON b.k = y WHERE 7 * overlap >= 2 * (a.size + b.size)),
b AS MATERIALIZED (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT k AS node, k AS seen FROM v UNION SELECT c.node, b.v FROM c JOIN b ON b.u = c.seen),
m AS (SELECT node, min(first) AS class_id FROM c JOIN v ON k = seen GROUP BY node),
d AS (SELECT u AS node, sum(n) AS links FROM b JOIN v ON k = b.v GROUP BY u)
SELECT doc_id, class_id, (coalesce(links, 0) + n - 1)::BIGINT AS links
FROM s JOIN v USING (gs) JOIN m ON m.node = k LEFT JOIN d ON d.node = k WHERE n > 1 OR links IS NOT NULL
"""
