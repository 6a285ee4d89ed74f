"""Line deduplication within a few edits: segment-partition join with bit-parallel verification.

A line is what stands between line feeds. A line that isn't empty is dropped if an
equal line stands at an earlier place, ordered by (doc_id, line number); a line of at
least `Config.least` bytes also if such a line within `Config.tau` edits stands
earlier, for in shorter ones so many edits make another line. Edits insert, delete or
replace one byte of UTF-8. Empty lines stay.

The join: two lines within tau edits share one of the tau + 1 segments into which the
shorter is cut, at nearly its own place. Every distinct line is indexed under
(length, segment number, segment) and probes, for each length from its own less tau
to its own, the substrings that can be a segment under the multi-match bounds. Keys
are dealt by hash to blocks of about `Config.block` bytes of text as packed arrays with
a hash and a letter count for each line, never its text. Lines that meet and whose
letter counts differ by at most 2 tau are candidates. A second scan sends just their
texts, found by a Bloom filter of their hashes, or by a join where the filter would be
larger than `Config.filter_bits`; a banded bit-vector (Hyyrö 2003) run on many pairs at
once decides. Copies of a line are one line throughout and the places of a line are
dealt by document, so hot lines cost nothing. Lines are told apart by 64-bit hashes
(see tokens.span_hashes).

Results for odd input: null and empty texts have no lines to drop and stay; a null
doc_id comes before all others; an empty table stays empty; a text of any length is
taken whole. `dropped` names places by (doc_id, line number), so to it rows of equal
doc_id are the same document and a line repeated at the same place stays. `dedup`
tells rows of equal doc_id apart by a hash of their text, which also orders them; only
rows of equal doc_id and text are the same document, and stay both; with a null doc_id
each row is one of its own, and of equal texts one stays. It keeps all columns, whatever
they are called; n_chars, if there, follows the text; a document with dropped lines of
which only empty ones are left goes, any other stays, with its remaining lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Blocks, Seen, binary, blocks_for, by_block, col, drop, exchange, free_names, need, pack_arrays, part_of, plain, unpack_arrays, written
from quire.llm.tokens import mix, pieces, span_hashes, utf8

NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Config:
    tau: int = 2
    least: int = 24  # bytes from which tau edits don't count
    buffer: int = 2_000_000  # keys that a task gathers before it sends them
    block: int = 8 << 20  # bytes of text whose keys make a block
    filter_bits: int = 1 << 29  # of the largest Bloom filter that is broadcast, 16 for each candidate


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, end, text, number) of every line; an empty text has one empty line."""
    feeds = np.flatnonzero(raw == 10)
    owner = np.searchsorted(off, feeds, "right") - 1
    first = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    end = np.sort(np.concatenate([feeds, off[1:]]), kind="stable")
    text = np.sort(np.concatenate([np.arange(len(off) - 1), owner]), kind="stable")
    lead = np.searchsorted(text, np.arange(len(off) - 1))
    return first, end, text, np.arange(len(text)) - lead[text] if len(text) else text


def segments(length: np.ndarray, tau: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(start, size) of each of tau + 1 segments of lines of these lengths; the last ones take the remainder."""
    base, extra = length // (tau + 1), length % (tau + 1)
    size = [base + (i >= tau + 1 - extra) for i in range(tau + 1)]
    start, at = [], np.zeros_like(length)
    for s in size:
        start.append(at)
        at = at + s
    return start, size


def line_keys(raw: np.ndarray, first: np.ndarray, end: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, is it an index key too) of all keys of the lines."""
    n = end - first
    at, sizes, salts, own = [], [], [], []
    for delta in range(tau + 1):
        shorter = n - delta
        start, size = segments(shorter, tau)
        for i in range(tau + 1):
            low, high = max(-i, delta - (tau - i)), min(i, delta + (tau - i))
            for shift in range(low, high + 1):
                at.append(start[i] + shift)
                sizes.append(size[i])
                salts.append(shorter.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))
                own.append(delta == 0 and shift == 0)
    # all probes of a line side by side, so that its bytes are summed once
    a, size, salt = (np.stack(x, 1) for x in (at, sizes, salts))
    ok = (size > 0) & (a >= 0) & (a + size <= n[:, None])
    a = np.where(ok, a, 0) + first[:, None]
    key = mix(span_hashes(raw, a, a + np.where(ok, size, 0), first) + salt * np.uint64(0x9E3779B97F4A7C15))
    line, probe = np.nonzero(ok)
    return key[line, probe], line, np.array(own)[probe]


def within(raw_a: np.ndarray, off_a: np.ndarray, raw_b: np.ndarray, off_b: np.ndarray, tau: int, batch: int = 1 << 22) -> np.ndarray:
    """Whether the edit distance of each pair is at most tau."""
    la, lb = np.diff(off_a), np.diff(off_b)
    ok = np.abs(la - lb) <= tau
    out = np.zeros(len(la), bool)
    todo = np.flatnonzero(ok)
    todo = todo[np.argsort(la[todo], kind="stable")]
    at = 0
    while at < len(todo):
        stop = len(todo)
        while stop - at > 1 and (stop - at) * (int(la[todo[stop - 1]]) + 2 * tau) > batch:
            stop = at + (stop - at) // 2
        t = todo[at:stop]
        out[t] = _band(raw_a, off_a[t], la[t], raw_b, off_b[t], lb[t], tau)
        at = stop
    return out


def _band(raw_a, at_a, la, raw_b, at_b, lb, tau: int) -> np.ndarray:
    """The band of 2 tau + 1 diagonals as the top bits of a word, one word for each pair, one text byte a step."""
    n, width, steps = len(la), 2 * tau + 1, int(lb.max(initial=0))
    pad_a = np.full((n, steps + 2 * tau + 1), -1, np.int16)
    cols = np.arange(pad_a.shape[1] - tau)
    inside = cols < la[:, None]
    pad_a[:, tau:][inside] = raw_a[(at_a[:, None] + cols)[inside]]
    b = np.full((n, steps), -2, np.int16)
    cols = np.arange(steps)
    inside = cols < lb[:, None]
    b[inside] = raw_b[(at_b[:, None] + cols)[inside]]
    eq = np.zeros((n, steps), np.uint16)
    for k in range(width):  # bit k: pattern place j - tau + k, at pad_a column j + k
        eq |= (pad_a[:, k : k + steps] == b).astype(np.uint16) << np.uint16(k)
    eq = np.ascontiguousarray(eq.T)
    top = np.uint16(1 << (width - 1))
    full = np.uint16((1 << width) - 1)
    vp = np.full(n, full & ~np.uint16((1 << tau) - 1), np.uint16)
    vn = np.zeros(n, np.uint16)
    dist = np.full(n, tau, np.int32)
    for j in range(steps):
        x = eq[j]
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        across = j >= la - tau  # the band's upper edge has reached the end of the pattern
        live = j < lb
        dist += live & ~across & ((d0 & top) == 0)
        if across.any():
            bit = np.clip(width - 2 - (j - (la - tau)), 0, width)
            dist += live & across & ((hp >> bit.astype(np.uint16)) & 1).astype(bool)
            dist -= live & across & ((hn >> bit.astype(np.uint16)) & 1).astype(bool)
        shifted = d0 >> np.uint16(1)
        vp = (hn | ~(shifted | hp)) & full
        vn = shifted & hp
    return dist <= tau


def letter_counts(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each line has bytes of each of eight kinds, modulo 256, in one word; an edit changes the sum of differences by two at most."""
    kind, out = raw & 7, np.empty((len(first), 8), np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint8)
    for k in range(8):
        np.cumsum(kind == k, dtype=np.uint8, out=sums[1:])
        out[:, k] = sums[end] - sums[first]
    return out.view(np.uint64).ravel()


def _alike(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    d = a.view(np.uint8) - b.view(np.uint8)
    return np.minimum(d, -d).reshape(-1, 8).sum(1, dtype=np.int64) <= 2 * tau


def _entries(docs: DataFrame, config: Config, blocks: Blocks, by_row: bool) -> DataFrame:
    """(part, blob): keys with the hash and letter count of their line, and the places of lines; by_row: with a hash of the text, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        places: list[tuple] = []
        count, lines, seen = 0, 0, Seen()

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, places, count, lines
            if not places:
                return
            key, line, both, name, letters = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int64, bool, np.uint64, np.uint64)))
            order = np.argsort(key)
            key, line, both = key[order], line[order], both[order]
            where, doc, number, text = (np.concatenate([p[i] for p in places]) for i in range(4))
            part = part_of(key, blocks.all)
            # places go anywhere, so that a hot line is spread
            home = part_of(mix(doc.view(np.uint64) + text + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), blocks.all)
            by = np.argsort(home, kind="stable")
            which = np.union1d(part, home)
            cut, home_cut = ([*np.searchsorted(x, which), len(x)] for x in (part, home[by]))
            held, places, count, lines = [], [], 0, 0
            blobs = []
            for i in range(len(which)):
                e, o = slice(cut[i], cut[i + 1]), by[home_cut[i] : home_cut[i + 1]]
                used, local = np.unique(line[e], return_inverse=True)
                blobs.append(pack_arrays(np.diff(key[e], prepend=np.uint64(0)), (local * 2 + both[e]).astype(np.uint32), name[used], letters[used], where[o], doc[o], number[o], text[o]))
            for a in range(0, len(which), 64):
                yield pa.RecordBatch.from_arrays([pa.array(which[a : a + 64].astype(np.int32)), binary(blobs[a : a + 64])], names=["part", "blob"])

        for b in pieces(batches, "text"):
            raw, off = utf8(b.column(1))
            first, end, text, number = line_spans(raw, off)
            some = np.flatnonzero(end > first)
            if not len(some):
                continue
            first, end, text, number = first[some], end[some], text[some], number[some]
            h = span_hashes(raw, first, end)
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            row = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            places.append((h, ids[text], number.astype(np.int32), row[text]))
            long = np.flatnonzero(end - first >= config.least)
            new, one = np.unique(h[long], return_index=True)
            one = np.sort(long[one[seen.new(new)]])
            key, line, both = line_keys(raw, first[one], end[one], config.tau)
            held.append((key, line + lines, both, h[one], letter_counts(raw, first[one], end[one])))
            lines += len(one)
            count += len(key) + len(h)
            if count >= config.buffer:
                yield from send()
        yield from send()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", (F.xxhash64("text") if by_row else F.lit(0).cast("bigint")).alias("r")).mapInArrow(run, "part int, blob binary")


def _meetings(blobs: DataFrame, config: Config) -> DataFrame:
    """kind 0: two different lines that share a key; kind 1: a line with its doc_id, number and row."""

    def rows(kind: int, x, y, number=None, row=None) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(x), 1 << 16):
            c = slice(a, a + (1 << 16))
            n = len(x[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(x[c].view(np.int64)), pa.array(y[c].view(np.int64)), pa.nulls(n, pa.int32()) if number is None else pa.array(number[c]), pa.nulls(n, pa.int64()) if row is None else pa.array(row[c].view(np.int64))], names=["kind", "x", "y", "number", "row"])

    def pairs(key: np.ndarray, line: np.ndarray, both: np.ndarray, names: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
        """In every group of a key: each of its index lines with every other line."""
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        indexed = np.add.reduceat(both.astype(np.int64), start)
        n = len(names)
        held, count = [], 0

        def found() -> Iterator[pa.RecordBatch]:
            k = np.unique(np.concatenate(held))
            yield from rows(0, names[k // n], names[k % n])

        busy = (size > 1) & (indexed > 0)
        for d in np.unique(size[busy]).tolist():
            own = start[busy & (size == d)]
            for i in range(d):
                for a in range(0, len(own), max(1, (1 << 21) // d)):
                    s = own[a : a + max(1, (1 << 21) // d)]
                    s = s[both[s + i]]
                    x = np.repeat(line[s + i], d)
                    y = line[(s[:, None] + np.arange(d)).ravel()]
                    low, high = np.minimum(x, y), np.maximum(x, y)
                    may = x != y
                    may[may] = _alike(letters[x[may]], letters[y[may]], config.tau)
                    k = np.unique((low * n + high)[may])
                    held.append(k)
                    count += len(k)
                    if count > 4_000_000:
                        yield from found()
                        held, count = [], 0
        if count:
            yield from found()

    def block(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        keys, lines, names, letters, base = [], [], [], [], 0
        for raw in blobs:
            key, line, name, count, h, doc, number, row = unpack_arrays(raw, np.uint64, np.uint32, np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.uint64)
            keys.append(np.cumsum(key, dtype=np.uint64))
            lines.append(line.astype(np.int64) + 2 * base)
            names.append(name)
            letters.append(count)
            base += len(name)
            yield from rows(1, h, doc, number, row)
        if not base:
            return
        name, at, number = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        key, line = np.concatenate(keys), np.concatenate(lines)
        both, line = (line & 1).astype(bool), number[line >> 1]
        del keys, lines, names
        order = np.lexsort((~both, line, key))
        key, line, both = key[order], line[order], both[order]
        keep = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))
        yield from pairs(key[keep], line[keep], both[keep], name, np.concatenate(letters)[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in by_block(batches):
            yield from block(blobs)

    return blobs.select("part", "blob").mapInArrow(run, "kind int, x bigint, y bigint, number int, row bigint")


def _probes(h: np.ndarray, m: int) -> np.ndarray:
    """Four places below m in the filter; they stay inside the hash's own part of it."""
    return np.stack([mix(h + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(m) for i in range(1, 5)])


def _filter(hashes: DataFrame, n: int, parts: int) -> np.ndarray:
    """A Bloom filter of 16 bits a hash in `parts` sections; each section is made where its hashes are."""
    m = max(64, 16 * n // parts // 8 * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, part = np.zeros(m, bool), None
        for b in batches:
            for raw in b.column(1).to_pylist():
                part = b.column(0)[0].as_py()
                bits[_probes(np.frombuffer(raw, np.uint64), m).ravel().astype(np.int64)] = True
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), binary([np.packbits(bits, bitorder="little").tobytes()])], names=["part", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            p = part_of(h, parts)
            order = np.argsort(p, kind="stable")
            which, cut = np.unique(p[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), binary([x.tobytes() for x in np.split(h[order], cut[1:])])], names=["part", "blob"])

    whole = np.zeros((parts, m // 8), np.uint8)
    for r in exchange(hashes.mapInArrow(deal, "part int, blob binary"), Blocks(parts, 1)).mapInArrow(run, "part int, blob binary").toLocalIterator():
        whole[r.part] = np.frombuffer(bytes(r.blob), np.uint8)
    return whole


def _texts(docs: DataFrame, wanted: DataFrame, config: Config, parts: int) -> DataFrame:
    """(x, line): the distinct lines with the wanted hashes x, and few others."""
    n = wanted.count()
    small = 16 * n <= config.filter_bits
    at = docs.sparkSession.sparkContext.broadcast(_filter(wanted, n, parts)) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in pieces(batches, "text"):
            raw, off = utf8(b.column(0))
            first, end, _, _ = line_spans(raw, off)
            long = np.flatnonzero(end - first >= config.least)
            new, one = np.unique(span_hashes(raw, first[long], end[long]), return_index=True)
            if at is not None:
                bits = at.value
                m = bits.shape[1] * 8
                p, hit = part_of(new, len(bits)), np.ones(len(new), bool)
                for q in _probes(new, m):
                    hit &= (bits[p, (q >> np.uint64(3)).astype(np.int64)] >> (q & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                new, one = new[hit], one[hit]
            fresh = seen.new(new)
            k = long[one[fresh]]
            yield pa.RecordBatch.from_arrays([pa.array(new[fresh].view(np.int64)), binary([raw[a:z].tobytes() for a, z in zip(first[k], end[k])])], names=["x", "line"])

    lines = docs.select("text").mapInArrow(run, "x bigint, line binary")
    return (lines if small else lines.join(wanted, "x", "left_semi")).dropDuplicates(["x"])


def _verified(pairs: DataFrame, lines: DataFrame, config: Config) -> DataFrame:
    """The pairs (x, y) of lines within tau edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces([whole], "a", 1 << 20):
                sides = []
                for i in (2, 3):
                    col = b.column(i).cast(pa.large_binary())
                    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
                    sides += [np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8), off]
                yield b.select(["x", "y"]).filter(pa.array(within(*sides, config.tau)))

    a, b = lines.select("x", F.col("line").alias("a")), lines.select(F.col("x").alias("y"), F.col("line").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInArrow(run, "x bigint, y bigint")


def _places(docs: DataFrame, config: Config, by_row: bool) -> DataFrame:
    """(at, low): the place (d, n, r) of each line that goes, and the earliest of a line near it."""
    need(docs, "doc_id", "text")
    blocks = blocks_for(docs, "text", config.block)
    met = written(_meetings(exchange(_entries(docs, config, blocks, by_row), blocks), config), "meetings")
    pairs = written(met.where("kind = 0").select("x", "y").distinct(), "candidates")
    both = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).distinct()
    found = _verified(pairs, _texts(docs, both, config, blocks.parts), config)
    near = written(found.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.x", "p.y"), "near")
    drop(pairs)
    place = met.where("kind = 1").select("x", F.struct(F.col("y").alias("d"), F.col("number").alias("n"), F.col("row").alias("r")).alias("at"))
    first = place.groupBy("x").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    by_near = near.join(first.select(F.col("x").alias("y"), "first"), "y").groupBy("x").agg(F.min("first").alias("near"))
    low = first.join(by_near, "x", "left").where(F.col("near").isNotNull() | (F.col("k") > 1)).select("x", F.least("first", F.coalesce("near", "first")).alias("low"))
    return place.join(low, "x").where("at > low").select("at", "low")


def dropped(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, line_no, first_doc_id, first_line_no): each line that goes and the earliest line near it; numbers from 0."""
    real = lambda c: F.when(c != NULL_ID, c)
    return (
        _places(docs, config, False)
        .select(real(F.col("at.d")).alias("doc_id"), F.col("at.n").alias("line_no"), real(F.col("low.d")).alias("first_doc_id"), F.col("low.n").alias("first_line_no"))
        .distinct()
    )


def _without(text: str, gone: list[int]) -> str | None:
    """The text without the lines of these numbers; null if only empty lines are left."""
    out = set(gone)
    left = [x for i, x in enumerate(text.split("\n")) if i not in out]
    return "\n".join(left) if any(left) else None


def dedup(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The documents, all their columns, without the dropped lines; documents of dropped lines alone go."""
    row, id_, key, gone_ = free_names(docs, "__row", "__gone_id", "__gone_row", "__gone")
    gone = _places(docs, config, True).groupBy(F.col("at.d").alias(id_), F.col("at.r").alias(key)).agg(F.collect_set("at.n").alias(gone_))
    own = docs.withColumn(row, F.xxhash64("text"))
    # of rows without id, those of equal text are documents of their own: all lines of the others are copies
    some = F.coalesce(F.length(F.translate("text", "\n", "")) > 0, F.lit(False))
    known = F.col("doc_id").isNotNull()
    own = own.where(known | ~some).union(own.where(~known & some).dropDuplicates([row]))
    own = own.join(gone, (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)) == F.col(id_)) & (F.col(row) == F.col(key)), "left")
    safe = plain(own.select(*(col(c) for c in docs.columns), gone_))
    *names, _ = safe.columns
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = pc.and_(b.column(len(names)).is_valid(), b.column(at).is_valid())
            cols = b.columns[: len(names)]
            if pc.any(hit).as_py():
                new = [_without(t, g) for t, g in zip(cols[at].filter(hit).to_pylist(), b.column(len(names)).filter(hit).to_pylist())]
                left = np.ones(b.num_rows, bool)
                left[hit.to_numpy(zero_copy_only=False)] = [t is not None for t in new]
                cols[at] = pc.replace_with_mask(cols[at], hit, pa.array(new, cols[at].type))
                if size is not None:
                    cols[size] = pc.replace_with_mask(cols[size], hit, pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols[size].type))
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(left))
            else:
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return safe.mapInArrow(run, safe.select(*names).schema).toDF(*docs.columns)


ORACLE = """
WITH l AS (
  SELECT doc_id, (x[2])::INT AS n, x[1] AS line FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS x FROM documents)
), o AS (SELECT doc_id, n, line FROM l WHERE line <> ''),
u AS (SELECT line, strlen(line) AS k, min({'d': doc_id, 'n': n}) AS first FROM o GROUP BY line),
v AS (SELECT * FROM u WHERE k >= 24),
p AS (
  SELECT a.line, min(b.first) AS near FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS d FROM v) a JOIN v b ON b.k = a.k + a.d
  WHERE b.first < a.first AND levenshtein(a.line, b.line) <= 2 GROUP BY a.line
), q AS (SELECT line, coalesce(near, first) AS low FROM u LEFT JOIN p USING (line))
SELECT DISTINCT doc_id, n AS line_no, low.d AS first_doc_id, low.n AS first_line_no FROM o JOIN q USING (line) WHERE {'d': doc_id, 'n': n} > low
"""
