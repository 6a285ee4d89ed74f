"""Benchmark decontamination on a positional inverted index.

`index` stores the training tokens as postings, partitioned by document: a segment
holds some megabytes of documents, its sorted terms with counts, and for each term
the ascending positions (byte planes of their differences, compressed). Making it
needs no shuffle; phrases are matched inside a segment, so neither do queries.

Test items are cut into all their windows of `Config.n` words (an item of fewer
words is one window). For a window the terms are ranked by their count in the whole
index, ties by place. An exact match takes the postings of the rarest term, moved
back by its place, and intersects them with those of the others, rarest first. A
proximity match is an occurrence of one of the misses + 1 rarest terms around which
at least n - misses of the window's terms, it included, stand in the document within
`slack` positions of their places.

The windows are broadcast, at most `Config.windows` at once; a larger benchmark is
taken in as many slices, each a pass over the index.

Result of `matches`: (doc_id, item_id, exact, near, windows): for each document and
item with a match, how many of the item's windows occur verbatim and near. Items of any
number of words are searched. `clean` judges documents by items of `Config.least` words
or more, since one to three words in a row are no sign of a leak.

Results for odd input: null, empty or wordless texts and items match nothing; texts of
any length are searched whole; a null doc_id or item_id is kept as an id of its own; to
`matches` rows of equal doc_id count as one, `clean` tells them apart by their text;
rows of equal item_id count as one (a window's place in the item tells windows apart);
terms of equal count are ranked by their place; an empty table on either side gives no
rows; extra columns are left out, and kept by `clean`, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binary, free_names, need, pack_arrays, release, squeezed, unpack_arrays, unsqueezed, written
from quire.llm.tokens import WORD_RE, pieces, word_hashes


@dataclass(frozen=True)
class Config:
    n: int = 8
    misses: int = 2
    slack: int = 2
    least: int = 4  # words of an item that `clean` goes by
    segment: int = 1_000_000  # tokens of a segment, about; a longer document is a segment of its own
    windows: int = 200_000  # broadcast at once
    near: float = 0.5  # `clean` drops a document with this share of an item's windows near


def index(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(terms, postings, docs): one row for each segment."""
    need(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def segment() -> pa.RecordBatch:
            nonlocal held, count
            words = np.concatenate([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            ids, known, texts = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            held, count = [], 0
            order = np.argsort(words, kind="stable")
            sorted_ = words[order]
            start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(words) else np.zeros(0, np.int64)
            gaps = np.diff(order, prepend=0)
            gaps[start] = order[start]
            terms = sorted_[start]
            return pa.RecordBatch.from_arrays([
                binary([squeezed(pack_arrays(np.diff(terms, prepend=np.uint64(0)), np.diff(np.append(start, len(words))).astype(np.uint32)))]),
                binary([squeezed(pack_arrays(gaps.astype(np.uint32)))]),
                binary([squeezed(pack_arrays(ids, known.astype(np.uint8), np.cumsum(sizes).astype(np.int64), texts))]),
            ], names=["terms", "postings", "docs"])

        for b in pieces(batches, "text"):
            words, ptr = word_hashes(b.column(1))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            held.append((words, np.diff(ptr), b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, b.column(2).to_numpy(zero_copy_only=False)))
            count += len(words)
            if count >= config.segment:
                yield segment()
                release()
        if held:
            yield segment()
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("r")).mapInArrow(run, "terms binary, postings binary, docs binary")


@dataclass
class Query:
    items: list  # item_id by number
    item: np.ndarray  # of each window
    start: np.ndarray
    term: np.ndarray  # [windows, n], numbers of terms, -1 beyond the end
    size: np.ndarray
    terms: np.ndarray  # sorted hashes
    order: np.ndarray | None = None  # [windows, n]: places by rarity


def windows_of(rows: list[tuple], config: Config) -> Query:
    """The windows of (item_id, text) rows; items of equal id share a number."""
    ids = sorted({r[0] for r in rows}, key=lambda x: (x is not None, x))
    number = {x: i for i, x in enumerate(ids)}
    words, ptr = word_hashes(pa.array([r[1] for r in rows], pa.string()))
    terms, term = np.unique(words, return_inverse=True)
    item, start, table, size = [], [], [], []
    for r, a, z in zip(rows, ptr[:-1].tolist(), ptr[1:].tolist()):
        n = min(config.n, z - a)
        for s in range(z - a - n + 1 if n else 0):
            item.append(number[r[0]])
            start.append(s)
            size.append(n)
            table.append([*term[a + s : a + s + n], *[-1] * (config.n - n)])
    return Query(ids, np.array(item, np.int64), np.array(start, np.int64), np.array(table, np.int64).reshape(-1, config.n), np.array(size, np.int64), terms)


def rank(q: Query, counts: np.ndarray) -> None:
    """Places by (count in the index, place); places beyond the end come last."""
    c = np.where(q.term >= 0, counts[q.term] if len(counts) else 0, np.iinfo(np.int64).max)
    q.order = np.argsort(c, axis=1, kind="stable")


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values of ranges."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


class Segment:
    """The postings of a query's terms in one segment."""

    def __init__(self, terms: bytes, postings: bytes, docs: bytes, wanted: np.ndarray):
        gaps, counts = unpack_arrays(unsqueezed(terms), np.uint64, np.uint32)
        own = np.cumsum(gaps, dtype=np.uint64)
        counts = counts.astype(np.int64)
        at = np.searchsorted(own, wanted)
        there = at < len(own)
        there[there] = own[at[there]] == wanted[there]
        first = np.cumsum(counts) - counts
        self.count = np.zeros(len(wanted), np.int64)
        self.count[there] = counts[at[there]]
        begin = np.zeros(len(wanted), np.int64)
        begin[there] = first[at[there]]
        (steps,) = unpack_arrays(unsqueezed(postings), np.uint32)
        term, place = _ranges(begin, self.count)
        run = np.cumsum(steps[place].astype(np.int64))
        self.first = np.cumsum(self.count) - self.count  # of each term in pos
        base = np.append(0, run)[self.first]
        self.pos = run - base[term]
        self.key = (term << 32) | self.pos  # ascending
        ids, known, self.ends, self.texts = unpack_arrays(unsqueezed(docs), np.int64, np.uint8, np.int64, np.int64)
        self.ids, self.known = ids, known.astype(bool)

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term stands at a position from low to high."""
        at = np.searchsorted(self.key, (term << 32) | np.maximum(low, 0))
        out = at < len(self.key)
        out[out] = self.key[at[out]] <= ((term[out] << 32) | np.maximum(high[out], -1))
        return out & (high >= low)


def search(s: Segment, q: Query, config: Config, most: int = 250_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, window) of exact and of near matches, with repetitions; about `most` occurrences are tried at once."""
    starts = np.append(0, s.ends[:-1])
    found: list[list] = [[], [], [], []]
    allowed = np.minimum(config.misses, q.size // 4)

    def occurrences(depth: int, keep: np.ndarray) -> Iterator[tuple]:
        place = q.order[:, depth]
        term = q.term[np.arange(len(place)), place]
        count = np.where((term >= 0) & keep, s.count[term], 0)
        cut = np.searchsorted(np.cumsum(count), np.arange(most, count.sum() + most, most))
        for a, z in zip(np.append(0, cut[:-1] + 1), cut + 1):
            w, at = _ranges(s.first[term[a:z]], count[a:z])
            w = w + a
            pos = s.pos[at]
            doc = np.searchsorted(s.ends, pos, "right")
            yield w, pos - place[w], starts[doc], s.ends[doc], doc, place[w]

    here = (s.count[q.term] > 0) | (q.term < 0) if len(s.count) else q.term < 0
    missing = (~here).sum(1)
    for w, at, low, high, doc, _ in occurrences(0, missing == 0):
        ok = (at >= low) & (at + q.size[w] <= high)
        w, at, doc = w[ok], at[ok], doc[ok]
        for d in range(1, config.n):
            place = q.order[w, d]
            term = q.term[w, place]
            ok = (term < 0) | s.holds(np.maximum(term, 0), at + place, at + place)
            w, at, doc = w[ok], at[ok], doc[ok]
        found[0].append(doc)
        found[1].append(w)
    for depth in range(config.misses + 1):
        for w, at, low, high, doc, own in occurrences(depth, (missing <= allowed) & (allowed >= depth)):
            missed = np.zeros(len(w), np.int64)
            for d in range(config.n):
                place = q.order[w, d]
                term = q.term[w, place]
                hit = (term < 0) | (place == own) | s.holds(np.maximum(term, 0), np.maximum(at + place - config.slack, low), np.minimum(at + place + config.slack, high - 1))
                missed += ~hit
                ok = missed <= allowed[w]
                if not ok.all():
                    w, at, low, high, doc, own, missed = (x[ok] for x in (w, at, low, high, doc, own, missed))
            found[2].append(doc)
            found[3].append(w)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _counts(stored: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs in the index."""
    at = stored.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(at.value), np.int64)
        for b in batches:
            for raw in b.column(0):
                gaps, counts = unpack_arrays(unsqueezed(raw.as_py()), np.uint64, np.uint32)
                own = np.cumsum(gaps, dtype=np.uint64)
                k = np.searchsorted(own, at.value)
                there = np.flatnonzero(k < len(own))
                there = there[own[k[there]] == at.value[there]]
                total[there] += counts[k[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in stored.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.term] = r.n
    return out


MATCHES = "doc_id bigint, item_id bigint, exact int, near int, windows int"


def matches(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, item_id, exact, near, windows); see above."""
    return _all_matches(docs, benchmark, config, ["doc_id"])


def _all_matches(docs: DataFrame, benchmark: DataFrame, config: Config, keys: list[str]) -> DataFrame:
    need(benchmark, "item_id", "text")
    stored = written(index(docs, config), "index")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0  # about the windows
    slices = -(-int(total) // config.windows) or 1
    out = None
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k) if slices > 1 else items
        q = windows_of([(r.item_id, r.text) for r in own.collect()], config)  # one slice, about config.windows
        rank(q, _counts(stored, q.terms))
        part = _matches(stored, q, config, keys)
        out = part if out is None else out.unionByName(part)
    return out


def _matches(stored: DataFrame, q: Query, config: Config, keys: list[str]) -> DataFrame:
    at = stored.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = at.value
        per_item = np.zeros(len(q.items), np.int64)
        if len(q.item):
            np.add.at(per_item, np.unique(q.item * (1 << 32) + q.start) >> 32, 1)

        def found(row: tuple) -> pa.RecordBatch:
            s = Segment(*(x.as_py() for x in row), q.terms)
            ed, ew, nd, nw = search(s, q, config)
            d, w, exact = np.concatenate([ed, nd]), np.concatenate([ew, nw]), np.repeat([1, 0], [len(ed), len(nd)])
            return pa.RecordBatch.from_arrays([
                pa.array(s.ids[d], pa.int64(), mask=~s.known[d]), pa.array(s.texts[d]), pa.array([q.items[i] for i in q.item[w]], pa.int64()),
                pa.array(q.start[w]), pa.array(exact.astype(np.int32)), pa.array(per_item[q.item[w]].astype(np.int32)),
            ], names=["doc_id", "r", "item_id", "start", "exact", "windows"])

        for b in batches:
            for row in zip(*b.columns):  # one segment at a time: a batch can hold some
                yield found(row)
                release()

    hits = stored.mapInArrow(run, "doc_id bigint, r bigint, item_id bigint, start bigint, exact int, windows int")
    once = hits.groupBy(*keys, "item_id", "windows", "start").agg(F.max("exact").alias("exact"), F.min("exact").alias("far"))
    return (
        once.groupBy(*keys, "item_id", "windows").agg(F.sum("exact").cast("int").alias("exact"), F.sum(F.lit(1) - F.col("far")).cast("int").alias("near"))
        .select(*keys, "item_id", "exact", "near", "windows")
    )


def clean(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """The documents, all their columns, without those that hold a window verbatim or `near` of an item's windows nearly."""
    items = benchmark.where(F.regexp_count(F.lower("text"), F.lit(WORD_RE)) >= config.least)
    i, r = free_names(docs, "__bad", "__bad_text")
    bad = _all_matches(docs, items, config, ["doc_id", "r"]).where((F.col("exact") > 0) | (F.col("near") >= config.near * F.col("windows")))
    bad = bad.select(F.col("doc_id").alias(i), F.col("r").alias(r)).distinct()
    return docs.join(bad, F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(r)), "left_anti")


ORACLE = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM documents),
tok AS (SELECT doc_id, r, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM dw),
bw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '{WORD_RE}') AS ws FROM benchmark),
st AS (SELECT item_id, ws, least(8, len(ws)) AS n, unnest(range(len(ws) - least(8, len(ws)) + 1)) AS s FROM bw WHERE len(ws) > 0),
win AS (SELECT item_id, s, n, least(2, n // 4) AS allowed, unnest(range(n)) AS j, unnest(ws[s+1:s+n]) AS term FROM st),
cf AS (SELECT term, count(*) AS c FROM tok WHERE term IN (SELECT term FROM win) GROUP BY term),
rk AS (SELECT win.*, row_number() OVER (PARTITION BY item_id, s ORDER BY coalesce(c, 0), j) AS k FROM win LEFT JOIN cf USING (term)),
cand AS (SELECT item_id, s, n, allowed, rk.j AS a, doc_id, r, pos FROM rk JOIN tok USING (term) WHERE k <= allowed + 1),
hit AS (
  SELECT c.item_id, c.s, c.a, c.doc_id, c.r, c.pos, any_value(c.n) AS n, any_value(c.allowed) AS allowed,
    count(DISTINCT win.j) AS near, count(DISTINCT win.j) FILTER (WHERE t.pos = c.pos - c.a + win.j) AS exact
  FROM cand c JOIN win ON win.item_id = c.item_id AND win.s = c.s
  JOIN tok t ON t.r = c.r AND t.term = win.term AND t.pos BETWEEN c.pos - c.a + win.j - 2 AND c.pos - c.a + win.j + 2
    AND (win.j <> c.a OR t.pos = c.pos)
  GROUP BY c.item_id, c.s, c.a, c.doc_id, c.r, c.pos
), m AS (SELECT doc_id, item_id, s, max((exact = n)::INT) AS exact FROM hit WHERE near >= n - allowed GROUP BY ALL),
wc AS (SELECT item_id, count(DISTINCT s) AS windows FROM win GROUP BY item_id)
SELECT doc_id, item_id, sum(exact)::INT AS exact, count(*)::INT AS near, any_value(windows)::INT AS windows FROM m JOIN wc USING (item_id) GROUP BY doc_id, item_id
"""
