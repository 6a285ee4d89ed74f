"""First-fit decreasing with a tournament tree of free capacities, in randomised groups of documents.

A document becomes the token ids of a public byte-level vocabulary and an end token
(`Config.end`); the vocabulary is read from a file and never trained. Documents longer
than a sequence are cut into full sequences and a rest, so the whole text is packed.
Documents are dealt to groups by a keyed hash of their id, their text and how often the
task has met both; a group has about `Config.group` tokens, so it is one task's work
however large the corpus is, and neither a hot id nor many copies of a text fill one.
The number of groups follows the total. The ids travel once, as 16-bit numbers where
the vocabulary allows it.

Within a group pieces go by falling length, equal lengths by doc_id (nulls first), then
by the dealing hash and by their place in the document; each goes into the first
sequence that has room. The tree holds at each node the largest room below it, so that
sequence is found in log2(sequences) steps.

Result: one row for each sequence: grp, bin (its number in the group), n_tokens, for
each piece its document, start in the sequence and start in the document's ids (lists
in the order of the sequence), and the token ids.

Results for odd input: a null or empty text has no tokens and no place; a blank text is
tokens like any other; a text of any length is encoded whole and cut as said; a null
doc_id is an id like any other; repeated rows are packed as often as they occur; an
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import need, slots, written
from quire.llm.tokens import mix, pieces, span_hashes, utf8


@dataclass(frozen=True)
class Config:
    capacity: int = 2048  # tokens of a training sequence
    group: int = 4_000_000  # tokens of a group, about
    end: int = 50_256  # the token after every document
    seed: int = 11


SCHEMA = "grp bigint, bin int, n_tokens int, doc_ids array<bigint>, starts array<int>, doc_starts array<bigint>, tokens array<int>"
#: What a text is cut into before ranks merge bytes: contractions, letters, digits, other signs, blanks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(ranks: bytes):
    """The encoder of a file of ranks, once a process."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, start in the bin) of each size; sizes fall and none is over the capacity."""
    n = len(sizes)
    leaves = 1
    while leaves < max(n, 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, starts = np.empty(n, np.int32), np.empty(n, np.int32)
    for i, s in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < s:
                node += 1
        bins[i], starts[i] = node - leaves, capacity - room[node]
        room[node] -= s
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, starts


def encoded(docs: DataFrame, vocabulary: str, config: Config = Config()) -> DataFrame:
    """(doc_id, deal, n, ids) of every document with a text: the number that deals it, its tokens with the end token, as bytes of 16 or 32 bits each."""
    need(docs, "doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # as large as the vocabulary
    kind = _kind(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoding(ranks.value), {}
        for b in pieces(batches, "text"):
            b = b.filter(pc.greater(pc.fill_null(pc.binary_length(b.column(1)), 0), 0))
            raw, off = utf8(b.column(1))
            key = span_hashes(raw, off[:-1], off[1:]) ^ mix(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(config.seed))
            times = np.zeros(len(key), np.uint64)
            for i, k in enumerate(key.tolist()):
                times[i] = met[k] = met.get(k, -1) + 1
            deal = mix(key + times * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            ids = [np.array([*encoder.encode_ordinary(t), config.end], kind) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deal), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "deal", "n", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, deal bigint, n bigint, ids binary")


def _kind(config: Config) -> type:
    return np.uint16 if config.end < 1 << 16 else np.uint32


def pack(docs: DataFrame, vocabulary: str, config: Config = Config()) -> DataFrame:
    """The sequences; see above. vocabulary: the path of a file of ranks whose ids are below `Config.end`."""
    whole = written(encoded(docs, vocabulary, config), "tokens")
    total = whole.agg(F.sum("n")).first()[0] or 0
    groups = -(-int(total) // config.group) or 1
    capacity, kind = config.capacity, _kind(config)

    def run(got: pa.Table) -> pa.Table:
        ids, n, deal = got["doc_id"].combine_chunks(), got["n"].to_numpy().astype(np.int64), got["deal"].to_numpy()
        tokens = np.frombuffer(b"".join(got["ids"].to_pylist()), kind)
        parts = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), parts)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * capacity
        size = np.minimum(n[row] - start, capacity)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[row]
        key = ids.fill_null(0).to_numpy(zero_copy_only=False)[row]
        order = np.lexsort((start, deal[row], key, known, -size))
        row, start, size = row[order], start[order], size[order]
        bins, at = first_fit_decreasing(size, capacity)
        order = np.lexsort((at, bins))
        row, start, size, bins, at = row[order], start[order], size[order], bins[order], at[order]
        head = np.append(np.flatnonzero(np.append(True, bins[1:] != bins[:-1])), len(bins)).astype(np.int32)
        first = (np.cumsum(n) - n)[row] + start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        ends = np.append(0, np.cumsum(size))[head].astype(np.int32)
        lists = lambda off, values: pa.ListArray.from_arrays(pa.array(off), values)
        return pa.table(
            [
                pa.array(np.full(len(head) - 1, got["grp"][0].as_py(), np.int64)), pa.array(bins[head[:-1]].astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)),
                lists(head, ids.take(pa.array(row))), lists(head, pa.array(at.astype(np.int32))), lists(head, pa.array(start)), lists(ends, pa.array(tokens[place].astype(np.int32))),
            ], names=["grp", "bin", "n_tokens", "doc_ids", "starts", "doc_starts", "tokens"],
        )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's groups, one after another."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            grp = b.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for a, z in zip(cuts, cuts[1:]):
                if held and held[-1].column(4)[0].as_py() != grp[a]:
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(b.slice(a, z - a))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    parts = min(groups, slots(docs.sparkSession))  # groups are dealt evenly, where a hash would put several into one partition
    sent = whole.withColumn("grp", F.pmod("deal", F.lit(groups))).repartitionById(parts, F.pmod("grp", F.lit(parts)).cast("int")).sortWithinPartitions("grp")
    return sent.mapInArrow(packed, SCHEMA)
