"""Language identification by unigrams over a public piece vocabulary, segmentations summed out.

A word (run of non-blank bytes, with one blank before it) can be cut into pieces of
the vocabulary in many ways. A language gives every piece a probability; a word's
score is the sum over all its segmentations of the product of their pieces, by the
forward algorithm. A text's score is the product over its words; the language of the
highest score wins. The 256 byte pieces make every text scorable. Words are scored
whole, however long (a text without blanks is one word): every few places the
probabilities are scaled to 1 and the scale is kept as a logarithm.

Piece probabilities come from expectation maximisation (forward-backward) over a
sample of documents for each language, bounded by `Config.sample` and `Config.bytes`; there alone words
of more than `Config.longest` bytes are cut into runs of that many bytes, each a word
without blank. The vocabulary is read from a file and never trained; the path is a
parameter.

Scoring works on the distinct words of a batch: all places of all words at once. A task
keeps the scores of up to `Config.kept` words it has seen.

Results for odd input: a null, empty or blank text has no words: predicted is null
and the scores 0; a null `lang` trains nothing and stays null; with no training text
at all predicted is null everywhere; equal scores go to the first language by name;
repeated rows give repeated rows, an empty table none; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import need
from quire.llm.tokens import pieces, runs, span_hashes, utf8

@dataclass(frozen=True)
class Config:
    sample: int = 400  # documents of each language that training reads
    bytes: int = 64 << 20  # of text that it reads in all
    rounds: int = 4
    smooth: float = 0.02
    longest: int = 64  # bytes of a word in training
    kept: int = 500_000  # words whose scores a task keeps


@dataclass
class Model:
    hashes: np.ndarray  # of the pieces, ascending
    bitmap: np.ndarray  # which leading bits occur among them
    most: int  # bytes of the longest piece
    langs: list[str]
    prob: np.ndarray  # [pieces, langs]
    config: Config


def read_vocabulary(path: str) -> list[bytes]:
    """The distinct byte strings of the vocabulary's pieces; a leading blank marks a word's beginning."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    found = {bytes([i]) for i in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


_SHIFT = np.uint64(42)


def _table(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    raw = np.frombuffer(b"".join(vocabulary), np.uint8)
    off = np.cumsum([0, *map(len, vocabulary)])
    h = np.sort(span_hashes(raw, off[:-1], off[1:]))
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(h >> _SHIFT).astype(np.int64)] = True
    return h, bitmap, max(map(len, vocabulary))


def blank_mask(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


@dataclass
class Words:
    """The distinct words of some texts."""

    raw: np.ndarray  # their bytes, blanks included
    off: np.ndarray
    hashes: np.ndarray  # ascending
    number: np.ndarray  # the word of every token
    ptr: np.ndarray  # tokens of the texts

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of some of them."""
        size = np.diff(self.off)[which]
        off = np.append(0, np.cumsum(size))
        at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(self.off[:-1][which], size)
        return self.raw[at], off


def distinct_words(texts: pa.Array, longest: int | None = None) -> Words:
    raw, off = utf8(texts)
    first, end = runs(~blank_mask(raw), off)
    cuts = np.maximum(1, -(-(end - first) // longest)) if longest else np.ones(len(first), np.int64)
    owner = np.repeat(np.arange(len(first)), cuts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    a = first[owner] + nth * (longest or 0)
    z = np.minimum(end[owner], a + longest) if longest else end[owner]
    head = nth == 0
    h, one, number = np.unique(span_hashes(raw, a, z) ^ head.astype(np.uint64), return_index=True, return_inverse=True)
    a1, n1, blank = a[one], (z - a)[one], head[one].astype(np.int64)
    offsets = np.append(0, np.cumsum(n1 + blank))
    out = np.full(offsets[-1], 32, np.uint8)
    word = np.repeat(np.arange(len(one)), n1)
    within = np.arange(len(word)) - np.repeat(np.cumsum(n1) - n1, n1)
    out[offsets[word] + blank[word] + within] = raw[a1[word] + within]
    return Words(out, offsets, h, number, np.searchsorted(a, off))


def lattice(m: Model, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, piece, place of `to` in its word) of all pieces in the words; node off[w] + w + t is place t of word w."""
    size = np.diff(off)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(raw)) - off[:-1][word]  # place in the word
    source, target, piece, depth = [], [], [], []
    for n in range(1, m.most + 1):
        k = np.flatnonzero(at + n <= size[word])
        if not len(k):
            break
        h = span_hashes(raw, k, k + n)
        may = m.bitmap[(h >> _SHIFT).astype(np.int64)]
        k, h = k[may], h[may]
        i = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
        hit = m.hashes[i] == h
        k, i = k[hit], i[hit]
        node = k + word[k]
        source.append(node)
        target.append(node + n)
        piece.append(i)
        depth.append(at[k] + n)
    if not source:
        return (np.zeros(0, np.int64),) * 4
    source, target, piece, depth = map(np.concatenate, (source, target, piece, depth))
    order = np.lexsort((target, depth))
    return source[order], target[order], piece[order], depth[order]


SCALED = 16  # places between scalings: sixteen pieces of the least probability stay far above the smallest float


def forward(m: Model, raw: np.ndarray, off: np.ndarray, edges: tuple | None = None, scaled: bool = True, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of every node [nodes, langs], node at the end of each word, logarithm of the scale of each word's end [words, langs]); start: the nodes that a single word begins with."""
    source, target, piece, depth = lattice(m, raw, off) if edges is None else edges
    words, size = np.arange(len(off) - 1), np.diff(off)
    alpha = np.zeros((int(off[-1]) + len(words), len(m.langs)))
    alpha[off[:-1] + words] = 1
    if start is not None:
        alpha[: len(start)] = start
    logs = np.zeros((len(words), len(m.langs)))
    deepest = int(depth.max(initial=0))
    cut = np.searchsorted(depth, np.arange(1, deepest + 2))
    open_ = words
    for d in range(1 if start is None else len(start), deepest + 1):
        a, z = cut[d - 1], cut[d]
        if a < z:
            t = target[a:z]
            at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            alpha[t[at]] = np.add.reduceat(alpha[source[a:z]] * m.prob[piece[a:z]], at, axis=0)
        if scaled and d % SCALED == 0:
            open_ = open_[size[open_] > d]
            if len(open_):  # the nodes that a piece can still begin at
                window = (off[open_] + open_ + d)[:, None] - np.arange(min(m.most, d + 1))
                top = alpha[window].max(1)
                top[top <= 0] = 1
                alpha[window] /= top[:, None]
                logs[open_] += np.log(top)
    return alpha, off[1:] + words, logs


def _counts(m: Model, raw: np.ndarray, off: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of every piece [pieces, langs], each word weighted by its count in the language."""
    edges = source, target, piece, depth = lattice(m, raw, off)
    alpha, ends, _ = forward(m, raw, off, edges, False)
    beta = np.zeros_like(alpha)
    beta[ends] = times / np.maximum(alpha[ends], 1e-300)
    cut = np.searchsorted(depth, np.arange(1, int(depth.max(initial=0)) + 2))
    for a, z in list(zip(cut[:-1], cut[1:]))[::-1]:
        np.add.at(beta, source[a:z], beta[target[a:z]] * m.prob[piece[a:z]])
    use = alpha[source] * m.prob[piece] * beta[target]
    return np.stack([np.bincount(piece, use[:, i], len(m.hashes)) for i in range(use.shape[1])], 1)


def train(texts: list[str], langs: list[str], vocabulary: list[bytes], config: Config = Config()) -> Model:
    """Expectation maximisation from equal probabilities."""
    names = sorted(set(langs))
    h, bitmap, most = _table(vocabulary)
    m = Model(h, bitmap, most, names, np.full((len(h), len(names)), 1 / len(h)), config)
    if not names:
        return m
    w = distinct_words(pa.array(texts, pa.string()), config.longest)
    times = np.zeros((len(w.hashes), len(names)))
    np.add.at(times, (w.number, np.repeat([names.index(x) for x in langs], np.diff(w.ptr))), 1)
    for _ in range(config.rounds):
        got = np.zeros_like(m.prob)
        step = 20_000
        for a in range(0, len(times), step):
            z = min(a + step, len(times))
            got += _counts(m, w.raw[w.off[a] : w.off[z]], w.off[a : z + 1] - w.off[a], times[a:z])
        got += config.smooth
        m.prob = got / got.sum(0)
    return m


def fit(docs: DataFrame, vocabulary: str, config: Config = Config()) -> Model:
    """Trains on config.sample documents of each language and config.bytes of text, picked by a hash of id and text; vocabulary: the path of a sentencepiece model."""
    need(docs, "doc_id", "text", "lang")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 20
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(scale, -(-config.sample * scale * 5 // (4 * n))))).otherwise(share)
    near = known.where(F.pmod("h", F.lit(scale)) < share)
    # repeated rows are one; sizes come first, so that long texts can't bring more than the bound
    rows = near.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n")).collect()
    left = dict.fromkeys(sizes, config.bytes // max(1, len(sizes)))
    count, chosen = dict.fromkeys(sizes, 0), []
    for r in sorted(rows):
        if count[r.lang] < config.sample and r.n <= left[r.lang]:
            count[r.lang] += 1
            left[r.lang] -= r.n
            chosen.append((r.lang, r.h))
    picked = docs.sparkSession.createDataFrame(chosen, "lang string, h bigint")
    got = sorted(near.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text").collect())
    return train([r.text for r in got], [r.lang for r in got], read_vocabulary(vocabulary), config)


def _slices(m: Model, raw: np.ndarray, step: int) -> np.ndarray:
    """The log probability of one long word, in slices that carry over the nodes at which a piece can still begin."""
    alpha, log, at = np.ones((1, len(m.langs))), np.zeros(len(m.langs)), 0
    while at < len(raw):
        lead, z = len(alpha) - 1, min(len(raw), at + step)
        alpha, _, more = forward(m, raw[at - lead : z], np.array([0, z - at + lead]), start=alpha)
        alpha, log, at = alpha[-m.most :], log + more[0], z
    return log + np.log(np.maximum(alpha[-1], 1e-300))


class Kept:
    """Scores of words that were met before, by hash; it takes no more once it is full."""

    def __init__(self, langs: int, most: int):
        self.most, self.hashes, self.logs = most, np.zeros(0, np.uint64), np.zeros((0, langs))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are here, where)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, at

    def add(self, hashes: np.ndarray, logs: np.ndarray) -> None:
        room = self.most - len(self.hashes)
        if room > 0:
            hashes, logs = np.concatenate([self.hashes, hashes[:room]]), np.concatenate([self.logs, logs[:room]])
            order = np.argsort(hashes)
            self.hashes, self.logs = hashes[order], logs[order]


def log_scores(m: Model, texts: pa.Array, kept: Kept | None = None, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each text [texts, langs], its number of word bytes)."""
    w = distinct_words(texts)
    logs = np.zeros((len(w.hashes), len(m.langs)))
    here, at = (np.zeros(len(logs), bool), None) if kept is None else kept.find(w.hashes)
    if kept is not None:
        logs[here] = kept.logs[at[here]]
    todo = np.flatnonzero(~here)
    todo = todo[np.argsort(np.diff(w.off)[todo], kind="stable")]  # long words meet long ones
    size = np.cumsum(np.diff(w.off)[todo])
    a = 0
    while a < len(todo):
        z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        raw, off = w.take(todo[a:z])
        if len(raw) > most:  # one word
            logs[todo[a]] = _slices(m, raw, most)
        else:
            alpha, ends, scale = forward(m, raw, off)
            logs[todo[a:z]] = np.log(np.maximum(alpha[ends], 1e-300)) + scale
        a = z
    if kept is not None and len(todo):
        kept.add(w.hashes[todo], logs[todo])
    sums = np.concatenate([np.zeros((1, len(m.langs))), np.cumsum(logs[w.number], axis=0)])
    sizes = np.append(0, np.cumsum(np.diff(w.off)[w.number]))
    return sums[w.ptr[1:]] - sums[w.ptr[:-1]], sizes[w.ptr[1:]] - sizes[w.ptr[:-1]]


RESULT = "doc_id bigint, lang string, predicted string, second string, bits_per_byte double, margin double"


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, predicted, second, bits_per_byte of the best, margin to the second in bits a byte)."""
    need(docs, "doc_id", "text", "lang")
    at = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = at.value
        kept = Kept(len(m.langs), m.config.kept)
        for b in pieces(batches, "text", 6 << 20):
            n, langs = b.num_rows, len(m.langs)
            if not langs:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=["doc_id", "lang", "predicted", "second", "bits_per_byte", "margin"])
                continue
            score, size = log_scores(m, b.column(2), kept)
            bits = np.round(-score / np.log(2) / np.maximum(size, 1)[:, None], 6)
            order = np.argsort(bits, axis=1, kind="stable")
            names = np.array(m.langs, object)
            none = size == 0
            best, second = names[order[:, 0]], names[order[:, min(1, langs - 1)]]
            row = np.arange(n)
            low, next_ = bits[row, order[:, 0]], bits[row, order[:, min(1, langs - 1)]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(best, pa.string(), mask=none), pa.array(second, pa.string(), mask=none | (langs < 2)), pa.array(np.where(none, 0, low)), pa.array(np.where(none, 0, np.round(next_ - low, 6)))],
                names=["doc_id", "lang", "predicted", "second", "bits_per_byte", "margin"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").mapInArrow(run, RESULT)
