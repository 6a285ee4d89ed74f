"""Quality by nearest-neighbour voting in a latent-semantic space.

Features are hashed runs of word characters and runs of symbols, as written, and a
mark for words in capitals; their document frequencies are counted over all
documents. A bounded sample of labelled rows (`Config.sample` and `Config.bytes`, half of
each class) is weighted by log tf and idf and factored by a randomised SVD in numpy. Their
unit vectors are broadcast: sample x dim floats, whatever the corpus. Every document
is projected and its cosines with all of them are computed exactly, block by block.
The k-th largest cosine is the cut: all neighbours at least as similar vote, those
tied with the k-th too, each with its similarity (not below 0) as weight. The share
of votes for quality is the score; a document never votes for itself. The threshold
is the cut with the best balanced accuracy when the sample votes on itself this way.

Results for odd input: a text that is null, empty or blank has a zero vector, no
votes and score 0.5; so has every document if the labels lack a class. Null labels
and labels without document are left out; a document labelled twice is good if one
row says so, and of rows of equal id one is sampled. A text of any length is read
whole. Neighbours that tie with the k-th all vote; a score equal to the threshold is
good. Repeated rows give repeated rows, an empty table none; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_texts, need
from quire.llm.tokens import _IS_WORD, mix, pieces, runs, span_hashes, utf8


@dataclass(frozen=True)
class Config:
    sample: int = 4096  # labelled rows at most, half of each class
    bytes: int = 64 << 20  # of their texts at most
    bits: int = 15  # 2**bits features
    dim: int = 48
    k: int = 15
    block: int = 512  # documents whose cosines are held at once
    seed: int = 5


@dataclass
class Model:
    config: Config
    basis: np.ndarray  # [features, dim], idf included
    vectors: np.ndarray  # [sample, dim], of length 1
    label: np.ndarray
    ids: np.ndarray
    threshold: float


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count), ascending; whole texts."""
    raw, off = utf8(texts)
    word = _IS_WORD[raw] | ((raw >= 65) & (raw <= 90))
    symbol = ~word & (raw > 32)
    found = []
    for mask in (word, symbol):
        first, end = runs(mask, off)
        doc = np.searchsorted(off, first, "right") - 1
        found.append((doc, span_hashes(raw, first, end)))
        if mask is word:
            second = raw[np.minimum(first + 1, max(len(raw) - 1, 0))] if len(raw) else first
            loud = (end - first > 1) & (second >= 65) & (second <= 90)
            found.append((doc[loud], np.full(int(loud.sum()), 0xCA91, np.uint64)))
    doc = np.concatenate([d for d, _ in found])
    h = np.concatenate([x for _, x in found])
    key = np.sort((doc.astype(np.int64) << bits) | (mix(h) >> np.uint64(64 - bits)).astype(np.int64))
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[start] >> bits, key[start] & ((1 << bits) - 1), np.diff(np.append(start, len(key)))


def document_frequencies(docs: DataFrame, config: Config) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents), over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << config.bits, np.int64), 0
        for b in pieces(batches, "text"):
            total += np.bincount(features(b.column(0), config.bits)[1], minlength=len(total))
            n += b.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["f", "n"])

    out, n = np.zeros(1 << config.bits, np.int64), 0
    for r in docs.select("text").mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toLocalIterator():
        if r.f < 0:
            n = r.n
        else:
            out[r.f] = r.n
    return out, n


def _product(doc: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Sparse rows times a dense basis."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    for a in range(0, len(doc), step):
        d = doc[a : a + step]
        start = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        out[d[start]] += np.add.reduceat(basis[feature[a : a + step]] * weight[a : a + step, None], start, axis=0)
    return out


def _weight(count: np.ndarray) -> np.ndarray:
    return (1 + np.log(count)).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.where(n > 1e-12, v / np.maximum(n, 1e-12), 0).astype(np.float32)


def votes(vectors: np.ndarray, ids: np.ndarray, known: np.ndarray, m: Model) -> np.ndarray:
    """The share of the neighbours' weight that says good, 0.5 without neighbours."""
    out = np.full(len(vectors), 0.5)
    sample = len(m.label)
    if not sample:
        return out
    k = min(m.config.k, sample)
    good = m.label.astype(np.float32)
    for a in range(0, len(vectors), m.config.block):
        z = min(a + m.config.block, len(vectors))
        s = vectors[a:z] @ m.vectors.T
        np.round(s, 5, out=s)
        s[(ids[a:z, None] == m.ids) & known[a:z, None]] = -2
        kth = np.partition(s, sample - k, axis=1)[:, sample - k]
        s[s < np.maximum(kth, 0)[:, None]] = 0
        total = s.sum(1, dtype=np.float64)
        out[a:z] = np.where(total > 1e-9, (s @ good) / np.maximum(total, 1e-9), 0.5)
    return np.round(out, 4)


def train(texts: list[str | None], labels: np.ndarray, ids: np.ndarray, df: np.ndarray, n_docs: int, config: Config = Config()) -> Model:
    idf = np.log((1 + n_docs) / (1 + df)).astype(np.float32)
    empty = Model(config, np.zeros((len(df), config.dim), np.float32), np.zeros((0, config.dim), np.float32), np.zeros(0), np.zeros(0, np.int64), 0.5)
    if not len(labels) or labels.min() == labels.max():
        return empty
    doc, feature, count = features(pa.array(texts, pa.string()), config.bits)
    weight = _weight(count) * idf[feature]
    norm = np.sqrt(np.bincount(doc, weight.astype(np.float64) ** 2, len(texts)))
    weight = (weight / np.maximum(norm[doc], 1e-12)).astype(np.float32)
    order = np.argsort(feature, kind="stable")
    back = feature[order], doc[order], weight[order]
    rng = np.random.default_rng(config.seed)
    v = rng.normal(size=(len(df), config.dim + 8)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        u, _ = np.linalg.qr(_product(doc, feature, weight, len(texts), v))
        v, _ = np.linalg.qr(_product(*back, len(df), u))
    u, s, w = np.linalg.svd(_product(doc, feature, weight, len(texts), v), full_matrices=False)
    basis = (v @ w.T)[:, : config.dim]
    m = Model(config, (basis * idf[:, None]).astype(np.float32), np.zeros((0, config.dim), np.float32), labels, ids, 0.5)
    m.vectors = project(m, pa.array(texts, pa.string()))
    score = votes(m.vectors, ids, np.ones(len(ids), bool), m)
    cuts = np.unique(score)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    if len(cuts):
        good, bad = np.sort(score[labels > 0]), np.sort(score[labels <= 0])
        balance = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
        m.threshold = float(cuts[np.flatnonzero(balance >= balance.max() - 1e-12)[0]])
    return m


def project(m: Model, texts: pa.Array) -> np.ndarray:
    doc, feature, count = features(texts, m.config.bits)
    return _unit(_product(doc, feature, _weight(count), len(texts), m.basis))


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config(), label: str = "quality") -> Model:
    """Trains on labelled documents picked by a hash of doc_id, at most config.sample of them and config.bytes of text."""
    need(docs, "doc_id", "text")
    need(labels, "doc_id", label)
    df, n = document_frequencies(docs, config)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("good"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    half = config.sample // 2
    known = known.withColumnRenamed("good", "label")
    picked = known.where("label = 1").orderBy(*order).limit(half).unionByName(known.where("label = 0").orderBy(*order).limit(half))
    rows = sorted((r.doc_id, r.text, r.label) for r in bounded_texts(docs, picked, config.bytes, []))
    return train([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64), df, n, config)


RESULT = "doc_id bigint, score double, good boolean"


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, good) of every document."""
    need(docs, "doc_id", "text")
    at = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = at.value
        for b in pieces(batches, "text", 2 << 20):
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            score = votes(project(m, b.column(1)), ids, b.column(0).is_valid().to_numpy(zero_copy_only=False), m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(score >= m.threshold)], names=["doc_id", "score", "good"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, RESULT)
