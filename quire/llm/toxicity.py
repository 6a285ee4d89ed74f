"""Toxicity by a convolutional text classifier.

Every word becomes the sum of two rows of one hashed embedding table: that of the
word and that of its first bytes, so that unseen compounds of a known stem still
count. Filters of several widths run over the whole text, each keeps its maximum
(with zero: ReLU), and a logistic unit weighs them. Training is plain numpy on a
sample of the labelled rows, bounded by `Config.sample` and `Config.bytes`. `fit` then scores all labelled
rows in Spark and sets a threshold for every language from score histograms of the rows
not trained on, each class weighted to its share among all labelled rows of the language;
`train` alone sets them on a held-out fifth of its rows. `Config.prior` rows of the mix
of all languages join those of each, so a threshold moves from the common one to the
language's own as its labels grow.

Results for odd input: a text that is null, empty or without words has only zero
features and scores like any such text; a text of any length is read whole; a language
that is null or has no labels gets the threshold of all languages together; without
labels of both kinds nothing is toxic; a score equal to the threshold is toxic; an empty
table gives no rows. Labels that are null or without document
are left out; a document labelled twice counts as toxic if one row says so; of rows of
equal id one is sampled. Equal
texts get equal scores. Extra columns are kept by `drop_toxic` and left out by
`score`; duplicate rows give duplicate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import BOOL, DOUBLE, bounded_texts, need, plain
from quire.llm.tokens import pieces, span_hashes, word_spans


@dataclass(frozen=True)
class Config:
    sample: int = 8000  # labelled rows that training reads at most, half of each kind
    bytes: int = 64 << 20  # of their texts at most
    bits: int = 18  # the table has 2**bits rows
    dim: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8  # of each width
    prefix: int = 4  # bytes of the stem
    epochs: int = 8
    batch: int = 32
    rate: float = 0.02
    decay: float = 1e-4
    prior: float = 100  # rows of all languages that join each one's own for its threshold
    bins: int = 4096  # of the score histograms, over the logit of the score
    seed: int = 7


@dataclass
class Model:
    config: Config
    table: np.ndarray  # [2**bits + 1, dim]; the last row stays zero
    filters: list[np.ndarray]  # per width [width * dim, filters]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    threshold: dict[str | None, float]  # None: all languages


def word_ids(texts: pa.Array, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of every word, id of its stem, ptr)."""
    raw, first, end, ptr = word_spans(texts)
    mask = np.uint64((1 << config.bits) - 1)
    word = span_hashes(raw, first, end) & mask
    stem = span_hashes(raw, first, np.minimum(end, first + config.prefix))
    stem = (stem * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask
    return word.astype(np.int32), stem.astype(np.int32), ptr


def _padded(word: np.ndarray, stem: np.ndarray, ptr: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids with empty words after every text, so that no filter reaches into the next; first place and size of each text."""
    pad = max(config.widths) - 1
    sizes = np.diff(ptr)
    at = ptr[:-1] + pad * np.arange(len(sizes))
    w = np.full(int(ptr[-1]) + pad * (len(sizes) + 1), 1 << config.bits, np.int32)
    s = w.copy()
    place = np.repeat(at - ptr[:-1], sizes) + np.arange(int(ptr[-1]))
    w[place], s[place] = word, stem
    return w, s, at, sizes


def _features(m: Model, word: np.ndarray, stem: np.ndarray, at: np.ndarray, sizes: np.ndarray, want_place: bool = False):
    """Max-pooled filter outputs of each text [texts, filters of all widths]; with the places of the maxima, -1 where ReLU gave zero."""
    emb = m.table[word] + m.table[stem]
    full = np.flatnonzero(sizes)
    dim, k = m.config.dim, m.config.filters
    feats = np.zeros((len(sizes), k * len(m.config.widths)), np.float32)
    places = np.full(feats.shape, -1, np.int64)
    n = len(word) - max(m.config.widths) + 1
    edges = np.stack([at[full], at[full] + sizes[full]], 1).ravel()
    for j, width in enumerate(m.config.widths):
        y = emb[:n] @ m.filters[j][:dim]
        for d in range(1, width):
            y += emb[d : n + d] @ m.filters[j][d * dim : (d + 1) * dim]
        y += m.bias[j]
        if not len(full):
            continue
        cut = slice(j * k, j * k + k)
        top = np.maximum.reduceat(np.concatenate([y, y[-1:]]), edges, axis=0)[::2]
        feats[full, cut] = np.maximum(top, 0)
        if want_place:
            for i, t in enumerate(full):
                a = at[t]
                best = y[a : a + sizes[t]].argmax(0)
                places[t, cut] = np.where(top[i] > 0, a + best, -1)
    return (feats, places, emb) if want_place else feats


def scores(m: Model, texts: pa.Array) -> np.ndarray:
    f = _features(m, *_padded(*word_ids(texts, m.config), m.config))
    return 1 / (1 + np.exp(-(f.astype(np.float64) @ m.out + m.out_bias)))


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], config: Config = Config()) -> Model:
    """Adam on the logistic loss; every fifth row is held out for the thresholds."""
    rng = np.random.default_rng(config.seed)
    k, nw = config.filters, len(config.widths)
    m = Model(
        config, rng.normal(0, 0.05, ((1 << config.bits) + 1, config.dim)).astype(np.float32),
        [rng.normal(0, 0.5, (w * config.dim, k)).astype(np.float32) for w in config.widths],
        [np.zeros(k, np.float32) for _ in config.widths], rng.normal(0, 0.3, k * nw), 0.0, {None: 2.0},
    )
    m.table[-1] = 0
    if not len(labels) or labels.min() == labels.max():
        return m
    held = np.arange(len(labels)) % 5 == 4
    ids = [word_ids(pa.array([t]), config) for t in texts]
    rows = np.flatnonzero(~held)
    state: dict[str, list] = {}
    step = 0

    def adam(name: str, x: np.ndarray, g: np.ndarray, rate: float) -> None:
        s = state.setdefault(name, [np.zeros_like(x), np.zeros_like(x)])
        s[0] += 0.1 * (g - s[0])
        s[1] += 0.01 * (g * g - s[1])
        x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6)

    adagrad = np.zeros(len(m.table), np.float32)
    for epoch in range(config.epochs):
        rng.shuffle(rows)
        rate = config.rate / (1 + 0.5 * epoch)
        for b in range(0, len(rows), config.batch):
            take, step = rows[b : b + config.batch], step + 1
            ptr = np.concatenate([[0], np.cumsum([len(ids[i][0]) for i in take])])
            word, stem, at, sizes = _padded(np.concatenate([ids[i][0] for i in take]), np.concatenate([ids[i][1] for i in take]), ptr, config)
            f, places, emb = _features(m, word, stem, at, sizes, True)
            p = 1 / (1 + np.exp(-(f @ m.out + m.out_bias)))
            d = (p - labels[take]) / len(take)
            g_out, g_bias = f.T @ d + config.decay * m.out, np.array([d.sum()])
            g_f = d[:, None] * m.out
            for j, width in enumerate(config.widths):
                cut = slice(j * k, j * k + k)
                t, c = np.nonzero(places[:, cut] >= 0)
                where, g = places[:, cut][t, c], g_f[:, cut][t, c].astype(np.float32)
                old = m.filters[j].reshape(width, config.dim, k).copy()
                gw = np.zeros_like(old)
                for q in range(width):
                    np.add.at(gw[q].T, c, g[:, None] * emb[where + q])
                    rows_e = np.concatenate([word[where + q], stem[where + q]])
                    ge = np.tile(g[:, None] * old[q][:, c].T, (2, 1))
                    ge[rows_e == 1 << config.bits] = 0
                    np.add.at(adagrad, rows_e, (ge**2).mean(1))
                    np.add.at(m.table, rows_e, -8 * rate * ge / (np.sqrt(adagrad[rows_e])[:, None] + 0.003))
                gb = np.bincount(c, g, k).astype(np.float32)
                adam(f"w{j}", m.filters[j], gw.reshape(-1, k) + config.decay * m.filters[j], rate)
                adam(f"b{j}", m.bias[j], gb, rate)
            adam("out", m.out, g_out, rate)
            bias = np.array([m.out_bias])
            adam("out_bias", bias, g_bias, rate)
            m.out_bias = float(bias[0])
    if labels[held].min(initial=1) == labels[held].max(initial=0) or not held.any():
        held[:] = True  # too few rows to hold out both kinds
    own = np.flatnonzero(held)
    names, number = np.unique([langs[i] or "" for i in own], return_inverse=True)
    counts = np.zeros((len(names), 2, config.bins))
    np.add.at(counts, (number, labels[own].astype(np.int64), bin_of(scores(m, pa.array([texts[i] for i in own], pa.string())), config.bins)), 1)
    m.threshold = thresholds(dict(zip(names.tolist(), counts)), config.prior)
    return m


def bin_of(score: np.ndarray, bins: int) -> np.ndarray:
    """Bins of equal width over logits from -20 to 20."""
    s = np.clip(score, 1e-12, 1 - 1e-12)
    return np.clip(np.floor((np.log(s / (1 - s)) + 20) / 40 * bins), 0, bins - 1).astype(np.int32)


def histogram_threshold(hits: np.ndarray, others: np.ndarray) -> float:
    """The bin edge with the highest F1 for weighted rows a bin; of equal ones the middle."""
    bins = len(hits)
    tp, fp = np.cumsum(hits[::-1])[::-1], np.cumsum(others[::-1])[::-1]
    f1 = 2 * tp / np.maximum(tp + fp + hits.sum(), 1e-300)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(1 / (1 + np.exp(-((best[0] + best[-1]) / 2 / bins * 40 - 20))))


def thresholds(counts: dict[str, np.ndarray], prior: float) -> dict[str | None, float]:
    """Thresholds of all languages (None) and of each, from (weighted) rows [class, bin] by language."""
    whole = sum(counts.values())
    mix = prior * whole / whole.sum()
    return {None: histogram_threshold(whole[1], whole[0])} | {x: histogram_threshold(*(h + mix)[::-1]) for x, h in sorted(counts.items()) if x}


def known_labels(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, label) of every labelled document."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    )


def corpus_thresholds(docs: DataFrame, labels: DataFrame, model: Model, trained: list) -> dict[str | None, float]:
    """Thresholds from all labelled rows: histograms of those not trained on, each class weighted to its number among all."""
    config, at = model.config, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bin_of(scores(at.value, b.column(2)), config.bins))], names=["doc_id", "lang", "bin"])

    # every document is scored where it is: only numbers, never texts, go to the join
    kinds = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType())])
    binned = docs.where("doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, kinds)
    # at most config.sample ids
    seen = docs.sparkSession.createDataFrame([(i,) for i in trained], T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])).withColumn("seen", F.lit(True))
    own = binned.join(known_labels(labels), "doc_id").join(F.broadcast(seen), "doc_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))

    held: dict[str, np.ndarray] = {}
    total: dict[str, np.ndarray] = {}
    for r in own.groupBy("lang", "label", "seen", "bin").count().toLocalIterator():
        total.setdefault(r.lang, np.zeros(2))[r.label] += r["count"]
        h = held.setdefault(r.lang, np.zeros((2, config.bins)))
        if not r.seen:
            h[r.label, r.bin] += r["count"]
    if not held:
        return model.threshold

    if min(sum(held.values()).sum(1)) < 1:  # every row of a kind was trained on
        return model.threshold
    share = {x: total[x] / np.maximum(h.sum(1), 1) for x, h in held.items()}
    return thresholds({x: h * share[x][:, None] for x, h in held.items()}, config.prior)


def sample_labelled(docs: DataFrame, labels: DataFrame, config: Config, label: str = "toxic") -> list[tuple]:
    """Up to config.sample labelled documents (text, label, lang, doc_id) and config.bytes of text, half of each kind, picked by a hash of doc_id."""
    need(docs, "doc_id", "text", "lang")
    need(labels, "doc_id", label)
    known = known_labels(labels, label)
    half = config.sample // 2
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.where("label = 1").orderBy(*order).limit(half).unionByName(known.where("label = 0").orderBy(*order).limit(half))
    rows = sorted((r.doc_id, r.text, r.label, r.lang or "") for r in bounded_texts(docs, picked, config.bytes, ["lang"]))
    rng = np.random.default_rng(config.seed)
    return [(rows[i][1], rows[i][2], rows[i][3] or None, rows[i][0]) for i in rng.permutation(len(rows))]


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    got = sample_labelled(docs, labels, config)
    m = train([g[0] for g in got], np.array([g[1] for g in got], np.int64), [g[2] for g in got], config)
    if m.threshold[None] <= 1:  # else it could not be trained
        m.threshold = corpus_thresholds(docs, labels, m, sorted({g[3] for i, g in enumerate(got) if i % 5 != 4}))
    return m


def _scored(docs: DataFrame, model: Model, keep: list[str], drop: bool) -> DataFrame:
    at = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x dim floats, whatever the corpus
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType(fields + ([] if drop else [T.StructField("score", DOUBLE), T.StructField("threshold", DOUBLE), T.StructField("toxic", BOOL)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = at.value
        for b in pieces(batches, "text", 2 << 20):
            s = scores(m, b.column(b.schema.get_field_index("text")))
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            cut = np.array([m.threshold.get(x, m.threshold[None]) for x in langs])
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            if drop:
                yield pa.RecordBatch.from_arrays(cols, names=keep).filter(pa.array(s < cut))
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.round(s, 6)), pa.array(np.round(cut, 6)), pa.array(s >= cut)], names=[*keep, "score", "threshold", "toxic"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, threshold, toxic) of every document."""
    need(docs, "doc_id", "text", "lang")
    return _scored(docs.select("doc_id", "lang", "text"), model, ["doc_id", "lang"], False)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all their columns, without the toxic ones."""
    need(docs, "doc_id", "text", "lang")
    safe = plain(docs)
    return _scored(safe, model, safe.columns, True).toDF(*docs.columns)
