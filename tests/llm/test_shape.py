"""Odd input for every operator: nulls, empty and very long texts, repeated rows, empty tables, clashing column names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, knn, langid, linededup, ogg, packing, pii, sstable, toxicity

RANKS, VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/piece_bpe_32k.model"
LONG = "word stream " * 30_000
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", None), (3, "", "de", "b"), (4, None, None, "b"), (None, "lonely text without an id but with words", "en", "c"),
    (None, None, None, None), (5, LONG, "en", "d"), (6, "   \n \n", "fr", "e"), (7, "!!! ??? ***", "fr", "e"), (8, "one", "zz", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The documents with columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("part", "blob", "x", "y", "grp", "k", "v", "p", "key", "media", "score", "toxic", "exact", "item_id", "a.b", "__gone", "__gone_id", "__gone_text", "__gone_row", "__row", "__d", "__again", "__bad", "__plain_0"):
        df = df.withColumn(name, F.lit(f"keep {name}"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (99, 0, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, "beta gamma delta epsilon zeta"), (0, "beta gamma delta epsilon zeta"), (1, None), (2, ""), (None, "nothing that occurs at all here")], "item_id bigint, text string")


def keep_all(got, docs):
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    return got.collect()


def test_ogg(docs):
    got = ogg.query(docs)
    files = [r for r in ROWS if r[1] is not None]
    assert got.where("kind = 'header'").count() == 8 * len(files)
    assert got.where("status = 'bad'").count() == got.where("status = 'damaged'").count() == len(files)
    assert got.where("doc_id is null and kind = 'header'").count() == 8
    assert ogg.query(docs.limit(0)).count() == 0


def test_sstable(docs):
    shards = sstable.build(docs, parts=3).cache()
    got = sorted((repr(sstable.id_of(bytes(r.key))), repr(r.value)) for r in sstable.scan(shards).collect())
    assert got == sorted((repr(r[0]), repr(r[1])) for r in ROWS)
    assert sorted(r.value for r in sstable.lookup(shards, [1, 77]).collect()) == [ROWS[0][1]] * 2
    assert sstable.build(docs.limit(0)).count() == 0


def test_quality(docs, labels):
    model = knn.fit(docs, labels)
    rows = knn.classify(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.score == 0.5 for r in rows if r.doc_id in (3, 4, 6))
    none = knn.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in knn.classify(docs, none).collect()} == {0.5}
    assert knn.classify(docs.limit(0), model).count() == 0


def test_decontamination(docs, bench):
    got = {(r.doc_id, r.item_id): (r.exact, r.near, r.windows) for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 0): (1, 1, 1), (2, 0): (1, 1, 1)}
    left = keep_all(decontam.clean(docs, bench), docs)
    assert len(left) == len(ROWS) - 3
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_jaccard(docs):
    got = jaccard.classes(docs).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1)]
    assert jaccard.pairs(docs).count() == 0
    left = keep_all(jaccard.one_of_each(docs), docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted((r[0] is None, r[0] or 0) for r in ROWS if r[0] != 2)
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.one_of_each(docs.limit(0)).count() == 0


def test_jaccard_tells_rows_of_one_id_apart(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = [(1, a, 0), (2, b, 1), (2, a + " eta", 2), (3, b, 3), (3, "nothing like the others at all here", 4)]
    left = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, k int")).collect()
    assert sorted(r.k for r in left) == [0, 1, 4]


def test_language(docs):
    model = langid.fit(docs, VOCABULARY)
    rows = langid.classify(docs, model).collect()
    assert len(rows) == len(ROWS) and all(r.predicted is None for r in rows if r.doc_id in (3, 4, 6))
    none = langid.fit(docs.limit(0), VOCABULARY)
    assert {r.predicted for r in langid.classify(docs, none).collect()} == {None}
    assert langid.classify(docs.limit(0), model).count() == 0


def test_packing(docs):
    config = packing.Config(capacity=1000, group=20_000)
    got = packing.pack(docs, RANKS, config).collect()
    encoder = packing.encoding(open(RANKS, "rb").read())
    want, total = {}, {}
    for i, t, *_ in ROWS:
        if t:
            want[i] = want.get(i, 0) + len(encoder.encode_ordinary(t)) + 1
    for r in got:
        assert len(r.tokens) == r.n_tokens <= 1000
        for i, a, z in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens]):
            total[i] = total.get(i, 0) + z - a
    assert total == want
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == len(ROWS)
    toxic = {(r.doc_id, r.score >= r.threshold) for r in toxicity.score(docs, model).collect() if r.toxic}
    left = keep_all(toxicity.drop_toxic(docs, model), docs)
    assert (2, True) in toxic and len(left) == len(ROWS) - sum((r[0], True) in toxic for r in ROWS)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"))  # one kind alone: nothing is toxic
    assert toxicity.score(docs, none).where("toxic").count() == toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("toxic").count() == 0


def test_line_dedup(docs):
    got = {(r.doc_id, r.line_no, r.first_doc_id, r.first_line_no) for r in linededup.dropped(docs).collect()}
    assert got == {(2, 0, 1, 0)}
    left = keep_all(linededup.dedup(docs), docs)
    assert len(left) == len(ROWS) - 1  # document 2 had no other line
    assert [r.text for r in left if r.doc_id == 6] == ["   \n \n"]
    assert linededup.dedup(docs.limit(0)).count() == 0


def test_pii(docs):
    got = keep_all(pii.pseudonymise(docs, b"k"), docs)
    assert sorted(map(repr, got)) == sorted(map(repr, docs.collect()))
    assert pii.report(docs, b"k").count() == len(ROWS) and pii.report(docs.limit(0), b"k").count() == 0


def test_kernels_take_empty_arrays():
    none = pa.array([], pa.string())
    assert jaccard.distinct_grams(none, 5)[0].size == 0
    assert langid.distinct_words(none).raw.size == langid.distinct_words(none, 32).raw.size == 0
    assert knn.features(none, 10)[0].size == 0
    assert linededup.within(*(np.zeros(0, np.uint8), np.zeros(1, np.int64)) * 2, 2).size == 0
