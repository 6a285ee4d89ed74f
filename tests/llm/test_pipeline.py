"""Each stage against a brute-force version of it, on its own input."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontam, packing, toxicity
from quire.llm.tokens import WORD_RE
from quire.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile(WORD_RE.replace(r"\x{BF}", "\xbf").replace(r"\x{2000}", " ").replace(r"\x{206F}", "⁯").replace(r"\x{3000}", "　").replace(r"\x{303F}", "〿"))


def words(text):
    return WORD.findall(text.lower())


def near(a, b, tau=2):
    """Edit distance at most tau, row by row; row minima never fall."""
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        if min(q) > tau:
            return False
        p = q
    return p[-1] <= tau


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    more = "/root/testdata/sf0.01"  # the smallest tables have too few toxic labels
    wide = table(spark, more, "documents")
    bad = {r.doc_id for r in toxicity.score(wide, toxicity.fit(wide, table(spark, more, "labels"))).collect() if r.toxic}
    assert bad and {r.doc_id for r in stages["toxicity"](spark, wide, more).collect()} == {r.doc_id for r in wide.collect()} - bad
    one = stages["toxicity"](spark, docs, SF).cache()
    assert one.columns == docs.columns

    two = stages["line_dedup"](spark, one, SF).cache()
    want, kept = {}, []
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        left = []
        for line in r.text.split("\n"):
            b = line.encode()
            if not b or not any(b == k or min(len(b), len(k)) >= 24 and abs(len(b) - len(k)) <= 2 and near(b, k) for k in kept):
                left.append(line)
            kept.append(b)
        if any(left) or not r.text.strip("\n"):
            want[r.doc_id] = "\n".join(left)
    assert {r.doc_id: r.text for r in two.collect()} == want and all(r.n_chars == len(r.text) for r in two.collect())

    three = stages["ngram_jaccard"](spark, two, SF).cache()
    sets = {r.doc_id: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for r in two.collect() if (w := words(r.text))}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 7 * len(sets[a] & sets[b]) >= 2 * (len(sets[a]) + len(sets[b])):
                ra, rb = root[a], root[b]
                root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert {r.doc_id for r in three.collect()} == set(root.values()) | ({r.doc_id for r in two.collect()} - set(sets))

    four = stages["decontamination"](spark, three, SF).cache()
    items = [words(r.text) for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 8]) for w in items for i in range(len(w) - 7)}
    hit = {r.doc_id for r in three.collect() if (w := words(r.text)) and any(tuple(w[i : i + 8]) in grams for i in range(len(w) - 7))}
    close = {m.doc_id for m in decontam.matches(three, table(spark, SF, "benchmark")).collect() if m.near >= 0.5 * m.windows}
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()} - hit - close and four.columns == docs.columns

    five = stages["packing"](spark, four, SF).toPandas()
    encoder = packing.encoding(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    parts = {}
    for r in five.itertuples():
        assert r.n_tokens == len(r.tokens) <= packing.Config().capacity
        for i, a, z, at in zip(r.doc_ids, r.starts, [*r.starts[1:], r.n_tokens], r.doc_starts):
            parts.setdefault(i, []).append((at, list(r.tokens[a:z])))
    assert {i: encoder.decode(sum((t for _, t in sorted(p)), [])[:-1]) for i, p in parts.items()} == {r.doc_id: r.text for r in four.collect() if r.text}
    whole = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(repr, whole.values.tolist())) == sorted(map(repr, five.values.tolist()))


ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta", "en", None),
    (3, "", "de", "b"), (4, None, None, "b"), (None, "lonely text without an id but with words", "en", "c"), (None, "another lonely text, and other words in it", "fr", "c"), (None, None, None, None),
    (5, "word stream " * 30_000, "en", "d"), (6, "   \n \n", "fr", "e"), (7, "one two three four five six seven eight nine", "fr", "e"), (7, "quite another text under the same number", "fr", "e"),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Each stage on nulls, empty and very long texts, repeated rows and ids, clashing names and no rows at all."""
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("__gone", "__gone_id", "__gone_text", "__Gone_Row", "__row", "__bad", "__bad_text", "part", "x", "a.b", "__plain_5", "r", "score"):
        docs = docs.withColumn(name, F.lit(f"keep {name}"))
    docs = docs.cache()
    plain = docs.select("doc_id", "text", "lang")
    plain.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 0), (3, 1), (None, 1), (7, None)], "doc_id bigint, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, "two three four five six seven eight nine"), (None, None), (1, ""), (2, "words")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = lambda df: sorted(repr((r.doc_id, r.text)) for r in df.collect())
    every = rows(docs)
    for name, stage in stages.items():
        if name == "packing":
            continue
        got, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert got.columns == none.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema] and none.count() == 0
        assert all(r["a.b"] == "keep a.b" and r["__Gone_Row"] == "keep __Gone_Row" for r in got.collect())
        left = rows(got)
        if name == "line_dedup":  # document 2 has only a copy, document 6 a second line of its own and an empty one
            assert left == sorted(repr((i, "   \n \n" if i == 6 else t)) for i, t, *_ in ODD if i != 2)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
        elif name == "ngram_jaccard":
            assert left == sorted(repr((i, t)) for i, t, *_ in ODD if i != 2)
        elif name == "decontamination":
            assert left == sorted(repr((i, t)) for i, t, *_ in ODD if not (t or "").startswith("one two"))
        else:
            assert set(left) <= set(every)
    packed = stages["packing"](spark, docs, sf).collect()
    assert sorted(repr(i) for r in packed for i, s in zip(r.doc_ids, r.doc_starts) if s == 0) == sorted(repr(i) for i, t, *_ in ODD if t)
    assert stages["packing"](spark, docs.limit(0), sf).count() == 0
