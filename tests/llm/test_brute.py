"""The registered operators, as frames, against plain versions of them on small tables."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from quire.llm import common, knn, langid, pii, sstable, toxicity
from quire.llm.tokens import span_hashes
from quire.session import table
from tests.llm.test_pipeline import words

SF = "/root/testdata/sf0.001"


def hash_of(word, bits, stem=False):
    b = word.encode()
    h = int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    return (h * 0x9E3779B97F4A7C15 % (1 << 64) >> 20 if stem else h) & ((1 << bits) - 1)


def test_toxicity_scores_equal_plain_convolution(spark):
    """Embedding, filters over every window, maxima and the logistic unit, one text and one window at a time."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    config = toxicity.Config(bits=10, dim=3, filters=2, epochs=2, sample=60)
    m = toxicity.fit(docs, labels, config)
    rows = {r.doc_id: r for r in docs.collect()}
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(rows)
    for r in got:
        ws = words(rows[r.doc_id].text)
        emb = [m.table[hash_of(w, 10)] + m.table[hash_of(w.encode()[:4].decode(errors="ignore") if len(w.encode()[:4].decode(errors="ignore").encode()) == len(w.encode()[:4]) else w, 10, True)] if w.isascii() else None for w in ws]
        if any(e is None for e in emb):
            continue  # stems cut inside a character have no plain string
        feats = []
        for width, w, b in zip(config.widths, m.filters, m.bias):
            for k in range(config.filters):
                best = 0.0
                for i in range(len(emb)):
                    window = [emb[i + d] if i + d < len(emb) else np.zeros(3) for d in range(width)]
                    best = max(best, float(sum(np.dot(window[d], w[d * 3 : d * 3 + 3, k]) for d in range(width)) + b[k]))
                feats.append(best)
        want = 1 / (1 + math.exp(-(sum(f * o for f, o in zip(feats, m.out)) + m.out_bias)))
        assert abs(r.score - want) < 1e-4 and abs(r.threshold - m.threshold.get(rows[r.doc_id].lang, m.threshold[None])) < 1e-6
        assert r.toxic == (want >= r.threshold) or abs(want - r.threshold) < 1e-4
    assert sum(words(r.text)[0].isascii() for r in rows.values()) > 50


def test_toxicity_gradient_lowers_the_loss():
    """One pass over a few rows moves every weight the way that finite differences say."""
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefgh") * 2 for _ in range(6)) for _ in range(40)]
    labels = np.array(["aa bb" in t or "cc" in t for t in texts], np.int64)
    config = toxicity.Config(bits=8, dim=4, epochs=1)
    loss = lambda m: -np.mean(np.log(np.where(labels == 1, s := toxicity.scores(m, pa.array(texts)), 1 - s)))
    before, after = (loss(toxicity.train(texts, labels, ["x"] * 40, toxicity.Config(bits=8, dim=4, epochs=e))) for e in (0, 12))
    assert after < 0.6 * before and config.epochs == 1


def test_quality_votes_as_a_frame(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    m = knn.fit(docs, labels, knn.Config(block=13))
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    v = np.concatenate([knn.project(m, pa.array([r.text])) for r in rows])
    got = {r.doc_id: r for r in knn.classify(docs, m).collect()}
    known = set(m.ids.tolist())
    assert len(got) == len(rows) and known <= set(got)
    for r, x in zip(rows, v):
        near = sorted(((round(float(np.dot(x, y)), 5), bool(g)) for y, g, i in zip(m.vectors, m.label, m.ids) if i != r.doc_id), reverse=True)
        cut = max(near[14][0], 0)
        votes = [(s, g) for s, g in near if s >= cut - 2e-5 and s > 0]
        want = sum(s for s, g in votes if g) / sum(s for s, _ in votes) if votes else 0.5
        assert abs(got[r.doc_id].score - want) < 0.02 and got[r.doc_id].good == (got[r.doc_id].score >= m.threshold)


def test_language_as_a_frame(spark):
    docs = table(spark, SF, "documents").limit(25)
    m = langid.fit(table(spark, SF, "documents"), "/opt/tokenizers/piece_bpe_32k.model", langid.Config(sample=20, rounds=1))
    pieces = {v: i for v in langid.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model") for i in [int(np.searchsorted(m.hashes, span_hashes(np.frombuffer(v, np.uint8), np.array([0]), np.array([len(v)]))[0]))]}
    memo = {}

    def score(word, lang):
        if (word, lang) not in memo:
            a = [1.0] + [0.0] * len(word)
            for j in range(1, len(word) + 1):
                a[j] = sum(a[i] * m.prob[pieces[word[i:j]], lang] for i in range(max(0, j - m.most), j) if word[i:j] in pieces)
            memo[word, lang] = math.log(a[-1])
        return memo[word, lang]

    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.classify(docs, m).collect():
        ws = [b" " + w.encode() for w in re.findall(r"[^ \t\n\r\f\v]+", texts[r.doc_id])]
        bits = [-sum(score(w, k) for w in ws) / math.log(2) / sum(map(len, ws)) for k in range(len(m.langs))]
        order = sorted(range(len(bits)), key=lambda k: bits[k])
        assert r.predicted == m.langs[order[0]] and abs(r.bits_per_byte - bits[order[0]]) < 2e-6 and abs(r.margin - (bits[order[1]] - bits[order[0]])) < 3e-6


def test_pii_finds_what_was_planted(spark):
    """Valid and invalid values among plain words: each valid one is replaced as alone, nothing else changes, the counts are right."""
    r = random.Random(3)
    key, rows, want = b"k", [], {}
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = r.choice("3456") + digits(r.randint(11, 17))
        d += str(pii.luhn(d))
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), "card"

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}", "iban"

    def wrong():
        d = "4" + digits(14)
        return r.choice([d + str((pii.luhn(d) + 1) % 10), f"000-{r.randint(10, 99)}-{digits(4)}", "31.02.2021", "300.1.2.3", "2021-13-01", "1234", "deadbeef"]), None

    kinds = [
        card, iban, wrong, lambda: (f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", "ssn"), lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"),
        lambda: (f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "date"), lambda: (f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1000, 9999)}", "date"),
        lambda: (f"user.{digits(3)}@example{digits(1)}.org", "mail"), lambda: ("+49 151 " + digits(8), "phone"), lambda: ("".join(r.choice("0123456789abcdef") for _ in range(r.randint(34, 90))) + "a1", "token"),
    ]
    for i in range(150):
        out, new, count = [], [], dict.fromkeys(pii.KINDS, 0)
        for _ in range(r.randint(1, 12)):
            value, kind = r.choice(kinds)()
            words_ = " ".join(r.choice(["alpha", "Über", "so, then", "fin."]) for _ in range(r.randint(1, 3)))
            out += [words_, value]
            if kind is None:
                new += [words_, value]
            else:
                alone, found = pii.replace(value, key)
                assert found == {kind: 1} and alone != value, (value, kind, found)
                count[kind] += 1
                new += [words_, alone]
            out.append("and")
            new.append("and")
        rows.append((i, " ".join(out)))
        want[i] = (" ".join(new), *count.values())
    got = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string"), key).collect()
    assert {x.doc_id: tuple(x)[1:] for x in got} == want
    back = pii.restore(pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key), key).collect()
    assert sorted(map(tuple, back)) == rows


def test_sstable_of_the_documents_equals_a_sort(spark):
    docs = table(spark, SF, "documents")
    shards = sstable.build(docs, parts=4).collect()
    entries = [e for r in sorted(shards, key=lambda r: bytes(r.shard_key)) for e in sstable.Reader(bytes(r.data)).scan()]
    assert [(sstable.id_of(k), v[1:].decode()) for k, v in entries] == sorted((r.doc_id, r.text) for r in docs.collect())
    for r in shards:
        reader = sstable.Reader(bytes(r.data))
        assert (reader.entries, len(reader.place)) == (r.entries, r.blocks) and reader.last[-1] == bytes(r.last_key)


def test_sampled_texts_are_bounded(spark):
    rows = [(1, "short"), (2, "x" * 5000), (3, "also short"), (3, "a second text"), *[(4, "hot")] * 3000, (None, "none"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    picked = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id bigint, label int")
    got = common.bounded_texts(docs, picked, 100, [])
    assert sorted((r.doc_id, r.label) for r in got) == [(1, 1), (3, 1), (4, 0), (5, 1)] and sum(len(r.text) for r in got) <= 100
    one = common.written(docs, "probe")
    assert one.count() == len(rows)
    common.sweep(spark)
    assert not spark.sparkContext._quire_tables
