import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm import quality as m
from llm.features import _SYMBOL, DENSE, DIMENSIONS, chunks

TEXTS = [
    None, "", "  \n\t ", "one", "a b c a b c a b c", "x y\nx y\n\nx y \nx y\n \n", "é𝄞 #*$%&|<> ü\x0b\x0cend", "a a a a", "q " * 5000, "\nlead\n\nlead", "tail\n", "w" * 3000 + "\n" + "w" * 3000, "a b c\rd a b c", "x\n" * 7,
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    repeats = len(covered)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, repeats, failed


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_counts(limit):
    got = []
    for _, c in chunks(pa.array(TEXTS), limit):
        got += list(zip(c.n_words, c.word_chars(), c.count(_SYMBOL), c.dup_lines(), c.repeat_words(), strict=True))
        assert c.features().shape == (c.texts, DENSE + DIMENSIONS) and np.isfinite(c.features()).all()
    assert [tuple(map(int, g)) for g in got] == [brute(t)[:5] for t in TEXTS]


def test_rules_on_table(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = m.op6_quality_rules(spark, d).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(docs[r.doc_id])
        assert 0 <= r.score <= 1 and not (r.base_failed and r.kept)


def test_edge_rows(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "a"), (3, "a")], "doc_id long, text string")
    frame = frame.select("*", frame["text"].alias("score"), frame["text"].alias("kept"))
    assert m.rule_columns(frame, m.neutral()).count() == len(TEXTS) + 2
    assert {r.score for r in m.scored(frame, m.neutral()).collect()} == {0.5}
    assert m.scored(frame.limit(0), m.neutral()).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert m.train_quality(frame, none).weights.any() == np.False_


def test_pu_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = m.op3_quality_classifier(spark, d).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.9


def test_nnpu_recovers_prior():
    rng = np.random.default_rng(0)
    make = lambda n, at: np.concatenate([rng.normal(at, 1, (n, DENSE)), np.zeros((n, 4))], 1)
    positive, unlabelled = make(1500, 1), np.concatenate([make(1200, 1), make(800, -1)])
    prior = m.estimate_prior(positive, unlabelled)
    assert abs(prior - 0.6) < 0.08
    model = m.fit_nnpu(positive, unlabelled, prior)
    assert (model.score(make(500, 1)) > 0.5).mean() > 0.95 and (model.score(make(500, -1)) < 0.5).mean() > 0.95


def test_risk_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    size = 6
    for prior, shift in ((0.4, 0.5), (0.95, -3.0)):  # the negative part above and below zero
        positive, unlabelled = rng.normal(1, 1, (40, size)), rng.normal(shift, 1, (90, size))
        center, scale = rng.normal(0, 1, size), rng.uniform(0.5, 2, size)

        def at(p, center=center, scale=scale, positive=positive, unlabelled=unlabelled, prior=prior):
            model = m.Linear(center, scale, p[:-1], float(p[-1]))
            w = model.weights / model.scale
            return m.pu_risk(model, m.unlabelled_sums(unlabelled, w, float(model.bias - center @ w)), positive, prior, 1e-2)

        p = rng.normal(0, 0.3, size + 1)
        z = (positive - center) / scale @ p[:-1] + p[-1]
        negative = at(p)[0] > prior * np.logaddexp(0, -z).mean() + 0.005 * p[:-1] @ p[:-1] + 1e-5

        def risk(p, center=center, scale=scale, positive=positive, unlabelled=unlabelled, prior=prior, negative=negative):
            zp, zu = (positive - center) / scale @ p[:-1] + p[-1], (unlabelled - center) / scale @ p[:-1] + p[-1]
            below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            return (prior * np.logaddexp(0, -zp).mean() + below if negative else -below) + 0.005 * p[:-1] @ p[:-1]

        got = at(p)[1]
        want = [(risk(p + e) - risk(p - e)) / 2e-5 for e in 1e-5 * np.eye(size + 1)]
        np.testing.assert_allclose(got, want, atol=1e-4)


def test_packed_features_and_sums(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id")], "doc_id long, text string")
    training = m.remainder(docs["doc_id"], 3) != 1
    packed = m.packed_features(docs, training)
    rows = [m.unpacked(r.asDict()) for r in packed.collect()]
    texts = [t for k, t in enumerate(TEXTS) if zlib.crc32(str(k).encode()) % 3 != 1]
    want = np.concatenate([c.features() for _, c in chunks(pa.array(texts))])
    got = np.concatenate([x for x, _ in rows])
    order = lambda x: x[np.lexsort(x[:, :DENSE].T)]
    assert np.abs(order(got) - order(want)).max() < 1 / 255
    sums = m.summed(packed, lambda x, of: np.array([len(x), (of == 0).sum()], float), 2)
    assert sums[0] == len(texts) and 0 <= sums[1] <= len(texts)


def test_labels_repeated_null_and_unknown(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, None, 0), (3, 7, 0), (None, 1, 0), (4, 0, 1), (99, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("Quality ", m.F.lit(1))
    assert sorted(map(tuple, m.labelled(labels, None).collect())) == [(1, "0"), (2, "1"), (4, "0"), (99, "1")]


def test_one_row_of_a_kind_is_enough(spark):
    docs = spark.createDataFrame([(1, "a fine text about rivers " * 20), (2, "$$ ## buy now " * 20), (3, "rivers and fine hills " * 20), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model = m.train_quality(docs, labels)
    score = {r.doc_id: r.score for r in m.scored(docs, model).collect()}
    assert score[1] > 0.5 > score[2]
    everyone = m.F.lit(True)
    pu, prior = m.train_pu(docs, labels, everyone)
    assert 0.05 <= prior <= 0.98 and m.scored(docs, pu).count() == 4
    assert m.train_pu(docs, labels.where("quality = 0"), everyone)[0].weights.any() == np.False_
    assert m.train_pu(docs.limit(0), labels, everyone)[1] == 0.5


def test_calibration_on_unseen_rows():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 4000).astype(float)
    x = np.concatenate([rng.normal(y[:, None] * 1.2, 1, (4000, 3)), np.zeros((4000, DENSE + 1))], 1)
    model = m.calibrate(m.fit_logistic(x[:1000], y[:1000]), x[1000:2000], y[1000:2000])
    score = model.score(x[2000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (score >= low) & (score < low + 0.25)
        assert abs(score[part].mean() - y[2000:][part].mean()) < 0.06
