import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import language_model as m
from llm.quality import remainder


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), None]


def discounted(counts, r):
    n = Counter(counts.values())
    k = 5
    if r > k:
        return r - m.ABOVE
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1
    if n[1] and tail < 1 and all(n[j] for j in range(1, k + 1)):
        d = [((j + 1) * n[j + 1] / (j * n[j]) - tail) / (1 - tail) for j in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return r * d[r - 1]
    loss = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return r - loss


class Brute:
    """Katz's law of contexts of two, one and no words, each by its definition."""

    def __init__(self, texts):
        split = [tokens(t) for t in texts]
        starts = ["<start>", "<start>"]
        self.one = Counter(w for s in split for w in s)
        self.grams = {n: Counter(tuple(t[k - n + 1 : k + 1]) for s in split for t in [starts + s] for k in range(2, len(t))) for n in (2, 3)}
        self.contexts = {n: Counter(g[:-1] for g in c.elements()) for n, c in self.grams.items()}
        self.n = sum(self.one.values())
        kept = sum(discounted(self.one, c) for c in self.one.values()) / self.n
        self.unknown = max(1 - kept, 1 / (self.n + len(self.one) + 1))
        self.scale = (1 - self.unknown) / kept
        self.seen = {}

    def law(self, context, w):
        if not context:
            return discounted(self.one, self.one[w]) / self.n * self.scale if self.one[w] else self.unknown
        n = len(context) + 1
        c = self.contexts[n][context]
        if not c:
            return self.law(context[1:], w)
        if context not in self.seen:
            after = {g[-1]: discounted(self.grams[n], r) / c for g, r in self.grams[n].items() if g[:-1] == context}
            weight = (1 - sum(after.values())) / (1 - sum(self.law(context[1:], x) for x in after))
            self.seen[context] = after, weight
        after, weight = self.seen[context]
        return after[w] if w in after else weight * self.law(context[1:], w)

    def score(self, text):
        s = ["<start>", "<start>", *tokens(text)]
        return sum(math.log10(self.law(tuple(s[k - 2 : k]), s[k])) for k in range(2, len(s)))


def corpus(seed, n=70):
    rng = random.Random(seed)
    vocab = [f"W{k}" for k in range(60)]
    return [(k, " ".join(rng.choice(vocab[: rng.choice([3, 20, 60])]) + ("x" * rng.randrange(30) if rng.random() < 0.1 else "") for _ in range(rng.choice([0, 1, 8, 60])))) for k in range(n)]


@pytest.mark.parametrize(("seed", "chunk", "part"), [(1, 10**6, 10**6), (2, 150, 200)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, part):
    monkeypatch.setattr(m, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(m, "PART_TOKENS", part)
    rows = corpus(seed) + [(500, None), (None, "W1 W2"), (7, "W1 W1")]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    model = Brute([t for d, t in rows if not held(d)])
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frame = frame.select("*", frame["text"].alias("held"), frame["text"].alias("chunk"))
    got = sorted((tuple(r) for r in m.katz_scores(frame, remainder(F.col("doc_id"), 7) == 2).collect()), key=str)
    want = []
    for d, t in rows:
        s = tokens(t)
        base = sum(math.log10((model.one[w] + 1) / (model.n + len(model.one) + 1)) for w in s)
        want.append((d, held(d), len(s), sum(model.one[w] > 0 for w in s), model.n, base, model.score(t)))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:5] == b[:5]
        np.testing.assert_allclose(a[5:], b[5:], rtol=1e-9)


def test_law_sums_to_one():
    model = Brute([t for _, t in corpus(3)])
    contexts = [(), ("<start>",), ("w1",), ("w50",), ("never seen",), ("<start>", "<start>"), ("w1", "w2"), ("w2", "never seen"), next(iter(model.contexts[3]))]
    for context in contexts:
        assert abs(sum(model.law(context, w) for w in model.one) + model.law(context, "new") - 1) < 1e-9


def test_equal_files_are_repeated_rows(spark, tmp_path):
    """Two equal files make two equal chunks, which score apart."""
    rows = corpus(4, 20)
    for k in range(2):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"documents.parquet/k={k}"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert frame.rdd.getNumPartitions() == 2
    got = sorted(((r.doc_id, r.score) for r in m.katz_scores(frame, F.lit(False)).collect()))
    model = Brute([t for _, t in rows] * 2)
    for (d, score), (want_d, text) in zip(got, sorted(rows * 2, key=lambda r: r[0]), strict=True):
        assert d == want_d and abs(score - model.score(text)) < 1e-8


def test_tables_go(spark):
    before = {t.name for t in spark.catalog.listTables()}
    m.katz_scores(spark.createDataFrame(corpus(5, 5), "doc_id long, text string"), F.lit(False)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    assert (m.unpack_sorted(m.pack_sorted(x)) == x).all() and len(m.unpack_sorted(m.pack_sorted(x[:0]))) == 0
    y = rng.normal(size=77)
    assert (m.unpack(m.pack(y), "<f8") == y).all()


def test_slices_cover_keys():
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    for parts in (1, 2, 64, 1 << 20):
        got = list(m._slices(keys, parts))
        assert [k for _, a, b in got for k in range(a, b)] == list(range(500)) and len({p for p, _, _ in got}) == len(got)
        assert all(int(keys[k]) * parts >> 64 == p for p, a, b in got for k in range(a, b))
    assert list(m._slices(keys[:0], 8)) == []


def test_empty_and_held_out_only(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert m.katz_scores(empty, F.lit(False)).count() == 0
    rows = m.katz_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)]


def test_beats_base_on_held_out_text(spark):
    rows = m.op4_katz_scores(spark, "/root/testdata/sf0.001").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
