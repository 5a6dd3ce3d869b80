import hashlib
import random
import re

import numpy as np

from llm import substring_dedup as m


def brute(rows, size=50):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (doc, _), words in zip(rows, split, strict=True):
        if doc is not None:
            for k in range(len(words) - size + 1):
                w = tuple(words[k : k + size])
                least[w] = min(doc, least.get(w, doc))
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - size + 1):
            if doc is not None and least[tuple(words[k : k + size])] < doc:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([49, 50, 51, 60, 140]))] for _ in range(6)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 60, 300]))]
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.25:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "edit"
        rows.append((rng.randrange(10**6) if rng.random() < 0.9 else 7, "\n".join(words) if rng.random() < 0.3 else " ".join(words)))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = m.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges(spark):
    same = " ".join(f"x{k}" for k in range(80))
    rows = [(1, None), (2, ""), (3, " \n"), (4, same), (4, same), (9, same), (None, same), (5, "q " * 400), (6, "q " * 300 + "end"), (7, "a" * 40000 + " b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.select("*", frame["text"].alias("starts"), frame["text"].alias("copy"), frame["doc_id"].alias("D1"))
    assert sorted(map(tuple, m.dedup(frame).collect()), key=str) == brute(rows)
    assert m.dedup(frame.limit(0)).count() == 0


def test_automaton_alone_locates():
    """Nested, overlapping and adjacent phrases, found without any hint of their place."""
    words = [f"a{k}" for k in range(120)]
    machine, ids = m.automaton([(words[0:69], 5), (words[10:60], 7), (words[60:110], 9), (words[60:110], 3)])
    text = ["z", *words[:70], "y", *words[60:110], *words[10:60]]
    assert m.occurrences(machine, ids, 8, text) == [1, 70, 72, 172]
    assert m.occurrences(machine, ids, 6, text) == [1, 70, 72, 122]
    assert m.occurrences(machine, ids, 3, text) == []


def test_many_shards_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_WORDS", 60)
    monkeypatch.setattr(m, "PIECE_WORDS", 400)
    rows = corpus(3)
    got = m.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_phrases_are_whole_wherever_they_occur(spark):
    """A passage that occurs in parts and whole is cut into phrases so that each occurrence is whole."""
    words = [f"p{k}" for k in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[:120]])), (3, " ".join([*words[60:], "y"])), (4, " ".join([*words[100:160], *words[100:160]]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.dedup(frame).collect()), key=str) == brute(rows)
    found = m.phrases(m.base.stored(m.anchored_windows(frame))).collect()
    assert {r.doc_id for r in found} == {1} and 2 <= len(found) <= 8 and all(r.b - r.a >= 50 for r in found)


def test_anchor_of_every_window():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 50, 300, dtype=np.uint64)
    least, mask = m.anchors(grams, 41)
    assert [int(x) for x in least] == [int(grams[k : k + 41].min()) for k in range(260)]
    assert all(any(mask[k : k + 41] & (grams[k : k + 41] == least[k])) for k in range(260))
