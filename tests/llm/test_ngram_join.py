import random

import numpy as np
import pytest

from llm.ngram_join import join_task, ngram_join, trie_join


def sets_of(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    ids = [r[0] for r in rows]
    sets = [sets_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    out = []
    for k in range(len(rows)):
        out.append((ids[k], len(sets[k]), min(ids[j] for j in range(len(rows)) if find(j) == find(k)), links[k]))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.45:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab)
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 30, 80, 200]))]
            if kind > 0.8:
                words = common + words
        rows.append((k * 3, " ".join(words).upper() if rng.random() < 0.1 else "\n".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_blocks_agree_with_one_task(spark, monkeypatch):
    import llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK_TOKENS", 150)
    monkeypatch.setattr(m, "BLOCK_SETS", 3)
    rows = corpus(3)
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t", 7), (4, "a b", 7), (4, "a b", 7), (None, "a b", 7), (6, "x " * 20000, 7), (7, "X " * 19000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, D1 int")
    frame = frame.select("*", frame["D1"].alias("rep"), frame["D1"].alias("token"), frame["D1"].alias("TEXT"))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join(frame).collect()}
    assert got == {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 1), (None, 1, None, 0), (6, 1, 6, 1), (7, 1, 6, 1)}
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_join_matches_pairs():
    rng = np.random.default_rng(5)
    pool = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint32) for _ in range(60)]
    pool = list({x.tobytes(): x for x in pool + [np.unique(np.append(x, 61)).astype(np.uint32) for x in pool[:30]]}.values())
    want = {(a, b) for a, x in enumerate(pool) for b, y in enumerate(pool) if 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))}
    assert {(s, int(q)) for s, found in trie_join(pool, pool) for q in found} == want


def test_task_sides():
    a, b = np.arange(8, dtype=np.uint64), np.arange(1, 9, dtype=np.uint64)
    links, root = join_task(np.array([5, 9]), np.array([2, 3]), np.array([0, 1]), [a, b])
    assert links.tolist() == [3, 2] and root.tolist() == [5, 5]
