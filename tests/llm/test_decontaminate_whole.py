"""Windows that the starts of single shingles or a SimHash radius would lose."""

import random

from llm import decontaminate as m

from .test_decontaminate import brute


def found(spark, docs, items):
    got = m.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in got.collect()}


def agrees(spark, docs, items):
    got, want = found(spark, docs, items), brute(docs, items)
    assert set(got) == set(want)
    assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in want)
    return got


def test_reordered_passages(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for k, n in enumerate((40, 60, 61, 90)):
        item = fresh(n)
        items.append((k, " ".join(item)))
        half = n // 2
        docs.append((k, " ".join([*fresh(150), *item[half:], *item[:half], *fresh(150)])))
        docs.append((100 + k, " ".join([*item[half:], *item[:half], *fresh(200)])))
    got = agrees(spark, docs, items)
    assert len(got) == 8


def test_edited_ends(spark):
    rng = random.Random(6)
    items, docs = [], []
    for k in range(120):
        n = rng.choice([32, 46, 74])
        item = [f"e{rng.randrange(10**6)}" for _ in range(n)]
        edited = item[: n - (n - 4) // 7] + [f"f{rng.randrange(10**6)}" for _ in range((n - 4) // 7)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([f"g{rng.randrange(10**6)}" for _ in range(20)] + edited + [f"g{rng.randrange(10**6)}" for _ in range(20)])))
    got = agrees(spark, docs, items)
    assert len(got) == 120 and max(r.distance for r in got.values()) > m.RADIUS


def test_repeats_and_repeated_ids(spark):
    item = "a b c d e " * 6
    docs = [(1, "x " * 30 + item * 3 + "y " * 10), (2, "a b c d e a b"), (3, item[:-6]), (4, "q w e r t " * 20), (4, "z " + item)]
    got = found(spark, docs, [(1, item), (2, "a b c")])
    want = brute(docs, [(1, item), (2, "a b c")])
    assert {k: r.similarity for k, r in got.items()} == want


def test_recall_of_truncated_and_repeating_items(spark):
    """Items whose similarity to a passage lies just above the threshold, and items that end in one repeated word."""
    rng = random.Random(8)
    fresh = lambda n: [f"t{rng.randrange(10**7)}" for _ in range(n)]
    items, docs = [], []
    for k in range(60):
        item = fresh(100)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*fresh(5), *item[:87], *fresh(15)])))
        tail = [*fresh(87), *["same"] * 13]
        items.append((1000 + k, " ".join(tail)))
        docs.append((1000 + k, " ".join([*fresh(5), *tail[:87], *fresh(15)])))
    got = found(spark, docs, items)
    want = {p: s for d, i in zip(docs, items, strict=True) for p, s in brute([d], [i]).items()}  # the items share no word
    assert len(want) == 120 and set(got) == set(want)
    assert all(abs(got[p].similarity - s) < 1e-9 for p, s in want.items())


def test_index_alone_finds_nearly_all(spark):
    """The share that the fingerprints find before the exact way for the rest."""
    rng = random.Random(9)
    fresh = lambda n: [f"t{rng.randrange(10**7)}" for _ in range(n)]
    items, docs = [], []
    for k in range(200):
        item = fresh(100)
        items.append((k, " ".join(item)))
        docs.append((k, " ".join([*item[:87], *fresh(13)])))
    known = m.items(spark.createDataFrame(items, "item_id long, text string"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = m.hits(frame, known)
    gate = m.gated(found, known).selectExpr("h1", "h2", "carrier", "size", "k", "explode(starts) as start").distinct()
    stamped = m.windows(frame, gate).selectExpr("h1", "h2", "carrier", "size", "k", "start", f"{m.prints('features')} as prints")
    pairs = m.looked_up(stamped, known).where("carrier = item_id").select("carrier").distinct().count()
    assert pairs >= 198


def test_very_long_text_ties_and_copies(spark):
    rng = random.Random(10)
    item = [f"k{j}" for j in range(40)]
    filler = [f"z{rng.randrange(50)}" for _ in range(60_000)]
    long = " ".join([*filler[:30_000], *item, *filler[30_000:], *item])  # two windows of similarity 1: the first counts
    docs = [(1, long), (2, long), (3, " ".join(item)), (3, " ".join(item)), (4, "A " * 50)]
    got = found(spark, docs, [(7, " ".join(item)), (8, " ".join(item))])
    assert {k: (r.similarity, r.start) for k, r in got.items()} == {(d, i): (1.0, 30_000 if d < 3 else 0) for d in (1, 2, 3) for i in (7, 8)}
