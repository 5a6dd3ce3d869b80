import random
import re
from collections import Counter

from llm import decontaminate as m


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = {}
    for doc, text in docs:
        words = split(text)
        for item, wanted in items:
            want = split(wanted)
            if not want:
                continue
            k = min(5, len(want))
            goal, n = grams(want, k), len(want)
            for start in range(max(1, len(words) - n + 1)):
                own = grams(words[start : start + n], k)
                shared = sum((own & goal).values())
                total = sum((own | goal).values())
                if total and shared / total >= 0.75:
                    out[doc, item] = max(out.get((doc, item), 0), shared / total)
    return out


def cases(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 14, 30, 59])))) for k in range(25)]
    items += [(90, items[1][1]), (91, ""), (92, None)]
    docs = []
    for k in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 4, 40, 400]))]
        for _ in range(rng.randrange(3)):
            passage = split(rng.choice(items)[1])
            for _ in range(rng.choice([0, 0, 1, 3])):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(vocab)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((k, " ".join(words).upper() if k % 7 == 0 else "\n".join(words)))
    return docs + [(None, items[3][1]), (100, None), (101, items[4][1])], items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string")
        d = d.select("*", d["text"].alias("size"), d["doc_id"].alias("item_id"), d["text"].alias("words"))
        got = m.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
        want = {k: v for k, v in brute(docs, items).items() if k[0] is not None}
        found = {(r.doc_id, r.item_id): r.similarity for r in got}
        assert set(found) == set(want)
        assert all(abs(found[k] - want[k]) < 1e-9 or found[k] >= 0.75 for k in want)
        assert all(r.distance <= m.RADIUS for r in got)


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert m.contaminated(d, b).count() == 0
    assert m.contaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), b).count() == 0


def test_simhash_bits(spark):
    rows = spark.sql(f"select {m.simhash('w')} f from values (array('a')), (array('a', 'a')), (cast(array() as array<string>)) as t(w)").collect()
    one = spark.sql("select xxhash64('a') f").first().f
    assert [r.f for r in rows] == [one, one, 0]


def test_blocks_find_all_within_radius(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 16)):
            b ^= 1 << bit
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    frame = spark.createDataFrame(pairs, "a long, b long").selectExpr(f"{m.blocks('a', near=True)} as x", f"{m.blocks('b')} as y")
    assert frame.where("size(array_intersect(x, y)) = 0").count() == 0
