import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from llm.sharding import communication_matrix, hypergeometric, shard_sizes, shuffle_into_shards


def test_hypergeometric_law():
    rng = random.Random(1)
    seen = Counter(hypergeometric(rng, 6, 9, 5) for _ in range(20000))
    from math import comb

    for k in range(6):
        assert abs(seen[k] / 20000 - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 0.015
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 4, 0, 3) == 3
    big = hypergeometric(rng, 10**10, 39 * 10**10, 10**5)
    assert abs(big - 2500) < 400


def test_matrix_sums():
    counts, sizes = [7, 0, 30, 5], shard_sizes(42, 5)
    matrix = communication_matrix(counts, sizes)
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix, strict=True)] == sizes
    assert max(sizes) - min(sizes) == 1


def check(rows, shards):
    per = Counter(r.shard for r in rows)
    counts = [per[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))


def test_shards(spark, monkeypatch):
    import llm.sharding as m

    monkeypatch.setattr(m, "PIECE_ROWS", 20)
    frame = spark.range(1003).selectExpr("id as doc_id", "id % 3 as extra", "'x' as _x")
    rows = shuffle_into_shards(frame, ["doc_id"], 7).collect()
    assert len(rows) == 1003 and {r.doc_id for r in rows} == set(range(1003))
    check(rows, 7)
    pairs = sum(1 for s in range(7) for a, b in zip(*(lambda v: (v, v[1:]))([r.doc_id for r in sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)]), strict=False) if b > a)
    assert 400 < pairs < 600  # no order is left


def test_edges(spark):
    frame = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "doc_id long")
    check(shuffle_into_shards(frame, ["doc_id"], 3).collect(), 3)
    assert shuffle_into_shards(frame.limit(0), ["doc_id"], 3).count() == 0


def test_query(spark):
    from llm.sharding import op9_hypergeometric_sharding

    rows = op9_hypergeometric_sharding(spark, "/root/testdata/sf0.001").collect()
    check(rows, 40)
    assert {r.law for r in rows} == {"rows"}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = {k: (len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in docs.items()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == want and len(rows) == len(want)


def test_clashing_names_and_long_texts(spark):
    frame = spark.createDataFrame([(k, "x" * 3_000_000 if not k else "y", 7) for k in range(5)], "doc_id long, Shard string, _part int")
    rows = shuffle_into_shards(frame.withColumn("slot", F.col("_part")).withColumn("__rank", F.lit(1)), ["doc_id"], 3).collect()
    check(rows, 3)
    assert {r.doc_id: (len(r.Shard_in), r._part, r.slot_in, r["__rank"]) for r in rows} == {k: (1 if k else 3_000_000, 7, 7, 1) for k in range(5)}


def test_equal_rows_spread(spark):
    frame = spark.range(3000).selectExpr("cast(1 as bigint) as doc_id")
    sent = shuffle_into_shards(frame, ["doc_id"], 4)
    check(sent.collect(), 4)
    import llm.sharding as m

    row = m.base.numbered(frame, "r").selectExpr("pmod(xxhash64(90, r, doc_id), 16) as p").groupBy("p").count().collect()
    assert len(row) == 16 and max(x["count"] for x in row) < 260
