"""Repeated ids in the sampled rows."""

import numpy as np

from llm import quality as m


def test_repeated_ids_do_not_displace_others(spark):
    rows = [(k, f"text number {k} " * 5) for k in range(8)] + [(3, f"copy {c}") for c in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.selectExpr("doc_id", "'u' kind")  # as often as the rows
    got = m.sampled_features(docs, ids, 8)["u"]
    least = {k: min(t for i, t in rows if i == k) for k in range(8)}
    alone = spark.createDataFrame(list(least.items()), "doc_id long, text string")
    want = m.sampled_features(alone, alone.selectExpr("doc_id", "'u' kind"), 8)["u"]
    assert got.shape == want.shape == (8, got.shape[1]) and np.array_equal(got, want)
    assert np.array_equal(m.sampled_features(docs.repartition(5), ids, 8)["u"], want)
