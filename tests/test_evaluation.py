"""Answer metrics over whole documents, against brute force."""

from collections import Counter

import duckdb
import pytest

from lekha.plans import evaluation as E

FILLER = " ".join(f"w{k % 37}" for k in range(300))
DOCUMENTS = {1: f"{FILLER} golden answer", 2: "short golden answer", 3: f"{FILLER} nothing", 4: f"golden {FILLER} answer"}
GOLD = "golden answer"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("evaluation"))
    spark.createDataFrame(list(DOCUMENTS.items()), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, GOLD) for k in DOCUMENTS], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def same(a, b):
    return sum((Counter(a.split()) & Counter(b.split())).values())


def f1(a, b):
    return 2 * same(a, b) / (len(a.split()) + len(b.split()))


def rows(spark, folder, query):
    return {r.item_id: r for r in query(spark, folder).collect()}


def test_token_f1_pairs(spark, folder):
    got = rows(spark, folder, E.token_f1_pairs)
    assert {k: r.overlap for k, r in got.items()} == {k: same(t, GOLD) for k, t in DOCUMENTS.items()}
    assert all(abs(got[k].f1 - f1(t, GOLD)) < 1e-8 for k, t in DOCUMENTS.items())


def test_contains_match(spark, folder):
    assert {k: r.whole for k, r in rows(spark, folder, E.contains_match).items()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_best_of_references(spark, folder):
    got = rows(spark, folder, E.best_of_references)
    assert all(abs(got[k].f1 - max(f1(t, GOLD), f1(t, t[:60]))) < 1e-8 for k, t in DOCUMENTS.items())


def test_best_of_references_nfkd(spark, folder):
    got = rows(spark, folder, E.best_of_references_nfkd)
    assert {k: r.contains_match for k, r in got.items()} == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert all(abs(got[k].f1 - f1(t, GOLD)) < 1e-8 for k, t in DOCUMENTS.items())


def test_best_answer_of_odd_lines(spark, tmp_path):
    lines = [
        (1, 1, None, 0.09, "F"), (1, 2, 7.0, 0.09, "O"),  # a null score comes last
        (2, 1, None, 0.09, "F"),
        (3, 1, 5.0, 0.09, None), (3, 1, 5.0, 0.09, "O"),  # so does a null answer
        (4, 2, 5.0, 0.025, "F"), (4, 1, 6.0, 0.025, "O"),  # 2.5 is rounded to 2
        (5, 2, 5.0, 0.025, "F"),
        (6, 1, float("nan"), 0.09, "F"), (6, 2, 60.0, 0.09, "O"),
        (7, 1, float("nan"), 0.09, "F"), (7, None, 1.0, 0.09, "O"), (7, 2, 1.0, None, "O"),
        (None, 1, 1.0, 0.09, "F"),
    ]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_linestatus string"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, 8, None)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    for name in ("lineitem", "orders"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(map(repr, map(tuple, E.best_answer(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, duck.execute(E.SQL["best_answer"]).fetchall()))
