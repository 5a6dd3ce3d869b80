import re

import corpus_pipeline as p
from llm import base, quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_packing import valid

SF = "/root/testdata/sf0.001"
SECRET = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.A)


def test_stages_against_brute_force(spark):
    docs = base.documents(spark, SF)
    model = quality.train_quality(docs, base.documents(spark, SF, "labels"))
    verdict = {r.doc_id: r.kept for r in quality.rule_columns(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = base.stored(p.quality_rules(spark, docs, SF))
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert kept == {k: t for k, t in rows.items() if verdict[k]} and len(kept) > len(rows) / 3

    second = base.stored(p.ngram_jaccard_join(spark, first, SF))
    want = {d for d, _, c, _ in groups(sorted(kept.items())) if d == c}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == want

    third = base.stored(p.benchmark_decontamination(spark, second, SF))
    items = [(r.item_id, r.text) for r in base.documents(spark, SF, "benchmark").collect()]
    dirty = {d for d, _ in leaks([(d, kept[d]) for d in want], items)}
    assert {r.doc_id for r in third.collect()} == want - dirty

    fourth = base.stored(p.secret_scans(spark, third, SF))
    assert fourth.columns == docs.columns
    out = {r.doc_id: r for r in fourth.collect()}
    assert set(out) == want - dirty
    for k, r in out.items():
        assert r.n_chars == len(r.text) and not SECRET.search(r.text.replace("[secret]", " "))
        assert (r.text == kept[k]) == (not SECRET.search(kept[k])) or "PRIVATE KEY" in kept[k]

    last = p.best_fit_packing(spark, fourth, SF)
    valid(last.collect(), {k: r.text for k, r in out.items()})
    assert p.run(spark, SF).count() == last.count()


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " more", "c"), (None, text, "d"), (3, None, "e"), (4, "token=abcdefgh " + text[::-1], "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    docs = docs.select("*", docs["blob"].alias("spans"), docs["blob"].alias("score"), docs["doc_id"].alias("component_id"))
    kept = p.ngram_jaccard_join(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]
    clean = {str(r.doc_id): r.text for r in p.secret_scans(spark, docs, SF).collect()}
    assert p.secret_scans(spark, docs, SF).columns == docs.columns
    assert clean["4"].startswith("[secret] ") and clean["3"] is None
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
