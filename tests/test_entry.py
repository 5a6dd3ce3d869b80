import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["conv_id", "prompt"] and out.count() > 0
    assert str(ROOT) in spark.sparkContext.environment["PYTHONPATH"].split(":")


def test_engine_does_not_import_the_optional_part():
    for path in (ROOT / "lekha").rglob("*.py"):
        assert not re.search(r"^\s*(?:from|import) (?:llm|corpus_pipeline)\b", path.read_text(encoding="utf-8"), re.M), path
