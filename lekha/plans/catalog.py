"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import corpus, evaluation, files, operations, sampling

MODULES = (corpus, sampling, evaluation, operations, files)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}


def flagship(spark, sf_dir: str):
    return corpus.gen_prompt_llama3(spark, sf_dir)
