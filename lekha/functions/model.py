"""The model contract: batches of prompts in, texts or token log-probabilities out. A deterministic stub stands in."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Generate = Callable[[list[str]], list[str]]
Score = Callable[[list[str], list[str]], list[list[float]]]


def stub_generate(prompts: list[str]) -> list[str]:
    """The last line of each prompt that has text."""
    return [next((line.strip() for line in reversed(p.splitlines()) if line.strip()), "") for p in prompts]


def stub_score(prompts: list[str], answers: list[str]) -> list[list[float]]:
    """A log-probability between -5 and 0 for each answer word, by checksum."""
    return [[-(zlib.crc32(f"{len(p)} {w}".encode()) % 5000) / 1000 for w in a.split()] for p, a in zip(prompts, answers, strict=True)]


def generate(df: DataFrame, prompt: str, output: str, make: Callable[[], Generate], batch: int = 32) -> DataFrame:
    """df with generated texts; ``make`` loads the model once for each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            texts = [t for k in range(0, len(part), batch) for t in model(part[prompt].iloc[k : k + batch].tolist())]
            yield part.assign(**{output: texts})

    return df.mapInPandas(run, _with(df, f"{output} string"))


def score(df: DataFrame, prompt: str, answer: str, output: str, make: Callable[[], Score], batch: int = 32) -> DataFrame:
    """df with the log-probabilities of the answer's tokens after the prompt."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            rows = [x for k in range(0, len(part), batch) for x in model(part[prompt].iloc[k : k + batch].tolist(), part[answer].iloc[k : k + batch].tolist())]
            yield part.assign(**{output: rows})

    return df.mapInPandas(run, _with(df, f"{output} array<double>"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + column
