"""Tokenizers as Arrow UDFs behind one contract: a function from texts to lists of ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .text import SPEECH_TAG, col, split_on

Encode = Callable[[str], list[int]]


def hashing_encoder(size: int = 32_000, bos: int | None = 1) -> Encode:
    """Words by checksum: needs no vocabulary, deterministic everywhere. Ids 0 to 9 stay free for special tokens."""

    def encode(text: str) -> list[int]:
        ids = [10 + zlib.crc32(w.encode()) % (size - 10) for w in text.split()]
        return ids if bos is None else [bos, *ids]

    return encode


def tokenize(text: Column | str, make: Callable[[], Encode]) -> Column:
    """Ids of a text; ``make`` builds the encoder once for each worker's iterator, and says whether a start id is added."""

    @pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for x in parts:
            yield x.map(lambda t: None if t is None else encode(t))

    return run(col(text))


def tokenize_chunks(text: Column | str, make: Callable[[], Encode], tag: str = SPEECH_TAG) -> Column:
    """Ids of the pieces around a tag, one array for each."""

    @pandas_udf("array<array<int>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for x in parts:
            yield x.map(lambda pieces: None if pieces is None else [encode(t) for t in pieces])

    return run(split_on(text, tag))


def overlength(size: Column, most: int, policy: str, ids: Column) -> Column:
    """The three policies for long rows: drop (null), truncate, or keep for a later cut."""
    if policy == "drop":
        return F.when(size <= most, ids)
    if policy == "truncate":
        return F.slice(ids, 1, most)
    if policy == "keep":
        return ids
    raise ValueError(f"unknown policy: {policy}")
