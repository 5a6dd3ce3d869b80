"""Splits, subsets, buckets and batches: exact sizes, ranked by a hash that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import split_size
from .conversation import with_position

#: Offsets of the split's seed for its parts.
SEED = 42
SEED_OFFSETS = {"split": 101, "train": 202, "val": 303}


def order_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """0-based rank over a total order, by ranges: no task sorts more than its range."""
    return with_position(df, *order, name=name)


def check_fractions(val: float, test: float) -> None:
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("fractions must be at least 0 and sum below 1")


def exact_split(df: DataFrame, key: str, val: float, test: float = 0.0, seed: int = SEED) -> DataFrame:
    """df with ``split`` (train, val or test), each part of exact size; no split below two rows."""
    check_fractions(val, test)
    n = F.lit(df.count()).cast("long")
    ranked = global_rank(df.withColumn("_k", order_key(F.col(key), seed)), "_k", key, name="_r")
    n_test = split_size(n, test, 1, n - 1)
    n_val = split_size(n, val, 1, n - 1 - n_test)
    part = F.when(n < 2, F.lit("train")).when(F.col("_r") < n_val, F.lit("val")).when(F.col("_r") < n_val + n_test, F.lit("test")).otherwise(F.lit("train"))
    return ranked.withColumn("split", part).drop("_k", "_r")


def fraction_subset(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """max(1, round(n * fraction)) rows; all of them from 1 on."""
    if fraction <= 0:
        raise ValueError("the fraction must be positive")
    if fraction >= 1:
        return df
    size = F.greatest(F.lit(1), F.bround(F.lit(df.count()) * F.lit(fraction)))
    return global_rank(df.withColumn("_k", order_key(F.col(key), seed)), "_k", key, name="_r").where(F.col("_r") < size).drop("_k", "_r")


def shard(df: DataFrame, position: str, count: int, index: int) -> DataFrame:
    """Rows that one of ``count`` readers owns."""
    return df.where(F.pmod(F.col(position), F.lit(count)) == index)


def length_buckets(df: DataFrame, length: str, key: str, batch: int, factor: int = 10) -> DataFrame:
    """df with ``rank`` by length (ties by key) and ``bucket`` of batch * factor rows of like length."""
    return global_rank(df, length, key).withColumn("bucket", F.floor(F.col("rank") / (batch * factor)).cast("long"))


def bucket_batches(df: DataFrame, key: str, batch: int, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """df of length_buckets with ``batch``: buckets in random order, rows in random order inside them."""
    s = seed + epoch
    keyed = df.withColumn("_b", order_key(F.col("bucket"), s)).withColumn("_k", order_key(F.col(key), s))
    return global_rank(keyed, "_b", "_k", key, name="_r").withColumn("batch", F.floor(F.col("_r") / batch).cast("long")).drop("_b", "_k", "_r")


def sequential_batches(df: DataFrame, *order: str, batch: int) -> DataFrame:
    return global_rank(df, *order, name="_r").withColumn("batch", F.floor(F.col("_r") / batch).cast("long")).drop("_r")


def shuffled(df: DataFrame, key: str, seed: int = SEED, epoch: int = 0) -> DataFrame:
    return df.orderBy(order_key(F.col(key), seed + epoch), key)


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    """Each row once an epoch; the epochs are literals, no join is needed."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 0 else df.withColumn("epoch", F.lit(0)).limit(0)


def first_rows(df: DataFrame, *order: str, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def capped_each(df: DataFrame, reader: str, order: str, n: int) -> DataFrame:
    """At most n rows of each reader, by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(reader).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def padding_waste(df: DataFrame, length: str, batch: str = "batch") -> DataFrame:
    """(batch, rows, longest, padding) of batches padded to their longest row."""
    return df.groupBy(batch).agg(
        F.count("*").alias("rows"), F.max(length).cast("long").alias("longest"), (F.count("*") * F.max(length) - F.sum(length)).cast("long").alias("padding")
    )


def padded_batches(df: DataFrame, batch: str, order: str, ids: str, labels: str, pad: int, ignore: int = -100) -> DataFrame:
    """(batch, input_ids, labels, attention_mask) with rows padded to the longest of their batch."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("l")))).alias("r"))
    longest = F.array_max(F.transform("r", lambda x: F.size(x["i"])))
    fill = lambda x, value: F.concat(x, F.array_repeat(F.lit(value), longest - F.size(x)))
    out = rows.withColumn("input_ids", F.transform("r", lambda x: fill(x["i"], pad))).withColumn("labels", F.transform("r", lambda x: fill(x["l"], ignore)))
    return out.withColumn("attention_mask", F.transform("input_ids", lambda x: F.transform(x, lambda t: t != pad))).drop("r")
