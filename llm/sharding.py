"""Operator 9, sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes. Every row gets a number of its own, by whose hash it is dealt to a
source partition, so that equal rows spread like any; the matrix of
counts from each partition to each shard is drawn exactly (row by row, a chain of hypergeometric
variables: the law of those counts under a uniform permutation). Every partition permutes its rows and
hands the shards their counts in turn; every shard permutes what it got.

Only the counts of partitions, at most MAX_PARTITIONS numbers, reach the driver; the matrix goes back as a
broadcast of at most MAX_PARTITIONS * shards longs. Both permutations are sorts, which spill, within pieces
of about PIECE_ROWS rows, so no task holds a whole shard; from MAX_PARTITIONS * PIECE_ROWS rows on (819
million) the source partitions grow instead of their number, to some 6 million narrow rows at 50 billion.

Defined cases: null keys hash like any value; equal rows each get a slot of their own; with fewer rows than
shards some shards stay empty; an empty table gives an empty result; very long texts are read where they lie,
only their size and checksum move; extra columns ride along, and a caller's ``shard`` or ``slot`` is returned
as ``shard_in`` or ``slot_in``. A run is repeatable on the same files and session settings.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

SHARDS = 40
SEED = 9
PIECE_ROWS = 100_000
#: Source partitions: by size, within these bounds.
MIN_PARTITIONS, MAX_PARTITIONS = 16, 8192


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` taken without return from good + bad are good; exact inversion from the mode outwards."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = right = mode
    p_left = p_right = peak
    u = rng.random() - peak
    while u > 0:
        moved = False
        if right < high:
            p_right *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right, moved = right + 1, True
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left, moved = left - 1, True
            u -= p_left
            if u <= 0:
                return left
        if not moved or max(p_left, p_right) < 1e-300:
            break  # rounding left a rest of the unit interval
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int = SEED) -> list[list[int]]:
    """A random matrix of these row and column sums, as a uniform permutation makes it."""
    rng, rest, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, open_, total = [], n, sum(rest)
        for j, room in enumerate(rest):
            total -= room
            x = hypergeometric(rng, room, total, open_) if open_ else 0
            row.append(x)
            open_ -= x
        rest = [a - b for a, b in zip(rest, row, strict=True)]
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int, seed: int = SEED) -> list[int]:
    extra = set(random.Random(seed + 1).sample(range(shards), rows % shards))
    return [rows // shards + (j in extra) for j in range(shards)]


def unclashed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with columns of those names (whatever their case) renamed: ``_in`` follows them until they are free."""
    taken = [c.lower() for c in df.columns]
    out = []
    for c in df.columns:
        while c.lower() in names or (c not in df.columns and c.lower() in taken):
            c += "_in"
        out.append(c)
    return df.toDF(*out)


def shuffle_into_shards(df: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with ``shard`` and ``slot`` (gapless from 0 in each shard); keys are hashed with the row's number."""
    spark = df.sparkSession
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    row, part, rank, upto, piece, n, before = (mark + x for x in ("row", "part", "rank", "upto", "piece", "n", "before"))
    plain = base.numbered(unclashed(df, ("shard", "slot")), row)
    rows = plain.count()
    parts = min(MAX_PARTITIONS, max(MIN_PARTITIONS, -(-rows // PIECE_ROWS)))
    hashed = lambda k: F.xxhash64(F.lit(seed * 10 + k), row, *keys)
    dealt = plain.withColumn(part, F.pmod(hashed(0), F.lit(parts)).cast("int"))
    counts = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}
    order = sorted(counts)
    matrix = communication_matrix([counts[p] for p in order], shard_sizes(sum(counts.values()), shards, seed), seed)
    table = spark.createDataFrame(
        [(p, [sum(r[: j + 1]) for j in range(shards)]) for p, r in zip(order, matrix, strict=True)] or [(0, [0] * shards)], f"{part} int, {upto} array<long>"
    )
    local = Window.partitionBy(part).orderBy(hashed(1), row)
    sent = (
        dealt.withColumn(rank, F.row_number().over(local) - 1)
        .join(F.broadcast(table), part)
        .withColumn("shard", F.expr(f"size(filter({upto}, x -> x <= {rank}))").cast("int"))
        .drop(part, upto, rank)
    )
    pieces = max(1, -(-rows // (shards * PIECE_ROWS)))
    sent = base.cut(sent.withColumn(piece, F.pmod(hashed(2), F.lit(pieces)).cast("int")))
    sizes = sent.groupBy("shard", piece).agg(F.count("*").alias(n))
    ahead = sizes.select("shard", piece, (F.sum(n).over(Window.partitionBy("shard").orderBy(piece)) - F.col(n)).alias(before))
    inner = Window.partitionBy("shard", piece).orderBy(hashed(3), row)
    return (
        sent.withColumn(rank, F.row_number().over(inner) - 1)
        .join(ahead, ["shard", piece])
        .withColumn("slot", (F.col(before) + F.col(rank)).cast("long"))
        .drop(piece, rank, before, row)
    )


def op9_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = base.take(base.documents(spark, sf_dir), "doc_id", "text").select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
