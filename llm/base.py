"""Shared helpers: table reading, lineage cuts, bounded filters, connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that go to a Python worker at once; the operators cut them further by bytes.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lowers the session's Arrow batch size, in rows and bytes: long texts would fill a worker's memory otherwise."""
    for key, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= limit:
            spark.conf.set(key, str(limit))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, set as the context's; only where the
    setting is absent and the master local (tests) a temporary folder serves."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: smaller than a checkpoint where texts are in it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing reads any more."""
    for frame in frames:
        remove(frame.sparkSession, frame.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by Hadoop's file system, so on whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of frames that are no longer referenced; they count as disk until then.

    Python's references to the JVM go beside the driver, so the first collection may come too early for the last frame.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(1)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, cut, with a unique number for each row, so that equal rows can be told apart and dealt evenly."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def take(df: DataFrame, *names: str) -> DataFrame:
    """Selects columns by name; of several with one name (or names that differ in case) the first counts."""
    lower = [c.lower() for c in df.columns]
    plain = df.toDF(*[f"c{k}" for k in range(len(lower))])
    return plain.select(*[F.col(f"c{lower.index(n.lower())}").alias(n) for n in names])


#: Bits of a Bloom filter: 16 for each id, within these bounds (8 KB to 16 MB).
BLOOM_BITS = (1 << 16, 1 << 27)


class Bloom:
    """A Bloom filter (two probes) over a long column, bounded in size whatever the input.

    Built by a distributed bit_or, so the driver receives one row for each 64 bits at most. Beyond its
    bound it lets more and more pass; an exact join follows each use.
    """

    def __init__(self, ids: DataFrame, column: str):
        """ids is read twice: cut or stored before."""
        self.bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << max(0, 16 * ids.count() - 1).bit_length()))
        rows = (
            ids.select(F.explode(F.array(*self.probes(column))).alias("bit"))
            .groupBy(F.expr("bit div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
            .toArrow()
        )
        words = np.zeros(self.bits // 64, np.int64)
        words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(words)

    def probes(self, column: str) -> list:
        return [F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(self.bits)).alias(f"probe{k}") for k in range(2)]

    def might_hold(self, *probes: pa.Array) -> np.ndarray:
        words = self.table.value
        out = np.ones(len(probes[0]), bool)
        for probe in probes:
            at = probe.to_numpy(zero_copy_only=False).astype(np.int64)
            out &= (words[at >> 6] >> (at & 63)) & 1 > 0
        return out


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches, each on its own."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): (id, component), the smallest id of each component.

    Alternating large-star and small-star contraction. Each half round is a grouped minimum (combined
    before the shuffle) and a join; a node with very many neighbours is split by adaptive skew joins.
    Every round's edges are checkpointed, so a lost executor costs one round at most.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = pairs.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        own = least.where("a > m").select("a", F.col("m").alias("b"))
        return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def state(pairs: DataFrame) -> tuple:
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    for _ in range(rounds if before[0] else 0):
        now = cut(star(star(both_ways(now), True), False))
        after = state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
