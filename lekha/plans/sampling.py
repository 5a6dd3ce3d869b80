"""Queries over splits, buckets and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import sampling as P
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("len"))


RANKED = "SELECT doc_id, n_chars AS len, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank FROM documents"


@query(f"SELECT doc_id, len, rank, rank // 80 AS bucket FROM ({RANKED})")
def text_len_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.length_buckets(lengths(spark, sf_dir), "len", "doc_id", 8).select("doc_id", "len", "rank", "bucket")


@query(f"""SELECT doc_id, (row_number() OVER (ORDER BY md5(CAST(rank // 80 AS VARCHAR) || '|43'), md5(CAST(doc_id AS VARCHAR) || '|43'), doc_id) - 1) // 8 AS batch FROM ({RANKED})""")
def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bucket_batches(P.length_buckets(lengths(spark, sf_dir), "len", "doc_id", 8), "doc_id", 8, epoch=1).select("doc_id", "batch")


@query(f"""SELECT rank // 16 AS batch, count(*) AS rows, max(len) AS longest, CAST(count(*) * max(len) - sum(len) AS BIGINT) AS padding FROM ({RANKED}) GROUP BY 1""")
def batch_padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.padding_waste(P.sequential_batches(lengths(spark, sf_dir), "len", "doc_id", batch=16), "len")


@query("""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1 AS r FROM documents),
    s AS (SELECT n, greatest(1, least(n - 1, CAST(round_even(n * 0.05, 0) AS BIGINT))) AS t FROM n), v AS (SELECT n, t, greatest(1, least(n - 1 - t, CAST(round_even(n * 0.1, 0) AS BIGINT))) AS v FROM s)
    SELECT doc_id, CASE WHEN n < 2 THEN 'train' WHEN r < v THEN 'val' WHEN r < v + t THEN 'test' ELSE 'train' END AS split FROM r, v""")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exact_split(lengths(spark, sf_dir), "doc_id", 0.1, 0.05).select("doc_id", "split")


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= greatest(1, round_even(n * 0.33, 0))""")
def fraction_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fraction_subset(lengths(spark, sf_dir), "doc_id", 0.33).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def modulo_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.shard(lengths(spark, sf_dir), "doc_id", 4, 1).select("doc_id")


@query("SELECT doc_id, e AS epoch FROM documents, (SELECT unnest([0, 1, 2]) AS e)")
def repeated_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repeated(lengths(spark, sf_dir), 3).select("doc_id", "epoch")


@query("SELECT doc_id, n_chars AS len FROM documents ORDER BY n_chars, doc_id LIMIT 25")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first-n operator: the limit is the feature."""
    return P.first_rows(lengths(spark, sf_dir), "len", "doc_id", n=25)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def capped_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.capped_each(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT DISTINCT url FROM pages")
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url")
    return pages.where("length(url) % 2 = 0").union(pages).distinct().orderBy("url")


@query("""SELECT o_orderkey, CAST(greatest(1, ceil(ceil(o_orderkey / 2.0) / 7) * 3) AS BIGINT) AS steps, CAST((o_orderkey + 1) // 2 AS BIGINT) AS frames, CAST((o_orderkey + 1) // 2 // 5 AS BIGINT) AS projected,
    CASE WHEN o_orderkey % 3 = 0 THEN greatest(1.0, round_even(0.25 * 15000 * 7, 0)) ELSE CAST(o_orderkey % 3 * 500 AS DOUBLE) END AS interval,
    CASE WHEN o_orderkey = 0 THEN 0 ELSE CAST(greatest(1, least(o_orderkey, round_even(o_orderkey * 0.25, 0))) AS BIGINT) END AS split FROM orders""")
def step_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    value = F.when(n % 3 == 0, F.lit(0.25)).otherwise((n % 3 * 500).cast("double"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", N.optimizer_steps(n, 2, 7, 3).alias("steps"), N.encoder_frames(n).cast("long").alias("frames"), N.projected_frames(n).cast("long").alias("projected"),
        N.validation_interval(value, F.lit(15000), 7).alias("interval"), N.split_size(n, 0.25, 1, n).alias("split"),
    )
