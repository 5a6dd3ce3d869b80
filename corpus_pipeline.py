"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

Every stage but the last returns the columns of ``documents``:

1. quality rules: documents that the rules or the calibrated model reject go;
2. n-gram Jaccard join: of each group of linked documents the one of smallest doc_id stays;
3. benchmark decontamination: documents with a window like a benchmark item go;
4. secret scans: every span found is replaced by ``[secret]`` and n_chars follows;
5. best-fit packing: the rows are pieces of token sequences.

Rows with a null doc_id pass stages 2 and 3, which decide by id; of rows that repeat a doc_id stage 2
keeps the one of least text (then of least other columns, as JSON). Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import base, decontaminate, ngram_join, packing, quality, secrets

#: SQL has no logistic regression, SimHash or bin packing.
ORACLE_SQL = None


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those ids; they are broadcast only if few, so that texts need not move."""
    return docs.join(decontaminate.bounded(base.cut(ids)), "doc_id", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, quality.train_quality(docs, base.documents(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = base.cut(ngram_join.ngram_join(docs).where("doc_id is not null").select("doc_id", "component_id"))
    out = without(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = groups.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return out
    again = base.cut(repeated)
    order = F.struct("text", F.to_json(F.struct(*docs.columns)))
    least = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("__row")).select("__row.*")
    return without(out, again).unionByName(least)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, base.documents(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id").distinct())


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = base.cut(secrets.update(docs).where("size(spans) > 0").select("blob", F.array_sort("spans").alias("spans")))
    ledger = ledger.select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = docs.withColumn("__blob", blob).join(decontaminate.bounded(ledger), "__blob", "left")
    found = F.coalesce("__spans", F.array().cast(secrets.SPAN))
    changed = F.size(found) > 0
    masked = joined.withColumn("text", F.when(changed, secrets.masked(F.col("text"), found)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored in the shared folder and read again."""
    docs, before = base.documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = base.stored(stage(spark, docs, sf_dir))
        base.release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
