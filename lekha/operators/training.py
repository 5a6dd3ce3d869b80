"""Metric logs, checkpoints and parameter norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
#: Groups of parameters by name, first match wins.
PARAMETER_GROUPS = (("lora_A", "lora_A"), ("lora_B", "lora_B"), ("projector", "speech_projector"))


def epoch_records(log: DataFrame, *keys: str, order: str = "seq", values: tuple[str, ...] = ("lr", "train_loss", "val_loss")) -> DataFrame:
    """The last record of each key; a value that it lacks stays from before. Rows without any loss count for nothing."""
    losses = [c for c in values if c.endswith("loss")]
    useful = log.where(F.coalesce(*[F.col(c).isNotNull().cast("int") * 0 + F.when(F.col(c).isNotNull(), 1) for c in losses]).isNotNull()) if losses else log
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return useful.groupBy(*keys).agg(*[latest(c) for c in values])


def learning_rate(logged: Column, current: Column) -> Column:
    """The logged rate unless it is null or zero, else the optimizer's."""
    return F.when(logged.isNotNull() & (logged != 0), logged).otherwise(current)


def monitored(val_loss: Column, train_loss: Column, has_validation: Column) -> Column:
    """The monitored value: validation loss, or training loss where there is no validation."""
    return F.when(has_validation, val_loss).otherwise(train_loss)


def checkpoint_score(meta_val: Column, meta_train: Column) -> Column:
    return F.coalesce(meta_val, meta_train, F.lit(INF))


def top_checkpoints(df: DataFrame, metric: str, order: str, k: int, mode: str = "min", *keys: str) -> DataFrame:
    """The k best by metric, earlier ones first on ties; rows without a metric are no checkpoints."""
    ranked = F.asc(metric) if mode == "min" else F.desc(metric)
    w = Window.partitionBy(*keys).orderBy(ranked, F.asc(order)) if keys else None
    kept = df.where(F.col(metric).isNotNull())
    if w is None:
        return kept.orderBy(ranked, F.asc(order)).limit(k)
    return kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def best_checkpoint(df: DataFrame) -> DataFrame:
    """One row (path): least score, first on ties (a missing score ranks last); without any, the last legacy file."""
    own = df.where(~F.col("legacy")).agg(F.min(F.struct(checkpoint_score(F.col("val_loss"), F.col("train_loss_epoch")).alias("s"), "ord", "path")).alias("b"))
    old = df.where("legacy").agg(F.max("path").alias("old"))
    return own.join(F.broadcast(old)).select(F.coalesce("b.path", "old").alias("path"))


def resume_order(df: DataFrame) -> DataFrame:
    """Candidates in order of preference: final model, then least validation loss, then newest; unique paths.

    A folder ``checkpoints/last`` and then ``final_model`` go before everything.
    """
    short = F.when(F.col("path").endswith("checkpoints/last"), 0).when(F.col("path").endswith("final_model"), 1).otherwise(2)
    unique = df.groupBy("path").agg(F.min(F.coalesce("val_loss", F.lit(INF))).alias("val_loss"), F.max("mtime").alias("mtime"))
    return unique.orderBy(short, "val_loss", F.desc("mtime"), "path")


def accumulated_loss(micro: DataFrame, step: str = "global_step", loss: str = "loss") -> DataFrame:
    """Mean of micro-batch losses of each optimizer step."""
    return micro.groupBy(step).agg(F.avg(loss).alias("loss"), F.count("*").alias("micro_batches"))


def parameter_group(name: Column) -> Column:
    out = None
    for group, part in PARAMETER_GROUPS:
        out = F.when(F.contains(name, F.lit(part)), F.lit(group)) if out is None else out.when(F.contains(name, F.lit(part)), F.lit(group))
    return out


def norm_report(params: DataFrame, *keys: str) -> DataFrame:
    """L2 norms of norms, and the gradient's relative to the weights' (floor 1e-12), of trainable parameters."""
    l2 = lambda c: F.sqrt(F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)))
    rows = params.where("requires_grad") if "requires_grad" in params.columns else params
    out = rows.groupBy(*keys).agg(l2("grad_norm").alias("grad_norm"), l2("weight_norm").alias("weight_norm"))
    return out.withColumn("ratio", F.col("grad_norm") / F.greatest(F.col("weight_norm"), F.lit(1e-12)))


def parameter_counts(params: DataFrame) -> DataFrame:
    total, live = F.coalesce(F.sum("numel"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("requires_grad"), F.col("numel"))), F.lit(0))
    return params.agg(live.alias("trainable"), total.alias("total")).withColumn("percent", F.when(F.col("total") > 0, 100 * F.col("trainable") / F.col("total")).otherwise(F.lit(0.0)))


def recorded(log: DataFrame) -> DataFrame:
    """Rows that make records: rank 0, and no training epoch where validation exists."""
    return log.where((F.col("rank") == 0) & ~((F.col("hook") == "train") & F.col("has_validation")))


def run_progress(log: DataFrame, accumulate: int, batches_an_epoch: int) -> DataFrame:
    done = F.col("global_step") * accumulate + F.col("batch_idx") % accumulate
    return log.withColumn("completed", done).withColumn("true_epoch", done / batches_an_epoch)
