"""Evaluation metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import safe_exp
from ..functions.text import contains_match, normalize_answer, strip, token_f1

INF = float("inf")


def zero_mean(x: Column) -> Column:
    """Mean, 0.0 of nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def eligible(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with ``skip_reason``: the first check that holds, null for eligible rows."""
    reason = None
    for name, check in checks.items():
        reason = F.when(check, F.lit(name)) if reason is None else reason.when(check, F.lit(name))
    return df.withColumn("skip_reason", reason)


def qa_eligible(df: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Empty answers are tested before the prompt's length; answers keep their text, blank ones go."""
    kept = df.withColumn("answers", F.filter("answers", lambda a: strip(a) != ""))
    return eligible(kept, {"empty_answers": F.size("answers") == 0, "too_long": tokens > most})


def best_of_references(df: DataFrame, prediction: str, answers: str, decompose: bool = True, key: str | None = None) -> DataFrame:
    """df with ``contains_match`` and ``f1``, each the best over the references on its own.

    Normalising once each: with decomposition (an Arrow UDF) the references are exploded, normalised and
    grouped back by key; without it everything stays in array expressions.
    """
    if not decompose:
        p, refs = normalize_answer(prediction, False), F.transform(answers, lambda a: normalize_answer(a, False))
        out = df.withColumn("_p", p).withColumn("_a", refs)
        best = lambda f: F.array_max(F.transform("_a", lambda a: f(F.col("_p"), a)))
        return out.withColumn("contains_match", best(contains_match)).withColumn("f1", best(token_f1)).drop("_p", "_a")
    if key is None:
        raise ValueError("a key is needed to bring references back together")
    pairs = df.select(key, F.col(prediction).alias("_p"), F.explode(answers).alias("_a"))
    pairs = pairs.withColumn("_p", normalize_answer("_p")).withColumn("_a", normalize_answer("_a"))
    scored = pairs.select(key, contains_match(F.col("_p"), F.col("_a")).alias("c"), token_f1(F.col("_p"), F.col("_a")).alias("f"))
    return df.join(scored.groupBy(key).agg(F.max("c").alias("contains_match"), F.max("f").alias("f1")), key, "left")


def best_answer(samples: DataFrame, scores: DataFrame, key: str = "sample_idx") -> DataFrame:
    """samples (key, answers) with the answer of least mean_nll, the first on ties, among valid candidates.

    scores: key, ord, answer, mean_nll[, start, length]; a candidate is valid if length > start >= 0.
    Nulls come after all values. Without a valid candidate: (inf, inf, first answer).
    """
    if {"start", "length"} <= set(scores.columns):
        scores = scores.where((F.col("length") > F.col("start")) & (F.col("start") >= 0))
    order = [x for c in ("mean_nll", "ord", "answer") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    best = scores.groupBy(key).agg(F.min(F.struct(*order)).alias("_b"))
    out = samples.join(best, key, "left")
    nll = F.coalesce("_b.mean_nll", F.lit(INF))
    first = F.try_element_at(F.col("answers"), F.lit(1))
    return out.select("*", nll.alias("nll"), safe_exp(nll).alias("perplexity"), F.coalesce("_b.answer", first).alias("best_answer")).drop("_b")


def qa_summary(samples: DataFrame) -> DataFrame:
    """One row: total, means of contains_match, f1 and nll, and exp of the mean nll; 0.0 of nothing."""
    return samples.agg(
        F.count("*").alias("total"),
        zero_mean(F.col("contains_match")).alias("contains_match"),
        zero_mean(F.col("f1")).alias("f1"),
        zero_mean(F.col("nll")).alias("nll"),
        F.coalesce(F.exp(F.avg("nll")), F.lit(0.0)).alias("perplexity"),
    )


def accuracy(samples: DataFrame, *keys: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """(keys, total, correct, invalid, accuracy): a null prediction is invalid, accuracy of nothing 0.0."""
    hit = F.coalesce(F.col(gold) == F.col(predicted), F.lit(False)).cast("int")
    return samples.groupBy(*keys).agg(
        F.count("*").alias("total"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("correct"), F.count_if(F.col(predicted).isNull()).alias("invalid"), zero_mean(hit).alias("accuracy")
    )


def best_bert(pairs: DataFrame, key: str = "sample_idx") -> DataFrame:
    """(key, precision, recall, f1) of the best F1 above 0; ties take the first, nothing above gives zeros."""
    best = pairs.groupBy(key).agg(F.max(F.when(F.col("f1") > 0, F.struct("f1", (-F.col("ord")).alias("o"), "precision", "recall"))).alias("b"))
    zero = lambda c: F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c)
    return best.select(key, zero("precision"), zero("recall"), zero("f1"))


def positional(left: DataFrame, right: DataFrame, on: str = "index") -> DataFrame:
    """1:1 join on position; a position that one side lacks is an error when the row is read."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, on, "full_outer")
    check = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("positions differ in length")).cast("boolean")).otherwise(F.lit(True))
    return both.where(check).drop("_l", "_r")


def model_delta(metrics: DataFrame, *keys: str, base: str = "base", tuned: str = "stage1", value: str = "value", model: str = "model") -> DataFrame:
    """(keys, base, tuned, delta) from one row for each model: one conditional aggregation."""
    of = lambda name: F.max(F.when(F.col(model) == name, F.col(value)))
    return metrics.groupBy(*keys).agg(of(base).alias(base), of(tuned).alias(tuned)).withColumn("delta", F.col(tuned) - F.col(base))


def category_rollup(scores: DataFrame, category: str, base: str, tuned: str) -> DataFrame:
    """Means by category and overall (category null), with the count of ties."""
    return scores.rollup(category).agg(
        F.count("*").alias("n"), F.avg(base).alias("base"), F.avg(tuned).alias("tuned"), F.count_if(F.col(base) == F.col(tuned)).alias("ties")
    )


def metric_rows(payload: DataFrame, column: str = "results") -> DataFrame:
    """(task, metric, value) of scalar metrics in JSON text of {task: {metric: value}}: numbers, texts, truth values and nulls."""
    tasks = payload.select("*", F.explode(F.from_json(F.col(column), "map<string,string>")).alias("task", "_m")).drop(column)
    metrics = tasks.select("*", F.explode(F.from_json("_m", "map<string,string>")).alias("metric", "value")).drop("_m")
    return metrics.where(F.col("value").isNull() | ~F.col("value").rlike(r"^\s*[\[{]"))


def greedy_cosine(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with precision, recall and f1 of greedy cosine matching of two arrays of unit vectors."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: dot(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    out = pairs.withColumn("precision", best(F.col(left), F.col(right))).withColumn("recall", best(F.col(right), F.col(left)))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total))


def first_in_ties(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Of each key the row of least value, the first by order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.asc(value), F.asc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
