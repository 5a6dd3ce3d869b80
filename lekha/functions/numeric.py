"""Sizes, steps and intervals; rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_size(n: Column, fraction: Column | float, low: Column | int, high: Column) -> Column:
    """round(n * fraction) within [low, high]; 0 where n, fraction or high isn't positive."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    low = low if isinstance(low, Column) else F.lit(low)
    size = F.greatest(low, F.least(high, F.bround(n * fraction).cast("long")))
    return F.when((n > 0) & (fraction > 0) & (high > 0), size).otherwise(F.lit(0)).cast("long")


def optimizer_steps(rows: Column, batch: int, accumulate: int, epochs: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.ceil(rows / batch) / accumulate) * epochs).cast("long")


def validation_interval(value: Column, steps_an_epoch: Column, accumulate: int) -> Column:
    """Only a fraction strictly between 0 and 1 is rescaled to steps; any other value stays."""
    return F.when((value > 0) & (value < 1), F.greatest(F.lit(1.0), F.bround(value * steps_an_epoch * accumulate))).otherwise(value)


def encoder_frames(mel: Column) -> Column:
    return F.floor((mel + 1) / 2).cast("int")


def projected_frames(mel: Column, k: int = 5) -> Column:
    return F.floor(encoder_frames(mel) / k).cast("int")


def safe_exp(nll: Column, limit: float = 50.0) -> Column:
    """exp, infinite from the limit on."""
    return F.when(nll < limit, F.exp(nll)).otherwise(F.lit(float("inf")))


def progress(step: Column, batch: Column, accumulate: int) -> Column:
    return step * accumulate + batch % accumulate


def served_tokens(asked: Column, most: int) -> Column:
    return F.least(asked.cast("int"), F.lit(most))


def does_sample(temperature: Column) -> Column:
    return temperature > 0.001


def queue_length(limit: Column, free: Column, waiting: Column) -> Column:
    return limit - free + waiting


def logged(n: Column) -> Column:
    """Log throttle: the first ten, then every hundredth."""
    return (n <= 10) | (n % 100 == 0)


def reports_progress(done: Column, batch: Column) -> Column:
    return done % 25 < batch
