"""Writers: JSON Lines and arrays, summaries, CSV reports, text tables, chunk streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line, whole output replaced; the form for large tables."""
    df.write.mode("overwrite").json(path)


def json_document(df: DataFrame, path: str) -> None:
    """One pretty array in a file: for reports that fit one task, by their use."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("r"))
    rows.select(F.to_json("r", {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def result_document(summary: DataFrame, samples: DataFrame, path: str) -> None:
    """A summary row with its samples inside, as one JSON text."""
    inner = samples.agg(F.collect_list(F.struct(*samples.columns)).alias("samples"))
    summary.join(F.broadcast(inner)).select(F.to_json(F.struct(*summary.columns, "samples")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_report(df: DataFrame, path: str, columns: Iterable[str]) -> None:
    """Fixed columns with a header; nulls are empty."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def table_lines(df: DataFrame, *order: str) -> DataFrame:
    """(line, value): an aligned text table of a small report, header and rule first."""
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns], F.row_number().over(_window(order, df)).alias("_n"))
    widths = shown.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in df.columns]).withColumnsRenamed({c: f"_w_{c}" for c in df.columns})
    line = lambda make: F.rtrim(F.concat_ws("  ", *[F.rpad(make(c), F.col(f"_w_{c}"), " ") for c in df.columns]))
    head = widths.select(F.lit(-1).alias("line"), line(lambda c: F.lit(c)).alias("value"))
    rule = widths.select(F.lit(0).alias("line"), F.concat_ws("  ", *[F.repeat(F.lit("-"), F.col(f"_w_{c}")) for c in df.columns]).alias("value"))
    return head.union(rule).union(shown.join(F.broadcast(widths)).select(F.col("_n").alias("line"), line(F.col).alias("value")))


def _window(order: tuple[str, ...], df: DataFrame):
    from pyspark.sql import Window

    return Window.orderBy(*(order or df.columns[:1]))


def chunk_record(fields: Column) -> Column:
    """One record of a chunk stream: JSON and a NUL."""
    return F.concat(F.to_json(fields), F.lit("\0"))


def chunk_stream(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").option("lineSep", "\0").text(path)


def printed(summary: DataFrame) -> str:
    """The summary rows as JSON text for the console: a report, not a table."""
    return "\n".join(summary.toJSON().take(1000))
