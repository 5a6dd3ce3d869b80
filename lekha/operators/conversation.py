"""Corpus shapes: messages, conversations and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, col, map_role, python_text, strip
from ..session import cut

MESSAGE = "array<struct<role:string,content:string>>"
TURN = "array<struct<from:string,value:string>>"
#: Fixed text: the question that a streamed speech row without conversation gets.
DEFAULT_QUESTION = "<speech>\nकृपया उपयोगकर्ता के भाषण में प्रश्नों का सीधे उत्तर दें।"


def first_exchange(messages: Column | str) -> Column:
    """Messages 0 and 1 only; a shorter list is an error."""
    x = col(messages)
    return F.when(F.size(x) >= 2, F.slice(x, 1, 2)).otherwise(F.raise_error(F.lit("two messages expected")))


def from_pair(question: Column | str, answer: Column | str) -> Column:
    """A question and an answer as two messages."""
    turn = lambda role, x: F.struct(F.lit(role).alias("role"), col(x).alias("content"))
    return F.array(turn("user", question), turn("assistant", answer))


def plain_messages(messages: Column | str) -> Column:
    """All turns with role and content alone."""
    return F.transform(col(messages), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))


def turns_of(messages: Column | str, compat: str = "reject") -> Column:
    """Turns (from, value) with mapped roles and stripped values."""
    turn = lambda m: F.struct(map_role(m["role"]).alias("from"), strip(python_text(m["content"], compat)).alias("value"))
    return F.transform(col(messages), turn)


def either_style(x: Column | str, compat: str = "reject") -> Column:
    """Turns of elements that have from and value, or else role and content."""
    who = lambda m: F.coalesce(m["from"], map_role(m["role"]))
    said = lambda m: F.when(m["from"].isNotNull(), m["value"]).otherwise(m["content"])
    return F.transform(col(x), lambda m: F.struct(who(m).alias("from"), strip(python_text(said(m), compat)).alias("value")))


def skip_reason(turns: Column | str) -> Column:
    """Why turns make no sample, in the order of the tests; null if they do."""
    x = col(turns)
    reply = F.exists(F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda t: t["from"] == "gpt")
    return (
        F.when(x.isNull() | (F.size(x) == 0), F.lit("empty"))
        .when(F.exists(x, lambda t: ~F.coalesce(t["from"].isin("human", "gpt"), F.lit(False))), F.lit("role"))
        .when(F.exists(x, lambda t: F.coalesce(t["value"], F.lit("")) == ""), F.lit("blank"))
        .when(F.try_element_at(x, F.lit(1))["from"] != "human", F.lit("order"))
        .when(~reply, F.lit("no_reply"))
    )


def first_pair(turns: Column | str) -> Column:
    """The first turn and the first reply after it; turns between are left out. Null where they make no sample."""
    x = col(turns)
    replies = F.filter(F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda t: t["from"] == "gpt")
    return F.when(skip_reason(turns).isNull(), F.array(F.try_element_at(x, F.lit(1)), F.try_element_at(replies, F.lit(1))))


def normalize(df: DataFrame, messages: str = "messages", compat: str = "reject") -> DataFrame:
    """df with ``conversations`` (null if rejected) and ``skip_reason``."""
    turns = df.withColumn("_turns", turns_of(messages, compat))
    return turns.withColumn("conversations", first_pair("_turns")).withColumn("skip_reason", skip_reason("_turns")).drop("_turns")


def normalize_samples(df: DataFrame, position: str = "pos", compat: str = "reject") -> DataFrame:
    """(id, conversations, skip_reason): ``conversations`` wins over ``messages``; a missing id is sample-<position>."""
    for name, kind in (("conversations", TURN), ("messages", MESSAGE), ("id", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    turns = F.when(F.col("conversations").isNotNull(), F.transform("conversations", lambda t: F.struct(t["from"].alias("from"), strip(python_text(t["value"], compat)).alias("value")))).otherwise(turns_of("messages", compat))
    out = df.withColumn("_turns", turns)
    return out.select(F.coalesce("id", F.concat(F.lit("sample-"), F.col(position).cast("string"))).alias("id"), first_pair("_turns").alias("conversations"), skip_reason("_turns").alias("skip_reason"))


def speech_conversations(conversations: Column | str, assistant_text: Column | str, text: Column | str, question: str = DEFAULT_QUESTION) -> Column:
    """A row's conversation, or a fixed question with the first text that isn't empty as its answer."""
    answer = strip(F.coalesce(F.nullif(col(assistant_text), F.lit("")), F.nullif(col(text), F.lit("")), F.lit("")))
    made = F.array(F.struct(F.lit("human").alias("from"), F.lit(question).alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))
    return F.when(F.coalesce(F.size(col(conversations)), F.lit(0)) > 0, col(conversations)).otherwise(made)


def assembled(flat: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, messages) from one row for each turn."""
    item = F.struct(F.col(order).alias("_o"), F.col(role).alias("role"), F.col(text).alias("content"))
    rows = flat.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_m"))
    return rows.select(key, plain_messages("_m").alias("messages"))


def skip_counts(df: DataFrame, reason: str = "skip_reason") -> DataFrame:
    """(skip_reason, n): kept rows under "kept"."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("skip_reason")).agg(F.count("*").alias("n"))


def mixture(**sources: DataFrame) -> DataFrame:
    """Corpora of one shape under one another, with their name in ``source``."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def with_position(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """0-based input position where rows carry their order (file, place); globally sorted by ranges, without one task holding all rows.

    Rows are range-partitioned by the order, numbered inside partitions and shifted by the counts before.
    Ranges come from a sample, so the parts are checkpointed: counts and rows then see the same ones.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()))
    inner = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__row", F.row_number().over(inner) - 1)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = counts.select("__part", (F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")).alias("__before"))
    placed = numbered.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__row")).cast("long"))
    return placed.drop("__part", "__row", "__before")


def existing_audio(df: DataFrame, files: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose audio's base name is listed (keep), or those whose isn't; a blank path counts as missing."""
    known = files.select(basename("path").alias("_name")).distinct()
    named = df.withColumn("_name", F.when(strip("speech") != "", basename("speech")))
    return named.join(known, "_name", "left_semi" if keep else "left_anti").drop("_name")


def speech_cursor(df: DataFrame, key: str, order: str, n: str) -> DataFrame:
    """df with ``cursor``: the first feature of each row. A row takes as many as it has speech segments (n), one without any."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("cursor", F.coalesce(F.sum(F.greatest(F.col(n), F.lit(1))).over(before), F.lit(0)).cast("long"))
