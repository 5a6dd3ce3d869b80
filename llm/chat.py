"""Operator 10, chat formatting over reply trees.

A node names its parent. Iterative self-joins enumerate root-to-leaf paths: each round joins the table of
pointers with itself and so doubles the distance that a pointer spans, which takes log2(depth) rounds.
Branches (leaves) are ranked by the mean score of their path, and the best ``keep`` of each tree are
formatted, one conversation each.

Template of a turn: ``### Role: text </turn>`` and a line end. Inside texts a backslash becomes ``\\b``,
``<`` becomes ``\\l`` and ``#`` becomes ``\\h``, so neither marker can occur there and unescaping is
exact. Roles user, assistant and system are written with a capital; any other is written after ``=``,
escaped, its colons as ``\\c``. The loss mask is a list of spans, one for each assistant text.

Defined cases: a null text or role is empty; a null tree id is a tree of its own; a parent that is null,
unknown or the node itself makes a root; nodes that only hang on a cycle reach no root and are left out;
of equal node ids in one tree each is kept as a node of its own, and replies to that id follow the one of
highest score (then least role and text) alone; the flat form numbers turns itself, so repeated or tied turns
all stay, ordered by turn, role and text; very long texts are one string, which only the formatting touches;
empty tables give empty results; clashing extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

END = " </turn>\n"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_ROLES = ("user", "assistant", "system")


def _replaced(x: Column, pairs) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escaped(x: Column) -> Column:
    return _replaced(x, _ESCAPES)


def unescaped(x: Column) -> Column:
    return _replaced(x, [(new, old) for old, new in reversed(_ESCAPES)])


def role_head(role: Column) -> Column:
    other = F.concat(F.lit("="), _replaced(role, (*_ESCAPES, (":", "\\c"))))
    return F.when(role.isin(*_ROLES), F.initcap(role)).otherwise(other)


def head_role(head: Column) -> Column:
    rest = head.substr(F.lit(2), F.length(head))
    return F.when(head.startswith("="), unescaped(F.replace(rest, F.lit("\\c"), F.lit(":")))).otherwise(F.lower(head))


def best_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, pos, node) of the best branches; nodes: tree, node, parent, score, node unique in a tree.

    Round k holds the pointers that span 2**k replies, which only nodes that deep have, and extends every
    path by those of its nodes: both tables shrink to the deep trees as rounds go on.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.expr("if(known and parent <> node, parent, null)").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    linked = base.cut(linked)
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    span = linked.where("up is not null").select("tree", "node", "up")
    parents = span.select("tree", F.col("up").alias("node"))
    paths = linked.select("tree", "node").join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k in range(math.ceil(math.log2(most)) if most > 1 else 0):
        paths = base.cut(paths)
        more = paths.join(span, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        paths = paths.union(more)
        above = span.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        span = base.cut(span.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")))
        if span.isEmpty():
            break
    paths = base.cut(paths)
    scored = paths.join(linked, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max(F.col("up").isNull()).alias("rooted")).where("rooted")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.asc("leaf")))
    best = scored.withColumn("_rank", rank).where(F.col("_rank") <= keep).select("tree", "leaf")
    return paths.join(best, ["tree", "leaf"]).select("tree", "leaf", (-F.col("back")).alias("pos"), "node")


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss) from (tree, leaf, pos, role, text); loss: spans in code points."""
    head = F.concat(F.lit("### "), role_head(F.col("role")), F.lit(": "))
    body = escaped(F.col("text"))
    order = Window.partitionBy("tree", "leaf").orderBy("pos")
    rows = (
        turns.withColumn("role", F.coalesce("role", F.lit("")))
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("head", head)
        .withColumn("body", body)
        .withColumn("turn", F.concat("head", "body", F.lit(END)))
        .withColumn("at", F.coalesce(F.sum(F.length("turn")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
        .withColumn("span", F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))))
    )
    return (
        rows.groupBy("tree", "leaf")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "span"))).alias("turns"))
        .select("tree", "leaf", F.expr("array_join(turns.turn, '')").alias("formatted"), F.expr("filter(turns.span, s -> s is not null)").alias("loss"))
    )


def read_back(out: DataFrame) -> DataFrame:
    """turns (role, text) and loss_text of each formatted conversation, parsed from its string and mask."""
    parts = F.split("formatted", r"\Q </turn>\E\n", -1)
    turn = lambda x: F.struct(
        head_role(x.substr(F.lit(5), F.instr(x, ": ") - 5)).alias("role"),
        unescaped(x.substr(F.instr(x, ": ") + 2, F.length(x))).alias("text"),
    )
    lost = F.transform("loss", lambda s: unescaped(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return out.withColumn("turns", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)).withColumn("loss_text", F.array_join(lost, ""))


def chain(conversations: DataFrame) -> DataFrame:
    """A flat conversation as a tree: each row replies to the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    flat = base.take(conversations, "conv_id", "turn", "role", "text")
    return flat.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("~")).alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def told_apart(nodes: DataFrame) -> DataFrame:
    """nodes under ids (node, twin) that are unique in a tree; parents are the first twins."""
    first = Window.partitionBy("tree", "node").orderBy(F.desc("score"), "role", "text")
    parent = F.when(~F.col("parent").eqNullSafe(F.col("node")) & F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), F.lit(0).alias("twin")))
    rows = nodes.withColumn("twin", F.row_number().over(first) - 1).withColumn("parent", parent)
    return rows.withColumn("node", F.struct("node", "twin")).drop("twin")


def format_trees(nodes: DataFrame, keep: int = 1, unique: bool = False) -> DataFrame:
    """The best branches of reply trees (tree, node, parent, role, text, score), formatted; unique: no tree repeats a node id."""
    nodes = base.take(nodes, "tree", "node", "parent", "role", "text", "score")
    if not unique:
        nodes = base.stored(told_apart(nodes))
    paths = best_paths(nodes, keep)
    out = formatted(paths.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]))
    return out if unique else out.withColumn("leaf", F.col("leaf.node"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = base.take(base.documents(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    sly = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", sly), (-7, 1, "assistant", sly)], "conv_id long, turn long, role string, text string")
    back = read_back(format_trees(base.stored(chain(table.union(extra))), unique=True))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        F.expr("try_cast(nullif(tree, '~') as bigint)").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role)
        ELSE 1 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END
        + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + 15 AS chars
    FROM rows
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
