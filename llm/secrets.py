"""Operator 5, secret scans with an incremental blob ledger.

A version of a document is addressed by the SHA-256 of its text. The ledger holds, for each blob, the
rule versions that have scanned it and the spans found. An update scans only blobs, and of those only
rules, that the ledger lacks; each new blob is scanned once whatever number of paths carry it. Findings
are then joined back to all paths. The query writes a ledger of its own and reads its findings from it.

Spans are code points, end exclusive: Spark has no positions of regex matches, so a text is split at the
matches and the lengths of pieces and matches are added up.

Defined cases: a null text is the empty blob; a null doc_id is a path like any other; rows that repeat are
returned as often as they come; matches of one rule never overlap (leftmost first), spans of different
rules may; empty tables give empty results; columns other than doc_id and text are ignored, of clashing
names the first counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .decontaminate import bounded


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has ``least`` characters; texts without any of ``hints`` (lower case) have none."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base; their order breaks ties of start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("gh", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)
BASE_KINDS = 3
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Matches that are folded in one run.
RUN = 256
#: Bits of the filter of repeated blobs: 16 for each, within these bounds; a row of the filter holds 64.
FILTER_BITS = (1 << 16, 1 << 27)


def _literal(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'" if "'" in text else "r'" + text + "'"


def spans(rule: Rule, rank: int, text: str = "text", lower: str = "lower", todo: str = "todo") -> Column:
    """Spans of one rule, an empty list where it isn't due or can't match.

    Matches are folded RUN at a time, so that a text of very many is not copied for each of them.
    """
    pattern = _literal(rule.pattern)
    might = " or ".join(f"contains({lower}, '{h}')" for h in rule.hints) or f"{text} rlike {pattern}"
    pieces = f"transform(split({text}, {pattern}, -1), x -> length(x))"
    wholes = f"transform(regexp_extract_all({text}, {pattern}, 0), x -> length(x))"
    values = f"transform(regexp_extract_all({text}, {pattern}, {rule.group}), x -> length(x))"
    none = f"cast(array() as {SPAN})"
    matches = f"transform(array({wholes}), w -> arrays_zip(slice({pieces}, 1, size(w)), w, {values}))[0]"
    run = f"""
        aggregate(slice(m, r * {RUN} + 1, {RUN}), named_struct('at', b.at, 'out', {none}),
            (a, x) -> named_struct('at', a.at + x['0'] + x.w, 'out', if(x['2'] >= {rule.least},
                concat(a.out, array(named_struct('start', a.at + x['0'], 'rank', {rank}, 'end', a.at + x['0'] + x.w, 'kind', '{rule.kind}'))), a.out)))
    """
    folded = f"""
        transform(array({matches}), m -> aggregate(if(size(m) > 0, sequence(0, (size(m) - 1) div {RUN}), cast(array() as array<bigint>)),
            named_struct('at', 0, 'out', cast(array() as array<{SPAN}>)),
            (b, r) -> transform(array({run.replace("r * ", "cast(r as int) * ")}), y -> named_struct('at', y.at, 'out', concat(b.out, array(y.out))))[0],
            b -> flatten(b.out)))[0]
    """
    return F.expr(f"if(array_contains({todo}, '{rule.name}') and ({might}), {folded}, {none})")


def addressed(docs: DataFrame, with_text: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    return out if with_text else out.drop("text")


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rules, spans): what it lacks for these documents, scanned.

    Without a ledger every blob is due: texts of blobs that no other row carries are scanned where they lie.
    Of the others, and with a ledger, only texts go on that may be due, by a filter of bounded size.
    """
    versions = base.stored(addressed(docs, False).groupBy("blob").agg(F.min("doc_id").alias("carrier"), F.count("*").alias("rows")))
    wanted = F.array(*[F.lit(r.name) for r in rules])
    texts = addressed(docs, True).withColumn("carrier", F.col("doc_id")).drop("doc_id")
    if ledger is None:
        marked = versions.where("rows > 1")
        bits, table = blob_filter(marked)
        due = passing(versions, bits, table, True).withColumn("todo", wanted)
        alone = passing(texts, bits, table, False).withColumn("todo", wanted).select("blob", "todo", "text")
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        due = versions.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
        due = base.stored(due.where("size(todo) > 0").drop("done"))
        bits, table = blob_filter(due)
        alone = None
    due = base.stored(due.select(F.col("blob").alias("own"), F.col("carrier").alias("path"), "todo"))
    # the text moves by path, which is unique, and not by blob, of which a third of all rows may be copies
    same = F.col("carrier").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("own"))
    moved = passing(texts, bits, table, True).join(bounded(due), same).select("blob", "todo", "text")
    found = scanned(moved, rules).dropDuplicates(["blob"])
    return found if alone is None else found.unionByName(scanned(alone, rules))


def scanned(due: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    rows = due.withColumn("lower", F.lower("text"))
    return rows.select("blob", F.col("todo").alias("rules"), F.concat(*[spans(r, k) for k, r in enumerate(rules)]).alias("spans"))


def blob_filter(marked: DataFrame) -> tuple[int, DataFrame]:
    """(bits, (word, held)): one bit for each blob, by its hash, in words of 64; at most FILTER_BITS / 64 rows."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * marked.count()).bit_length()))
    at = marked.select(F.pmod(F.xxhash64("blob"), F.lit(bits)).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("held"))
    return bits, base.cut(words)


def passing(rows: DataFrame, bits: int, table: DataFrame, hit: bool) -> DataFrame:
    """The rows whose blob's bit is set (or not); the table's size is bounded by construction."""
    marked = rows.withColumn("at", F.pmod(F.xxhash64("blob"), F.lit(bits))).withColumn("word", F.expr("at div 64"))
    joined = marked.join(F.broadcast(table), "word", "left")
    set_ = F.expr("coalesce(shiftrightunsigned(held, cast(at % 64 as int)) & 1, 0) = 1")
    return joined.where(set_ if hit else ~set_).drop("word", "at", "held")


def record(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger table at ``path`` lacks, appends it there and returns the whole ledger."""
    spark = docs.sparkSession
    try:
        before = spark.read.parquet(path)
    except AnalysisException as error:  # the first call has no table yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        before = None
    update(docs, before, rules).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, spans) of every path: the ledger's spans of its blob by start, then rule."""
    hits = ledger.where("size(spans) > 0").groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return addressed(docs, False).join(hits, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def joined(kept: str) -> Column:
    return F.expr(f"array_join(transform(filter(spans, s -> {kept}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    out = findings(docs, record(docs, f"{base.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"))
    count = lambda kind: F.expr(f"size(filter(spans, s -> s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(f"s.rank < {BASE_KINDS}"), 256).alias("base_sha256"), joined("true").alias("spans")
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[secret]``; spans that overlap or touch become one."""
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(-1)) >= s["start"]),
            F.concat(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    built = F.aggregate(
        merged,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("[secret]")).alias("out")),
        lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, built).otherwise(text)
