"""Queries over sources and sinks: a table is written in a format, read back, and compared with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import numeric as N
from ..functions import template as T
from ..functions import text as X
from ..operators import conversation as C
from ..operators import sampling as P
from ..operators import serving as V
from ..operators import training as R
from ..session import scratch, table
from ..sources import readers as S
from ..sources import sinks as K
from ..streaming import serving as W
from . import sqltext

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


ITEMS = "SELECT item_id, text FROM benchmark"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


@query("SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INT) AS pos, CAST(item_id AS VARCHAR) AS id, 'user' AS role, text AS content FROM benchmark")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array with junk around it."""
    path = scratch(spark)
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = F.array_sort(F.collect_list(F.struct("item_id", F.struct(F.col("item_id").cast("string").alias("id"), message.alias("messages")).alias("m"))))
    whole = items(spark, sf_dir).agg(F.to_json(F.transform(rows, lambda r: r["m"])).alias("value"))
    whole.select(F.concat(F.lit("// junk\n"), "value", F.lit("\n;tail")).alias("value")).coalesce(1).write.text(path)
    return S.json_array(spark, path).select("pos", "id", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("content"))


@query(ITEMS)
def strict_json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    K.json_document(items(spark, sf_dir), path)
    return S.strict_json_array(spark, path, "item_id long, text string")


@query(f"SELECT CAST(item_id AS VARCHAR) AS id, {sqltext.strip('text')} AS context, 'q ' || item_id AS question, CAST(item_id AS VARCHAR) || '|' AS answers FROM benchmark")
def nested_qa_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    answer = lambda text: F.struct(text.alias("text"), F.lit(0).alias("answer_start"))
    ident = F.col("item_id").cast("string")
    qa = F.struct(ident.alias("id"), F.concat(F.lit(" q "), ident).alias("question"), F.array(answer(ident), answer(F.lit(" "))).alias("answers"))
    paragraph = F.struct(F.concat(F.lit(" "), "text").alias("context"), F.array(qa).alias("qas"))
    article = F.struct(F.array(paragraph).alias("paragraphs"))
    items(spark, sf_dir).agg(F.collect_list(article).alias("data")).coalesce(1).write.json(path)
    return S.nested_qa(spark, path).select("id", "context", "question", F.array_join("answers", "|").alias("answers"))


@query("SELECT doc_id, text FROM documents")
def json_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    K.json_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path)


@query("SELECT conv_id AS request_id, turn AS seq, text FROM conversations")
def chunk_stream_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that end in NUL."""
    path = scratch(spark)
    K.chunk_stream(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), "text"), path)
    return S.nul_chunks(spark, path, "request_id long, seq long, text string")


@query("SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 0.5::DOUBLE END AS score FROM labels")
def csv_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed columns, empty for null."""
    path = scratch(spark)
    K.csv_report(table(spark, sf_dir, "labels").withColumn("score", F.when(F.col("toxic") == 1, 0.5)), path, ["doc_id", "quality", "score"])
    return spark.read.option("header", True).schema("doc_id long, quality long, score double").csv(path)


@query("SELECT count(*) AS total, CAST(sum(item_id) AS BIGINT) AS ids FROM benchmark")
def result_document_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary with its samples inside."""
    path = scratch(spark)
    rows = items(spark, sf_dir)
    K.result_document(rows.agg(F.count("*").alias("total")), rows.select("item_id"), path)
    back = spark.read.schema("total long, samples array<struct<item_id:long>>").json(path)
    return back.select("total", F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + x["item_id"]).alias("ids"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INT) AS line, rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '  ' || r_name AS value FROM region")
def table_lines_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.table_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey").where("line > 0")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def matched_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder of parquet shards those that patterns name, each once."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for lang in ("en", "de", "fr"):
        rows.where(F.col("lang") == lang).write.parquet(f"{path}/data/{lang}")
    return S.parquet_shards(spark, path, ["data/en/*.parquet", "data/[ed]*/*"])


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def mirrored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang").where("lang = 'en'").write.parquet(f"{path}/en/train")
    return S.hub_mirror(spark, path + "/", "en", "train")


@query("SELECT 'run_' || r_regionkey AS run, r_regionkey / 4.0 AS val_loss, r_regionkey AS global_step FROM region")
def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the folders that hold a marker, one file in each."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "region")
    meta = F.to_json(F.struct(F.lit(1).alias("epoch"), F.col("r_regionkey").alias("global_step"), (F.col("r_regionkey") / 4.0).alias("val_loss")))
    rows.select(meta.alias("value"), F.concat(F.lit("run_"), "r_regionkey").alias("run")).write.partitionBy("run").text(path)
    found = S.checkpoint_meta(spark, f"{path}/run=*")
    return found.select(F.regexp_extract("path", "run=([^/]*)$", 1).alias("run"), "val_loss", "global_step")


@query("SELECT 'run_' || r_regionkey AS run, 'base/' || r_name AS base_model FROM region")
def adapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    config = F.to_json(F.struct(F.concat(F.lit("base/"), "r_name").alias("base_model_name_or_path")))
    table(spark, sf_dir, "region").select(config.alias("value"), F.concat(F.lit("run_"), "r_regionkey").alias("run")).write.partitionBy("run").text(path)
    return S.adapter_base(spark, f"{path}/run=*").select(F.regexp_extract("path", "run=([^/]*)$", 1).alias("run"), "base_model")


@query("SELECT count(DISTINCT lang) AS folders, true AS sized FROM documents")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that reads no contents."""
    path = scratch(spark)
    table(spark, sf_dir, "documents").select("doc_id", "lang").write.partitionBy("lang").parquet(path)
    files = S.list_files(spark, path, "*.parquet")
    return files.agg(F.count_distinct(X.dirname("path")).alias("folders"), F.min(F.col("length") > 0).alias("sized"))


@query("SELECT event_id, event_type FROM events")
def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded stream over a parquet folder, written by one trigger and read back."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows.write.parquet(f"{path}/in")
    stream = W.read_parquet(spark, f"{path}/in", rows.schema, 10)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query(f"SELECT conv_id, CASE WHEN role = 'user' THEN 'human' WHEN role = 'assistant' THEN 'gpt' END AS who, {sqltext.strip('text')} AS said FROM conversations")
def either_style_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of either style, by conversation."""
    c = table(spark, sf_dir, "conversations")
    old = (F.col("conv_id") % 2 == 0) & X.map_role("role").isNotNull()
    when = lambda use, value: F.when(use, value).otherwise(F.lit(None).cast("string"))
    element = F.struct(when(old, X.map_role("role")).alias("from"), when(old, F.col("text")).alias("value"), when(~old, F.col("role")).alias("role"), when(~old, F.col("text")).alias("content"))
    rows = c.select("conv_id", C.either_style(F.array(element)).alias("t"))
    return rows.select("conv_id", F.col("t")[0]["from"].alias("who"), F.col("t")[0]["value"].alias("said"))


@query(f"SELECT conv_id, {sqltext.strip('arg_min(text, turn)')} AS first FROM conversations GROUP BY conv_id")
def first_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.assembled(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", X.first_turn(F.transform("messages", lambda m: m["content"])).alias("first"))


@query("""SELECT conv_id, count(*) = 2 AS first_round, CAST(count(*) * 3 - 1 AS BIGINT) AS start, CAST(count(*) * 5 - 1 AS BIGINT) AS stop, least(count(*) * 300, 1024) AS tokens, conv_id % 3 / 1000.0 > 0.001 AS samples, conv_id % 2 = 0 AS known FROM conversations GROUP BY conv_id""")
def serving_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer spans, first rounds and generation settings of requests."""
    rows = C.assembled(table(spark, sf_dir, "conversations"))
    n = F.size("messages")
    span = A.answer_span((n * 3).cast("long"), (n * 5).cast("long"))
    model = F.when(F.col("conv_id") % 2 == 0, F.lit("a")).otherwise(F.lit("z"))
    return rows.select(
        "conv_id", V.first_round("messages", 0).alias("first_round"), span["start"].alias("start"), span["stop"].alias("stop"), N.served_tokens(n * 300, 1024).cast("long").alias("tokens"),
        N.does_sample(F.col("conv_id") % 3 / 1000.0).alias("samples"), T.known_model(model, ["a", "b"]).alias("known"),
    )


@query("SELECT vec_id, round(CAST(CAST(embedding[1] * 1000 AS INT) AS DOUBLE) / 32768, 9) AS first, 64 AS n FROM embeddings")
def int16_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers as samples between -1 and 1."""
    ints = F.transform("embedding", lambda x: F.bround(x * 1000).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.int16_to_float(ints).alias("s"))
    return rows.select("vec_id", F.round(F.col("s")[0], 9).alias("first"), F.size("s").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|45'), doc_id) AS place FROM documents")
def shuffled_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of an epoch, and by place: ranks over range partitions."""
    rows = P.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", epoch=3)
    return P.global_rank(rows.withColumn("key", P.order_key(F.col("doc_id"), P.SEED + 3)), "key", "doc_id", name="r").select("doc_id", (F.col("r") + 1).alias("place"))


@query("SELECT user_id AS worker_name, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY user_id")
def unknown_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of workers that the registry lacks."""
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("worker_name"))
    known = beats.where("worker_name % 3 = 0").distinct()
    return V.unknown_heartbeats(beats, known).groupBy("worker_name").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE event_id / 8.0 END AS rate, CASE WHEN user_id % 2 = 0 THEN value ELSE -value END AS monitored FROM events")
def monitored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    logged = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(0.0))
    rate = F.when(F.coalesce(F.col("event_id") % 3 == 0, F.lit(False)), F.col("value")).otherwise(R.learning_rate(logged, F.col("event_id") / 8.0))
    return e.select("event_id", rate.alias("rate"), R.monitored(F.col("value"), -F.col("value"), F.col("user_id") % 2 == 0).alias("monitored"))


@query(f"""WITH p AS (SELECT doc_id, text, regexp_extract_all(translate(text, '०१२३४५६७८९', '0123456789'), '-?\\d+(?:,\\d{{3}})*(?:\\.\\d+)?')[-1] AS m FROM documents)
    SELECT doc_id, CASE WHEN contains(text, '####') THEN {sqltext.number("text[length(text) - instr(reverse(text), '####') + 2:]")} ELSE {sqltext.number("coalesce(m, '')")} END AS predicted FROM p""")
def predicted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.predicted_number("text").alias("predicted"))
