"""Queries over metric logs, checkpoints and serving logs; events, lineitem and embeddings stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import logged, queue_length
from ..operators import serving as V
from ..operators import training as R
from ..operators.conversation import with_position
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


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


LOG = """log AS (SELECT event_id AS seq, user_id, CAST(date_trunc('day', ts) AS DATE) AS day, CASE WHEN event_type <> 'error' THEN value END AS lr, CASE WHEN event_type IN ('click', 'view') THEN value END AS train_loss, CASE WHEN event_type = 'signup' THEN value END AS val_loss FROM events)"""


@query(f"""WITH {LOG}, u AS (SELECT * FROM log WHERE train_loss IS NOT NULL OR val_loss IS NOT NULL)
    SELECT user_id, day, arg_max(lr, seq) FILTER (lr IS NOT NULL) AS lr, arg_max(train_loss, seq) FILTER (train_loss IS NOT NULL) AS train_loss, arg_max(val_loss, seq) FILTER (val_loss IS NOT NULL) AS val_loss FROM u GROUP BY user_id, day""")
def epoch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c: F.when(c, F.col("value"))
    log = events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), "user_id", F.to_date("ts").alias("day"), when(F.col("event_type") != "error").alias("lr"),
        when(F.col("event_type").isin("click", "view")).alias("train_loss"), when(F.col("event_type") == "signup").alias("val_loss"),
    )
    return R.epoch_records(log, "user_id", "day")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r <= 3")
def ckpt_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_checkpoints(events(spark, sf_dir).select("user_id", "event_id", "value"), "value", "event_id", 3, "min", "user_id")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 4")
def ckpt_topk_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best four overall: the limit is the feature."""
    return R.top_checkpoints(events(spark, sf_dir).select("event_id", "value"), "value", "event_id", 4, "max")


@query("SELECT 'ckpt-' || event_id AS path FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE WHEN event_id % 2 = 0 THEN value ELSE value + 1 END AS s FROM events WHERE event_type <> 'error') ORDER BY s, event_id LIMIT 1")
def ckpt_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    meta = e.select(
        F.concat(F.lit("ckpt-"), "event_id").alias("path"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").alias("legacy"),
        F.when((F.col("event_id") % 7 != 0) & (F.col("event_id") % 2 == 0), F.col("value")).alias("val_loss"), F.when(F.col("event_id") % 7 != 0, F.col("value") + 1).alias("train_loss_epoch"),
    )
    return R.best_checkpoint(meta)


@query("SELECT path, row_number() OVER (ORDER BY CASE WHEN path = 'run/final_model' THEN 1 ELSE 2 END, v, m DESC, path) AS place FROM (SELECT CASE WHEN user_id = 3 THEN 'run/final_model' ELSE 'run/u' || user_id END AS path, min(value) AS v, max(event_id) AS m FROM events GROUP BY 1)")
def resume_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("user_id") == 3, F.lit("run/final_model")).otherwise(F.concat(F.lit("run/u"), "user_id"))
    ordered = R.resume_order(events(spark, sf_dir).select(path.alias("path"), F.col("value").alias("val_loss"), F.col("event_id").alias("mtime")))
    keyed = ordered.withColumn("_class", F.when(F.col("path").endswith("final_model"), 1).otherwise(2)).withColumn("_newest", -F.col("mtime"))
    return with_position(keyed, "_class", "val_loss", "_newest", "path").select("path", (F.col("pos") + 1).alias("place"))


PARAMS = "p AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'lora_A' WHEN 1 THEN 'lora_B' WHEN 2 THEN 'projector' END AS grp, CAST(embedding[1] AS DOUBLE) AS g, CAST(embedding[2] AS DOUBLE) AS w, vec_id % 5 <> 0 AS live FROM embeddings)"


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 4
    name = F.concat(F.lit("m."), F.when(k == 0, F.lit("lora_A.speech_projector")).when(k == 1, F.lit("lora_B")).when(k == 2, F.lit("speech_projector")).otherwise(F.lit("embed")), F.lit(".weight"))
    return table(spark, sf_dir, "embeddings").select(name.alias("name"), F.col("embedding")[0].cast("double").alias("grad_norm"), F.col("embedding")[1].cast("double").alias("weight_norm"), (F.col("vec_id") % 5 != 0).alias("requires_grad"), F.col("vec_id").alias("numel"))


@query(f"WITH {PARAMS} SELECT coalesce(grp, 'other') AS grp, round(sqrt(sum(g * g)), 6) AS grad_norm, round(sqrt(sum(w * w)), 6) AS weight_norm, round(sqrt(sum(g * g)) / greatest(sqrt(sum(w * w)), 1e-12), 6) AS ratio FROM p WHERE live GROUP BY 1")
def grad_norm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.norm_report(params(spark, sf_dir).withColumn("grp", F.coalesce(R.parameter_group(F.col("name")), F.lit("other"))), "grp")
    return out.select("grp", *[F.round(c, 6).alias(c) for c in ("grad_norm", "weight_norm", "ratio")])


@query("SELECT CAST(sum(vec_id) FILTER (vec_id % 5 <> 0) AS BIGINT) AS trainable, CAST(sum(vec_id) AS BIGINT) AS total, round(100.0 * sum(vec_id) FILTER (vec_id % 5 <> 0) / sum(vec_id), 6) AS percent FROM embeddings")
def parameter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parameter_counts(params(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query("SELECT event_id // 7 AS global_step, round(avg(value), 6) AS loss, count(*) AS micro_batches FROM events GROUP BY 1")
def accumulated_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.floor(F.col("event_id") / 7).cast("long").alias("global_step"), F.col("value").alias("loss"))
    return R.accumulated_loss(rows).withColumn("loss", F.round("loss", 6))


@query("SELECT event_id, user_id * 7 + event_id % 7 AS completed, round((user_id * 7 + event_id % 7) / 100.0, 6) AS true_epoch FROM events WHERE event_id % 3 = 0 AND NOT (event_type = 'view' AND user_id % 2 = 0)")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("global_step"), F.col("event_id").alias("batch_idx"), (F.col("event_id") % 3).alias("rank"),
        F.when(F.col("event_type") == "view", F.lit("train")).otherwise(F.lit("val")).alias("hook"), (F.col("user_id") % 2 == 0).alias("has_validation"),
    )
    return R.run_progress(R.recorded(log), 7, 100).select("event_id", "completed", F.round("true_epoch", 6).alias("true_epoch"))


@query("""SELECT user_id, ts AS last_seen, nxt AS next_seen FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL 30 SECOND""")
def worker_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.liveness_gaps(events(spark, sf_dir).select("user_id", "ts"), "user_id", "ts")


@query("SELECT user_id AS worker_name, max(ts) AS last_heart_beat FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 SECOND AND user_id % 2 = 0")
def workers_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    state = V.latest_state(e.select("user_id", "ts", F.lit(0).alias("queue_length")), "user_id").withColumn("check_heart_beat", F.col("user_id") % 2 == 0)
    now = e.agg(F.max("ts").alias("now"))
    return V.expired(state.join(F.broadcast(now)), F.col("now")).select(F.col("user_id").alias("worker_name"), "last_heart_beat")


@query("""SELECT event_type, arg_min(user_id, struct_pack(a := q / (user_id % 5 + 1), b := user_id)) AS worker_name, CAST(arg_min(q, struct_pack(a := q / (user_id % 5 + 1), b := user_id)) + 1 AS BIGINT) AS queue_length
    FROM (SELECT event_type, user_id, count(*) AS q FROM events GROUP BY event_type, user_id) GROUP BY event_type""")
def shortest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy("event_type", F.col("user_id").alias("worker_name")).agg(F.count("*").alias("queue_length"))
    w = w.withColumn("speed", F.col("worker_name") % 5 + 1).withColumn("ord", F.col("worker_name"))
    return V.shortest_queue(w, None, "event_type").select("event_type", "worker_name", "queue_length")


@query("""SELECT (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events)) AS models, CAST(sum(user_id % 5 + 1) AS BIGINT) AS speed, CAST(sum(q) AS BIGINT) AS queue_length FROM (SELECT user_id, count(*) AS q FROM events GROUP BY user_id)""")
def worker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("model_names"), F.count("*").alias("queue_length")).withColumn("speed", F.col("user_id") % 5 + 1)
    return V.summary(w).select(F.array_join("model_names", ",").alias("models"), "speed", "queue_length")


@query("""SELECT arg_min(w, -ln((CAST('0x' || substr(md5(w || '|42'), 1, 13) AS BIGINT) + 1) / 4503599627370497.0::DOUBLE) / s) AS worker_name
    FROM (SELECT CAST(user_id AS VARCHAR) AS w, user_id % 5 + 1 AS s FROM events WHERE event_type = 'click' GROUP BY user_id)""")
def worker_lottery(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = events(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("worker_name")).agg(F.collect_set("event_type").alias("model_names")).withColumn("speed", F.col("worker_name").cast("double") % 5 + 1)
    return V.lottery(w, "click", 42)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.row_number().over(w).alias("seq"), (F.row_number().over(w) * 7).alias("n_units"))


@query("""WITH c AS (SELECT user_id AS request_id, count(*) AS n FROM events GROUP BY user_id), f AS (SELECT request_id, n, unnest(range(1, n // 6 + 1)) AS k FROM c)
    SELECT request_id, CAST(k * 6 - 1 AS INT) AS at, CAST((k - 1) * 42 AS INT) AS start, CAST(k * 42 AS INT) AS stop FROM f
    UNION ALL SELECT request_id, -1, CAST(n // 6 * 42 AS INT), CAST(n * 7 AS INT) FROM c WHERE n % 6 > 0""")
def chunk_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.flushed(chunks(spark, sf_dir), 40)


@query("""WITH u AS (SELECT conv_id, turn, string_split(text, ' ') AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) SELECT conv_id, turn, (rn * 3 - 2) || ' ' || (rn * 3 - 1) || ' ' || (rn * 3) AS new_units, 'n' || turn AS new_text FROM u""")
def chunk_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    upto = F.row_number().over(w) * 3
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), upto.alias("n"))
    rows = rows.withColumn("unit", F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x.cast("string")), " "))
    text = V.text_increment(F.concat(F.lit("prompt n"), F.col("seq").cast("string"), F.lit(" ")), F.lit("prompt"))
    return V.unit_increments(rows).select(F.col("request_id").alias("conv_id"), F.col("seq").alias("turn"), X.ints_to_units("new_units").alias("new_units"), text.alias("new_text"))


@query("""SELECT conv_id AS request_id, CASE WHEN max(turn) % 2 = 0 THEN regexp_replace(arg_max(text, turn), '[.]$', '') ELSE arg_max(text, turn) || ' (error_code: 1)' END AS text FROM conversations GROUP BY conv_id""")
def final_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), "text", (F.col("turn") % 2).cast("int").alias("error_code"))
    return V.final_text(rows, ".").select("request_id", "text")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') || '-conv.json' AS log_name, 5 - event_id % 3 + user_id % 4 AS queue FROM events WHERE event_id <= 10 OR event_id % 100 = 0")
def serving_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = queue_length(F.lit(5), F.col("event_id") % 3, F.col("user_id") % 4)
    return events(spark, sf_dir).where(logged(F.col("event_id"))).select("event_id", V.log_name("ts").alias("log_name"), q.alias("queue"))
