"""Serving logs: registry, dispatch, liveness and unit chunks, over batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, cut_suffix, strip, units_to_ints

#: Seconds of silence that expire a worker, and between heartbeats; error codes.
EXPIRY_SECONDS, INTERVAL_SECONDS = 30, 15
ERROR_CODES = {"ok": 0, "worker": 1, "no_worker": 2, "transport": 3}


def serves(models: Column | str, model: str) -> Column:
    return F.array_contains(col(models), model)


def latest_state(heartbeats: DataFrame, worker: str = "worker_name", ts: str = "ts") -> DataFrame:
    """The registry by heartbeats: last time and last queue of each worker."""
    last = heartbeats.groupBy(worker).agg(F.max(F.struct(F.col(ts).alias("last_heart_beat"), "queue_length")).alias("s"))
    return last.select(worker, "s.*")


def expired(workers: DataFrame, now: Column) -> DataFrame:
    """Workers that are checked and have been silent for more than the expiry; exactly that long is alive."""
    return workers.where(F.col("check_heart_beat") & (F.col("last_heart_beat") < now - F.expr(f"INTERVAL {EXPIRY_SECONDS} SECONDS")))


def liveness_gaps(heartbeats: DataFrame, worker: str, ts: str) -> DataFrame:
    """(worker, last_seen, next_seen): silences longer than the expiry, the last open (next_seen null)."""
    w = Window.partitionBy(worker).orderBy(ts)
    rows = heartbeats.select(worker, F.col(ts).alias("last_seen"), F.lead(ts).over(w).alias("next_seen"))
    return rows.where(F.col("next_seen").isNull() | (F.col("next_seen") > F.col("last_seen") + F.expr(f"INTERVAL {EXPIRY_SECONDS} SECONDS")))


def unknown_heartbeats(heartbeats: DataFrame, workers: DataFrame, worker: str = "worker_name") -> DataFrame:
    return heartbeats.join(workers.select(worker), worker, "left_anti")


def summary(workers: DataFrame) -> DataFrame:
    """One row: all model names, total speed and queue."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("model_names"))))
    return workers.agg(names.alias("model_names"), F.coalesce(F.sum("speed"), F.lit(0)).alias("speed"), F.coalesce(F.sum("queue_length"), F.lit(0)).alias("queue_length"))


def shortest_queue(workers: DataFrame, model: str | None = None, *keys: str) -> DataFrame:
    """The worker of least queue by speed, the first on ties; its queue grows by one."""
    rows = workers if model is None else workers.where(serves("model_names", model))
    load = F.col("queue_length").cast("double") / F.col("speed")
    best = rows.groupBy(*keys).agg(F.min(F.struct(load.alias("load"), "ord", "worker_name", "queue_length")).alias("b"))
    return best.where("b is not null").select(*keys, "b.worker_name", "b.load", (F.col("b.queue_length") + 1).alias("queue_length"))


def lottery(workers: DataFrame, model: str, seed: int) -> DataFrame:
    """One worker drawn by speed: the least of -ln(u) / speed; none if speeds sum below 1e-4."""
    rows = workers.where(serves("model_names", model))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", "worker_name", F.lit(str(seed)))), 1, 13), 16, 10).cast("long")
    u = (drawn + 1) / F.lit(float((1 << 52) + 1))
    race = F.when(F.col("speed") > 0, -F.log(u) / F.col("speed"))
    return rows.agg(F.sum("speed").alias("s"), F.min(F.struct(race.alias("r"), "worker_name")).alias("b")).select(F.when(F.coalesce(F.col("s"), F.lit(0.0)) < 1e-4, F.lit("")).otherwise(F.col("b.worker_name")).alias("worker_name"))


def text_increment(text: Column, prompt: Column) -> Column:
    return strip(text.substr(F.length(prompt) + 1, F.length(text)))


def final_text(chunks: DataFrame, stop: str = "") -> DataFrame:
    """(request_id, text, error_code): the last chunk's text, its stop string cut; errors carry their code."""
    last = chunks.groupBy("request_id").agg(F.max(F.struct("seq", "text", "error_code")).alias("m"))
    text = F.when(F.col("m.error_code") == 0, cut_suffix(F.col("m.text"), stop)).otherwise(F.concat("m.text", F.format_string(" (error_code: %d)", F.col("m.error_code"))))
    return last.select("request_id", text.alias("text"), F.col("m.error_code").alias("error_code"))


def unit_increments(chunks: DataFrame) -> DataFrame:
    """chunks with ``new_units``: what each cumulative unit string adds to the one before."""
    w = Window.partitionBy("request_id").orderBy("seq")
    units = chunks.withColumn("units", units_to_ints("unit"))
    before = F.coalesce(F.lag(F.size("units")).over(w), F.lit(0))
    return units.withColumn("new_units", F.slice("units", before + 1, F.greatest(F.size("units"), F.lit(1))))


def flush_sizes(sizes: Column | str, chunk_size: int) -> Column:
    """Flushes of a request from the array of its units so far: (at, start, stop), where pending units reach
    chunk_size everything pending goes; the rest goes at the end, at -1."""
    start = F.struct(F.lit(0).alias("sent"), F.lit(0).alias("have"), F.array().cast("array<struct<at:int,start:int,stop:int>>").alias("out"), F.lit(0).alias("i"))
    flush = lambda at, a, stop: F.struct(at.cast("int").alias("at"), a["sent"].cast("int").alias("start"), stop.cast("int").alias("stop"))

    def step(a: Column, n: Column) -> Column:
        go = n - a["sent"] >= chunk_size
        return F.struct(
            F.when(go, n).otherwise(a["sent"]).alias("sent"), n.alias("have"), F.when(go, F.concat(a["out"], F.array(flush(a["i"], a, n)))).otherwise(a["out"]).alias("out"), (a["i"] + 1).alias("i")
        )

    end = lambda a: F.when(a["have"] > a["sent"], F.concat(a["out"], F.array(flush(F.lit(-1), a, a["have"])))).otherwise(a["out"])
    return F.aggregate(F.transform(col(sizes), lambda n: n.cast("int")), start, step, end)


def flushed(chunks: DataFrame, chunk_size: int) -> DataFrame:
    """(request_id, at, start, stop) of all flushes."""
    rows = chunks.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("seq", "n_units"))).alias("c"))
    out = rows.select("request_id", F.explode(flush_sizes(F.transform("c", lambda x: x["n_units"]), chunk_size)).alias("f"))
    return out.select("request_id", "f.*")


def log_name(ts: Column | str) -> Column:
    return F.concat(F.date_format(col(ts), "yyyy-MM-dd"), F.lit("-conv.json"))


def first_round(messages: Column | str, offset: int) -> Column:
    return F.size(col(messages)) == offset + 2
