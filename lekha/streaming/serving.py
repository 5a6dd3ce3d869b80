"""Streaming forms of the serving logs: worker registry with expiry, text and unit chunks, metric upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.serving import EXPIRY_SECONDS

REGISTRY = "worker_name string, event string, exist boolean, queue_length int, last_heart_beat double"


def read_parquet(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """New parquet files of a folder, a bounded number for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def worker_registry(events: DataFrame) -> DataFrame:
    """State of each worker from (worker_name, kind, ts, queue_length, check_heart_beat): one row for each change.

    kind ``register`` inserts or replaces; ``heartbeat`` updates a known worker, for an unknown one it emits
    exist = false, upon which the worker registers again. A checked worker that is silent for more than the
    expiry, by event time within the watermark, is removed and reported.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            queue, last, checked = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "expired", False, queue, last)], columns=REGISTRY_NAMES)
            return
        known = state.get if state.exists else None
        for row in pd.concat(list(parts)).sort_values(["ts", "kind"]).itertuples():
            now = row.ts.timestamp()
            if known and known[2] and known[1] < now - EXPIRY_SECONDS:
                out.append((key[0], "expired", False, known[0], known[1]))
                known = None
            if row.kind == "register":
                known = (int(row.queue_length), now, bool(row.check_heart_beat))
                out.append((key[0], "registered", True, known[0], now))
            elif known:
                known = (int(row.queue_length), now, known[2])
                out.append((key[0], "heartbeat", True, known[0], now))
            else:
                out.append((key[0], "unknown", False, int(row.queue_length), now))
        if known:
            state.update(known)
            if known[2]:
                state.setTimeoutTimestamp(max(int((known[1] + EXPIRY_SECONDS) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=REGISTRY_NAMES)

    return (
        events.withWatermark("ts", f"{EXPIRY_SECONDS} seconds")
        .groupBy("worker_name")
        .applyInPandasWithState(run, REGISTRY, "queue_length int, last double, checked boolean", "append", GroupStateTimeout.EventTimeTimeout)
    )


REGISTRY_NAMES = [c.strip().split()[0] for c in REGISTRY.split(",")]
FLUSH = "request_id string, start int, stop int, final boolean"


def unit_flushes(chunks: DataFrame, chunk_size: int) -> DataFrame:
    """Flushes of (request_id, seq, n_units, done): everything pending goes once it reaches chunk_size, the rest with ``done``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, have = state.get if state.exists else (0, 0)
        out, done = [], False
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            have, done = int(row.n_units), done or bool(row.done)
            if have - sent >= chunk_size:
                out.append((key[0], sent, have, False))
                sent = have
            if row.done and have > sent:
                out.append((key[0], sent, have, True))
                sent = have
        if not done:
            state.update((sent, have))
        elif state.exists:  # a request that has ended leaves no state
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "start", "stop", "final"])

    return chunks.groupBy("request_id").applyInPandasWithState(run, FLUSH, "sent int, have int", "append", GroupStateTimeout.NoTimeout)


def latest_text(chunks: DataFrame) -> DataFrame:
    """The text of the last chunk of each request so far (complete or update mode)."""
    return chunks.groupBy("request_id").agg(F.max_by(F.struct("text", "error_code"), "seq").alias("m")).select("request_id", "m.*")


def upsert_epochs(log: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("epoch", "step")):
    """Writes the metric log's records to ``path`` batch by batch, old ones merged; returns the stream's writer."""
    from ..operators.training import epoch_records

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.parquet(f"{path}/v={number - 1}")
        except Exception as error:  # the first batch has no table before it
            if "PATH_NOT_FOUND" not in str(error):
                raise
            before = batch.limit(0)
        log_rows = before.unionByName(batch.select(*before.columns)) if before.columns else batch
        values = tuple(c for c in batch.columns if c not in (*keys, "seq"))
        merged = epoch_records(log_rows, *keys, values=values)
        order = log_rows.groupBy(*keys).agg(F.max("seq").alias("seq"))
        merged.join(order, list(keys)).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={number}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
