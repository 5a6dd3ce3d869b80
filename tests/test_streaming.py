import datetime

from pyspark.sql import functions as F

from lekha.operators import serving as V
from lekha.streaming import serving as S


def run(stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_flushes_agree_with_batch(spark, tmp_path):
    rows = [(f"r{k % 3}", k // 3, (k // 3 + 1) * (7 + k % 3), k >= 27) for k in range(30)]
    frame = spark.createDataFrame(rows, "request_id string, seq int, n_units int, done boolean")
    for part in range(2):
        frame.where(f"seq % 10 div 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.unit_flushes(S.read_parquet(spark, str(tmp_path / "in"), frame.schema), 40)
    got = sorted((r.request_id, r.start, r.stop) for r in run(stream, "append", tmp_path, "flushes"))
    assert got == sorted((r.request_id, r.start, r.stop) for r in V.flushed(frame, 40).collect())


def test_registry(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", "register", at(0), 1, True), ("a", "heartbeat", at(15), 2, True), ("b", "heartbeat", at(16), 5, True), ("a", "heartbeat", at(45), 3, True), ("a", "heartbeat", at(76), 4, True), ("c", "register", at(300), 0, False)]
    frame = spark.createDataFrame(rows, "worker_name string, kind string, ts timestamp, queue_length int, check_heart_beat boolean")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(S.worker_registry(S.read_parquet(spark, str(tmp_path / "in"), frame.schema)), "append", tmp_path, "registry")
    events = [(r.worker_name, r.event) for r in got]
    assert [e for w, e in events if w == "a"] == ["registered", "heartbeat", "heartbeat", "expired", "unknown"]
    assert ("b", "unknown") in events and ("c", "registered") in events


def test_latest_text(spark, tmp_path):
    frame = spark.createDataFrame([("r", 1, "a", 0), ("r", 2, "ab", 0), ("s", 1, "x", 1)], "request_id string, seq int, text string, error_code int")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(S.latest_text(S.read_parquet(spark, str(tmp_path / "in"), frame.schema)), "complete", tmp_path, "texts")
    assert sorted((r.request_id, r.text) for r in got) == [("r", "ab"), ("s", "x")]


def test_upsert(spark, tmp_path):
    schema = "seq int, epoch int, step int, lr double, train_loss double, val_loss double"
    for k, rows in enumerate(([(1, 0, 1, 0.1, None, 3.0)], [(2, 0, 1, None, 2.0, None), (3, 1, 2, 0.3, 1.0, None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.read_parquet(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 10)
        S.upsert_epochs(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        last = spark.read.parquet(str(tmp_path / "out" / f"v={k}")).orderBy(F.col("epoch")).collect()
    assert [(r.epoch, r.lr, r.train_loss, r.val_loss) for r in last] == [(0, 0.1, 2.0, 3.0), (1, 0.3, 1.0, None)]


def test_observation(spark):
    from lekha.streaming.monitor import observed

    frame, watch = observed(spark.range(10), even=F.count_if(F.col("id") % 2 == 0))
    assert frame.count() == 10 and watch.get == {"rows": 10, "even": 5}
