import json

import pytest
from pyspark.sql import functions as F

from lekha.functions import model as L
from lekha.operators import conversation as C
from lekha.operators import metrics as M
from lekha.operators import sampling as P
from lekha.operators import serving as V
from lekha.operators import training as R
from lekha.sources import readers as S
from lekha.sources import sinks as K


def test_conversation_rules(spark):
    cases = [
        ([("user", " hi "), ("assistant", "yo")], None),
        ([("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "d")], None),
        ([("system", "s"), ("user", "a"), ("assistant", "b")], "role"),
        ([("assistant", "a"), ("user", "b")], "order"),
        ([("user", "a")], "no_reply"),
        ([("user", "a"), ("assistant", "b"), ("user", "   ")], "blank"),
        ([], "empty"),
        (None, "empty"),
        ([("user", None), ("assistant", "b")], "blank"),
    ]
    frame = spark.createDataFrame([(k, m) for k, (m, _) in enumerate(cases)], f"k int, messages {C.MESSAGE}")
    rows = C.normalize(frame).orderBy("k").collect()
    assert [r.skip_reason for r in rows] == [x for _, x in cases]
    assert [t.value for t in rows[0].conversations] == ["hi", "yo"] and [t.value for t in rows[1].conversations] == ["a", "c"]
    assert rows[2].conversations is None
    assert [t.value for t in C.normalize(frame, compat="python").where("k = 8").first().conversations] == ["None", "b"]


def test_positions_are_gapless(spark):
    frame = spark.range(500).selectExpr("id", "id % 7 as v")
    rows = [r for r in C.with_position(frame, "v", "id").orderBy("pos").collect()]
    assert [r.pos for r in rows] == list(range(500)) and [(r.v, r.id) for r in rows] == sorted((k % 7, k) for k in range(500))


def test_split_contract(spark):
    frame = spark.range(103).withColumnRenamed("id", "k")
    rows = P.exact_split(frame, "k", 0.1, 0.25).collect()
    count = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert count == {"train": 67, "val": 10, "test": 26} and len({r.k for r in rows}) == 103
    assert rows and sorted(rows) == sorted(P.exact_split(frame, "k", 0.1, 0.25).collect())
    assert {r.split for r in P.exact_split(frame.limit(1), "k", 0.5).collect()} == {"train"}
    for bad in ((-0.1, 0.0), (0.5, 0.5)):
        with pytest.raises(ValueError, match="fractions"):
            P.exact_split(frame, "k", *bad)
    with pytest.raises(ValueError, match="positive"):
        P.fraction_subset(frame, "k", 0)
    assert P.fraction_subset(frame, "k", 0.001).count() == 1 and P.fraction_subset(frame, "k", 2.0).count() == 103


def test_buckets_are_a_permutation(spark):
    frame = spark.range(97).selectExpr("id as k", "id * 37 % 50 as len")
    rows = P.bucket_batches(P.length_buckets(frame, "len", "k", 4), "k", 4).collect()
    assert sorted(r.k for r in rows) == list(range(97))
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r.batch, []).append(r)
    assert sorted(len(v) for v in by_batch.values()) == [1] + [4] * 24
    padded = P.padded_batches(spark.createDataFrame([(0, 1, [5], [5]), (0, 0, [1, 2], [-100, 2])], "b int, o int, i array<int>, l array<int>"), "b", "o", "i", "l", 0).first()
    assert padded.input_ids == [[1, 2], [5, 0]] and padded.labels == [[-100, 2], [5, -100]] and padded.attention_mask == [[True, True], [True, False]]


def test_metric_ties_and_defaults(spark):
    samples = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "sample_idx int, answers array<string>")
    scores = spark.createDataFrame([(1, 0, "x", 2.0), (1, 1, "y", 1.0), (1, 2, "z", 1.0)], "sample_idx int, ord int, answer string, mean_nll double")
    rows = {r.sample_idx: r for r in M.best_answer(samples, scores).collect()}
    assert rows[1].best_answer == "y" and (rows[2].nll, rows[2].perplexity, rows[2].best_answer) == (float("inf"), float("inf"), "z")
    empty = samples.limit(0).selectExpr("1.0d as contains_match", "1.0d as f1", "1.0d as nll")
    assert M.qa_summary(empty).first().asDict() == {"total": 0, "contains_match": 0.0, "f1": 0.0, "nll": 0.0, "perplexity": 0.0}
    with pytest.raises(Exception, match="positions differ"):
        M.positional(spark.range(3).withColumnRenamed("id", "index"), spark.range(2).withColumnRenamed("id", "index")).collect()
    best = M.best_of_references(spark.createDataFrame([(1, "x", ["y", "x z"])], "k int, p string, a array<string>"), "p", "a", key="k").first()
    assert best.contains_match == 1.0 and abs(best.f1 - 2 / 3) < 1e-9


def test_checkpoints(spark):
    rows = spark.createDataFrame([("a", 0, None, None, False), ("b", 1, 0.5, 0.1, False), ("c", 2, 0.5, None, False), ("z.ckpt", 3, None, None, True)], "path string, ord int, val_loss double, train_loss_epoch double, legacy boolean")
    assert R.best_checkpoint(rows).first().path == "b"
    assert R.best_checkpoint(rows.where("legacy")).first().path == "z.ckpt"
    log = spark.createDataFrame([(1, 0, 1, 0.1, None, 3.0), (2, 0, 1, None, 2.0, None), (3, 1, 2, 0.3, None, None)], "seq int, epoch int, step int, lr double, train_loss double, val_loss double")
    assert [tuple(r) for r in R.epoch_records(log, "epoch", "step").collect()] == [(0, 1, 0.1, 2.0, 3.0)]


def test_serving(spark):
    w = spark.createDataFrame([(0, "a", 2, 4, ["m"]), (1, "b", 1, 2, ["m"]), (2, "c", 1, 0, ["n"])], "ord int, worker_name string, speed int, queue_length int, model_names array<string>")
    assert V.shortest_queue(w, "m").first().asDict() == {"worker_name": "a", "load": 2.0, "queue_length": 5}
    assert V.shortest_queue(w, "absent").count() == 0
    drawn = {V.lottery(w, "m", s).first().worker_name for s in range(30)}
    assert drawn == {"a", "b"} and V.lottery(w, "absent", 1).first().worker_name == ""
    flush = spark.createDataFrame([("r", 1, 15), ("r", 2, 45), ("r", 3, 65)], "request_id string, seq int, n_units int")
    assert sorted((r.at, r.start, r.stop) for r in V.flushed(flush, 40).collect()) == [(-1, 45, 65), (1, 0, 45)]
    now = spark.sql("select timestamp'2024-01-01 00:01:00' as now")
    beats = spark.sql("select 'x' worker_name, true check_heart_beat, timestamp'2024-01-01 00:00:30' last_heart_beat union all select 'y', true, timestamp'2024-01-01 00:00:29.9' union all select 'z', false, timestamp'2020-01-01 00:00:00'")
    assert [r.worker_name for r in V.expired(beats.join(now), F.col("now")).collect()] == ["y"]


def test_sources(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text('junk [{"id": 1, "messages": [{"role": "user", "content": "x"}]}, {"id": "b"}] tail', encoding="utf-8")
    rows = S.json_array(spark, str(good)).collect()
    assert [(r.pos, r.id) for r in rows] == [(0, "1"), (1, "b")] and rows[0].messages[0].content == "x"
    bad = tmp_path / "bad.json"
    for text in ("no brackets", "] ["):
        bad.write_text(text, encoding="utf-8")
        with pytest.raises(Exception, match="no JSON array"):
            S.json_array(spark, str(bad)).collect()
    qa = {"data": [{"paragraphs": [{"context": " c ", "qas": [{"id": "1", "question": " q ", "answers": [{"text": " a ", "answer_start": 0}]}, {"id": "2", "question": "r", "answers": []}]}]}]}
    (tmp_path / "qa.json").write_text(json.dumps(qa), encoding="utf-8")
    rows = S.nested_qa(spark, str(tmp_path / "qa.json")).collect()
    assert [(r.id, r.context, r.question, r.answers) for r in rows] == [("1", "c", "q", ["a"]), ("2", "c", "r", [])]
    assert S.nested_qa(spark, str(tmp_path / "qa.json"), 1).count() == 1
    assert S.match_shards(["data/b-1.parquet", "data/a-1.parquet", "x"], ["a-*", "data/*-1*"], "data") == ["data/a-1.parquet", "data/b-1.parquet"]
    with pytest.raises(FileNotFoundError):
        S.match_shards(["x"], ["y*"])
    spark.range(3).write.parquet(str(tmp_path / "shards" / "p1.parquet"))
    assert S.parquet_shards(spark, str(tmp_path / "shards"), ["p1.parquet/*"]).count() == 3
    assert S.shard_url("o/r", "data/x.parquet") == "hf://datasets/o/r/data/x.parquet"


def test_paged_source(spark, tmp_path):
    for offset in (0, 3, 6):
        rows = [{"row": {"question": f"q{k}", "answer": str(k)}} for k in range(offset, min(offset + 3, 7))]
        (tmp_path / f"{offset}.json").write_text(json.dumps({"rows": rows, "num_rows_total": 7}), encoding="utf-8")
    spark.dataSource.register(S.PagedRows)
    read = lambda **o: spark.read.format("paged_rows").options(root=str(tmp_path), page="3", total="7", **o).load()
    assert [r.idx for r in read().orderBy("idx").collect()] == list(range(7))
    assert [r.question for r in read(limit="4").orderBy("idx").collect()] == ["q0", "q1", "q2", "q3"]


def test_files_and_config(spark, tmp_path):
    for name in ("r1.json", "samples_1.json", "run/a/adapter_model.safetensors", "run/b/other"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"val_loss": 0.5}', encoding="utf-8")
    files = S.list_files(spark, str(tmp_path))
    assert S.newest_json(files).first().path.endswith("r1.json")
    assert [r.path.rsplit("/", 1)[-1] for r in S.checkpoint_folders(files).collect()] == ["a"]
    assert S.checkpoint_meta(spark, str(tmp_path / "r1.json")).first().val_loss == 0.5
    text = "a:\n  b: 3\n  c: ${a.b}\nlist:\n  - x\n  - 2.5\nd: 'v ${a.b}' # note\ne: null\n"
    assert S.load_config(text) == {"a": {"b": 3, "c": 3}, "list": ["x", 2.5], "d": "v 3", "e": None}
    assert S.load_config(text, interpolate=False)["a"]["c"] == "${a.b}"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\nx", None), (2, "b", 0.5)], "k int, t string, v double")
    K.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    K.json_document(rows, str(tmp_path / "d"))
    text = next((tmp_path / "d").glob("part-*")).read_text(encoding="utf-8")
    assert [r["k"] for r in json.loads(text)] == [1, 2] and "é" in text
    K.csv_report(rows.where("k = 2"), str(tmp_path / "c"), ["k", "v"])
    assert next((tmp_path / "c").glob("part-*")).read_text().split() == ["k,v", "2,0.5"]
    K.chunk_stream(rows, str(tmp_path / "n"))
    assert sorted(r.t for r in S.nul_chunks(spark, str(tmp_path / "n"), "k int, t string").collect()) == ["b", "é\nx"]
    K.result_document(rows.select("k").where("k = 1"), rows.select("t"), str(tmp_path / "r"))
    assert len(json.loads(next((tmp_path / "r").glob("part-*")).read_text(encoding="utf-8"))["samples"]) == 2
    lines = [r.value for r in K.table_lines(rows.select("k", "v"), "k").orderBy("line").collect()]
    assert lines == ["k  v", "-  ---", "1", "2  0.5"]


def test_model_contract(spark):
    rows = spark.createDataFrame([("a\nlast ", "x y")], "prompt string, answer string")
    assert L.generate(rows, "prompt", "out", lambda: L.stub_generate).first().out == "last"
    assert len(L.score(rows, "prompt", "answer", "lp", lambda: L.stub_score).first().lp) == 2
