"""Edge rows with results derived by hand, and comparison with plain Python where that is the definition."""

import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lekha.functions import arrays as A
from lekha.functions import audio as W
from lekha.functions import numeric as N
from lekha.functions import template as T
from lekha.functions import text as X
from lekha.functions import tokens as K


def column(spark, values, kind, make):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in frame.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


SPACED = ["", " a ", "\x1c a\x1f", "  a　\x85", "a b", "\n\t", "\x0b a \r\n", "a \n", None]


def test_strip_and_split(spark):
    assert column(spark, SPACED, "string", X.strip) == [s if s is None else s.strip() for s in SPACED]
    assert column(spark, SPACED, "string", X.split_words) == [s if s is None else s.split() for s in SPACED]


def python_normalized(text):
    text = unicodedata.normalize("NFKD", text.lower().strip())
    text = text.translate({0x93C: None, 0x901: "ं", 0x200C: None, 0x200D: None})
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text).split())


ANSWERS = ["", "।", "क़लम", "कलम", "चाँद", "a‌b‍c", "ﬁne, it's €5 + 3!", "  Mixed\tCASE ", "éÉ", "½ ⅓", "a_b—c"]


def test_normalize_answer(spark):
    assert column(spark, ANSWERS, "string", X.normalize_answer) == [python_normalized(t) for t in ANSWERS]


@pytest.mark.parametrize(("make", "cases"), [
    (X.gold_number, {"x #### 1,234": "1234", "#### 2.50": "2.5", "#### abc": None, "-0": "0", "007": "7", "10.0": "10", "a #### 1 #### -0.0": "-0", "5,6": "56", "$3.10": "3.1", "0.05": "0.05"}),
    (X.predicted_number, {"so 3 then 4": "4", "2020-2021": "-2021", "उत्तर १८": "18", "#### 7 #### 8": "8", "no digits": None, "1,234.50 end": "1234.5", "####": None}),
])
def test_numbers(spark, make, cases):
    assert column(spark, list(cases), "string", make) == list(cases.values())


def python_f1(a, b):
    x, y = a.split(), b.split()
    if not x or not y:
        return float(x == y)
    same = sum((Counter(x) & Counter(y)).values())
    return 2 * same / (len(x) + len(y)) if same else 0.0


def test_answer_metrics(spark):
    cases = [("a a b", "a b b c"), ("", ""), ("", "x"), ("1824 में", "1824"), ("q", "z")]
    rows = spark.createDataFrame(cases, "a string, b string").select("a", "b", X.token_f1(F.col("a"), F.col("b")).alias("f"), X.contains_match(F.col("a"), F.col("b")).alias("c")).collect()
    for r in rows:
        assert abs(r.f - python_f1(r.a, r.b)) < 1e-12
    assert [r.c for r in rows] == [0.0, 1.0, 0.0, 1.0, 0.0]


def test_speech_tag(spark):
    cases = {"a <speech> b <speech>": "<speech>\na  b", "<speech>": "<speech>", "no tag ": "no tag "}
    assert column(spark, list(cases), "string", X.canonical_speech_tag) == list(cases.values())


def test_paths(spark):
    assert column(spark, ["/a/b.wav", "c/d", "x", "~/q"], "string", lambda x: X.resolve_path(x, "/r/", "/h")) == ["/a/b.wav", "/r/c/d", "/r/x", "/h/q"]
    assert column(spark, ["m/x", "/m/p/checkpoint-5/", "checkpoint-1"], "string", X.model_name) == ["x", "p_checkpoint-5", "checkpoint-1"]
    assert column(spark, ["data/a-1.parquet", "b"], "string", lambda x: X.glob_match(x, "data/*-?.parquet", "z*")) == [True, False]
    assert column(spark, ["ab[c", "]", ""], "string", lambda x: X.find(x, "[")) == [2, -1, -1]
    assert column(spark, ["a]b]c", "x"], "string", lambda x: X.rfind(x, "]")) == [3, -1]
    assert column(spark, ["end###", "x"], "string", lambda x: X.cut_suffix(x, F.lit(None).cast("string"))) == ["end###", "x"]


TURN = "array<struct<role:string,message:string>>"


def test_templates(spark):
    turns = [("user", " hi "), ("assistant", "yo")]
    system = T.HINDI_SYSTEM
    head = f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
    ask, say = "<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"
    got = column(spark, [turns, [("user", " hi "), ("assistant", None)], []], TURN, lambda x: T.render(x))
    assert got == [head + ask + say + "yo<|eot_id|>", head + ask + say, head]
    assert column(spark, [turns], TURN, lambda x: T.render(x, system="")) == ["<|begin_of_text|>" + ask + say + "yo<|eot_id|>"]
    v1 = [[("USER", "q"), ("ASSISTANT", "a"), ("USER", None)]]
    assert column(spark, v1, TURN, lambda x: T.render(x, "v1")) == [T.V1_SYSTEM + " USER: q ASSISTANT: a</s>USER:"]
    two = [[("USER", "q"), ("ASSISTANT", "a"), ("USER", "r")]]
    assert column(spark, two, TURN, lambda x: T.render(x, "llama_2")) == [f"[INST] <<SYS>>\n{system}\n<</SYS>>\n\nq [/INST] a </s><s>[INST] r [/INST]"]
    assert column(spark, [[("", "q")]], TURN, lambda x: T.render(x, "plain")) == ["q</s>"]
    for bad, name in (([("ASSISTANT", "q")], "llama_2"), ([("USER", "")], "llama_2"), ([("", "q"), ("", "a")], "plain")):
        with pytest.raises(Exception, match="message|mark"):
            column(spark, [bad], TURN, lambda x, name=name: T.render(x, name))
    assert [r.name for r in T.registry(spark).orderBy("name").collect()] == ["llama_2", "llama_3", "plain", "v1"]
    assert column(spark, [["a", "b", "c"], []], "array<string>", T.chat_pairs) == [[["a", "b"], ["c", None]], []]


def test_token_kernels(spark):
    ints, nested = "array<int>", "array<array<int>>"
    assert column(spark, [[[1, 5], [1, 2]], [[5], [2]], [[1]]], nested, lambda x: A.join_speech_chunks(x, 1)) == [[1, 5, -200, 2], [5, -200, 2], [1]]
    assert column(spark, [[1, 5, 6, 7, 8]], ints, lambda x: A.label_mask(x, F.lit(3))) == [[-100, -100, -100, 7, 8]]
    assert column(spark, [[1, 2, 3, 4, 5, 6, 7], [1, 2], []], ints, lambda x: A.stack_frames(x, 3)) == [[[1, 2, 3], [4, 5, 6]], [], []]
    assert column(spark, [1, 3, 0], "int", lambda x: A.length_mask(x, F.lit(3))) == [[False, True, True], [False] * 3, [True] * 3]
    assert column(spark, [0], "int", lambda x: A.length_mask(x, x)) == [[]]
    assert column(spark, [[7, -200, 8]], ints, lambda x: A.splice_labels(x, x, F.lit(3), 4)) == [[7, -100, -100, -100]]
    assert column(spark, [[3, 4]], ints, lambda x: A.pad_left(x, F.lit(4), F.lit(0))) == [[0, 0, 3, 4]]
    assert column(spark, [[[-1.0, -3.0], [True, False]]], "array<array<string>>", lambda x: A.masked_mean_nll(F.transform(x[0], lambda v: v.cast("double")), F.transform(x[1], lambda v: v.cast("boolean")))) == [1.0]
    assert column(spark, [[]], ints, A.positions) == [[]]


def test_sizes(spark):
    size = lambda n: N.split_size(n, 0.25, 1, n)
    assert column(spark, [10, 2, 0, 1], "long", size) == [2, 1, 0, 1]
    assert column(spark, [105000], "long", lambda n: N.optimizer_steps(n, 2, 7, 3)) == [22500]
    assert column(spark, [0.25, 1.0, 500.0], "double", lambda v: N.validation_interval(v, F.lit(7500), 7)) == [13125.0, 1.0, 500.0]
    assert column(spark, [3000], "int", N.encoder_frames) == [1500] and column(spark, [3000], "int", N.projected_frames) == [300]
    assert column(spark, [50.0, 0.0], "double", N.safe_exp) == [float("inf"), 1.0]


def wav(samples, rate, channels=1):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels), file.setsampwidth(2), file.setframerate(rate)
        file.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    t = np.arange(8000) / 8000
    tone = 0.5 * np.sin(2 * np.pi * 440 * t)
    rows = spark.createDataFrame([(1, wav(tone, 8000)), (2, b"junk"), (3, None), (4, wav(np.repeat(tone, 2), 8000, 2))], "k int, data binary")
    got = {r.k: r.x for r in rows.select("k", W.decode_wav("data").alias("x")).collect()}
    assert got[2] is None and got[3] is None and len(got[1]) == 16000
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(np.array(got[1])[500:-500] - want[500:-500]).max() < 5e-3
    assert np.allclose(got[1], got[4], atol=1e-4)
    mel = W.log_mel(np.array(got[1]), 80, 2)
    assert mel.shape == (200, 80) and mel.max() - mel.min() <= 2 + 1e-6
    peak = W.mel_filters(80)[:, round(440 / 40)].argmax()
    assert abs(int(mel[20].argmax()) - int(peak)) <= 1
    order = W.decode_value([0.5], wav(tone, 16000), None, 16000)
    assert order.tolist() == [0.5]


def test_tokenizer_contract(spark):
    make = lambda: K.hashing_encoder(100)
    pieces = column(spark, ["a b <speech> c", None], "string", lambda x: K.tokenize_chunks(x, make))
    rows = column(spark, pieces, "array<array<int>>", lambda x: A.join_speech_chunks(x, 1))
    assert rows[0][0] == 1 and rows[0].count(-200) == 1 and len(rows[0]) == 5 and rows[1] is None
    assert [len(x) for x in column(spark, ["a b", ""], "string", lambda x: K.tokenize(x, make))] == [3, 1]
    assert column(spark, [[1, 2, 3]], "array<int>", lambda x: K.overlength(F.size(x), 2, "truncate", x)) == [[1, 2]]


def test_digits_of_any_script(spark):
    assert column(spark, ["٣٤ and ৭.৫0", "𝟙𝟚", "१,२३४"], "string", X.normalize_number) == ["34", "12", "1234"]
    assert column(spark, ["x ৭ y ٤٢"], "string", X.predicted_number) == ["42"]


def test_bag_overlap_of_long_texts(spark):
    rows = spark.createDataFrame([(["a"] * 3000 + ["b"] * 5 + ["c"], ["b"] * 9 + ["a"] * 7)], "a array<string>, b array<string>")
    assert rows.select(X.bag_overlap(F.col("a"), F.col("b")).alias("n")).first().n == 12


def test_uncalled_helpers(spark):
    row = spark.range(1).select(T.message_text(F.struct(F.lit("t").alias("text"), F.lit("m").alias("media"))).alias("m"), N.reports_progress(F.lit(26), F.lit(2)).alias("p"), X.ints_to_units(F.array(F.lit(3), F.lit(1))).alias("u")).first()
    assert (row.m, row.p, row.u) == ("t", True, "3 1")
    turns = [[("human", "q"), ("gpt", "a")], [("human", "q")]]
    good, bad = (spark.createDataFrame([(t,)], "t array<struct<`from`:string,value:string>>").select(T.require_single_turn("t").alias("x")) for t in turns)
    assert good.first().x[1].value == "a"
    with pytest.raises(Exception, match="one human turn"):
        bad.collect()
