"""Queries over predictions, metrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..functions.numeric import safe_exp
from ..operators import metrics as M
from ..session import table
from . import sqltext as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as references of the whole documents with their number."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("prediction"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold")).join(d, "item_id")


PAIRS = f"""p AS (SELECT item_id, {S.normalized('d.text')} AS a, {S.normalized('b.text')} AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"""


@query(f"SELECT doc_id, {S.normalized('text')} AS answer FROM documents")
def answer_normalize_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_answer("text", decompose=False).alias("answer"))


@query()
def answer_normalize_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_answer("text").alias("answer"))


@query(f"WITH {PAIRS}, w AS (SELECT item_id, {S.split_words('a')} AS x, {S.split_words('b')} AS y FROM p) SELECT item_id, CAST({S.overlap('x', 'y')} AS BIGINT) AS overlap, round({S.f1('x', 'y')}, 9) AS f1 FROM w")
def token_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("item_id", X.normalize_answer("prediction", False).alias("a"), X.normalize_answer("gold", False).alias("b"))
    same = X.bag_overlap(X.split_words("a"), X.split_words("b"))
    return rows.select("item_id", same.cast("long").alias("overlap"), F.round(X.token_f1(F.col("a"), F.col("b")), 9).alias("f1"))


@query(f"WITH {PAIRS} SELECT item_id, CAST({S.contains_either('substr(b, 1, 20)', 'b')} AS DOUBLE) AS part, CAST({S.contains_either('a', 'b')} AS DOUBLE) AS whole FROM p")
def contains_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("item_id", X.normalize_answer("prediction", False).alias("a"), X.normalize_answer("gold", False).alias("b"))
    return rows.select("item_id", X.contains_match(F.substring("b", 1, 20), F.col("b")).alias("part"), X.contains_match(F.col("a"), F.col("b")).alias("whole"))


@query(f"""WITH {PAIRS}, r AS (SELECT item_id, a, unnest([b, {S.normalized('substr(a, 1, 60)')}, '']) AS g FROM p), w AS (SELECT item_id, a, g, {S.split_words('a')} AS x, {S.split_words('g')} AS y FROM r)
    SELECT item_id, CAST(max({S.contains_either('a', 'g')}) AS DOUBLE) AS contains_match, round(max({S.f1('x', 'y')}), 9) AS f1 FROM w GROUP BY item_id""")
def best_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("answers", F.array("gold", F.substring(X.normalize_answer("prediction", False), 1, 60), F.lit("।")))
    return M.best_of_references(rows, "prediction", "answers", decompose=False).select("item_id", "contains_match", F.round("f1", 9).alias("f1"))


@query()
def best_of_references_nfkd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("answers", F.array("gold", F.lit("।")))
    return M.best_of_references(rows, "prediction", "answers", key="item_id").select("item_id", "contains_match", F.round("f1", 9).alias("f1"))


@query("SELECT l_orderkey, arg_min(l_linenumber, l_quantity * 100 + l_linenumber) AS l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey")
def argmin_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_quantity", "l_linenumber")).alias("m"))
    return rows.select("l_orderkey", "m.l_linenumber", "m.l_quantity")


LINE_SCORES = "SELECT l_orderkey AS sample_idx, l_linenumber AS ord, l_linestatus || l_linenumber AS answer, l_quantity AS mean_nll, l_linenumber AS start, CAST(l_discount * 100 AS INT) AS length FROM lineitem"


@query(f"""WITH s AS ({LINE_SCORES}), v AS (SELECT * FROM s WHERE length > start AND start >= 0), b AS (SELECT sample_idx, mean_nll AS nll, answer AS best FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY mean_nll, ord, answer) AS r FROM v) WHERE r = 1)
    SELECT o.o_orderkey AS sample_idx, coalesce(nll, 'inf'::DOUBLE) AS nll, coalesce(best, 'none') AS best_answer, coalesce(nll, 'inf'::DOUBLE) >= 50 AS overflow FROM orders o LEFT JOIN b ON o.o_orderkey = b.sample_idx""")
def best_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample_idx"), F.col("l_linenumber").alias("ord"), F.concat("l_linestatus", "l_linenumber").alias("answer"), F.col("l_quantity").alias("mean_nll"),
        F.col("l_linenumber").alias("start"), F.rint(F.col("l_discount") * 100).cast("int").alias("length"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_idx"), F.array(F.lit("none")).alias("answers"))
    return M.best_answer(orders, line).select("sample_idx", "nll", "best_answer", (F.col("perplexity") == float("inf")).alias("overflow"))


@query(f"SELECT doc_id, {S.number('text')} AS first, {S.number('''CASE WHEN contains(text, '####') THEN text[length(text) - instr(reverse(text), '####') + 2:] ELSE text END''')} AS gold FROM documents")
def number_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_number("text").alias("first"), X.gold_number("text").alias("gold"))


@query(r"""SELECT doc_id, m AS last_match FROM (SELECT doc_id, regexp_extract_all(translate(text, '०१२३४५६७८९', '0123456789'), '-?\d+(?:,\d{3})*(?:\.\d+)?')[-1] AS m FROM documents)""")
def number_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.try_element_at(F.regexp_extract_all(X.digits_to_ascii("text"), F.lit(X.NUMBER_IN_TEXT), F.lit(0)), F.lit(-1))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("last_match"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rule = F.when(F.col("n_chars") < 200, F.lit(None)).otherwise((F.col("n_chars") > 900).cast("int"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("predicted", rule)


JUDGED = "j AS (SELECT l.*, d.lang, d.n_chars, CASE WHEN d.n_chars < 200 THEN NULL ELSE CAST(d.n_chars > 900 AS INT) END AS predicted FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {JUDGED} SELECT lang, count(*) AS total, CAST(sum(CASE WHEN quality = predicted THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) FILTER (predicted IS NULL) AS invalid, round(avg(CASE WHEN quality = predicted THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM j GROUP BY lang")
def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accuracy(judged(spark, sf_dir), "lang", gold="quality").withColumn("accuracy", F.round("accuracy", 9))


@query(f"WITH {JUDGED} SELECT lang, round(avg(quality), 9) AS base, round(avg(toxic), 9) AS stage1, round(avg(toxic) - avg(quality), 9) AS delta FROM j GROUP BY lang")
def model_delta_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    of = lambda model, c: rows.groupBy("lang").agg(F.avg(c).alias("value")).withColumn("model", F.lit(model))
    out = M.model_delta(of("base", "quality").unionByName(of("stage1", "toxic")), "lang")
    return out.select("lang", *[F.round(c, 9).alias(c) for c in ("base", "stage1", "delta")])


@query(f"WITH {JUDGED} SELECT coalesce(lang, 'overall') AS category, count(*) AS n, round(avg(quality), 9) AS base, round(avg(toxic), 9) AS tuned, count(*) FILTER (quality = toxic) AS ties FROM j GROUP BY ROLLUP (lang)")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.category_rollup(judged(spark, sf_dir), "lang", "quality", "toxic")
    return out.select(F.coalesce("lang", F.lit("overall")).alias("category"), "n", F.round("base", 9).alias("base"), F.round("tuned", 9).alias("tuned"), "ties")


@query(f"WITH {JUDGED}, s AS (SELECT CASE WHEN quality = 0 THEN 'empty_answers' WHEN n_chars > 1000 THEN 'too_long' ELSE 'kept' END AS skip_reason FROM j) SELECT skip_reason, count(*) AS n FROM s GROUP BY 1")
def qa_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("answers", F.when(F.col("quality") == 0, F.array(F.lit(" \n"))).otherwise(F.array(F.lit(""), F.lit("x"))))
    return M.qa_eligible(rows, F.col("n_chars"), 1000).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason")).agg(F.count("*").alias("n"))


LOGPROBS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE)) * 20) AS p, list_filter(embedding, lambda x: x > 0) AS m FROM embeddings), s AS (SELECT vec_id, -list_sum(list_transform(list_filter(range(1, 65), lambda i: i % 3 = 0), lambda i: p[i])) / 21 AS nll FROM e)"


def nll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    p = F.transform("embedding", lambda x: -F.abs(x.cast("double")) * 20)
    mask = F.transform("embedding", lambda x, i: (i + 1) % 3 == 0)
    return rows.select("vec_id", A.masked_mean_nll(p, mask).alias("nll"))


@query(f"WITH {LOGPROBS} SELECT vec_id, round(nll, 6) AS nll, CASE WHEN nll < 50 THEN round(exp(nll), 4) ELSE 'inf'::DOUBLE END AS perplexity FROM s")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nll_rows(spark, sf_dir).select("vec_id", F.round("nll", 6).alias("nll"), F.round(safe_exp(F.col("nll")), 4).alias("perplexity"))


@query(f"WITH {LOGPROBS} SELECT count(*) AS total, round(avg(nll), 6) AS nll, round(exp(avg(nll)), 4) AS perplexity, round(avg(CAST(vec_id % 2 AS DOUBLE)), 6) AS contains_match, round(avg((vec_id % 8) / 8.0), 6) AS f1 FROM s")
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nll_rows(spark, sf_dir).withColumn("contains_match", (F.col("vec_id") % 2).cast("double")).withColumn("f1", (F.col("vec_id") % 8) / 8.0)
    return M.qa_summary(rows).select("total", F.round("nll", 6).alias("nll"), F.round("perplexity", 4).alias("perplexity"), F.round("contains_match", 6).alias("contains_match"), F.round("f1", 6).alias("f1"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), n AS (SELECT vec_id // 4 AS g, vec_id % 4 AS k, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x FROM v),
    d AS (SELECT a.g, a.k AS i, b.k AS j, list_sum(list_transform(range(1, 65), lambda t: a.x[t] * b.x[t])) AS s FROM n a JOIN n b ON a.g = b.g AND a.k < 2 AND b.k >= 2),
    p AS (SELECT g, avg(s) AS precision FROM (SELECT g, i, max(s) AS s FROM d GROUP BY g, i) GROUP BY g), r AS (SELECT g, avg(s) AS recall FROM (SELECT g, j, max(s) AS s FROM d GROUP BY g, j) GROUP BY g)
    SELECT g, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 4) AS f1 FROM p JOIN r USING (g)""")
def greedy_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("g"), (F.col("vec_id") % 4).alias("k"), A.let(norm, lambda n: F.transform("embedding", lambda x: x.cast("double") / n)).alias("v"))
    sides = unit.groupBy("g").agg(F.array_sort(F.collect_list(F.when(F.col("k") < 2, F.struct("k", "v")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("k") >= 2, F.struct("k", "v")))).alias("b"))
    rows = sides.where("size(a) > 0 and size(b) > 0").select("g", F.transform("a", lambda x: x["v"]).alias("a"), F.transform("b", lambda x: x["v"]).alias("b"))
    return M.greedy_cosine(rows, "a", "b").select("g", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 4).alias("f1"))


@query("""WITH s AS (SELECT l_orderkey AS sample_idx, l_linenumber AS ord, l_discount AS precision, l_tax AS recall, CASE WHEN l_discount + l_tax = 0 THEN 0 ELSE 2 * l_discount * l_tax / (l_discount + l_tax) END - 0.05 AS f1 FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY f1 DESC, ord, precision DESC, recall DESC) AS r FROM s) SELECT sample_idx, CASE WHEN f1 > 0 THEN precision ELSE 0 END AS precision, CASE WHEN f1 > 0 THEN recall ELSE 0 END AS recall FROM b WHERE r = 1""")
def best_bert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    f1 = F.when(d + t == 0, F.lit(0.0)).otherwise(2 * d * t / (d + t)) - 0.05
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_idx"), F.col("l_linenumber").alias("ord"), d.alias("precision"), t.alias("recall"), f1.alias("f1"))
    return M.best_bert(rows).select("sample_idx", "precision", "recall")


@query("""SELECT 'task' || r AS task, metric, value FROM (SELECT r_regionkey AS r, unnest(['acc', 'name', 'ok', 'none']) AS metric, unnest([CAST(r_regionkey AS VARCHAR), 'x' || r_regionkey, 'true', NULL]) AS value FROM region)""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.to_json(F.struct(F.col("r_regionkey").alias("acc"), F.concat(F.lit("x"), "r_regionkey").alias("name"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("none"), F.array(F.lit(1)).alias("list")), {"ignoreNullFields": "false"})
    rows = table(spark, sf_dir, "region").select(F.concat(F.lit('{"task'), "r_regionkey", F.lit('": '), inner, F.lit("}")).alias("results"))
    return M.metric_rows(rows).select("task", "metric", "value")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def page_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.where("key = 'k'").select("event_id", F.col("value").cast("long").alias("k"))


@query(f"SELECT doc_id, md5('{X.GSM_HEAD}' || text || '{X.GSM_TAIL}') AS gsm, md5('{X.QA_HEAD}' || text || '{X.QA_MIDDLE}' || source || '{X.QA_TAIL}') AS qa FROM documents")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.gsm_prompt("text")).alias("gsm"), F.md5(X.qa_prompt("text", "source")).alias("qa"))


@query("SELECT doc_id, n_chars - quality AS difference FROM documents JOIN labels USING (doc_id)")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left_semi")
    return M.positional(d, l, "doc_id").select("doc_id", (F.col("n_chars") - F.col("quality")).alias("difference"))


@query("""WITH a AS (SELECT lang AS x, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT lang AS x, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) SELECT x AS lang, least(a.n, b.n) AS n FROM a JOIN b USING (x)""")
def multiset_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    half = lambda k: d.where(F.col("doc_id") % 2 == k).groupBy("lang").agg(F.count("*").alias(f"n{k}"))
    return half(0).join(half(1), "lang").select("lang", F.least("n0", "n1").alias("n"))


@query("SELECT doc_id, format('{:,}', n_chars) AS grouped, rpad(source, 8, ' ') AS padded, 'https://x/rows?dataset=' || replace(lang || '/' || source, '/', '%2F') || '&offset=' || doc_id AS url FROM documents")
def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = X.query_url("https://x/rows", {"dataset": F.concat_ws("/", "lang", "source"), "offset": F.col("doc_id")})
    return table(spark, sf_dir, "documents").select("doc_id", X.grouped("n_chars").alias("grouped"), X.padded("source", 8).alias("padded"), url.alias("url"))
