"""Queries over conversations: shapes, prompts, token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import audio as W
from ..functions import template as T
from ..functions import text as X
from ..functions import tokens as K
from ..operators import conversation as C
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


KEPT = f"""
turns AS (
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' END AS f, {S.strip('text')} AS v,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM conversations
), reasons AS (
    SELECT conv_id, CASE WHEN bool_or(f IS NULL) THEN 'role' WHEN bool_or(coalesce(v, '') = '') THEN 'blank'
        WHEN max(CASE WHEN rn = 1 THEN f END) <> 'human' THEN 'order'
        WHEN NOT bool_or(rn > 1 AND f = 'gpt') THEN 'no_reply' END AS reason
    FROM turns GROUP BY conv_id
), pairs AS (
    SELECT conv_id, max(CASE WHEN rn = 1 THEN v END) AS question, arg_min(v, rn) FILTER (rn > 1 AND f = 'gpt') AS answer
    FROM turns JOIN reasons USING (conv_id) WHERE reason IS NULL GROUP BY conv_id
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.normalize(C.assembled(table(spark, sf_dir, "conversations")))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).where("skip_reason is null").select("conv_id", "conversations")


def ask(n: int):
    return F.col("conversations")[n]["value"]


@query(f"WITH {KEPT} SELECT conv_id, question, answer FROM pairs")
def conv_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("conv_id", ask(0).alias("question"), ask(1).alias("answer"))


@query(f"WITH {KEPT} SELECT coalesce(reason, 'kept') AS skip_reason, count(*) AS n FROM reasons GROUP BY 1")
def conv_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.skip_counts(samples(spark, sf_dir))


@query("""SELECT conv_id, count(*) AS n_all, arg_min(role, turn) AS first_role, string_agg(text, '|' ORDER BY turn) FILTER (rn <= 2) AS first_texts
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id HAVING count(*) >= 2""")
def message_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.assembled(table(spark, sf_dir, "conversations")).where("size(messages) >= 2")
    two = C.first_exchange("messages")
    return rows.select("conv_id", F.size(C.plain_messages("messages")).cast("long").alias("n_all"), two[0]["role"].alias("first_role"), F.array_join(F.transform(two, lambda m: m["content"]), "|").alias("first_texts"))


@query(f"""SELECT item_id, 'human' AS asker, 'gpt' AS replier, {S.strip('text')} AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark WHERE {S.strip('text')} <> ''""")
def pair_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", C.from_pair("text", F.col("item_id").cast("string")).alias("messages"))
    c = F.col("conversations")
    return C.normalize(rows).where("skip_reason is null").select("item_id", c[0]["from"].alias("asker"), c[1]["from"].alias("replier"), ask(0).alias("question"), ask(1).alias("answer"))


@query(f"""WITH {KEPT}, numbered AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS pos FROM reasons)
    SELECT CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'sample-' || pos END AS id, question FROM pairs JOIN numbered USING (conv_id)""")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_position(C.assembled(table(spark, sf_dir, "conversations")), "conv_id")
    rows = rows.withColumn("id", F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))).select("pos", "id", "messages")
    return C.normalize_samples(rows).where("skip_reason is null").select("id", ask(0).alias("question"))


LLAMA3 = f"'{T.BEGIN}{T.HEADER_OPEN}system' || '<|end_header_id|>' || chr(10) || chr(10) || '{T.HINDI_SYSTEM}{T.END_OF_TURN}' || "


def h(role: str) -> str:
    return f"'{T.HEADER_OPEN}{role}<|end_header_id|>' || chr(10) || chr(10)"


@query(f"WITH {KEPT} SELECT conv_id, {LLAMA3} {h('user')} || question || '{T.END_OF_TURN}' || {h('assistant')} || answer || '{T.END_OF_TURN}' AS prompt FROM pairs")
def conv_prompt_llama3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("conv_id", T.render(T.with_roles("conversations")).alias("prompt"))


@query(f"WITH {KEPT} SELECT conv_id, '{T.V1_SYSTEM.replace(chr(39), chr(39) * 2)} USER: ' || question || ' ASSISTANT: ' || answer || '</s>' AS prompt FROM pairs")
def conv_prompt_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("conv_id", T.render(T.with_roles("conversations", "v1"), "v1").alias("prompt"))


@query(f"""WITH {KEPT} SELECT conv_id, '[INST] <<SYS>>' || chr(10) || '{T.HINDI_SYSTEM}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || question || ' [/INST] ' || answer || ' </s>' AS prompt FROM pairs""")
def conv_prompt_llama2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("conv_id", T.render(T.with_roles("conversations", "llama_2"), "llama_2").alias("prompt"))


@query(f"WITH {KEPT} SELECT conv_id, question || '</s>' AS prompt FROM pairs")
def conv_prompt_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.slice("conversations", 1, 1)
    return kept(spark, sf_dir).select("conv_id", T.render(T.with_roles(first, "plain"), "plain").alias("prompt"))


@query(f"WITH {KEPT} SELECT conv_id, {LLAMA3} {h('user')} || '<speech>' || chr(10) || question || '{T.END_OF_TURN}' || {h('assistant')} AS prompt FROM pairs")
def gen_prompt_llama3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: normalised conversations as generation prompts for speech input."""
    return kept(spark, sf_dir).select("conv_id", T.generation_prompt(ask(0), speech=True).alias("prompt"))


@query(f"WITH {KEPT}, i AS (SELECT conv_id, {LLAMA3} {h('user')} || question || '{T.END_OF_TURN}' || {h('assistant')} AS instruction FROM pairs) SELECT conv_id, instruction, length(instruction) AS instruction_chars FROM i")
def instruction_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = T.instruction_part(T.render(T.with_roles("conversations")))
    return kept(spark, sf_dir).select("conv_id", part.alias("instruction"), F.length(part).cast("long").alias("instruction_chars"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {S.strip("'<speech>' || chr(10) || " + S.strip('text'))} ELSE text END AS text FROM conversations""")
def speech_tag_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" <speech>"), "text", F.lit("<speech> "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.canonical_speech_tag(tagged).alias("text"))


@query("""SELECT conv_id, CAST((count(*) + 1) // 2 AS BIGINT) AS pairs, CAST(count(*) % 2 AS BIGINT) AS open_pairs, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id""")
def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.assembled(table(spark, sf_dir, "conversations")).select("conv_id", T.chat_pairs(F.transform("messages", lambda m: m["content"])).alias("p"))
    return rows.select("conv_id", F.size("p").cast("long").alias("pairs"), F.size(F.filter("p", lambda x: x[1].isNull())).cast("long").alias("open_pairs"), F.col("p")[0][0].alias("first_text"))


@query("""WITH t AS (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    u AS (SELECT *, max(CASE WHEN rn = 1 AND role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM t)
    SELECT conv_id, count(*) FILTER (rn > lead) AS turns, count(*) FILTER (rn > lead) = 2 AND bool_and(CASE WHEN rn = lead + 1 THEN role = 'user' WHEN rn = lead + 2 THEN role = 'assistant' ELSE true END) AS single
    FROM u GROUP BY conv_id""")
def leading_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform("messages", lambda m: F.struct(F.coalesce(X.map_role(m["role"]), m["role"]).alias("from"), m["content"].alias("value")))
    rows = C.assembled(table(spark, sf_dir, "conversations")).select("conv_id", T.drop_leading_reply(turns).alias("t"))
    return rows.select("conv_id", F.size("t").cast("long").alias("turns"), T.is_single_turn("t").alias("single"))


@query("""SELECT doc_id, '<speech>' || chr(10) || 'कृपया उपयोगकर्ता के भाषण में प्रश्नों का सीधे उत्तर दें।' AS question, CASE WHEN doc_id % 3 = 0 THEN 'assistant' WHEN doc_id % 3 = 1 THEN 'text' ELSE '' END AS answer FROM documents""")
def speech_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    none = F.array().cast(C.TURN)
    made = C.speech_conversations(none, F.when(F.col("doc_id") % 3 == 0, F.lit(" assistant ")).otherwise(F.lit("")), F.when(F.col("doc_id") % 3 == 1, F.lit("text")))
    return d.select("doc_id", made.alias("c")).select("doc_id", F.col("c")[0]["value"].alias("question"), F.col("c")[1]["value"].alias("answer"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conv_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.assembled(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", A.text_length(F.transform("messages", lambda m: F.struct(m["content"].alias("value")))).cast("long").alias("chars"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand for ids: 1 is the start, prefix counts it and the question."""
    rows = kept(spark, sf_dir).select("conv_id", X.split_words(ask(0)).alias("q"), X.split_words(ask(1)).alias("a"))
    return rows.select("conv_id", F.concat(F.array(F.lit(1)), F.transform(F.concat("q", "a"), lambda w: F.length(w) + 1)).alias("ids"), (F.size("q") + 1).alias("prefix"))


WORDS = f"{KEPT}, w AS (SELECT conv_id, {S.split_words('question')} AS q, {S.split_words('answer')} AS a FROM pairs)"
IDS = "list_transform({}, lambda x: CAST(length(x) + 1 AS BIGINT))"


def shown(numbers: str) -> str:
    """SQL of a list of numbers as one text, so that all elements are compared."""
    return f"array_to_string(list_transform({numbers}, lambda y: CAST(y AS VARCHAR)), ',')"


def joined(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",")


@query(f"""WITH {WORDS} SELECT conv_id, CAST(1 + len(q) + len(a) AS BIGINT) AS tokens, CAST(len(a) AS BIGINT) AS loss_tokens, CAST(coalesce(list_sum(list_transform(a, lambda x: length(x) + 1)), 0) AS BIGINT) AS loss_sum,
    {shown("list_concat(list_transform(range(0, 1 + len(q)), lambda i: -100), " + "list_transform(a, lambda x: CAST(length(x) + 1 AS BIGINT)))")} AS labels, {shown("range(1 + len(q), 1 + len(q) + len(a))")} AS loss_places FROM w""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir).withColumn("labels", A.label_mask("ids", F.col("prefix")))
    kept_ids = F.filter("labels", lambda x: x != A.IGNORE_INDEX)
    return rows.select(
        "conv_id", F.size("ids").cast("long").alias("tokens"), F.size(A.loss_positions("labels")).cast("long").alias("loss_tokens"), F.aggregate(kept_ids, F.lit(0), lambda s, x: s + x).cast("long").alias("loss_sum"),
        joined(F.col("labels")).alias("labels"), joined(A.loss_positions("labels")).alias("loss_places"),
    )


@query(f"""WITH {WORDS} SELECT conv_id, repeat('F', least(12, 1 + len(q))::INT) || repeat('T', greatest(0, 12 - 1 - len(q))::INT) AS mask, CAST(least(12, 1 + len(q)) AS BIGINT) AS length FROM w""")
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = A.length_mask(F.least(F.col("prefix"), F.lit(12)), F.lit(12))
    rows = token_rows(spark, sf_dir).select("conv_id", mask.alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: F.when(x, F.lit("T")).otherwise(F.lit("F"))), "").alias("mask"), A.mask_length("m").cast("long").alias("length"))


@query(f"""WITH {WORDS}, p AS (SELECT conv_id, list_concat([1::BIGINT], {IDS.format('list_concat(q, a)')}) AS ids FROM w), z AS (SELECT conv_id, ids, list_transform(range(0, greatest(0, 40 - len(ids))), lambda i: 0) AS zeros FROM p)
    SELECT conv_id, {shown('list_concat(zeros, ids)')} AS at_left, {shown('list_concat(ids, zeros)')} AS at_right, {shown('list_concat(list_transform(ids, lambda i: 1), zeros)')} AS mask FROM z""")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = A.pad_left("ids", F.lit(40), F.lit(0)), A.pad_right("ids", F.lit(40), F.lit(0))
    rows = token_rows(spark, sf_dir).select("conv_id", left.alias("l"), right.alias("r"))
    mask = F.transform(A.not_pad("r", F.lit(0)), lambda x: x.cast("int"))
    return rows.select("conv_id", joined(F.col("l")).alias("at_left"), joined(F.col("r")).alias("at_right"), joined(mask).alias("mask"))


@query(f"""WITH {WORDS} SELECT conv_id, {shown("list_concat(list_concat([1::BIGINT], " + IDS.format('q') + "), list_concat(list_concat([-200::BIGINT], " + IDS.format('a') + "), [-200::BIGINT, 9]))")} AS ids FROM w""")
def speech_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.array(F.lit(1))
    words = lambda c: F.concat(start, F.transform(F.col(c), lambda w: F.length(w) + 1))
    rows = kept(spark, sf_dir).select("conv_id", X.split_words(ask(0)).alias("q"), X.split_words(ask(1)).alias("a"))
    ids = A.join_speech_chunks(F.array(words("q"), words("a"), F.array(F.lit(1), F.lit(9))), 1)
    return rows.select("conv_id", joined(ids).alias("ids"))


@query(f"""WITH {WORDS} SELECT conv_id, {shown("list_concat(list_transform(range(0, 7), lambda i: -100), " + IDS.format('list_concat(q, a)') + ")[1:30]")} AS labels FROM w""")
def spliced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir).withColumn("ids", F.concat(F.array(F.lit(A.SPEECH_INDEX)), F.slice("ids", F.lit(2), F.size("ids"))))
    out = A.splice_labels("ids", "ids", F.lit(7), 30)
    return rows.select("conv_id", joined(out).alias("labels"))


@query("""SELECT vec_id, CAST(12 AS BIGINT) AS rows, round(list_sum(list_transform(embedding[1:60], lambda x: CAST(x AS DOUBLE))), 6) AS total, round(CAST(embedding[56] AS DOUBLE), 6) AS last_first FROM embeddings""")
def frame_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.stack_frames("embedding", 5).alias("f"))
    total = F.aggregate(F.flatten("f"), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.size("f").cast("long").alias("rows"), F.round(total, 6).alias("total"), F.round(F.element_at("f", -1)[0].cast("double"), 6).alias("last_first"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), m AS (SELECT vec_id, x, list_sum(x) / 64 AS mean FROM e),
    v AS (SELECT *, sqrt(list_sum(list_transform(x, lambda y: (y - mean) * (y - mean))) / 64 + 1e-5) AS sd FROM m) SELECT vec_id, round((x[1] - mean) / sd, 6) AS first, round((x[64] - mean) / sd, 6) AS last FROM v""")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.layer_norm("embedding").alias("n"))
    return rows.select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.col("n")[63], 6).alias("last"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 1 THEN 2 ELSE 1 END AS n FROM conversations)""")
def speech_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn % 3 stands for the speech segments of a row: none, one or two."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("n"))
    return C.speech_cursor(rows, "conv_id", "turn", "n").select("conv_id", "turn", "cursor")


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder,
    contains(url, '/en/') AND starts_with(url, 'https') AS matches, CASE WHEN starts_with(url, '/') THEN url ELSE '/root/' || url END AS resolved FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", X.basename("url").alias("base"), X.dirname("url").alias("folder"), X.glob_match("url", "https*/en/*").alias("matches"), X.resolve_path("url", "/root").alias("resolved")
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '_checkpoint-' || doc_id ELSE source END AS model FROM documents""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/m/"), "source", F.lit("/checkpoint-"), "doc_id")).otherwise(F.concat(F.lit("m/"), "source", F.lit("/")))
    return table(spark, sf_dir, "documents").select("doc_id", X.model_name(path).alias("model"))


@query("""SELECT doc_id, instr(text, ' ') - 1 AS first_gap, CASE WHEN contains(text, ' ') THEN length(text) - instr(reverse(text), ' ') ELSE -1 END AS last_gap,
    CASE WHEN ends_with(text, '.') THEN length(text) - 1 ELSE length(text) END AS cut_chars, CAST(length(text) - length(replace(text, 'the', '')) AS BIGINT) AS removed FROM documents""")
def string_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.find("text", " ").cast("long").alias("first_gap"), X.rfind("text", " ").cast("long").alias("last_gap"),
        F.length(X.cut_suffix("text", ".")).cast("long").alias("cut_chars"), (F.length("text") - F.length(X.remove_all("text", "the"))).cast("long").alias("removed"),
    )


@query(f"""WITH x AS (SELECT source, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'conversations', count(*) FROM conversations) SELECT source, n FROM x""")
def corpus_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    mixed = C.mixture(documents=d.select("text", F.col("source").alias("origin")), conversations=c.select("text"))
    return mixed.groupBy(F.coalesce("origin", "source").alias("source")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audio(spark, sf_dir, True)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audio(spark, sf_dir, False)


def _audio(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/"), "doc_id", F.lit(".wav")).alias("speech"))
    files = table(spark, sf_dir, "labels").select(F.concat(F.lit("/data/audio/"), "doc_id", F.lit(".wav")).alias("path"))
    return C.existing_audio(d, files, keep).select("doc_id")


@query("SELECT vec_id, CAST(128 AS BIGINT) AS samples, CAST(100 AS BIGINT) AS frames, CAST(40 AS BIGINT) AS bands FROM embeddings")
def audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 kHz waveforms: decoded by precedence, resampled, and their log-mel frames."""
    none = F.lit(None).cast("binary")
    wave = W.decode_audio(F.transform("embedding", lambda x: x.cast("float")), none, none, F.lit(8000))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", wave.alias("w"))
    rows = rows.select("vec_id", "w", W.mel_features("w", 40, 1).alias("m"))
    return rows.select("vec_id", F.size("w").cast("long").alias("samples"), F.size("m").cast("long").alias("frames"), F.size(F.col("m")[0]).cast("long").alias("bands"))


@query(f"""WITH {WORDS} SELECT conv_id, CASE WHEN len(q) > 20 THEN -1 ELSE len(q) END AS dropped, CAST(least(20, len(q)) AS BIGINT) AS truncated, len(q) AS kept FROM w""")
def overlength_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir).select("conv_id", F.transform(X.split_words(ask(0)), lambda w: F.length(w)).alias("ids"))
    size = lambda policy: F.coalesce(F.size(K.overlength(F.size("ids"), 20, policy, F.col("ids"))), F.lit(-1)).cast("long")
    return rows.select("conv_id", *[size(p).alias(n) for p, n in (("drop", "dropped"), ("truncate", "truncated"), ("keep", "kept"))])


@query(f"""WITH {WORDS} SELECT conv_id, CAST(1 + len(q) + len(a) AS BIGINT) AS tokens, CAST(1 + len(q) AS BIGINT) AS ignored, CAST(len(list_filter(list_concat(q, a), lambda x: length(x) = 2)) AS BIGINT) AS pads FROM w""")
def row_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_rows(spark, sf_dir).select("conv_id", A.row_shape("ids", A.label_mask("ids", F.col("prefix")), 3).alias("s"))
    return rows.select("conv_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("tokens", "ignored", "pads")])
