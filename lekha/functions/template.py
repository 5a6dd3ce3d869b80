"""Prompt templates: four separator styles over arrays of (role, message)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SPEECH_TAG, col, strip

#: Fixed values of the templates: system texts and marks.
V1_SYSTEM = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
HINDI_SYSTEM = "आप एक सहायक भाषा और वाणी सहायक हैं। उपयोगकर्ता की बात समझकर प्राकृतिक भाषा में सहायता करें।"
BEGIN, END_OF_TURN = "<|begin_of_text|>", "<|eot_id|>"
HEADER_OPEN, HEADER_CLOSE = "<|start_header_id|>", "<|end_header_id|>\n\n"


@dataclass(frozen=True)
class Template:
    name: str
    style: str
    system: str
    roles: tuple[str, str]
    sep: str
    sep2: str | None


#: The registry.
TEMPLATES = {
    "v1": Template("v1", "TWO", V1_SYSTEM, ("USER", "ASSISTANT"), " ", "</s>"),
    "plain": Template("plain", "PLAIN", "", ("", ""), "</s>", None),
    "llama_2": Template("llama_2", "LLAMA_2", HINDI_SYSTEM, ("USER", "ASSISTANT"), "<s>", "</s>"),
    "llama_3": Template("llama_3", "LLAMA_3", HINDI_SYSTEM, ("user", "assistant"), "", END_OF_TURN),
}
DEFAULT = "llama_3"


def registry(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.style, t.system, list(t.roles), t.sep, t.sep2) for t in TEMPLATES.values()]
    return spark.createDataFrame(rows, "name string, style string, system string, roles array<string>, sep string, sep2 string")


def header(role: Column) -> Column:
    return F.concat(F.lit(HEADER_OPEN), role, F.lit(HEADER_CLOSE))


def _filled(message: Column) -> Column:
    return F.coalesce(message, F.lit("")) != ""


def _llama_3(t: Template, turns: Column) -> Column:
    system = HEADER_OPEN + "system" + HEADER_CLOSE + t.system + END_OF_TURN if t.system else ""
    turn = lambda m: F.concat(header(m["role"]), F.when(_filled(m["message"]), F.concat(strip(m["message"]), F.lit(t.sep2))).otherwise(F.lit("")))
    return F.concat(F.lit(BEGIN + system), F.array_join(F.transform(turns, turn), ""))


def _two(t: Template, turns: Column) -> Column:
    def turn(m: Column, i: Column) -> Column:
        full = F.concat(m["role"], F.lit(": "), m["message"], F.when(i % 2 == 0, F.lit(t.sep)).otherwise(F.lit(t.sep2)))
        return F.when(_filled(m["message"]), full).otherwise(F.concat(m["role"], F.lit(":")))

    return F.concat(F.lit(t.system + t.sep), F.array_join(F.transform(turns, turn), ""))


def _llama_2(t: Template, turns: Column) -> Column:
    """The first message must be the user's and not empty; the leading mark goes as a set of characters."""
    system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""

    def turn(m: Column, i: Column) -> Column:
        asked = F.concat(F.lit(t.sep + "[INST] "), F.when(i == 0, F.lit(system)).otherwise(F.lit("")), m["message"], F.lit(" [/INST]"))
        said = F.concat(F.lit(" "), m["message"], F.lit(" " + t.sep2))
        return F.when(~_filled(m["message"]), F.lit("")).when(i % 2 == 0, asked).otherwise(said)

    first = F.try_element_at(turns, F.lit(1))
    text = F.regexp_replace(F.array_join(F.transform(turns, turn), ""), f"^[{t.sep}]+", "")
    bad = (F.size(turns) > 0) & (~_filled(first["message"]) | (first["role"] != t.roles[0]))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("the first message must be the user's and not empty"))).otherwise(text)


def _plain(t: Template, turns: Column) -> Column:
    """Messages and marks alone; without a second mark a filled odd turn is an error."""
    odd = F.lit(t.sep2) if t.sep2 is not None else F.raise_error(F.lit("the plain template has no mark for odd turns")).cast("string")
    turn = lambda m, i: F.when(~_filled(m["message"]), F.lit("")).otherwise(F.concat(m["message"], F.when(i % 2 == 0, F.lit(t.sep)).otherwise(odd)))
    return F.concat(F.lit(t.system), F.array_join(F.transform(turns, turn), ""))


STYLES = {"LLAMA_3": _llama_3, "TWO": _two, "LLAMA_2": _llama_2, "PLAIN": _plain}


def render(turns: Column | str, template: str | Template = DEFAULT, system: str | None = None) -> Column:
    """The prompt of an array of structs (role, message), roles as the template names them."""
    t = TEMPLATES[template] if isinstance(template, str) else template
    t = t if system is None else Template(t.name, t.style, system, t.roles, t.sep, t.sep2)
    return STYLES[t.style](t, col(turns))


def with_roles(conversations: Column | str, template: str = DEFAULT) -> Column:
    """Turns (from, value) as (role, message): human and gpt under the template's names."""
    human, gpt = TEMPLATES[template].roles
    role = lambda m: F.when(m["from"] == "human", F.lit(human)).when(m["from"] == "gpt", F.lit(gpt))
    return F.transform(col(conversations), lambda m: F.struct(role(m).alias("role"), m["value"].alias("message")))


def generation_prompt(message: Column | str, template: str = DEFAULT, speech: bool = False) -> Column:
    """A user turn and the open header of the answer; for speech input the tag heads the message if absent."""
    user, assistant = TEMPLATES[template].roles
    text = col(message)
    if speech:
        text = F.when(F.contains(text, F.lit(SPEECH_TAG)), text).otherwise(F.concat(F.lit(SPEECH_TAG + "\n"), text))
    turns = F.array(F.struct(F.lit(user).alias("role"), text.alias("message")), F.struct(F.lit(assistant).alias("role"), F.lit(None).cast("string").alias("message")))
    return render(turns, template)


def instruction_part(prompt: Column | str, template: str = DEFAULT) -> Column:
    """The prompt up to and with the first assistant header."""
    head = HEADER_OPEN + TEMPLATES[template].roles[1] + HEADER_CLOSE
    return F.concat(F.substring_index(col(prompt), head, 1), F.lit(head))


def drop_leading_reply(conversations: Column | str) -> Column:
    """Without one leading turn that isn't the human's."""
    x = col(conversations)
    return F.when(F.try_element_at(x, F.lit(1))["from"] != "human", F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))).otherwise(x)


def is_single_turn(conversations: Column | str) -> Column:
    x = col(conversations)
    return (F.size(x) == 2) & (F.try_element_at(x, F.lit(1))["from"] == "human") & (F.try_element_at(x, F.lit(2))["from"] == "gpt")


def require_single_turn(conversations: Column | str) -> Column:
    """The turns if they are one question and one answer, else an error."""
    ok = F.coalesce(is_single_turn(conversations), F.lit(False))
    return F.when(ok, col(conversations)).otherwise(F.raise_error(F.lit("one human turn and one gpt turn expected")))


def chat_pairs(messages: Column | str, offset: int = 0) -> Column:
    """Even messages open a pair [user, null], odd ones fill its second place."""
    rest = F.slice(col(messages), F.lit(offset + 1), F.greatest(F.size(col(messages)), F.lit(1)))
    places = F.when(F.size(rest) > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size(rest) - 1, F.lit(0))), lambda i: i % 2 == 0)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array(F.get(rest, i), F.get(rest, i + 1)))


def message_text(message: Column | str) -> Column:
    """The text of a message that comes as a struct of text and media."""
    return col(message)["text"]


def known_model(name: Column | str, models: list[str]) -> Column:
    return F.coalesce(col(name).isin(models), F.lit(False))
