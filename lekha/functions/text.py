"""String functions as Catalyst expressions; only canonical decomposition needs an Arrow UDF."""

from __future__ import annotations

import fnmatch
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters that Unicode white space has and ``\s`` lacks even in Unicode mode.
SPACE = r"[\s\x1c-\x1f]"
#: Code points that comparable answers drop, and one that they unify.
NUKTA, CHANDRABINDU, ANUSVARA, ZWNJ, ZWJ = "़", "ँ", "ं", "‌", "‍"
#: Patterns of numbers.
NUMBER = r"-?\d+(?:\.\d+)?"
NUMBER_IN_TEXT = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
SPEECH_TAG = "<speech>"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(col(x), rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def python_text(x: Column | str, compat: str = "reject") -> Column:
    """Text of a nullable value: null stays null, or with compat "python" reads ``None``."""
    return F.coalesce(col(x), F.lit("None")) if compat == "python" else col(x)


def split_words(x: Column | str) -> Column:
    """White-space separated words; blank text has none."""
    return F.filter(F.split(col(x), rf"(?U){SPACE}+"), lambda t: t != "")


def after_last(x: Column | str, mark: str) -> Column:
    """What follows the last mark, the whole text without one."""
    return F.substring_index(col(x), mark, -1)


def remove_all(x: Column | str, tag: str) -> Column:
    return F.replace(col(x), F.lit(tag), F.lit(""))


def split_on(x: Column | str, tag: str) -> Column:
    """Pieces between tags; empty ones stay."""
    return F.split(col(x), rf"\Q{tag}\E", -1)


def find(x: Column | str, mark: str) -> Column:
    """0-based index of the first mark, -1 without one."""
    return F.instr(col(x), mark) - 1


def rfind(x: Column | str, mark: str) -> Column:
    """0-based index of the last mark (one character), -1 without one."""
    back = F.instr(F.reverse(col(x)), mark)
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(col(x)) - back)


def cut_suffix(x: Column | str, stop: Column | str) -> Column:
    """Without the stop string at the end; a null or empty stop cuts nothing."""
    x, stop = col(x), stop if isinstance(stop, Column) else F.lit(stop)
    has = F.coalesce(x.endswith(stop) & (F.length(stop) > 0), F.lit(False))
    return F.when(has, x.substr(F.lit(1), F.length(x) - F.length(stop))).otherwise(x)


@pandas_udf(StringType())
def nfkd(x: pd.Series) -> pd.Series:
    """Compatibility decomposition; there is no built-in for it."""
    return x.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def fold_answer(x: Column | str) -> Column:
    """An already lower-case, decomposed answer in comparable form: variants unified, punctuation and symbols to spaces."""
    kept = F.translate(col(x), CHANDRABINDU + NUKTA + ZWNJ + ZWJ, ANUSVARA)
    return F.array_join(split_words(F.regexp_replace(kept, r"[\p{P}\p{S}]", " ")), " ")


def normalize_answer(x: Column | str, decompose: bool = True) -> Column:
    """Comparable form of an answer. Without decomposition it stays in the JVM: for text known to be decomposed."""
    lowered = strip(F.lower(col(x)))
    return fold_answer(nfkd(lowered) if decompose else lowered)


#: Every decimal digit of other scripts, and what it stands for.
DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"}


def digits_to_ascii(x: Column | str) -> Column:
    return F.translate(col(x), "".join(DIGITS), "".join(DIGITS.values()))


def normalize_number(x: Column | str) -> Column:
    """The first number of a text in canonical form, null without one.

    Commas and dollar signs go first. Decimals lose trailing zeros and point, integers leading zeros; an
    integer -0 is 0 and a decimal one stays -0. Exact for up to 15 digits, which is the contract.
    """
    found = F.regexp_extract(digits_to_ascii(F.replace(F.replace(col(x), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))), NUMBER, 0)
    sign = F.when(found.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_replace(F.substring_index(F.regexp_replace(found, "^-", ""), ".", 1), r"^0+(?=\d)", "")
    part = F.regexp_replace(F.when(F.contains(found, F.lit(".")), F.substring_index(found, ".", -1)).otherwise(F.lit("")), "0+$", "")
    decimal = F.concat(sign, whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
    integer = F.when(whole == "0", F.lit("0")).otherwise(F.concat(sign, whole))
    return F.when(found != "", F.when(F.contains(found, F.lit(".")), decimal).otherwise(integer))


def gold_number(x: Column | str) -> Column:
    """The number after the last ``####``, else the first of the text."""
    return normalize_number(after_last(x, "####"))


def predicted_number(x: Column | str) -> Column:
    """The number after the last ``####``, else the last of the text."""
    x = col(x)
    last = F.try_element_at(F.regexp_extract_all(digits_to_ascii(x), F.lit(NUMBER_IN_TEXT), F.lit(0)), F.lit(-1))
    return F.when(F.contains(x, F.lit("####")), normalize_number(after_last(x, "####"))).otherwise(normalize_number(last))


def contains_match(prediction: Column, gold: Column) -> Column:
    """1.0 if one normalised answer contains the other; if either is empty, if both are."""
    empty = (prediction == "") | (gold == "")
    return F.when(empty, prediction == gold).otherwise(F.contains(prediction, gold) | F.contains(gold, prediction)).cast("double")


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays; only the distinct elements that both have are counted."""
    count = lambda side, t: F.size(F.filter(side, lambda y: y == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of two normalised answers' words as bags; if either is empty, 1.0 if both are."""
    a, b = split_words(prediction), split_words(gold)
    same = bag_overlap(a, b).cast("double")
    precision, recall = same / F.size(a), same / F.size(b)
    score = F.when(same == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(score)


def canonical_speech_tag(x: Column | str, multimodal: bool = True) -> Column:
    """A text with the tag anywhere gets it once, at its head, on a line of its own."""
    x = col(x)
    moved = strip(F.concat(F.lit(SPEECH_TAG + "\n"), strip(remove_all(x, SPEECH_TAG))))
    return F.when(F.contains(x, F.lit(SPEECH_TAG)), moved).otherwise(x) if multimodal else x


def map_role(x: Column | str) -> Column:
    """user and assistant to human and gpt, anything else to null."""
    return F.when(col(x) == "user", F.lit("human")).when(col(x) == "assistant", F.lit("gpt"))


def basename(x: Column | str) -> Column:
    return F.element_at(F.split(col(x), "/"), -1)


def dirname(x: Column | str) -> Column:
    return F.regexp_extract(col(x), r"^(.*)/[^/]*$", 1)


def resolve_path(path: Column | str, root: str, home: str = "~") -> Column:
    """Absolute paths stay, ``~`` becomes home, others are joined under root."""
    expanded = F.regexp_replace(col(path), r"^~(?=/|$)", home)
    return F.when(expanded.startswith("/"), expanded).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), expanded))


def model_name(path: Column | str) -> Column:
    """Last part of a path; for checkpoint folders their parent's name comes first."""
    parts = F.split(F.regexp_replace(col(path), r"^/+|/+$", ""), "/")
    last, above = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return F.when(last.startswith("checkpoint-") & above.isNotNull(), F.concat(above, F.lit("_"), last)).otherwise(last)


def glob_match(x: Column | str, *patterns: str) -> Column:
    """True where any shell pattern matches."""
    return reduce(lambda a, b: a | b, [col(x).rlike(f"^(?:{fnmatch.translate(p)})") for p in patterns], F.lit(False))


def first_turn(turns: Column | str) -> Column:
    return F.coalesce(strip(F.try_element_at(col(turns), F.lit(1))), F.lit(""))


#: Fixed texts of the task prompts.
GSM_HEAD = "निम्न गणित प्रश्न को चरण-दर-चरण हल करें। अंत में अंतिम उत्तर को इस प्रारूप में लिखें: #### <उत्तर>\n\nप्रश्न: "
GSM_TAIL = "\n\nसमाधान:"
QA_HEAD = "नीचे दिए गए संदर्भ के आधार पर प्रश्न का उत्तर हिंदी में दें। उत्तर संक्षिप्त और संदर्भ के अनुसार रखें।\n\nसंदर्भ: "
QA_MIDDLE, QA_TAIL = "\n\nप्रश्न: ", "\n\nउत्तर:"


def gsm_prompt(question: Column | str) -> Column:
    return F.concat(F.lit(GSM_HEAD), col(question), F.lit(GSM_TAIL))


def qa_prompt(context: Column | str, question: Column | str) -> Column:
    return F.concat(F.lit(QA_HEAD), col(context), F.lit(QA_MIDDLE), col(question), F.lit(QA_TAIL))


def units_to_ints(x: Column | str) -> Column:
    return F.transform(split_words(x), lambda t: t.cast("int"))


def ints_to_units(x: Column | str) -> Column:
    return F.array_join(F.transform(col(x), lambda t: t.cast("string")), " ")


def grouped(x: Column | str, digits: int = 0) -> Column:
    """Thousands separated by commas."""
    return F.format_number(col(x), digits)


def percent(x: Column | str, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", col(x).cast("double") * 100)


def padded(x: Column | str, width: Column | int) -> Column:
    return F.rpad(col(x), width, " ")


def query_url(base: str, params: dict[str, Column]) -> Column:
    """A URL with encoded parameters, in the order given."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string"))) for k, v in params.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))
