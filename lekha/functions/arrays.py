"""Token, mask and frame kernels over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Sentinels of token sequences.
IGNORE_INDEX, SPEECH_INDEX = -100, -200


def upto(n: Column) -> Column:
    """0 to n - 1; empty for n below 1 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def interleave(pieces: Column | str, mark: int) -> Column:
    """Arrays joined with one mark between each two."""
    return F.flatten(F.transform(col(pieces), lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(mark)), c)).otherwise(c)))


def join_speech_chunks(chunks: Column | str, bos: int | None, mark: int = SPEECH_INDEX) -> Column:
    """Token ids of the texts around speech tags as one sequence; the start id stays once, at the head."""
    x = col(chunks)
    if bos is None:
        return interleave(x, mark)
    starts = F.coalesce(F.try_element_at(F.try_element_at(x, F.lit(1)), F.lit(1)) == bos, F.lit(False))
    cut = F.transform(x, lambda c, i: F.when((i > 0) & starts, F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))).otherwise(c))
    return interleave(cut, mark)


def label_mask(ids: Column | str, prefix: Column, conversation: Column | None = None) -> Column:
    """Labels: ids after the prefix (start id and instruction), IGNORE_INDEX before it and past the conversation."""
    end = conversation if conversation is not None else F.size(col(ids))
    return F.transform(col(ids), lambda x, i: F.when((i < F.greatest(prefix, F.lit(1))) | (i > end), F.lit(IGNORE_INDEX)).otherwise(x))


def loss_positions(labels: Column | str) -> Column:
    return F.filter(F.transform(col(labels), lambda x, i: F.when(x != IGNORE_INDEX, i)), lambda i: i.isNotNull())


def answer_span(prompt_size: Column, full_size: Column) -> Column:
    """Positions whose next token belongs to the answer: prompt - 1 up to full - 1, end exclusive."""
    return F.struct((prompt_size - 1).alias("start"), (full_size - 1).alias("stop"))


def pad_right(x: Column | str, length: Column, fill: Column) -> Column:
    return F.concat(col(x), F.array_repeat(fill, F.greatest(length - F.size(col(x)), F.lit(0))))


def pad_left(x: Column | str, length: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(length - F.size(col(x)), F.lit(0))), col(x))


def not_pad(ids: Column | str, pad: Column) -> Column:
    """Attention mask by value: real ids that equal the pad id are masked too."""
    return F.transform(col(ids), lambda x: x != pad)


def length_mask(size: Column, longest: Column) -> Column:
    """True at padding places."""
    return F.transform(upto(longest), lambda i: i >= size)


def mask_length(mask: Column | str) -> Column:
    return F.size(F.filter(col(mask), lambda m: ~m))


def truncate(x: Column | str, most: int) -> Column:
    return F.slice(col(x), 1, most)


def stack_frames(frames: Column | str, k: int) -> Column:
    """k frames (scalars or arrays) in a row each; the rest at the end is dropped."""
    x = col(frames)
    return F.transform(upto(F.floor(F.size(x) / k).cast("int")), lambda i: F.slice(x, i * k + 1, F.lit(k)))


def splice_labels(ids: Column | str, labels: Column | str, frames: Column, most: int = 2048) -> Column:
    """Labels after speech features take the marks' places: IGNORE_INDEX over each span, cut at most."""
    pairs = F.arrays_zip(col(ids).alias("i"), col(labels).alias("l"))
    spread = F.transform(pairs, lambda p: F.when(p["i"] == SPEECH_INDEX, F.array_repeat(F.lit(IGNORE_INDEX), frames)).otherwise(F.array(p["l"])))
    return truncate(F.flatten(spread), most)


def positions(x: Column | str) -> Column:
    return upto(F.size(col(x)))


def masked_mean_nll(logprobs: Column | str, mask: Column | str) -> Column:
    """Minus the mean log-probability over the mask; an empty mask counts as one position."""
    pairs = F.arrays_zip(col(logprobs).alias("p"), col(mask).alias("m"))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.when(x["m"], x["p"].cast("double")).otherwise(F.lit(0.0)))
    return -total / F.greatest(F.size(F.filter(col(mask), lambda m: m)), F.lit(1))


def let(value: Column, body) -> Column:
    """body of the value, which is computed once: an expression inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def layer_norm(x: Column | str, eps: float = 1e-5) -> Column:
    x = col(x)
    n = F.size(x)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))
    mean = total(x, lambda v: v.cast("double")) / n
    moved = let(mean, lambda m: F.transform(x, lambda v: v.cast("double") - m))
    return let(moved, lambda y: let(F.sqrt(total(y, lambda v: v * v) / n + eps), lambda s: F.transform(y, lambda v: v / s)))


def int16_to_float(x: Column | str) -> Column:
    return F.transform(col(x), lambda v: v.cast("double") / 32768)


def text_length(conversations: Column | str) -> Column:
    """Code points in all turns' values."""
    return F.aggregate(col(conversations), F.lit(0), lambda a, t: a + F.length(F.coalesce(t["value"], F.lit(""))))


def row_shape(ids: Column | str, labels: Column | str, pad: int) -> Column:
    """Counts of a row: tokens, pads, ignored labels."""
    count = lambda x, value: F.size(F.filter(col(x), lambda y: y == value))
    return F.struct(F.size(col(ids)).alias("tokens"), count(ids, pad).alias("pads"), count(labels, IGNORE_INDEX).alias("ignored"))
