"""Operator 8, substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words. A word goes if a window that covers it also starts in a document
with a smaller doc_id; windows are judged on the input.

1. Texts that are equal form a class; only the one of smallest id goes on, its copies lose all words.
2. Winnowing: of every WINDOW - GRAM + 1 consecutive word 10-grams the one of least hash is an anchor, so
   two documents that share a window share its anchor. About one position in 20 is one; anchors that only
   one class has end here.
3. Confirmation: windows whose anchor is shared are hashed whole (64 bits over word hashes) and grouped,
   counts combined before the shuffle. A window recurs if its smallest owner precedes a document. In the
   owner, recurring windows that occur everywhere one after the other are one phrase: whoever holds its first
   window holds all of it.
4. Automata: phrases are dealt to shards by their owner, about SHARD_WORDS words each, and cut from the
   owners' texts. A document goes, whole, to the shards of the phrases whose first window it holds; no place
   goes with it. There a pyahocorasick automaton over word ids locates every occurrence; those in documents
   after a phrase's owner are covered. Where many documents come to a shard, they are dealt to pieces of
   about PIECE_WORDS words, each with the shard's phrases.

Words are compared in the automata; hashes decide which texts and shards meet (128 bits for equal texts).

Defined cases: null or blank text has no words; texts below WINDOW words lose nothing; repeats inside one
document, or between rows of one doc_id, remove nothing; a row with a null doc_id neither loses words nor
makes others lose them; repeated rows are all returned; empty tables give empty results; columns other
than doc_id and text are ignored, of clashing names the first counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base
from .decontaminate import bounded
from .textops import text_chunks, windows, word_hashes, words

WINDOW = 50
GRAM = 10
SHARD_WORDS = 200_000
#: Words of the documents that one task streams through a shard's automaton.
PIECE_WORDS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """The pick (minimum or maximum) of each run of ``size`` values."""
    width = 1
    while width * 2 <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor hash of each window, mask of grams that are some window's anchor)."""
    least = _slide(grams, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    return least, _slide(np.concatenate([edge, least, edge]), span, np.maximum) == grams


def _documents(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of texts of at least WINDOW words."""
    for first, data, offsets in text_chunks(texts):
        starts, stops, of = words(data, offsets)
        hashes = word_hashes(data, starts, stops)
        for k in np.flatnonzero(np.diff(of) >= WINDOW):
            yield first + int(k), hashes[of[k] : of[k + 1]]


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text.alias("text"))
    return plain.select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, shared): representatives that share anchors with another class, and those anchors."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, flat, lengths = [], [np.zeros(0, np.uint64)], [0]
        for k, own in _documents(batch.column(3)):
            grams = windows(own, GRAM)
            found = np.unique(grams[anchors(grams, WINDOW - GRAM + 1)[1]])
            at.append(k), flat.append(found), lengths.append(lengths[-1] + len(found))
        part = batch.take(pa.array(at, pa.int64()))
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["doc_id", "d1", "d2", "anchors"])

    found = base.arrow_map(keyed(docs).where("doc_id is not null"), run, "doc_id long, d1 long, d2 long, anchors array<long>")
    classes = base.stored(found.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.first("anchors").alias("anchors")))
    rows = classes.select("doc_id", "d1", F.explode("anchors").alias("anchor"))
    common = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")
    return rows.join(common, "anchor").groupBy("doc_id", "d1").agg(F.collect_list("anchor").alias("shared"))


def gated(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, d1, text, columns of wanted) of the texts of wanted (stored, by doc_id and d1); only texts that may be there move."""
    some = base.Bloom(wanted, "doc_id")

    def gate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(batch.columns[:3], ["doc_id", "d1", "text"]).filter(pa.array(some.might_hold(*batch.columns[3:])))

    plain = keyed(docs).where("doc_id is not null").select("doc_id", "d1", "text", *some.probes("doc_id"))
    return base.arrow_map(plain, gate, "doc_id long, d1 long, text string").join(wanted.hint("shuffle_hash"), ["doc_id", "d1"])


def anchored_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, n, window, prev, next, start): windows that hold a shared anchor, with the windows beside them (0: none) and
    the document's number of words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(3)
        for k, own in _documents(batch.column(2)):
            least, _ = anchors(windows(own, GRAM), WINDOW - GRAM + 1)
            known = np.sort(lists[k].values.to_numpy().view(np.uint64))
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)
            if len(at):
                whole = np.concatenate(([0], windows(own, WINDOW).view(np.int64), [0]))
                ids = [np.full(len(at), x, np.int64) for x in (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), len(own))]
                columns = [*ids, whole[at + 1], whole[at], whole[at + 2], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "d1", "n", "window", "prev", "next", "start"])

    joined = gated(docs, base.stored(shared_anchors(docs)))
    return base.arrow_map(joined, run, "doc_id long, d1 long, n long, window long, prev long, next long, start int")


def phrases(rows: DataFrame) -> DataFrame:
    """(doc_id, d1, a, b, key): word intervals of the recurring phrases in their owners, and the hash of their first window."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("prev", "next") for f in (F.min, F.max)]
    found = rows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), *ends).where("owner < last")
    found = base.stored(found.drop("last"))  # a join of two exchanges: a window with very many rows can be split
    own = rows.select("doc_id", "d1", "window", "start").join(found, "window").where("doc_id = owner")
    order = Window.partitionBy("doc_id", "d1").orderBy("start")
    before = lambda c: F.lag(c).over(order)
    follows = (before("start") + 1 == F.col("start")) & (before("min_next") == F.col("window")) & (before("max_next") == F.col("window"))
    linked = follows & (F.col("min_prev") == before("window")) & (F.col("max_prev") == before("window"))
    runs = own.withColumn("head", F.when(linked, 0).otherwise(1)).withColumn("run", F.sum("head").over(order))
    found = runs.groupBy("doc_id", "d1", "run").agg(F.min("start").alias("a"), (F.max("start") + WINDOW).alias("b"), F.min_by("window", "start").alias("key"))
    return found.groupBy("doc_id", "d1", "key").agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b"))  # a phrase that repeats in its owner once


def routed(rows: DataFrame) -> DataFrame:
    """(doc_id, d1, todo): for each document the (shard, piece) that it streams through (a null), and of an owner the
    phrases (a, b) that it gives to a shard of that many pieces."""
    found = base.stored(phrases(rows))
    total = found.agg(F.sum(F.col("b") - F.col("a"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "d1"), F.lit(max(1, -(-total // SHARD_WORDS)))).alias("shard")
    heads = base.stored(found.select(F.col("key").alias("window"), F.col("doc_id").alias("owner"), shard).distinct())
    routes = rows.select("doc_id", "d1", "n", "window").join(bounded(heads), "window").where("doc_id > owner")
    routes = base.stored(routes.groupBy("doc_id", "d1", "shard").agg(F.max("n").alias("n")))
    load = base.stored(routes.groupBy("shard").agg(F.ceil(F.sum("n") / PIECE_WORDS).cast("long").alias("pieces")))
    piece = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).alias("piece")
    none = [F.lit(None).cast("int").alias(c) for c in ("a", "b")]
    to = routes.join(bounded(load), "shard").select("doc_id", "d1", "shard", piece, *none)
    give = found.select("doc_id", "d1", shard, "a", "b").join(bounded(load), "shard").select("doc_id", "d1", "shard", F.col("pieces").alias("piece"), "a", "b")
    return to.union(give).groupBy("doc_id", "d1").agg(F.collect_list(F.struct("shard", "piece", "a", "b")).alias("todo"))


def automaton(found: list[tuple[list[str], int]]):
    """(the automaton of phrases, the ids of their words) from phrases and owners; of equal phrases the smallest owner counts."""
    import ahocorasick

    ids: dict[str, int] = {}
    owners: dict[tuple, int] = {}
    for words_, owner in found:
        code = tuple(ids.setdefault(w, len(ids) + 1) for w in words_)
        owners[code] = min(owner, owners.get(code, owner))
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for code, owner in owners.items():
        machine.add_word(code, (len(code), owner))
    machine.make_automaton()
    return machine, ids


def occurrences(machine, ids: dict[str, int], doc: int, own: list[str]) -> list[int]:
    """Starts and stops, in turn, of the words that phrases of smaller owners cover."""
    marks = np.zeros(len(own) + 1, np.int64)
    for end, (size, owner) in machine.iter(tuple(ids.get(w, 0) for w in own)):
        if owner < doc:
            marks[end - size + 1] += 1
            marks[end + 1] -= 1
    covered = np.cumsum(marks[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8))).tolist()


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, runs): starts and stops of the words that go, in turn, as the automata find them."""
    plan = base.stored(routed(base.stored(anchored_windows(docs))))

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(6)]
        for doc, d1, text, todo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = _WORD.findall(text) if any(t["a"] is not None for t in todo) else []
            for t in todo:
                phrase = t["a"] is not None
                what = " ".join(own[t["a"] : t["b"]]) if phrase else text
                for piece in range(t["piece"]) if phrase else [t["piece"]]:
                    for column, value in zip(out, (t["shard"], piece, doc, d1, phrase, what), strict=True):
                        column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["shard", "piece", "doc_id", "d1", "phrase", "text"])

    def stream(table: pa.Table) -> pa.Table:
        given = table.filter(table.column("phrase"))
        machine, ids = automaton([(p.split(" "), d) for p, d in zip(given.column("text").to_pylist(), given.column("doc_id").to_pylist(), strict=True)])
        rest = table.filter(pc.invert(table.column("phrase")))
        out: list[tuple] = []
        for k in range(rest.num_rows):
            doc, d1, text = (rest.column(c)[k].as_py() for c in ("doc_id", "d1", "text"))
            runs = occurrences(machine, ids, doc, _WORD.findall(text)) if len(given) else []
            out.append((doc, d1, runs))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "d1", "runs"), columns, (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)})

    sent = base.arrow_map(gated(docs, plan), send, "shard long, piece long, doc_id long, d1 long, phrase boolean, text string")
    found = sent.groupBy("shard", "piece").applyInArrow(stream, "doc_id long, d1 long, runs array<int>")
    return found.where("size(runs) > 0").groupBy("doc_id", "d1").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of every row; text: the kept words."""
    keys = keyed(docs)
    ids = keys.select("doc_id", "d1", "d2").where("doc_id is not null")
    first = base.stored(ids.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    copies = ids.join(first, ["d1", "d2"]).where("doc_id > first").select("doc_id", "d1", F.lit(None).cast("array<int>").alias("runs"), F.lit(True).alias("copy")).distinct()
    edits = located(docs).withColumn("copy", F.lit(False)).unionByName(copies)
    edits = base.stored(edits.groupBy("doc_id", "d1").agg(F.max("copy").alias("copy"), F.max("runs").alias("runs")))
    some = base.Bloom(edits, "doc_id")
    names = ["doc_id", "d1", "text", "n_words", "n_removed", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def row(own: list[str], kept: list[str]) -> tuple[int, int, str, str]:
        text = " ".join(kept)
        return len(own), len(own) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text

    def untouched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole results of texts that lose nothing; the others go on with their text, and only they are heavy to move."""
        waits = some.might_hold(*batch.columns[3:])
        out: list[list] = [[] for _ in range(3)]
        texts = []
        for text, wait in zip(batch.column(2).to_pylist(), waits.tolist(), strict=True):
            own = [] if wait else _WORD.findall(text)
            n, removed, digest, kept = row(own, own)
            texts.append(text if wait else kept if with_text else None)
            for column, value in zip(out, (None,) * 3 if wait else (n, removed, digest), strict=True):
                column.append(value)
        columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(c, t) for c, t in zip(out, types[3:], strict=True)], names)

    first_pass = base.arrow_map(keys.select("doc_id", "d1", "text", *some.probes("doc_id")), untouched, "doc_id long, d1 long, text string, n_words long, n_removed long, kept_sha256 string")
    joined = first_pass.join(edits.hint("shuffle_hash"), ["doc_id", "d1"], "left").select(*names, "copy", "runs")

    def edited(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        done = batch.filter(batch.column(5).is_valid())
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(0), *done.columns[3:6], done.column(2)][: 4 + with_text], out_names)
        batch = batch.filter(batch.column(5).is_null())
        if not batch.num_rows:
            return
        rows = []
        for text, copy, runs in zip(*(batch.column(k).to_pylist() for k in (2, 6, 7)), strict=True):
            own = _WORD.findall(text)
            kept = own
            if copy and len(own) >= WINDOW:
                kept = []
            elif runs:
                gone = np.zeros(len(own), bool)
                for a, b in zip(runs[::2], runs[1::2], strict=True):
                    gone[a:b] = True
                kept = [w for w, g in zip(own, gone.tolist(), strict=True) if not g]
            rows.append(row(own, kept))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types[3:], pa.string()], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns][: 4 + with_text], out_names)

    out_names = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text]
    return base.arrow_map(joined, edited, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(base.documents(spark, sf_dir))
