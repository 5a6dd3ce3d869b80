"""Operator 4, language-model scoring by Katz backoff: trigrams to bigrams to unigrams.

P(w | u v) is the discounted count of u v w over the count of u v where that trigram occurs in training, else
the backoff weight of u v times P(w | v), which backs off to P(w) in the same way. Counts r <= K are
discounted by Good-Turing, larger ones give up ABOVE, so every context has mass to back off with; where
Good-Turing ratios are unusable (too few counts of counts) absolute discounting takes their place. What the
unigrams free goes to one unknown-word event. A backoff weight is the mass that its context frees over the
lower law's mass of the words not seen after it, so every context's law sums to 1 exactly.

How it runs at size. Texts become chunks of about CHUNK_TOKENS tokens, numbered by task and ordinal: the
distinct word hashes and the token stream as indices into them, compressed, in a table in the shared folder,
bucketed by chunk, a bucket for each BUCKET_BYTES of text. Count tables are partitioned by hash of the
n-gram: a chunk asks each partition for its slice of distinct n-grams, as one packed row, with its own
training counts; the partition adds the counts of all chunks and answers with totals, and names of each
n-gram one chunk as its owner. So a frequent n-gram costs one entry a chunk, and no key gathers rows; a chunk
sends only slices that hold something, so rows are bounded by the distinct n-grams of chunks. Rounds:

1. counts of unigrams and bigrams; 2. backoff weights of words: the owner of a bigram adds it to its
context's sums, partitioned by context; chunks get the weights that they back off with; 3. counts of
trigrams; 4. backoff weights of bigrams, from the law of round 2; 5. scores, token by token.

Only counts of counts reach the driver. Tables of a run are removed when its scores are stored.

Defined cases: null or blank text is the end token alone; a null doc_id counts as an empty id for the
held-out rule; repeated rows are scored each and counted each; with no training text at all every token
is unknown, of probability 1; a very long text makes a chunk of its own; empty tables give empty results;
columns other than doc_id and text are ignored, of clashing names the first counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .quality import remainder
from .textops import LOWER, mix, text_chunks, word_hashes, words

#: Tokens of a chunk: what a Python worker holds with all orders' n-grams, some 150 bytes a token.
CHUNK_TOKENS = 600_000
#: Tokens of the corpus for each partition of a count table.
PART_TOKENS = 2_000_000
#: Bytes of text for each bucket of the chunk table, and so for each task of a round.
BUCKET_BYTES = 32_000_000
#: Counts to K are discounted by Good-Turing, larger ones give up ABOVE.
K, ABOVE = 5, 0.05
ORDER = 3
#: Sums over the lower law travel as multiples of its inverse, 9e-13.
SHARE = float(1 << 40)
END, START, STARTS = np.uint64(0x5BD1E995_0000_0001), np.uint64(0x5BD1E995_0000_0002), np.uint64(0x5BD1E995_0000_0003)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def pack(x: np.ndarray) -> bytes:
    """Byte planes by zstd, after their length; planes of random bytes cost it next to nothing."""
    x = np.ascontiguousarray(x)
    if not len(x):
        return b""
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    raw = pa.Codec("zstd").decompress(pa.py_buffer(data)[8:], int.from_bytes(data[:8], "little"))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def pack_repeated(x: np.ndarray) -> bytes:
    """Floats of few distinct values: these, then each one's index."""
    distinct, index = np.unique(x, return_inverse=True)
    head = pack(distinct)
    return len(head).to_bytes(4, "little") + head + pack(index.astype("<u4"))


def unpack_repeated(data: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(data[:4], "little")
    return unpack(data[4:end], "<f8")[unpack(data[end:], "<u4")]


def pack_share(x: np.ndarray) -> bytes:
    """Sums of probabilities, in units of 1 / SHARE: five bytes of a float's eight say all that counts."""
    return pack(np.rint(x * SHARE).astype("<u8"))


def unpack_share(data: bytes) -> np.ndarray:
    return unpack(data, "<u8") / SHARE


def chunked(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row for each chunk: chunk, tokens, docs (ids, held, sizes), vocabulary and stream."""
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").withColumn("held", held_out)
    base.small_batches(docs.sparkSession)

    def close(number: int, ids: list, held: list, sizes: list, parts: list) -> pa.RecordBatch:
        stream = np.concatenate(parts)
        vocabulary, index = np.unique(stream, return_inverse=True)
        row = {
            "chunk": pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()),
            "tokens": pa.array([len(stream)], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([pack(np.array(held, np.uint8))], pa.binary()),
            "sizes": pa.array([pack(np.array(sizes, "<u4"))], pa.binary()),
            "vocabulary": pa.array([pack_sorted(vocabulary)], pa.binary()),
            "stream": pa.array([pack(index.astype("<u4"))], pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(row.values()), list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, parts, total, number = [], [], [], [], 0, 0
        for batch in batches:
            doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, data, offsets in text_chunks(batch.column(1)):
                data = LOWER[data]
                starts, stops, of = words(data, offsets)
                hashes = word_hashes(data, starts, stops)
                parts.append(np.insert(hashes, of[1:], END))
                own = np.diff(of) + 1
                n = len(own)
                ids += doc_ids[first : first + n]
                held += flags[first : first + n]
                sizes += own.tolist()
                total += int(own.sum())
                if total >= CHUNK_TOKENS:
                    yield close(number, ids, held, sizes, parts)
                    ids, held, sizes, parts, total, number = [], [], [], [], 0, number + 1
        if ids:
            yield close(number, ids, held, sizes, parts)

    schema = "chunk long, tokens long, ids array<long>, held binary, sizes binary, vocabulary binary, stream binary"
    return plain.mapInArrow(run, schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one held at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Grams:
    """The distinct n-grams of a chunk, by ascending key: their place of first occurrence, each token's n-gram,
    and of each its context and its suffix, as indices into the n-grams of one order less (contexts: one more,
    the last, for the start)."""

    def __init__(self, keys: np.ndarray, context: np.ndarray, suffix: np.ndarray):
        self.keys, of = np.unique(keys, return_inverse=True)
        self.of = of.astype(np.int32)
        at = np.empty(len(self.keys), np.int32)
        at[self.of[::-1]] = np.arange(len(keys) - 1, -1, -1, dtype=np.int32)  # the last write is the first place
        self.context, self.suffix = context[at], suffix[at]


class Chunk:
    """A chunk's arrays: vocabulary (sorted), token indices, and its distinct n-grams from order 2 on."""

    def __init__(self, row: dict, orders: tuple[int, ...] = ()):
        self.ids = row["ids"]
        self.held = unpack(row["held"], "u1").astype(bool)
        self.sizes = unpack(row["sizes"], "<u4").astype(np.int64)
        self.vocabulary = unpack_sorted(row["vocabulary"])
        self.token = unpack(row["stream"], "<u4").astype(np.int32)
        first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)
        names = np.append(self.vocabulary, START)
        before = self._shifted(self.token, first, len(self.vocabulary))
        two = mix(names[before] * _A + mix(names[self.token] * _B))
        self.names = {1: names}
        self.grams: dict[int, Grams] = {}
        if 2 in orders:
            self.grams[2] = Grams(two, before, self.token)
            self.names[2] = np.append(self.grams[2].keys, STARTS)
        if 3 in orders:
            three = mix(mix(names[self._shifted(before, first, len(self.vocabulary))] * _C) + two)
            pairs = self.grams[2].of if 2 in orders else self.token
            self.grams[3] = Grams(three, self._shifted(pairs, first, len(self.names[2]) - 1 if 2 in orders else 0), pairs)

    @staticmethod
    def _shifted(x: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        """For each token the value of the one before, ``start`` where a text begins."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = start
        return out


def _slices(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(partition, from, to) of the ranges that partitions hold of ascending keys; work follows the keys, not the partitions."""
    bits = parts.bit_length() - 1
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(keys)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(of[a]), a, b


def requests(chunks: DataFrame, parts: int, orders: tuple[int, ...]) -> DataFrame:
    """(kind, part, chunk, keys, counts): distinct n-grams (kind n) with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                c = Chunk(row, orders)
                for kind in orders:
                    keys, of = (c.vocabulary, c.token) if kind == 1 else (c.grams[kind].keys, c.grams[kind].of)
                    counts = np.bincount(of[c.training], minlength=len(keys)).astype("<u4")
                    out: list[list] = [[], [], []]
                    for part, a, b in _slices(keys, parts):
                        out[0].append(part), out[1].append(pack_sorted(keys[a:b])), out[2].append(pack(counts[a:b]))
                    n = len(out[0])
                    columns = [pa.array([kind] * n, pa.int32()), pa.array(out[0], pa.int32()), pa.array([row["chunk"]] * n, pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "chunk", "keys", "counts"])

    return chunks.mapInArrow(run, "kind int, part int, chunk long, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """Answers (kind, part, chunk, total, owner) in each request's key order, and with chunk null the counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        lists = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        distinct, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.int64)
        owner, trained = np.zeros(len(counts), np.uint8), np.flatnonzero(counts > 0)
        first = np.full(len(distinct), -1)
        first[inverse[trained[::-1]]] = trained[::-1]  # the last write is the first chunk
        owner[first[first >= 0]] = 1
        edges = np.cumsum([0, *map(len, lists)])
        of = total[inverse].astype("<u8")
        rows = [(pack(of[a:b]), pack(owner[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        stats = [*np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int((total > 0).sum()), int(total.sum())]
        n = len(rows)
        return pa.table(
            {
                "kind": pa.array(table.column("kind").to_pylist() + [table.column("kind")[0].as_py()], pa.int32()),
                "part": pa.array(table.column("part").to_pylist() + [table.column("part")[0].as_py()], pa.int32()),
                "chunk": pa.array(table.column("chunk").to_pylist() + [None], pa.int64()),
                "total": pa.array([r[0] for r in rows] + [None], pa.binary()),
                "owner": pa.array([r[1] for r in rows] + [None], pa.binary()),
                "stats": pa.array([None] * n + [stats], pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("kind", "part").applyInArrow(run, "kind int, part int, chunk long, total binary, owner binary, stats array<long>")


def discounts(n: list[int]) -> np.ndarray:
    """What counts 0 to K are multiplied with, from counts of counts n[0] (of 1) to n[K]."""
    out = np.zeros(K + 1)
    tail = (K + 1) * n[K] / n[0] if n[0] else 1.0
    good = n[0] > 0 and tail < 1
    for r in range(1, K + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if good and n[r - 1] else 0
        if not 0 < d < 1:
            good = False
        out[r] = d
    if not good:
        loss = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        r = np.arange(1, K + 1)
        out[1:] = (r - loss) / r
    return out


def discounted(count: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    return np.where(count > K, count - ABOVE, multipliers[np.minimum(count, K)] * count)


class Law:
    """The unigram law and the discounts: everything that is the same for all tokens.

    stats: for each order the counts of counts 1 to K + 1, the number of types and of tokens.
    """

    def __init__(self, stats: dict[int, list[int]], starts: int):
        self.types, self.tokens, self.starts = stats[1][K + 1], stats[1][K + 2], starts
        self.multipliers = {n: discounts(x[: K + 1]) for n, x in stats.items()}
        one, d = stats[1], self.multipliers[1]
        lost = sum((1 - d[r]) * r * one[r - 1] for r in range(1, K + 1)) + ABOVE * (self.types - sum(one[:K]))
        kept = 1.0 - lost / self.tokens if self.tokens else 0.0
        self.unknown = max(1 - kept, 1 / (self.tokens + self.types + 1))
        self.scale = (1 - self.unknown) / kept if kept else 1.0

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Probability of a token of that training count; 0 stands for the unknown word."""
        if not self.tokens:
            return np.ones(len(count))
        return np.where(count > 0, discounted(count, self.multipliers[1]) / self.tokens * self.scale, self.unknown)

    def weight(self, count: np.ndarray, seen: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Logarithm of the backoff weight, from a context's count and its sums of discounted counts and of the lower law."""
        return np.log10(1 - seen / count) - np.log10(np.maximum(1 - lower, 1e-15))


class Level:
    """A chunk's n-grams of one order under the law: totals, contexts' counts, and once weights are known log-probabilities."""

    def __init__(self, c: Chunk, order: int, answers: list[dict], counts: np.ndarray, lower: np.ndarray, law: Law):
        g = c.grams[order]
        self.grams, self.names = g, c.names[order - 1]
        self.total = _answers(answers, order, "total", "<u8").astype(np.int64)
        self.owner = _answers(answers, order, "owner", "u1") > 0
        self.counts = counts  # of contexts
        self.lower = lower[g.suffix]  # log-probabilities of the suffixes
        self.discounted = discounted(self.total, law.multipliers[order])
        backs = (self.total == 0) & (counts[g.context] > 0)
        self.asked = self._by_key(np.bincount(g.context[backs], minlength=len(counts)) > 0)

    def _by_key(self, mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return at[np.argsort(self.names[at], kind="stable")]

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts by key, discounted counts, lower law) summed over the n-grams that this chunk owns."""
        context, n = self.grams.context[self.owner], len(self.counts)
        at = self._by_key(np.bincount(context, minlength=n) > 0)
        seen = np.bincount(context, weights=self.discounted[self.owner], minlength=n)
        lower = np.bincount(context, weights=10 ** self.lower[self.owner], minlength=n)
        return at, seen[at], lower[at]

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Log-probabilities of the n-grams; weights: of the asked contexts."""
        backoff = np.zeros(len(self.counts))
        backoff[self.asked] = weights
        context = self.grams.context
        with np.errstate(divide="ignore"):
            known = np.log10(self.discounted) - np.log10(np.maximum(self.counts[context], 1))
        return np.where(self.total > 0, known, backoff[context] + self.lower)


def _answers(rows: list[dict], kind: int, field: str, dtype: str) -> np.ndarray:
    own = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([unpack(r[field], dtype) for r in own]) if own else np.zeros(0, dtype)


def _with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each chunk's row with its answers; only the answers move, chunks are bucketed."""
    out = chunks
    for k, frame in enumerate(answers):
        fields = [c for c in frame.columns if c not in ("chunk", "stats")]
        out = out.join(frame.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(f"answers{k}")), "chunk", "left")
    return out


def levels(row: dict, law: Law, order: int) -> tuple[Chunk, np.ndarray, Level, np.ndarray]:
    """(chunk, word counts, the level of that order, log-probabilities of the order below it); answers come as counts
    of orders 1 and 2, weights of words, counts of trigrams, weights of bigrams, as many as there are."""
    c = Chunk(row, tuple(range(2, order + 1)))
    words_ = _answers(row["answers0"], 1, "total", "<u8").astype(np.int64)
    with np.errstate(divide="ignore"):
        lower = np.log10(law.unigram(words_))
    level = Level(c, 2, row["answers0"], np.append(words_, law.starts), lower, law)
    if order == 3:
        lower = level.scores(_answers(row["answers1"] or [], 0, "weight", "<f8"))
        level = Level(c, 3, row["answers2"], np.append(level.total, law.starts), lower, law)
    return c, words_, level, lower


def context_sums(chunks: DataFrame, answers: list[DataFrame], law: Law, parts: int, order: int) -> DataFrame:
    """(part, chunk, asks, keys, x, y): contexts with the sums over n-grams that the chunk owns (x seen, y lower),
    and those whose weight it asks for (x their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                _, _, level, _ = levels(row, law, order)
                at, seen, lower = level.sums()
                out: list[list] = [[] for _ in range(5)]
                for asks, own, x, y in ((False, at, seen, lower), (True, level.asked, level.counts[level.asked].astype("<f8"), None)):
                    keys = level.names[own]
                    for part, a, b in _slices(keys, parts):
                        values = (part, asks, pack_sorted(keys[a:b]), pack_repeated(x[a:b]), None if y is None else pack_share(y[a:b]))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                types = [pa.int32(), pa.bool_(), *[pa.binary()] * 3]
                columns = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([row["chunk"]] * len(out[0]), pa.int64()), *columns[1:]], ["part", "chunk", "asks", "keys", "x", "y"])

    return _with_answers(chunks, *answers).mapInArrow(run, "part int, chunk long, asks boolean, keys binary, x binary, y binary")


def backoffs(sums: DataFrame, law: Law) -> DataFrame:
    """(kind, part, chunk, weight) of the contexts that a chunk asks for, in its order: logarithms to base 10."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        asks = np.array(table.column("asks").to_pylist(), bool)
        lists = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        x, y = table.column("x").to_pylist(), table.column("y").to_pylist()
        given, asked = np.flatnonzero(~asks).tolist(), np.flatnonzero(asks).tolist()
        if not asked:
            return table.select(["part", "chunk"]).slice(0, 0).add_column(0, "kind", pa.array([], pa.int32())).append_column("weight", pa.array([], pa.binary()))
        distinct, inverse = np.unique(np.concatenate([lists[k] for k in given]), return_inverse=True)
        total = lambda column, read: np.bincount(inverse, weights=np.concatenate([read(column[k]) for k in given]), minlength=len(distinct))
        seen, lower = total(x, unpack_repeated), total(y, unpack_share)
        out = []
        for k in asked:
            at = np.searchsorted(distinct, lists[k])
            out.append(pack(law.weight(unpack_repeated(x[k]), seen[at], lower[at])))
        rows = table.select(["part", "chunk"]).take(pa.array(asked, pa.int64()))
        return rows.add_column(0, "kind", pa.array([0] * len(out), pa.int32())).append_column("weight", pa.array(out, pa.binary()))

    return sums.groupBy("part").applyInArrow(run, "kind int, part int, chunk long, weight binary")


def scores(chunks: DataFrame, answers: list[DataFrame], law: Law) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                c, count, level, _ = levels(row, law, ORDER)
                of_gram = level.scores(_answers(row["answers3"] or [], 0, "weight", "<f8"))
                plain = np.log10((count + 1) / (law.tokens + law.types + 1))
                doc = np.repeat(np.arange(len(c.sizes)), c.sizes)
                n = len(c.sizes)
                columns = [
                    pa.array(c.ids, pa.int64()),
                    pa.array(c.held),
                    pa.array(c.sizes),
                    pa.array(np.bincount(doc, weights=count[c.token] > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, law.tokens, np.int64)),
                    pa.array(np.bincount(doc, weights=plain[c.token], minlength=n)),
                    pa.array(np.bincount(doc, weights=of_gram[level.grams.of], minlength=n)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _with_answers(chunks, *answers).mapInArrow(run, schema)


def katz_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    spark = docs.sparkSession
    table = f"katz_chunks_{uuid.uuid4().hex}"
    path = f"{base.shared_folder(spark)}/{table}"
    size = base.take(docs, "text").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    chunked(docs, held_out).write.option("path", path).bucketBy(width, "chunk").sortBy("chunk").saveAsTable(table)
    chunks = spark.table(table)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, tokens / PART_TOKENS)))))
    starts = base.take(docs, "doc_id").where(~held_out).count()
    answers: list[DataFrame] = []
    stats: dict[int, list[int]] = {n: [0] * (K + 3) for n in range(1, ORDER + 1)}

    for order, asked in ((2, (1, 2)), (3, (3,))):
        answers.append(base.stored(totals(requests(chunks, parts, asked))))
        base.sweep(spark)  # the exchange is over: its files go before the next one's come
        counted = answers[-1].where("chunk is null").select("kind", F.posexplode("stats").alias("at", "n")).groupBy("kind", "at").agg(F.sum("n").alias("n"))
        for row in counted.collect():
            stats[row.kind][row["at"]] = row.n
        law = Law(stats, starts)
        answers.append(base.stored(backoffs(context_sums(chunks, list(answers), law, parts, order), law)))
        base.sweep(spark)
    out = base.stored(scores(chunks, answers, law))
    spark.sql(f"DROP TABLE {table}")
    base.remove(spark, path)
    base.release(*answers)
    return out


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(base.documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)
