"""Operator 7, best-fit packing with swap-based local search.

Texts become token ids and an end id; longer ones are cut into full pieces, the rest comes first. Pieces
that fill a sequence stand alone. The others, each under a number of its own, are dealt by the hash of that
number into groups of about GROUP pieces, so equal rows spread like any; a group
is packed best fit first, longest piece first, and then improved by local search over its underfull
sequences: move a piece, exchange one for one, or two for one, always towards the fuller sequence, so that
the sum of squared fills grows until sequences empty. Sequences that are still not full are taken apart
and packed again in fewer groups, round by round, until one group holds what is left or a round leaves over
nine tenths of its pieces in underfull sequences. Every round works on bounded groups, so neither a task nor
the driver holds more than a few groups' lengths.

Defined cases: null or empty text is the end id alone; repeated rows are packed as often as they come; a
null doc_id is carried through; empty tables give empty results; columns other than doc_id and text are
ignored, of clashing names the first counts. A text that holds the special token's string gets the
tokenizer's own treatment of it.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs.
GROUP = 50_000
#: Underfull sequences among which the local search looks at a time; it goes over all of a group in such windows.
SEARCH = 256
#: A round after which more than this share of its pieces is left over is the last.
LEFT = 0.9
SPECIAL = "<|endoftext|>"

_LOADED: dict = {}


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks, which is read faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str):
    """A function from a text to its ids, the same as ``tokenizers`` gives, loaded once in each worker."""
    if (json_path, ranks_path) not in _LOADED:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        exact = Tokenizer.from_file(json_path)

        def encode(text: str) -> np.ndarray:
            ids = None
            if SPECIAL not in text:
                try:
                    ids = fast.encode_ordinary(text)
                except BaseException as error:  # its splitting overflows on a million spaces in a row
                    if type(error).__name__ != "PanicException":
                        raise
            return np.array(exact.encode(text, add_special_tokens=False).ids if ids is None else ids, "<u4")

        _LOADED[json_path, ranks_path] = encode
    return _LOADED[json_path, ranks_path]


def pieces(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    paths = paths or tokenizer_paths()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        out: list[list] = [[] for _ in range(6)]
        for k, doc in enumerate(batch.column(0).to_pylist()):
            ids = np.append(encode(batch.column(1)[k].as_py() or ""), np.uint32(END_ID)).astype("<u4")
            first = len(ids) % capacity or min(len(ids), capacity)
            for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                own = ids[start : first if not piece else start + capacity].tobytes()
                for column, value in zip(out, (doc, piece, start, len(own) // 4, zlib.crc32(own), own), strict=True):
                    column.append(value)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        n = 5 + with_ids
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types[:n], strict=True)], names[:n])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return base.arrow_map(base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices, longest first into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(k)
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


def _few(members: list[int], lengths: list[int]) -> list[int]:
    """At most two members of each length."""
    held: dict[int, list[int]] = {}
    for k in members:
        own = held.setdefault(lengths[k], [])
        if len(own) < 2:
            own.append(k)
    return [k for own in held.values() for k in own]


def _improve(a: list[int], b: list[int], room: int, lengths: list[int]) -> bool:
    """One exchange that moves tokens from a to b, the fuller one, within its room; the largest of its kind.

    Of equal lengths two are looked at, so a bin of very many small pieces has few to try.
    """
    whole_a, whole_b = a, b
    a, b = _few(a, lengths), _few(b, lengths)
    best = (0, (), ())
    for x in a:
        n = lengths[x]
        if best[0] < n <= room:
            best = (n, (x,), ())
    if not best[0]:
        for x in a:
            for y in b:
                n = lengths[x] - lengths[y]
                if best[0] < n <= room:
                    best = (n, (x,), (y,))
    if not best[0]:
        for i, x in enumerate(a):
            for x2 in a[:i]:
                for y in b:
                    n = lengths[x] + lengths[x2] - lengths[y]
                    if best[0] < n <= room:
                        best = (n, (x, x2), (y,))
    if not best[0]:
        for i, y in enumerate(b):
            for y2 in b[:i]:
                for x in a:
                    n = lengths[x] - lengths[y] - lengths[y2]
                    if best[0] < n <= room:
                        best = (n, (x,), (y, y2))
    if not best[0]:
        return False
    _, out, back = best
    for x in out:
        whole_a.remove(x)
    for y in back:
        whole_b.remove(y)
    whole_a.extend(back)
    whole_b.extend(out)
    return True


def _search(active: list[int], bins: list[list[int]], fill: list[int], lengths: list[int], capacity: int) -> None:
    """Exchanges between the active bins while any raises the sum of squared fills."""
    version = dict.fromkeys(active, 0)
    failed: dict[tuple[int, int], tuple[int, int]] = {}  # pairs that are as they were at their last vain attempt
    moved = True
    while moved and len(active) > 1:
        moved = False
        active.sort(key=lambda k: fill[k])
        for i in range(len(active)):
            a = active[i]
            for b in reversed(active[i + 1 :]):
                if not bins[a]:
                    break
                while bins[a] and fill[a] <= fill[b] < capacity and failed.get((a, b)) != (version[a], version[b]):
                    if not _improve(bins[a], bins[b], capacity - fill[b], lengths):
                        failed[a, b] = (version[a], version[b])
                        break
                    moved = True
                    version[a] += 1
                    version[b] += 1
                    total = fill[a] + fill[b]
                    fill[b] = sum(lengths[k] for k in bins[b])
                    fill[a] = total - fill[b]
        active = [k for k in active if 0 < fill[k] < capacity]


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY, search: int = SEARCH) -> list[list[int]]:
    """Exchanges between underfull bins, ``search`` at a time from the emptiest on, until a pass over all
    of them empties none; empty bins go."""
    fill = [sum(lengths[k] for k in b) for b in bins]
    emptied = True
    while emptied:
        waiting = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: fill[k])
        for at in range(0, len(waiting), search):
            _search(waiting[at : at + search], bins, fill, lengths, capacity)
        emptied = any(not fill[k] for k in waiting) and len(waiting) > search
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def place(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (cut, with a unique ``_row``) with ``sequence_id`` and ``offset`` instead of ``_row``."""
    names = found.columns
    schema = found.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long, fill long"

    def task(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        group = int(table.column("_group")[0].as_py())
        order, sequence, offset, fill = [], [], [], []
        for number, members in enumerate(pack_lengths(lengths, capacity)):
            at, total = 0, sum(lengths[k] for k in members)
            for k in members:
                order.append(k), sequence.append((group << 24) + number), offset.append(at), fill.append(total)
                at += lengths[k]
        out = table.drop_columns(["_group"]).take(pa.array(order, pa.int64()))
        for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    full = found.where(F.col("length") >= capacity).select("*", F.lit(0).cast("long").alias("_level"), F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest = [full], found.where(F.col("length") < capacity)
    left, level = rest.count(), 0
    while left:
        level, groups = level + 1, -(-left // GROUP)
        key = F.pmod(F.xxhash64(F.lit(level), "_row"), F.lit(groups)).alias("_group")
        packed = base.cut(rest.select("*", key).groupBy("_group").applyInArrow(task, schema))
        over = packed.where(F.col("fill") < capacity).count() if groups > 1 else 0
        last = groups == 1 or over > LEFT * left
        keep = packed if last else packed.where(F.col("fill") >= capacity)
        done.append(keep.select(*names, F.lit(level).cast("long").alias("_level"), "sequence_id", "offset"))
        if last:
            break
        rest, left = packed.where(F.col("fill") < capacity).select(*names), over
    out = done[0]
    for frame in done[1:]:
        out = out.union(frame)
    # a level's own numbers stay below 2**55: groups of at most 2**24 sequences, or partition and row of a piece
    return out.withColumn("sequence_id", F.shiftleft("_level", 55) + F.col("sequence_id")).drop("_level", "_row")


def pack(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """All pieces of docs with their places."""
    return place(base.numbered(pieces(docs, with_ids), "_row"))


def sequences(docs: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed token sequences themselves."""
    rows = pack(docs, with_ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate(F.col("p"), F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(base.documents(spark, sf_dir))
