"""Operator 1, n-gram Jaccard join over prefix trees.

Sets of distinct five-word shingles; two documents link at Jaccard similarity 0.75 or more. Exact:

1. Documents with equal sets form a class (128-bit digest); one representative of each goes on.
2. Order tokens by hash. A linking pair has its first ``c`` common tokens within the first
   ``n - ceil(t n) + c`` tokens of both (c is a tenth of n here), so only those are stored and grouped by
   token, and a document goes on only if at least c of them occur in another class. Most documents end here.
3. Of such a document's shared prefix tokens the commonest ``c - 1`` may be left out. The rest, the
   rare ones, connect candidates; components of that graph never separate a linking pair.
4. Each component is cut into blocks of bounded size, by size class and hash; each pair of blocks that
   sizes allow is one task. It stores the sets in a trie by a common order and walks it with all query
   sets of the block at once: overlaps of a shared path are counted once, and a subtree is left as soon
   as the tokens that remain cannot reach the overlap needed.
5. Tasks return counts of links and a spanning forest, never pairs, so a group of m near copies costs
   O(m) rows. Components of those edges are the classes of the result.

Defined cases: null or blank text has no shingles and links with nothing; fewer than five words make one
shingle, the whole sequence; a null doc_id is returned with its size but neither links nor has a
component; a doc_id that repeats is returned once per row, its rows share one node; empty tables give
empty results; columns other than doc_id and text are ignored, of clashing names the first counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .textops import shingle_sets

#: 100 * intersection >= PERCENT * union makes a link.
PERCENT = 75
SHINGLE = 5
#: Tokens of one block of sets; two blocks meet in one task.
BLOCK_TOKENS = 1_000_000
#: Sets of one block: a task's work grows with the product of its blocks' sets.
BLOCK_SETS = 2_000
#: Cells of the query matrix that a task holds at once.
MATRIX_CELLS = 1 << 25


def _digest(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def prefix_size(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(tokens of the prefix, common tokens that must lie in it)."""
    need = -(-percent * n // 100)
    c = max(1, min(n // 10, need))
    return n - need + c, c


def signatures(docs: DataFrame, doubtful: base.Bloom | None = None) -> DataFrame:
    """(doc_id, n, d1, d2) of each document; with a filter also (prefix, sure): the tokens of its prefix, and
    whether the filter rules out that the document is doubtful."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, d1, d2, lengths, parts = [], [], [], [0], []
        for _, own in shingle_sets(batch.column(1), SHINGLE):
            a, b = _digest(own)
            n.append(len(own)), d1.append(a), d2.append(b)
            if doubtful is not None:
                part = own[: prefix_size(len(own))[0]] if len(own) else own
                parts.append(part), lengths.append(lengths[-1] + len(part))
        out = [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())]
        names = ["doc_id", "n", "d1", "d2"]
        if doubtful is not None:
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            out.append(pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat.view(np.int64))))
            out.append(pa.array(~doubtful.might_hold(*batch.columns[2:])))
            names += ["prefix", "sure"]
        yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, n long, d1 long, d2 long" + (", prefix array<long>, sure boolean" if doubtful is not None else "")
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return base.arrow_map(plain if doubtful is None else plain.select("*", *doubtful.probes("doc_id")), run, schema)


def _only_shared(rows: DataFrame, least: bool) -> DataFrame:
    """Rows (token, rep) whose token has another rep, with its df and, if asked, its smallest rep.

    The counts are stored, so that the join reads both sides from exchanges of its own and a token with
    very many rows can be split.
    """
    smallest = [F.min("rep").alias("least")] if least else []
    counts = base.stored(rows.groupBy("token").agg(F.count("*").alias("df"), *smallest).where("df > 1"))
    return rows.join(counts, "token")


def candidates(docs: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (rep, n, d1, d2, copies) and candidate components (id, component) of representatives."""
    linking = signed.where("doc_id is not null and n > 0")
    classes = base.cut(linking.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")))
    # only copies, and ids that repeat, are held against the classes: all other documents represent their class
    copies = linking.join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc_id <> rep").select("doc_id")
    repeated = linking.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    doubtful = base.Bloom(base.cut(copies.union(repeated).distinct()), "doc_id")
    prefixes = base.stored(signatures(docs, doubtful).where("doc_id is not null and n > 0").select(F.col("doc_id").alias("rep"), "d1", "d2", "prefix", "sure"))
    tokens = lambda df: df.select("rep", F.explode("prefix").alias("token"))
    checked = prefixes.where("not sure").join(classes.select("rep", "d1", "d2"), ["rep", "d1", "d2"]).dropDuplicates(["rep", "d1", "d2"])
    rows = tokens(prefixes.where("sure")).union(tokens(checked))
    shared = base.cut(_only_shared(rows, False).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")))
    c = F.greatest(F.lit(1), F.least(F.expr("n div 10"), F.ceil(F.col("n") * PERCENT / 100)))
    rare = (
        shared.join(classes.select("rep", "n"), "rep")
        .withColumn("c", c.cast("int"))
        .where("size(shared) >= c")
        .select("rep", F.explode(F.expr("slice(shared, 1, size(shared) - c + 1)")).alias("x"))
        .select("rep", F.col("x.token").alias("token"))
    )
    edges = _only_shared(rare, True).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return classes.select("rep", "n", "d1", "d2", "copies"), base.components(edges)


def blocks(members: DataFrame) -> DataFrame:
    """Tasks (rep, task, side) of members (rep, n, component): side 0 meets side 1, side 2 meets itself.

    A component within BLOCK_TOKENS and BLOCK_SETS is one task. A larger one is split by size class (powers of 4/3:
    linking sets lie in one class or in neighbours) and hash into blocks; every block meets the blocks of
    its own class and of the next.
    """
    scale = int(np.log(PERCENT / 100) * -1e9) / 1e9
    sized = members.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / scale).cast("int"))
    weights = sized.groupBy("component", "class").agg(F.sum("n").alias("tokens"), F.count("*").alias("sets"))
    load = lambda f: F.greatest(f(F.col("tokens")) / BLOCK_TOKENS, f(F.col("sets")) / BLOCK_SETS)
    total = weights.groupBy("component").agg(load(F.sum).alias("all"))
    parts = weights.select("component", "class", F.ceil(load(lambda c: c)).cast("int").alias("parts"))

    def near(step: int) -> DataFrame:
        return parts.select("component", (F.col("class") - step).alias("class"), F.col("parts").alias({1: "above", -1: "below"}[step]))

    plan = parts.join(near(1), ["component", "class"], "left").join(near(-1), ["component", "class"], "left").join(total, "component")
    own = sized.join(plan, ["component", "class"]).withColumn("part", F.expr("cast(pmod(xxhash64(rep), parts) as int)"))
    span = lambda n: f"if(coalesce({n}, 0) > 0, sequence(0, {n} - 1), array())"
    name = "concat_ws(':', component, {})"
    tasks = f"""
        if(all <= 1, array(named_struct('task', cast(component as string), 'side', 2)),
        flatten(array(
            transform({span("parts")}, j -> named_struct('task', {name.format("class, least(part, j), class, greatest(part, j)")}, 'side', if(j = part, 2, if(j < part, 1, 0)))),
            transform({span("above")}, j -> named_struct('task', {name.format("class, part, class + 1, j")}, 'side', 0)),
            transform({span("below")}, j -> named_struct('task', {name.format("class - 1, j, class, part")}, 'side', 1)))))
    """
    return own.select("rep", F.explode(F.expr(tasks)).alias("t")).select("rep", "t.task", "t.side")


def trie_join(stored: list[np.ndarray], queries: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(stored index, query indices that link with it), from ascending distinct integer arrays below one bound.

    The stored sets, in lexicographic order, are the trie: a node is an interval that shares ``depth``
    tokens. All queries of a slice walk together.
    """
    if not stored or not queries:
        return
    bound = 1 + max(int(x[-1]) for x in (*stored, *queries))
    order = sorted(range(len(stored)), key=lambda k: stored[k].astype(">u4").tobytes())
    sets = [stored[k] for k in order]
    lens = np.array([len(x) for x in sets])
    shared = np.zeros(len(sets), np.int64)  # tokens in common with the next set
    for k in range(len(sets) - 1):
        n = min(lens[k], lens[k + 1])
        differs = np.flatnonzero(sets[k][:n] != sets[k + 1][:n])
        shared[k] = differs[0] if len(differs) else n
    step = max(1, MATRIX_CELLS // bound)
    for first in range(0, len(queries), step):
        part = queries[first : first + step]
        sizes = np.array([len(x) for x in part])
        has = np.zeros((len(part), bound), np.uint8)
        for k, x in enumerate(part):
            has[k, x] = 1
        flat = np.concatenate([x.astype(np.int64) + k * bound for k, x in enumerate(part)])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        stack = [(0, len(sets), 0, np.arange(len(part)), np.zeros(len(part), np.int64))]
        while stack:
            lo, hi, depth, live, overlap = stack.pop()
            inner = shared[lo : hi - 1]
            deep = int(min(lens[lo], inner.min())) if hi - lo > 1 else int(lens[lo])
            edge = sets[lo][depth:deep]
            if len(edge):
                overlap = overlap + has[live[:, None], edge[None, :]].sum(1, dtype=np.int64)
                used = np.searchsorted(flat, live * bound + int(edge[-1]), "right") - starts[live]
            else:
                used = np.zeros(len(live), np.int64)
            short, long = int(lens[lo:hi].min()), int(lens[lo:hi].max())
            most = overlap + np.minimum(sizes[live] - used, long - deep)
            # the similarity reachable with ``most`` common tokens, against the shortest set below
            keep = (100 + percent) * most >= percent * (sizes[live] + np.maximum(short, most))
            live, overlap = live[keep], overlap[keep]
            if not len(live):
                continue
            if lens[lo] == deep:
                ok = (100 + percent) * overlap >= percent * (sizes[live] + deep)
                if ok.any():
                    yield order[lo], first + live[ok]
                lo += 1
                if lo == hi:
                    continue
            ends = np.concatenate((lo + 1 + np.flatnonzero(shared[lo : hi - 1] == deep), [hi]))
            a = lo
            for b in ends.tolist():
                stack.append((a, b, deep, live, overlap))
                a = b


def join_task(reps: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each set of one task."""
    links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    if len(reps) < 2:
        return links, reps
    tokens, local, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.uint32)  # the trie's order: common tokens first, so that paths are shared
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens), dtype=np.uint32)
    ids = [np.sort(x) for x in np.split(rank[local], np.cumsum([len(x) for x in sets])[:-1])]
    within = sides[0] == 2
    left = np.arange(len(reps)) if within else np.flatnonzero(sides == 0)
    right = left if within else np.flatnonzero(sides == 1)
    for s, found in trie_join([ids[k] for k in left], [ids[k] for k in right]):
        x, others = left[s], right[found]
        others = others[others != x]
        if not len(others):
            continue
        links[x] += copies[others].sum()
        if not within:
            links[others] += copies[x]
        labels = np.unique(root[others])
        if len(labels) > 1 or labels[0] != root[x]:
            labels = np.append(labels, root[x])
            root[np.isin(root, labels)] = labels.min()
    order = np.argsort(reps, kind="stable")
    least = np.full(len(reps), np.iinfo(np.int64).max)
    np.minimum.at(least, root[order], reps[order])
    return links, least[root]


def linked(docs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(rep, links, root) of every task's sets that link: partial counts and spanning edges."""
    members = base.cut(groups.select(F.col("id").alias("rep"), "component").join(classes, "rep"))
    reps = base.Bloom(members, "rep")
    tasks = blocks(members)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"d1": [], "d2": [], "own": []}
        for _, own in shingle_sets(batch.column(1), SHINGLE):
            if len(own):
                a, b = _digest(own)
                out["d1"].append(a), out["d2"].append(b), out["own"].append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["d1"], pa.int64()), pa.array(out["d2"], pa.int64()), pa.array(out["own"], pa.binary())], ["d1", "d2", "own"])

    # only a representative's row passes the filter, save for a few by chance that the join removes
    def gate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = reps.might_hold(batch.column(2), batch.column(3))
        if keep.any():
            yield from run(batch.filter(pa.array(keep)))

    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    sets = base.arrow_map(plain.select("doc_id", "text", *reps.probes("doc_id")), gate, "d1 long, d2 long, own binary")
    sets = sets.join(members.select("rep", "d1", "d2", "copies"), ["d1", "d2"]).groupBy("rep", "d1", "d2").agg(F.first("copies").alias("copies"), F.first("own").alias("own"))

    def task(table: pa.Table) -> pa.Table:
        reps, copies, sides = (table.column(c).to_numpy() for c in ("rep", "copies", "side"))
        links, root = join_task(reps, copies, sides, [np.frombuffer(x, np.uint64) for x in table.column("own").to_pylist()])
        keep = links > 0
        return pa.table({"rep": reps[keep], "links": links[keep], "root": root[keep]})

    return tasks.join(sets, "rep").groupBy("task").applyInArrow(task, "rep long, links long, root long")


def ngram_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row of docs."""
    signed = base.cut(signatures(docs))
    classes, groups = candidates(docs, signed)
    found = base.cut(linked(docs, classes, groups))
    joined = base.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = (
        classes.join(links, "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
        .select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    rows = signed.join(named, ["d1", "d2"], "left")
    alone = F.expr("doc_id is null or n = 0")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links")).cast("long").alias("n_links"),
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(base.documents(spark, sf_dir))
