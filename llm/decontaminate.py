"""Operator 2, benchmark decontamination by SimHash windows, a multi-index and exact verification.

For each benchmark item, windows of a document that are as long as the item are compared with it by the
weighted Jaccard similarity of their five-word shingles (sum of the smaller counts over the sum of the
larger); THRESHOLD or more is a contamination. The multiset of shingles is made a set of features (shingle,
occurrence number), so that the similarity of sets is that of multisets whatever repeats.

1. Gate, without loss: an item's rarest shingles, as many as a passing window may lack and one more, are
   its keys. A document that holds a key makes a (document, item) pair; of a pair go on the item-sized
   windows with as many matching places as THRESHOLD needs. The rest of the corpus ends here.
2. Fingerprints: each window gets PRINTS independent 64-bit SimHashes of its features.
3. Multi-index: a fingerprint is four blocks of 16 bits. Of two fingerprints within RADIUS bits some block
   differs in three bits at most, so the items are indexed under all values that near, the windows look up
   their own. At similarity THRESHOLD a bit differs with probability 0.172, one fingerprint lies beyond
   RADIUS in 7 % of cases, both in 1 of 200.
4. What is found is verified exactly. Pairs of the gate of which nothing was verified go the exact way: all
   their gated windows are verified. So no pair is lost to the fingerprints; of a pair that the index settled,
   a better window that it missed is not looked for.

Everything is DataFrame expressions. Equal texts are looked at once, for their smallest doc_id. A side is
broadcast only if it stays within BROADCAST_ROWS, otherwise the join shuffles.

Defined cases: null or blank texts and items match nothing; an item of fewer than five words is one
shingle, matched whole; a document shorter than an item is one window, itself; repeated items are
reported for each item_id, rows with one doc_id count as one document, null ids as none; of windows of one
similarity the first counts; empty tables give empty results; only doc_id, item_id and text are read, of
clashing names the first counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 15
BITS = 64
PRINTS = 2
BLOCK_BITS = 16
BROADCAST_ROWS = 200_000


def word_hashes(text: str) -> Column:
    """Hashes of the lower-case words; blank text has none."""
    return F.expr(f"""transform(array(btrim(lower({text}), ' \t\n\x0B\f\r')), t -> if(t = '', cast(array() as array<bigint>), transform(split(t, r'[\x20\x09-\x0D]+'), w -> xxhash64(w))))[0]""")


def shingles(words: str, size: int) -> str:
    """SQL of the hashes of all runs of ``size`` words (hashes themselves), in order."""
    parts = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return f"transform(if(size({words}) >= {size}, sequence(0, size({words}) - {size}), array()), i -> xxhash64({size}, {parts}))"


def grams(words: str, k: str = "k") -> str:
    """SQL of the shingles of ``k`` words, one to SHINGLE."""
    return f"case {k} " + " ".join(f"when {n} then {shingles(words, n)}" for n in range(1, SHINGLE + 1)) + " end"


def features(hashes: str) -> str:
    """SQL of the set of (shingle, occurrence number) hashes; only multisets with repeats are sorted and numbered."""
    numbered = "transform(s, (g, i) -> xxhash64(g, cast(i + 2 - array_position(s, g) as int)))"
    one = f"if(size(array_distinct(h)) = size(h), transform(h, g -> xxhash64(g, 1)), transform(array(array_sort(h)), s -> {numbered})[0])"
    return f"transform(array({hashes}), h -> {one})[0]"


def fingerprint(hashes: str) -> str:
    """SQL of the 64-bit SimHash of an array of hashes: bit b is set if most of them have it.

    Bits are counted in parts of one long: four of 16 bits, for arrays beyond their range two of 32.
    """

    def counted(parts: int) -> str:
        width = BITS // parts
        lanes = f"transform(sequence(0, {width - 1}), j -> aggregate(x, 0L, (a, h) -> a + (shiftrightunsigned(h, j) & {sum(1 << width * p for p in range(parts))}L)))"
        bits = [f"if((shiftrightunsigned(c, {width * p}) & {(1 << width) - 1}L) * 2 > size(x), shiftleft(1L, j + {width * p}), 0L)" for p in range(parts)]
        return f"aggregate(transform({lanes}, (c, j) -> {' | '.join(bits)}), 0L, (a, b) -> a | b)"

    return f"transform(array({hashes}), x -> if(size(x) < 65536, {counted(4)}, {counted(2)}))[0]"


def simhash(words: str) -> str:
    """SQL of the 64-bit SimHash of an array of words."""
    return fingerprint(f"transform({words}, w -> xxhash64(w))")


def prints(features_: str) -> str:
    """SQL of the PRINTS independent fingerprints of a feature set."""
    return "array(" + ", ".join(fingerprint(f"transform({features_}, y -> xxhash64(y, {p}))") for p in range(PRINTS)) + ")"


def similarity(a: str, b: str) -> str:
    """SQL of the Jaccard similarity of two feature sets."""
    return f"transform(array(size(array_intersect({a}, {b}))), s -> s / (size({a}) + size({b}) - s))[0]"


def blocks(print_: str, near: bool = False) -> str:
    """SQL of the multi-index keys of a fingerprint: its blocks, with ``near`` all values within the bits that
    two fingerprints RADIUS apart may differ by in their nearest block."""
    n = BITS // BLOCK_BITS
    masks = [sum(1 << b for b in bits) for m in range(RADIUS // n + 1) for bits in combinations(range(BLOCK_BITS), m)] if near else [0]
    block = f"shiftrightunsigned({print_}, _b * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L"
    return f"flatten(transform(sequence(0, {n - 1}), _b -> transform(array({', '.join(f'{m}L' for m in masks)}), _m -> shiftleft(cast(_b as bigint), {BLOCK_BITS}) | (({block}) ^ _m))))"


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (cut, so counted for nothing) marked for broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, k, grams, features, prints, word_print) of items with words; k: words of a shingle."""
    rows = base.take(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), word_hashes("text").alias("words")).where("size(words) > 0")
    rows = rows.select("item_id", "words", F.size("words").alias("size"), F.expr(f"least({SHINGLE}, size(words))").alias("k"))
    rows = rows.select("*", F.expr(grams("words")).alias("grams")).select("*", F.expr(features("grams")).alias("features"))
    return base.cut(rows.select("item_id", "size", "k", "grams", "features", F.expr(prints("features")).alias("prints"), F.expr(fingerprint("words")).alias("word_print")))


#: SQL of the starts of all windows with ``least`` of the ascending ``places`` or more, each once. The i-th run of
#: ``least`` places lies in the windows from lo to hi; those before the run's predecessor ends are that one's.
STARTS = """case when n < size then array(0) else flatten(transform(filter(transform(sequence(0, size(places) - least), i -> named_struct(
    'lo', greatest(0, get(places, i + least - 1) - weight + 1, get(places, i - 1) + 1), 'hi', least(get(places, i), n - size))), x -> x.lo <= x.hi), x -> sequence(x.lo, x.hi))) end"""


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text): documents with an id, and 128 bits that stand for the text."""
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return plain.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, hits): the places (pos, gram) of documents of n words that hold shingles of the benchmark."""
    sizes = sorted(r.k for r in known.select("k").distinct().collect())  # at most five values
    found = "concat(" + ", ".join(f"transform({shingles('words', k)}, (h, i) -> named_struct('pos', i, 'gram', h))" for k in sizes or [SHINGLE]) + ")"
    rows = texts(docs).withColumn("words", word_hashes("text")).select("doc_id", "h1", "h2", F.size("words").alias("n"), F.explode(F.expr(found)).alias("x")).select("doc_id", "h1", "h2", "n", "x.pos", "x.gram")
    held = base.cut(known.select(F.explode("grams").alias("gram")).distinct())
    return base.cut(rows.join(bounded(held), "gram").groupBy("doc_id", "h1", "h2", "n").agg(F.array_sort(F.collect_set(F.struct("pos", "gram"))).alias("hits")))


def gated(found: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, h2, carrier, item_id, size, k, starts): of each text and item all item-sized windows that may pass.

    Of two windows of equal weight w, sharing s features, the similarity is s / (2 w - s), so a window needs
    2 w t / (1 + t) matching places for threshold t; a document shorter than the item needs w t.
    """
    places = known.select("item_id", F.size("grams").alias("weight"), F.posexplode("grams").alias("at", "gram"))
    common = places.groupBy("gram").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("items", "gram", "at"))
    keys = places.join(common, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("weight") - F.ceil(F.col("weight") * THRESHOLD) + 1)
    keys = base.cut(keys.select("gram", "item_id").distinct())
    carried = base.cut(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("carrier"), F.first("n").alias("n"), F.first("hits").alias("hits")))
    pairs = carried.select("h1", "h2", F.explode("hits.gram").alias("gram")).join(bounded(keys), "gram").select("h1", "h2", "item_id").distinct()
    wanted = known.select("item_id", "size", "k", "grams", F.size("grams").alias("weight"))
    places = F.expr("transform(filter(hits, x -> array_contains(grams, x.gram)), x -> x.pos)").alias("places")
    met = pairs.join(carried, ["h1", "h2"]).join(bounded(wanted), "item_id").select("h1", "h2", "carrier", "n", "item_id", "size", "k", "weight", places)
    least = F.when(F.col("n") < F.col("size"), F.ceil(F.col("weight") * THRESHOLD)).otherwise(F.ceil(F.col("weight") * 2 * THRESHOLD / (1 + THRESHOLD))).cast("int")
    near = met.withColumn("least", least).where(F.size("places") >= F.col("least"))
    return near.select("h1", "h2", "carrier", "item_id", "size", "k", F.expr(STARTS).alias("starts")).where(F.size("starts") > 0)


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each row of wanted (h1, h2, carrier, size, k, start, ...) with the window's features and its words' SimHash."""
    names = [c for c in wanted.columns if c not in ("h1", "h2", "carrier", "start")]
    by_text = wanted.groupBy("h1", "h2", "carrier").agg(F.collect_list(F.struct("start", *names)).alias("wanted"))
    rows = texts(docs).withColumnRenamed("doc_id", "carrier").join(bounded(base.cut(by_text)), ["h1", "h2", "carrier"])
    rows = rows.select("h1", "h2", "carrier", word_hashes("text").alias("words"), "wanted")  # a text is split once
    rows = rows.select("h1", "h2", "carrier", "words", F.explode("wanted").alias("x")).select("h1", "h2", "carrier", "words", "x.*")
    own = rows.withColumn("own", F.expr("slice(words, start + 1, size)")).drop("words")
    return own.withColumn("grams", F.expr(grams("own"))).withColumn("features", F.expr(features("grams"))).drop("grams")


def looked_up(prints_: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, h2, carrier, size, k, start, item_id): the items within RADIUS of a window in some fingerprint."""

    def keyed(df: DataFrame, near: bool) -> DataFrame:
        rows = df.select("*", F.posexplode("prints").alias("p", "print")).drop("prints")
        key = F.expr(f"transform({blocks('print', near)}, v -> shiftleft(cast(size as bigint), 24) | shiftleft(cast(p as bigint), 18) | v)")
        return rows.select("*", F.explode(key).alias("key"))

    index = keyed(known.select("item_id", "size", "prints"), True).select("key", "item_id", F.col("print").alias("goal"))
    asked = base.cut(keyed(prints_, False).drop("p"))
    near = index.join(bounded(asked), "key").where(F.bit_count(F.col("print").bitwiseXOR(F.col("goal"))) <= RADIUS)
    return near.select("h1", "h2", "carrier", "size", "k", "start", "item_id").distinct()


def verified(docs: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(h1, h2, item_id, x): of each text and item the best window that passes: similarity, near (minus its start), size, distance."""
    goal = known.select("item_id", F.col("features").alias("goal"), "word_print")
    rows = windows(docs, candidates).join(bounded(goal), "item_id").withColumn("similarity", F.expr(similarity("features", "goal")).cast("double"))
    passed = rows.where(F.col("similarity") >= THRESHOLD).select("h1", "h2", "item_id", "similarity", (-F.col("start")).alias("near"), "size", "own", "word_print")
    best = passed.groupBy("h1", "h2", "item_id").agg(F.max(F.struct("similarity", "near", "size", "own", "word_print")).alias("x"))
    distance = F.expr(f"cast(bit_count({fingerprint('x.own')} ^ x.word_print) as int)")
    return best.select("h1", "h2", "item_id", F.struct("x.similarity", "x.near", "x.size", distance.alias("distance")).alias("x"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, size, distance): the best window of each document for each item.

    distance: bits between the SimHashes of the words of window and item.
    """
    known = items(benchmark)
    found = hits(docs, known)
    gate = base.cut(gated(found, known).select("h1", "h2", "carrier", "item_id", "size", "k", F.explode("starts").alias("start")))
    distinct = base.cut(gate.select("h1", "h2", "carrier", "size", "k", "start").distinct())
    stamped = windows(docs, distinct).select("h1", "h2", "carrier", "size", "k", "start", F.expr(prints("features")).alias("prints"))
    first = base.cut(verified(docs, base.cut(looked_up(stamped, known)), known))
    rest = base.cut(gate.join(bounded(first.select("h1", "h2", "item_id")), ["h1", "h2", "item_id"], "left_anti"))
    best = base.cut(first.union(verified(docs, rest, known)))
    out = found.select("doc_id", "h1", "h2").join(bounded(best), ["h1", "h2"]).groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return out.select("doc_id", "item_id", "x.similarity", (-F.col("x.near")).alias("start"), "x.size", "x.distance")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(base.documents(spark, sf_dir), base.documents(spark, sf_dir, "benchmark"))
