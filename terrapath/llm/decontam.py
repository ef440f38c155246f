"""Benchmark decontamination with DataFrame functions only.

A benchmark item of L words is compared with every window of L words of a document. Shingles are
k = min(5, L) words; similarity is weighted Jaccard, a shingle weighing as often as it occurs
(sum of minima over sum of maxima). Pairs of 0.8 or more are reported.

1. Lossless filter: similarity >= s needs s * m of the item's m shingles within the window, so only
   windows with that many shingle hits go on. The starts at which a window holds `need` hits are the stretches
   between the places of the i-th and the (i + need)-th hit, so a long item costs its hits, not their square.
2. Those windows and all items get 64-bit SimHash fingerprints; a window's bit counts are a difference of running
   sums over the document's shingles. Multi-index Hamming blocks: eight blocks of eight bits; fingerprints within
   RADIUS agree in one block up to RADIUS // 8 bits (pigeonhole), so items are entered under all values that near
   and windows look up their own. RADIUS 23 is 4.6 standard deviations above the distance expected at similarity 0.8.
3. The pairs found are verified exactly: a shingle that the item has n times counts at a place for the starts after
   its n-th place before, so the shared weight of all windows is one running sum over the starts.

Defined cases: null or wordless texts match nothing; a document shorter than the item counts as one
window; repeated rows give one result per doc_id and item; rows with a null doc_id are one document in the result,
but `drop_leaks` drops only those of them that hold an item; empty tables give no rows; other columns are ignored."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, words, written

K, SIMILARITY, BLOCKS, RADIUS = 5, 0.8, 8, 23


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k-word shingles, in order."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.element_at(w, (i + j).cast("int")) for j in range(k)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), at)).otherwise(F.array().cast("array<bigint>"))


#: Two counters of 32 bits share a long; no text has more words than an array has places.
LANES = 0x0000000100000001
COUNTERS = [f"c{b}" for b in range(32)]


def bit_counts(h: Column) -> list[Column]:
    """For each bit of a hash a counter of 0 or 1."""
    return [F.shiftrightunsigned(h, b).bitwiseAND(F.lit(LANES)) for b in range(32)]


def majority(counts: list[Column], m: Column) -> Column:
    """The SimHash of `m` hashes from the sums of their bit counts."""
    fp = F.lit(0).cast("long")
    for b, c in enumerate(counts):
        for lane in (0, 32):
            fp = fp.bitwiseOR(F.shiftleft((F.shiftrightunsigned(c, lane).bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > m).cast("long"), lane + b))
    return fp


def block_rows(df: DataFrame, near: int) -> DataFrame:
    """A row per block and value within `near` bits of the block's own."""
    masks = [sum(1 << b for b in c) for n in range(near + 1) for c in combinations(range(64 // BLOCKS), n)]
    width = 64 // BLOCKS
    block = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", width * b).bitwiseAND(F.lit((1 << width) - 1)).alias("own")) for b in range(BLOCKS)]))
    out = df.withColumn("x", block)
    return out.withColumn("flip", F.explode(F.array(*[F.lit(x) for x in masks]))).withColumn("block", F.col("x.block")).withColumn("value", F.col("x.own").bitwiseXOR(F.col("flip").cast("long"))).drop("x", "flip")


def near_items(documents: DataFrame, benchmark: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame] | None:
    """Items (item, item_id, len, k, m, h, n), and documents that have enough of an item's shingles somewhere
    (doc_id, t1, t2, n_words, item, len, k, m, hits): hits are (h, pos, n), n the shingle's weight in the item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates()
    items = items.withColumns({"len": F.size("w"), "k": F.least(F.size("w"), F.lit(K)), "item": F.monotonically_increasing_id()})
    items = written(items, "texts")  # the numbers hold from here on
    ks = sorted(r.k for r in items.select("k").distinct().collect())  # at most five values
    if not ks:
        return None
    sh = F.array().cast("array<bigint>")
    for k in ks:
        sh = F.when(F.col("k") == k, shingles(F.col("w"), k)).otherwise(sh)
    item = items.withColumn("m", F.size(sh).cast("long")).select("item", "item_id", "len", "k", "m", F.explode(sh).alias("h"))
    item = written(item.groupBy("item", "item_id", "len", "k", "m", "h").agg(F.count("*").alias("n")), "items")

    docs = documents.select("doc_id", *row_key(), words(F.col("text")).alias("w"))
    found = None
    for k in ks:
        rows = docs.select("doc_id", "t1", "t2", F.size("w").alias("n_words"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        found = rows if found is None else found.unionByName(rows)
    hit = found.join(broadcast_if_small(item.select("h", "item", "len", "k", "m", "n")), "h")
    # a repeated row counts once
    near = hit.groupBy("doc_id", "t1", "t2", "n_words", "item", "len", "k", "m").agg(F.array_sort(F.collect_set(F.struct("h", "pos", "n"))).alias("hits"))
    return item, written(near.where(F.size("hits") >= needed(similarity)), "near")


def row_key() -> list[Column]:
    """128 bits that name a row's doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("t2")]


def needed(similarity: float) -> Column:
    return F.ceil(F.lit(similarity - 1e-9) * F.col("m")).cast("int")


def window_starts(near: DataFrame, similarity: float) -> DataFrame:
    """near with `size`, the shingles of a window, `last`, the last start, and `runs`, disjoint stretches (low, high) of
    starts whose window holds enough hits."""
    out = near.withColumns({"size": F.least("len", "n_words") - F.col("k") + 1, "last": F.greatest(F.lit(0), F.col("n_words") - F.col("len")), "need": needed(similarity), "at": F.array_sort(F.transform("hits", lambda x: x["pos"]))})
    # hits i to i + need - 1 are within the windows that start from `low` to `high`; both only grow with i
    runs = F.expr("""filter(transform(sequence(0, size(at) - need), i -> named_struct(
        'low', greatest(0, element_at(at, i + need) - size + 1, if(i = 0, 0, least(last, element_at(at, i)) + 1)),
        'high', least(last, element_at(at, i + 1)))), x -> x.low <= x.high)""")
    return out.withColumn("runs", runs).where(F.size("runs") > 0).drop("at", "need")


PAIR = ["t1", "t2", "item"]


def window_fingerprints(documents: DataFrame, spans: DataFrame, ks: list[int]) -> DataFrame:
    """(t1, t2, len, s, fp) of the windows of `spans`."""
    hull = spans.select(*PAIR, "len", "k", "size", "runs", F.array_min("runs.low").alias("a"), (F.array_max("runs.high") + F.col("size")).alias("b"))
    ids = written(hull.select("t1", "t2").distinct(), "ids")
    text = documents.select(*row_key(), "text").join(broadcast_if_small(ids), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    wide = text.select("t1", "t2", words(F.col("text")).alias("w")).join(hull.drop("runs"), ["t1", "t2"])
    own = F.array().cast("array<bigint>")
    for n in ks:
        own = F.when(F.col("k") == n, shingles(F.slice("w", F.col("a") + 1, F.col("b") - F.col("a") + F.col("k") - 1), n)).otherwise(own)
    rows = wide.select(*PAIR, "size", "a", F.posexplode(own).alias("i", "h")).withColumn("pos", F.col("a") + F.col("i"))
    so_far = Window.partitionBy(*PAIR).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*PAIR, "size", "pos", *[F.sum(c).over(so_far).alias(n) for c, n in zip(bit_counts(F.col("h")), COUNTERS, strict=True)])
    # what a window holds: the sums at its end less those before its start
    ends = sums.select(*PAIR, "size", (F.col("pos") - F.col("size") + 1).alias("s"), F.lit(1).alias("sign"), *COUNTERS)
    begins = sums.select(*PAIR, "size", (F.col("pos") + 1).alias("s"), F.lit(-1).alias("sign"), *COUNTERS)
    starts = hull.select(*PAIR, "len", F.inline("runs")).select(*PAIR, "len", F.explode(F.sequence("low", "high")).alias("s"))
    both = ends.unionByName(begins).groupBy(*PAIR, "size", "s").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTERS])
    fp = starts.join(both, [*PAIR, "s"]).select("t1", "t2", "len", "s", majority([F.col(c) for c in COUNTERS], F.col("size")).alias("fp"))
    return fp.dropDuplicates(["t1", "t2", "len", "s"])


def shared_weights(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (t1, t2, item, s) with `both`, the weight that the window at s shares with the item."""
    # hits are sorted by shingle and place, so a shingle's n-th place before stands n entries before
    counted = F.expr("""transform(sequence(1, size(hits)), i -> named_struct(
        'low', greatest(0, element_at(hits, i).pos - size + 1, if(i > element_at(hits, i).n and element_at(hits, greatest(1, i - cast(element_at(hits, i).n as int))).h = element_at(hits, i).h, element_at(hits, greatest(1, i - cast(element_at(hits, i).n as int))).pos + 1, 0)),
        'high', element_at(hits, i).pos))""")
    spans = near.select(*PAIR, F.inline(counted)).where("low <= high")
    steps = F.explode(F.array(F.struct(F.col("low").alias("s"), F.lit(1).alias("step")), F.struct((F.col("high") + 1).alias("s"), F.lit(-1).alias("step"))))
    steps = spans.select(*PAIR, steps.alias("x")).select(*PAIR, "x.s", "x.step", F.lit(False).alias("asked"))
    asked = pairs.select(*PAIR, "s", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    so_far = Window.partitionBy(*PAIR).orderBy("s", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.unionByName(asked).withColumn("both", F.sum("step").over(so_far)).where("asked").select(*PAIR, "s", "both")


def leaks(documents: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame | None:
    """(doc_id, t1, t2, item_id, similarity, s, len) of all verified windows."""
    found = near_items(documents, benchmark, similarity)
    if found is None:
        return None
    item, near = found
    ks = sorted(r.k for r in item.select("k").distinct().collect())
    spans = written(window_starts(near, similarity), "windows")
    window_fp = window_fingerprints(documents, spans, ks)
    sums = [F.sum(c * F.col("n")).alias(n) for c, n in zip(bit_counts(F.col("h")), COUNTERS, strict=True)]
    item_fp = item.groupBy("item", "len", "m").agg(*sums).select("item", "len", majority([F.col(c) for c in COUNTERS], F.col("m")).alias("ifp"))
    wanted = block_rows(item_fp.withColumnRenamed("ifp", "fp"), RADIUS // BLOCKS).withColumnRenamed("fp", "ifp")
    pairs = block_rows(window_fp, 0).join(wanted, ["len", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
    pairs = pairs.select(*PAIR, "s").distinct()
    scored = shared_weights(spans, pairs.join(spans.select(*PAIR), PAIR, "left_semi"))
    about = spans.select("doc_id", *PAIR, "len", "m", "size").join(item.select("item", "item_id").distinct(), "item")
    sim = F.col("both") / (F.col("size") + F.col("m") - F.col("both"))
    return scored.join(about, PAIR).withColumn("similarity", sim).where(F.col("similarity") >= similarity - 1e-12).select("doc_id", "t1", "t2", "item_id", "similarity", "s", "len")


def find_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, window_words): each pair's best window, the first on ties."""
    found = leaks(documents, benchmark, similarity)
    if found is None:
        types = {c: t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (benchmark, "item_id"))}
        return documents.sparkSession.createDataFrame([], f"doc_id {types['doc_id']}, item_id {types['item_id']}, similarity double, start_word long, window_words long")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("s")).alias("ns"), "len")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.ns")).cast("long").alias("start_word"), F.col("best.len").cast("long").alias("window_words"))


def drop_leaks(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents, same columns, without those that hold a benchmark item."""
    found = leaks(documents, benchmark, similarity)
    if found is None:
        return documents
    gone = written(found.select(F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct(), "leaks")
    t1, t2 = row_key()
    return documents.join(broadcast_if_small(gone), (t1 == F.col("__t1")) & (t2 == F.col("__t2")), "left_anti")
