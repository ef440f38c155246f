"""N-gram Jaccard join by chosen paths.

Texts are sets of 5-word shingles (lower-case letters and digits; a text of 1 to 4 words is one shingle).
Equal sets are one set with copies. Each set is embedded by WIDTH min-hashes, so a shared coordinate is a
shared token sampled with probability equal to the similarity.

1. Chosen paths: from each run's root, a node follows one coordinate, or two with probability 1/4, chosen by
   hash of the path so far (1.25 on average, 1 / 0.8); a child is the path with the coordinate's value. Sets
   alike keep sharing paths, others part quickly. DEPTH levels make a bucket; `runs_for` gives the number of
   runs at which a pair at the threshold shares a bucket with probability TARGET.
2. Buckets are not split further, which would part alike sets again: all sets of a bucket meet, on one-byte
   sketches, four standard deviations below the threshold. Buckets of up to SMALL sets are compared pair by pair;
   in larger ones a group grows by each member's look at all sets that are in no group yet. A bucket above a
   block is dealt to block pairs.
3. The pairs make candidate groups, and every pair of sets within a group is compared exactly. A group above
   BLOCK sets or BLOCK_SHINGLES shingles is dealt to block pairs. A task gives sums per set, never its pairs.
4. Links join sets to classes (connected components).

Defined cases: a null text or one without words has no shingles, links nothing and is its own class; a null
doc_id is carried through and never a class id if another member has one; repeated rows are copies; an
empty table gives no rows; other columns are ignored; whole texts are read whatever their length."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, components, give_back, sorted_runs, written

K, SIMILARITY, WIDTH, DEPTH, DEEPEST, SMALL, BLOCK, TARGET = 5, 0.8, 128, 4, 14, 48, 256, 0.9999
#: Shingles of a block of sets, on average at most.
BLOCK_SHINGLES = 1 << 21
WORD = re.compile(r"[^\W_]+")
U = np.uint64
SEEDS = np.random.default_rng(5).integers(1, 1 << 32, WIDTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: Sets of one bucket that meet at a time: two blocks of half as many.
HELD = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sorted distinct hashes of a text's shingles; word hashes are looked up."""

    CACHE = 300_000

    def __init__(self, k: int = K):
        self.k, self.known = k, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text.lower()) if text else []
        if not found:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.CACHE:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        k = min(self.k, len(h))
        s = np.full(len(h) - k + 1, U(k))
        for i in range(k):
            s = mix(s * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(s)


def sketch(s: np.ndarray) -> np.ndarray:
    """WIDTH min-hashes of a non-empty set."""
    x = (s ^ (s >> U(32))).astype(np.uint32)
    out = np.full(WIDTH, np.uint32(0xFFFFFFFF))
    for at in range(0, len(x), 2048):
        h = x[at : at + 2048, None] * SEEDS
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(0), out=out)
    return out


def runs_for(similarity: float = SIMILARITY, depth: int = DEPTH, target: float = TARGET) -> int:
    """Runs until a pair at the threshold shares some path of `depth` with probability `target`."""
    alive = 1.0
    for _ in range(depth):
        one = similarity * alive
        alive = 0.75 * one + 0.25 * (1 - (1 - one) ** 2)
    return math.ceil(math.log(1 - target) / math.log(1 - alive))


def step(keys: np.ndarray, values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: paths `keys` of sets `owner` (rows of values) to their children."""
    h = mix(keys)
    two = np.flatnonzero((h >> U(40)) & U(3) == 0)
    parents = np.concatenate([keys, keys[two]])
    owner = np.concatenate([owner, owner[two]])
    at = np.concatenate([h & U(WIDTH - 1), ((h[two] & U(WIDTH - 1)) + U(1) + ((h[two] >> U(20)) % U(WIDTH - 1))) & U(WIDTH - 1)])
    return mix(parents * U(0x9E3779B97F4A7C15) + (at << U(33)) + values[owner, at.astype(np.int64)].astype(np.uint64)), owner


def paths(values: np.ndarray, runs: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows of values): the paths of all sets, in all runs."""
    n = len(values)
    owner = np.tile(np.arange(n), runs)
    keys = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), n)
    for _ in range(depth):
        keys, owner = step(keys, values, owner)
    return keys, owner


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): shared coordinates."""
    return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.int16)


def shared_with(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Coordinates that each of `rows` (WIDTH bytes) shares with `one`: eight bytes are counted at a time."""
    same = (rows == one).view(U).sum(1, dtype=U)
    return (same * U(0x0101010101010101)) >> U(56)


def bucket_pairs(ids: np.ndarray, sk: np.ndarray, need: int, seed: int, depth: int = DEPTH, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Pairs that join the sets of a bucket whose sketches share `need` coordinates, directly or through others:
    a tree for each group, never all its pairs. With `side`, only pairs across its two values count. `seed` orders
    the sets; a bucket is compared whole at any `depth`, as each further level would part alike sets again."""
    if len(ids) < 2:
        return
    if len(ids) <= SMALL:
        m = alike(sk, sk) >= need
        np.fill_diagonal(m, False)
        if side is not None:
            m &= side[:, None] != side[None, :]
        for i, j in enumerate(roots(m)):
            if i != j:
                yield int(ids[i]), int(ids[j])
        return
    # a group grows from its first set: each member meets all sets that are in no group yet
    order = np.random.default_rng(seed).permutation(len(ids))
    ids, sk, side = ids[order], sk[order], None if side is None else side[order]
    rest, rows = np.arange(1, len(ids)), sk[1:]
    grown = [0]
    while len(rest):
        if not grown:
            grown, rest, rows = [int(rest[0])], rest[1:], rows[1:]
            continue
        i = grown.pop()
        near = shared_with(rows, sk[i]) >= need
        if side is not None:
            near &= side[rest] != side[i]
        if near.any():
            found = rest[near]
            for j in found:
                yield int(ids[i]), int(ids[j])
            grown += found.tolist()
            rest, rows = rest[~near], rows[~near]


def to_smallest(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(smallest, other) for each group that the pairs join: the same few pairs whichever bucket a group meets in."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    for x in list(above):
        if (t := top(x)) != x:
            yield t, x


def exact_links(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> np.ndarray:
    """Boolean matrix of pairs of the required similarity; with `side`, only pairs across its two values."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    names, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count > 1)
    place = np.full(len(names), -1)
    place[keep] = np.arange(len(keep))
    at = place[inverse]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both, width = np.zeros((n, n)), 4096
    for low in range(0, len(keep), width):
        a, z = np.searchsorted(at, [low, low + width])
        m = np.zeros((n, min(width, len(keep) - low)), np.float32)
        m[owner[a:z], at[a:z] - low] = 1
        both += m @ m.T
    links = both >= (similarity - 1e-12) * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(links, False)
    return links if side is None else links & (side[:, None] != side[None, :])


def roots(links: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sets_of(documents: DataFrame) -> DataFrame:
    """(doc_id, row, sid, n, sketch): sid names the shingle set (null without words), row the row's content."""
    bounded_batches(documents.sparkSession)
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            sid, n, sk = [], [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                n.append(len(s))
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(sk, pa.binary())], ["doc_id", "row", "sid", "n", "sketch"])

    return rows.mapInArrow(run, rows.select("doc_id", "row").schema.add("sid", "long").add("n", "long").add("sketch", "binary"))


def candidate_pairs(sketches: DataFrame, similarity: float, target: float) -> DataFrame:
    """(a, b) of (sid, sketch): pairs that share a bucket and look alike there."""
    bounded_batches(sketches.sparkSession, 2048)
    runs = runs_for(similarity, target=target)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, WIDTH)
            keys, owner = paths(values, runs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(owner))], ["key", "sid"])

    keys = written(sketches.mapInArrow(choose, "key long, sid long"), "paths")
    # a bucket above a block is dealt to pairs of blocks, so that each two of its sets meet somewhere
    blocks = F.ceil(F.count("*") / (HELD // 2)).cast("int").alias("blocks")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), blocks).where("n > 1").select("key", "blocks")
    small = sketches.select("sid", "sketch")
    met = keys.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "sid", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = met.join(small, "sid").select("key", "i", "j", "own", "sid", "sketch")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    sd = math.sqrt(similarity * (1 - similarity) / WIDTH)
    need = math.floor((similarity - 4 * sd) * WIDTH)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            rows = list(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"])

        for t, _ in sorted_runs(batches, ["key", "i", "j"]):
            ids = t.column("sid").to_numpy()
            # the low byte of each coordinate
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, WIDTH, 4)[:, :, 0]
            seed = int(t.column("key")[0].as_py()) & ((1 << 62) - 1)
            side = t.column("own").to_numpy() if t.column("i")[0] != t.column("j")[0] else None
            out.update(to_smallest(bucket_pairs(ids, sk, need, seed, side=side)))
            if len(out) > 1 << 16:
                yield flush()
        yield flush()
        t = ids = sk = side = None  # what give_back() gives back
        give_back()

    return met.mapInArrow(compare, "a long, b long").distinct()


def exact_groups(documents: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """(sid, links, root) of members (row, sid, copies, n, component): `links` counts documents linked, and root
    is a set that the set reaches by links; a set may have several rows, to be summed and joined."""
    bounded_batches(documents.sparkSession, 64)
    need = members.select("row").distinct()
    texts = documents.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(broadcast_if_small(need), "row", "left_semi").dropDuplicates(["row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["row", "shingles"])

    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    m = members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("row", "sid", "copies", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = m.join(texts.mapInArrow(cut, "row long, shingles array<bigint>"), "row")
    met = met.select("component", "i", "j", "own", "sid", "copies", "shingles").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in sorted_runs(batches, ["component", "i", "j"]):
            sid, copies, own = (t.column(c).to_numpy() for c in ("sid", "copies", "own"))
            if len(sid) < 2:
                continue
            sets = [np.asarray(c.values, np.int64).view(np.uint64) for c in t.column("shingles")]
            links = exact_links(sets, own if t.column("i")[0] != t.column("j")[0] else None, similarity)
            if links.any():
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array((links @ copies).astype(np.int64)), pa.array(sid[roots(links)])], ["sid", "links", "root"])
        t = sets = links = None
        give_back()

    return met.mapInArrow(compare, "sid long, links long, root long")


def join(documents: DataFrame, similarity: float = SIMILARITY, target: float = TARGET) -> DataFrame:
    """(doc_id, row, class_id, n_links), a row per document: its class's smallest doc_id, and how many other
    documents are at least `similarity` alike."""
    docs = written(sets_of(documents), "sets")
    sets = docs.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.max("n").alias("n"))
    sets = written(sets, "classes")
    one = docs.where("sid is not null").join(sets.select("sid", "row"), ["sid", "row"], "left_semi").select("sid", "sketch").dropDuplicates(["sid"])
    pairs = candidate_pairs(written(one, "sketches"), similarity, target)
    groups = components(pairs)
    members = written(groups.withColumnRenamed("id", "sid").join(sets, "sid"), "members")
    found = written(exact_groups(documents, members, similarity), "links")
    label = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "sid")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    about = sets.select("sid", "copies").join(links, "sid", "left").join(label, "sid", "left")
    about = about.where("copies > 1 or component is not null").select("sid", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "sid").alias("component"))
    about = written(about, "about")
    least = docs.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    class_id = about.join(least, "sid").groupBy("component").agg(F.min("least").alias("class_id"))
    about = about.join(class_id, "component").select("sid", "copies", "links", "class_id")
    return docs.join(about, "sid", "left").select(
        "doc_id", "row", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links")
    )


def keep_one(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents without all but one of each class: the one with the smallest doc_id, once if its row is repeated."""
    found = join(documents, similarity)
    grouped = found.where("n_links > 0")
    keep = grouped.groupBy("class_id").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.row").alias("__row"), F.lit(True).alias("__keep"))
    member = grouped.select(F.col("row").alias("__row")).distinct().join(keep, "__row", "left").select("__row", F.coalesce("__keep", F.lit(False)).alias("__keep"))
    member = broadcast_if_small(written(member, "members"))
    rows = documents.withColumn("__row", F.xxhash64("doc_id", "text")).join(member, "__row", "left")
    alone = rows.where("__keep is null").drop("__row", "__keep")
    kept = rows.where("__keep").dropDuplicates(["__row"]).drop("__row", "__keep")
    return alone.unionByName(kept)
