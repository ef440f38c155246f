"""Approximate nearest neighbours by cross-polytope hashing.

A table joins `width` cross-polytope hashes. Each is a pseudo-random rotation (three rounds of random signs and a
fast Hadamard transform, zero padded to a power of two); a unit vector's axis is the signed axis it lies nearest
to, and its cell the list of its axes. The more rows, the more axes (`axes_for`), so that cells keep about the same
number of rows. A query probes (table, cell) in falling order of the sum of its own rotated coordinates, over all
tables together, and what it collects is reranked exactly in double precision.

Where norms differ, vectors are first lengthened by one coordinate to equal norms, sqrt(largest^2 - norm^2), and
queries by zero: the largest inner product is then the smallest angle.

How many probes: `calibrate` takes SAMPLE rows (by hash), finds their true neighbours with one distributed pass
over all rows, and takes the depth at which the TARGET share of them is collected. The same rule holds at every
size; there are no caps on cells or candidates. A query that ends with fewer than k rows though more exist meets
all rows, in blocks.

Cells meet queries in groups, a range of first axes of one table. A group is split into blocks of BLOCK_ROWS rows
and BLOCK_QUERIES queries by hash, so a cell with a third of all rows is shared by many tasks; of a block's equal
vectors only the k + 1 smallest ids go on. A task gives k rows per query, never its pairs.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components or differ in
dimension from most are left out; a repeated vec_id is one candidate, at its best score, but a query never
finds its own id, and of different vectors under one query's id the smallest asks; ties go to the smaller vec_id;
fewer candidates than k give them all; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import bounded_batches, give_back, sorted_runs, written

TABLES, SAMPLE, TARGET, SEED = 12, 64, 0.95, 17
BLOCK_ROWS, BLOCK_QUERIES, CELL_ROWS = 16_384, 8192, 8
#: Pairs scored at a time, and rows that a task holds before it keeps the best.
PAIRS, HELD = 1 << 16, 1 << 18
#: Longest rows whose rotations are kept as matrices.
MATRIX = 256
FOUND = "query_id long, vec_id long, score double"
BLOCK = "g int, i int, j int, asks boolean, id long, vec binary, cells binary"


def padded(d: int) -> int:
    return 1 << max(0, (d - 1).bit_length())


def axes_for(rows: int, wide: int) -> int:
    """Axes per table at which a cell holds about CELL_ROWS rows."""
    return max(1, math.ceil(math.log(max(2, rows / CELL_ROWS)) / math.log(2 * wide)))


def signs(tables: int, d: int, seed: int = SEED) -> np.ndarray:
    """(tables, 3, d) random signs, the same wherever they are made."""
    return np.random.default_rng(seed).integers(0, 2, (tables, 3, d)).astype(np.float32) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.float32(np.sqrt(d))


def rotate(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Rows of x under one pseudo-rotation (s: 3 sign vectors), zero padded to their length."""
    y = np.zeros((len(x), s.shape[1]), np.float32)
    y[:, : x.shape[1]] = x
    for one in s:
        y = hadamard(y * one)
    return y


def as_matrix(s: np.ndarray) -> np.ndarray:
    """A pseudo-rotation as a matrix: one product takes the place of three transforms where rows are short."""
    return np.ascontiguousarray(rotate(np.eye(s.shape[1], dtype=np.float32), s))


class Tables:
    """The hashes of an index: `tables` tables of `axes` axes each, for vectors of dimension d.

    `largest` is the largest norm where norms differ, None where all are equal."""

    def __init__(self, d: int, axes: int, largest: float | None = None, tables: int = TABLES):
        self.d, self.axes, self.largest, self.tables = d, axes, largest, tables
        self.wide = padded(d + (largest is not None))
        self.signs = signs(tables * axes, self.wide).reshape(tables, axes, 3, self.wide)
        self.cells = (2 * self.wide) ** axes
        self.matrices = [[as_matrix(s) for s in own] for own in self.signs] if self.wide <= MATRIX else None

    def rotated(self, x: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """Unit rows x under each rotation of a table."""
        if self.matrices is None:
            yield from (rotate(x, s) for s in self.signs[table])
            return
        for m in self.matrices[table]:
            yield x @ m[: x.shape[1]]

    def unit(self, x: np.ndarray, asks: bool) -> np.ndarray:
        x = x.astype(np.float64)
        most = np.abs(x).max(1, keepdims=True)
        norm = most * np.sqrt(((x / most) ** 2).sum(1, keepdims=True))
        if self.largest is None or asks:
            out = x / norm
            return (out if self.largest is None else np.concatenate([out, np.zeros_like(norm)], 1)).astype(np.float32)
        share = np.minimum(norm / self.largest, 1.0)
        return np.concatenate([x / self.largest, np.sqrt(1 - share * share)], 1).astype(np.float32)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) cells of rows: digits base 2 * wide, twice the axis plus one on its negative side."""
        x, out = self.unit(x, False), np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for y in self.rotated(x, t):
                axis = np.argmax(np.abs(y), 1)
                out[:, t] = out[:, t] * 2 * self.wide + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, scores) of each query's probes in all tables; a code is table * cells + cell. An axis is probed on
        the side where the query lies; with three axes or more only the best of each are joined."""
        x, codes, scores = self.unit(x, True), [], []
        each, beam = (self.wide, self.wide**2) if self.axes <= 2 else (16, 512)
        for t in range(self.tables):
            code, score = np.full((len(x), 1), t, np.int64), np.zeros((len(x), 1), np.float32)
            for y in self.rotated(x, t):
                own = 2 * np.arange(self.wide) + (y < 0)
                y = np.abs(y)
                if each < self.wide:
                    best = np.argpartition(-y, each - 1, 1)[:, :each]
                    own, y = np.take_along_axis(own, best, 1), np.take_along_axis(y, best, 1)
                score = (score[:, :, None] + y[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * (2 * self.wide) + own[:, None, :]).reshape(len(x), -1)
                if score.shape[1] > beam:
                    best = np.argpartition(-score, beam - 1, 1)[:, :beam]
                    code, score = np.take_along_axis(code, best, 1), np.take_along_axis(score, best, 1)
            codes.append(code)
            scores.append(score)
        return np.concatenate(codes, 1), np.concatenate(scores, 1)

    def deepest(self, x: np.ndarray, depth: int) -> np.ndarray:
        """(rows, at most depth) codes of the best probes, in no order."""
        code, score = self.probes(x)
        if depth >= code.shape[1]:
            return code
        return np.take_along_axis(code, np.argpartition(-score, depth - 1, 1)[:, :depth], 1)


def matrix(a: pa.ListArray) -> np.ndarray:
    """Rows of equal lists."""
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1)


def clean(embeddings: DataFrame) -> DataFrame:
    """Usable rows (vec_id, embedding), of floats if they are stored so, else of doubles."""
    kind = embeddings.schema["embedding"].dataType
    kind = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).where("vec_id is not null")
    return v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))


def top(slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each slot's k best different ids, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, slot))
    s, v, x = slot[order], ids[order], scores[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (v[1:] != v[:-1]) | (x[1:] != x[:-1])]) if len(s) else np.zeros(0, bool)
    order, s, v = order[first], s[first], v[first]
    # an id may hold several vectors: its best score stands first
    again = np.lexsort((np.arange(len(s)), v, s))
    same = np.concatenate([[False], (s[again][1:] == s[again][:-1]) & (v[again][1:] == v[again][:-1])]) if len(s) else np.zeros(0, bool)
    keep = np.ones(len(s), bool)
    keep[again[same]] = False
    order, s = order[keep], s[keep]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    nth = np.arange(len(s)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(s)]])))
    return order[nth < k]


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed in index order so that every task gives the same bits."""
    out = np.zeros(len(q))
    for x, y in zip(np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(v.T, np.float64), strict=True):
        out += x * y
    return out


class Best:
    """A task's k best candidates per query. Float products with slack leave out what can't be among them."""

    def __init__(self, k: int):
        self.k, self.slots, self.held, self.n = k, {}, [], 0
        self.bar = np.zeros(0)

    def add(self, qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, qi: np.ndarray, vi: np.ndarray) -> None:
        """Score the pairs (qi, vi) of queries q and vectors v."""
        slot = np.array([self.slots.setdefault(x, len(self.slots)) for x in qid.tolist()], np.int64)
        if len(self.bar) < len(self.slots):
            self.bar = np.concatenate([self.bar, np.full(2 * len(self.slots) - len(self.bar), -np.inf)])
        most = np.sqrt((v.astype(np.float64) ** 2).sum(1).max()) if len(v) else 0.0
        slack = 1e-5 * most * np.sqrt((q.astype(np.float64) ** 2).sum(1))
        q32, v32 = q.astype(np.float32), v.astype(np.float32)
        for at in range(0, len(qi), PAIRS):
            a, b = qi[at : at + PAIRS], vi[at : at + PAIRS]
            other = qid[a] != vid[b]
            a, b = a[other], b[other]
            rough = np.einsum("ij,ij->i", q32[a], v32[b])
            near = ~(rough < self.bar[slot[a]] - slack[a])  # kept where a float overflows
            a, b = a[near], b[near]
            self.held.append((slot[a], vid[b], exact_scores(q[a], v[b])))
            self.n += len(a)
            if self.n > HELD:
                self.shrink()

    def shrink(self) -> None:
        slot, ids, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keep = top(slot, ids, scores, self.k)
        slot, ids, scores = slot[keep], ids[keep], scores[keep]
        last = np.flatnonzero(np.concatenate([slot[1:] != slot[:-1], [True]])) if len(slot) else np.zeros(0, np.int64)
        count = np.bincount(slot, minlength=len(self.bar))
        full = last[count[slot[last]] >= self.k]
        self.bar[slot[full]] = scores[full]
        self.held, self.n = [(slot, ids, scores)], 0

    def rows(self) -> pa.RecordBatch:
        if not self.held:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        self.shrink()
        slot, ids, scores = self.held[0]
        names = np.fromiter(self.slots, np.int64, len(self.slots))
        return pa.RecordBatch.from_arrays([pa.array(names[slot]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def pairs_of(asked: np.ndarray, lists: list[np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, places): all pairs of a query and a place of the sorted `cells` that it asks for."""
    who = np.repeat(asked, [len(x) for x in lists])
    code = np.concatenate([*lists, np.zeros(0, np.int64)])
    low, high = np.searchsorted(cells, code, "left"), np.searchsorted(cells, code, "right")
    n = high - low
    begin = np.cumsum(n) - n
    return np.repeat(who, n), np.repeat(low - begin, n) + np.arange(n.sum())


def smallest_of_equal(ids: np.ndarray, cells: np.ndarray, raw: list[bytes], most: int) -> np.ndarray:
    """Places to keep, by cell: of equal vectors the `most` smallest ids."""
    order = np.lexsort((ids, cells))
    seen: dict[bytes, int] = {}
    keep = []
    for i in order.tolist():
        n = seen.get(raw[i], 0)
        if n < most:
            seen[raw[i]] = n + 1
            keep.append(i)
    return np.array(keep, np.int64)


def reduce_best(found: DataFrame, k: int) -> DataFrame:
    """The k best different candidates of each query. Rows first shrink to k per query and part."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours of a bounded list of queries, in one pass over all rows."""
    bounded_batches(vectors.sparkSession, 4096)
    ids = np.array([i for i, _ in queries], np.int64)
    q = np.array([x for _, x in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                best.add(ids, q, b.column(0).to_numpy(), v, np.repeat(np.arange(len(q)), len(v)), np.tile(np.arange(len(v)), len(q)))
        yield best.rows()

    return reduce_best(vectors.mapInArrow(run, FOUND), k)


def calibrate(vectors: DataFrame, t: Tables, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """The number of probes at which `target` of the sampled rows' true neighbours are collected."""
    picked = [(r.vec_id, r.embedding) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    if not picked:
        return 1
    true = brute_force(vectors, picked, k)
    near = true.join(vectors, "vec_id").select("query_id", "embedding").collect()  # sample * k rows
    if not near:
        return 1
    code, score = t.probes(np.array([x for _, x in picked]))
    order = {i: dict(zip(c[by].tolist(), range(1, len(by) + 1), strict=True)) for (i, _), c, by in zip(picked, code, np.argsort(-score, 1, kind="stable"), strict=True)}
    at = t.cell(np.array([r.embedding for r in near])) + np.arange(t.tables) * t.cells
    all_probes = code.shape[1]
    need = sorted(min(order[r.query_id].get(c, all_probes) for c in row) for r, row in zip(near, at.tolist(), strict=True))
    return need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]


def meet(blocks: DataFrame, k: int, kind: np.dtype) -> DataFrame:
    """FOUND of rows BLOCK: the k best per query and task, of vectors whose cell a query of the same block asks for."""
    bounded_batches(blocks.sparkSession, 4096)
    ordered = blocks.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for t, _ in sorted_runs(batches, ["g", "i", "j"]):
            asks = t.column("asks").to_numpy()
            ids, n = t.column("id").to_numpy(), int(len(asks) - asks.sum())
            if n == 0 or n == len(asks):
                continue
            raw, cells = t.column("vec").to_pylist(), t.column("cells").to_pylist()
            own = np.frombuffer(b"".join(cells[:n]), np.int64)
            keep = smallest_of_equal(ids[:n], own, raw[:n], k + 1)
            v = np.frombuffer(b"".join([raw[i] for i in keep.tolist()]), kind).reshape(len(keep), -1)
            q = np.frombuffer(b"".join(raw[n:]), kind).reshape(len(ids) - n, -1)
            lists = [np.frombuffer(c, np.int64) for c in cells[n:]]
            low, pairs = 0, np.cumsum([len(x) for x in lists])
            while low < len(lists):  # queries whose probes are looked up together
                high = max(low + 1, int(np.searchsorted(pairs, (pairs[low - 1] if low else 0) + PAIRS)))
                qi, vi = pairs_of(np.arange(low, high), lists[low:high], own[keep])
                best.add(ids[n:], q, ids[:n][keep], v, qi, vi)
                low = high
            if len(best.slots) > HELD // 4:
                yield best.rows()
                best = Best(k)
        yield best.rows()
        best = raw = cells = v = q = lists = None
        give_back()

    return ordered.mapInArrow(run, FOUND)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, depth: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product among all other rows."""
    spark = embeddings.sparkSession
    v = clean(embeddings)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.min(norm).alias("least"), F.max(norm).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not most:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = most[0].d, most[0].n
    v = v.where(F.size("embedding") == d)
    q = clean(queries).where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    spread = math.isinf(most[0].most) or most[0].most > 1.0001 * most[0].least
    t = Tables(d, axes_for(n, padded(d)), math.sqrt(most[0].most) if spread else None, tables)
    depth = depth or calibrate(v, t, k)
    kind = np.dtype(np.float32 if isinstance(v.schema["embedding"].dataType.elementType, FloatType) else np.float64)
    # a group is a range of first axes of one table, about BLOCK_ROWS rows if they lie evenly
    ranges = min(2 * t.wide, -(-n // BLOCK_ROWS))
    first = t.cells // (2 * t.wide)
    bounded_batches(spark, 4096)

    def group(code: np.ndarray) -> np.ndarray:
        table, cell = code // t.cells, code % t.cells
        return (table * ranges + cell // first * ranges // (2 * t.wide)).astype(np.int32)

    def codes(b: pa.RecordBatch) -> np.ndarray:
        return t.cell(matrix(b.column(1))) + np.arange(t.tables) * t.cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(t.tables * ranges, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(group(codes(b)).ravel(), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["g", "n"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code, m = codes(b), matrix(b.column(1)).astype(kind)
                g, vec = group(code), pa.array([x.tobytes() for x in m], pa.binary())
                for table in range(t.tables):
                    own = pa.array([x.tobytes() for x in code[:, table]], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(g[:, table]), b.column(0), vec, own], ["g", "id", "vec", "cells"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                m = matrix(part.column(1)).astype(kind)
                code = t.deepest(m, depth)
                g = group(code)
                out: list[list] = [[], [], [], []]
                for i, (own, gs) in enumerate(zip(code, g, strict=True)):
                    by = np.argsort(gs, kind="stable")
                    cut = np.flatnonzero(np.diff(gs[by])) + 1
                    for some in np.split(by, cut):
                        for x, y in zip(out, (int(gs[some[0]]), part.column(0)[i].as_py(), m[i].tobytes(), np.sort(own[some]).tobytes()), strict=True):
                            x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["g", "id", "vec", "cells"])

    # tables * ranges groups: their sizes are small, however many rows there are
    sizes = v.mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 0")
    # a query's probes cost more than its bytes tell, so queries are spread over all cores
    asked = written(q.repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(ask, "g int, id long, vec binary, cells binary"), "asked")
    sizes = sizes.join(asked.groupBy("g").agg(F.count("*").alias("m")), "g")
    sizes = F.broadcast(sizes.select("g", F.ceil(F.col("n") / (2 * BLOCK_ROWS)).cast("int").alias("rb"), F.ceil(F.col("m") / BLOCK_QUERIES).cast("int").alias("qb")))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = v.mapInArrow(index, "g int, id long, vec binary, cells binary").join(sizes, "g").select("g", own("rb").alias("i"), each("qb").alias("j"), F.lit(False).alias("asks"), "id", "vec", "cells")
    wants = asked.join(sizes, "g").select("g", each("rb").alias("i"), own("qb").alias("j"), F.lit(True).alias("asks"), "id", "vec", "cells")
    found = written(reduce_best(meet(rows.unionByName(wants), k, kind), k), "found")

    few = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = written(q.join(few, "vec_id", "left_anti"), "short")
    m = short.count()
    if not m or n < 2:
        return found
    rb, qb = -(-n // BLOCK_ROWS), -(-m // BLOCK_QUERIES)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(1, np.int64).tobytes()
        for b in batches:
            if b.num_rows:
                vec = pa.array([x.tobytes() for x in matrix(b.column(1)).astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), vec, pa.array([zero] * b.num_rows, pa.binary())], ["id", "vec", "cells"])

    form = "id long, vec binary, cells binary"
    block = lambda c: F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    rows = v.mapInArrow(plain, form).select(F.lit(0).alias("g"), block(rb).alias("i"), all_of(qb).alias("j"), F.lit(False).alias("asks"), "id", "vec", "cells")
    wants = short.mapInArrow(plain, form).select(F.lit(0).alias("g"), all_of(rb).alias("i"), block(qb).alias("j"), F.lit(True).alias("asks"), "id", "vec", "cells")
    more = reduce_best(meet(rows.unionByName(wants), k, kind), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(more)
