"""Removal of repeated byte strings, by deep-shallow suffix sorting.

Every byte of a document that is covered by a string of WIDTH bytes which also starts in a document with a
smaller doc_id is removed; strings are judged on the input, and matches never cross documents.

1. Of texts with equal bytes only those with the smallest doc_id go on; the others lose every byte if they
   have WIDTH or more.
2. Anchors: among the GRAM-byte grams inside a string, the one with the smallest hash (the leftmost on ties)
   is its anchor, so equal strings have equal anchors at equal offsets, and about one byte in 16 is one. Anchor
   hashes meet in buckets; only anchors whose gram occurs in two documents or more go on. That filter loses
   nothing. A gram found repeated within one task is sent on once, so a gram that a third of all documents
   share does not gather in one task.
3. Around each such anchor all its strings lie within one short context. Equal contexts are taken together:
   in order of doc_id, later documents lose the strings of a context seen before. A task that meets a context
   again, in a document with a larger doc_id, sends on only that its strings go: so a passage that a third of all
   documents share reaches the task of its gram about once per task before, not once per document. The strings of the
   contexts left under a gram are suffixes of those contexts and are sorted: multikey quicksort (8 bytes at a
   time, all groups of a round together) to SHALLOW bytes, then blind tries for the groups that remain. Equal
   strings stand next to each other, and those of a document above the smallest are removed.

Defined cases: a null text is empty; texts under WIDTH bytes keep all bytes; rows repeated under one doc_id
remove nothing from each other; a null doc_id counts as the largest; an empty table gives no rows; other
columns are ignored; whole texts are used whatever their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, give_back, written

WIDTH, GRAM, SHALLOW = 50, 20, 24
LAST = (1 << 63) - 1
U = np.uint64
#: Bits of a packed word that hold a position; longer texts are taken in parts.
PLACE = U((1 << 26) - 1)
#: Bytes of text whose anchors meet in one bucket, anchors held before they are sent, strings sorted at a time,
#: contexts that a task remembers, bytes of text whose contexts meet in one task.
BUCKET_BYTES, HELD, AT_ONCE, REMEMBERED, TASK_BYTES = 8 << 20, 1 << 19, 1 << 18, 1 << 16, 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the k bytes at each place, by doubling."""
    n, base, power = len(b) - k + 1, 0x100000001B3, {}
    power[1] = b.astype(np.uint64) + U(1)
    size = 1
    while size * 2 <= k:
        h = power[size]
        power[size * 2] = h[:-size] * U(pow(base, size, 1 << 64)) + h[size:]
        size *= 2
    out, done = power[size][:n], size
    for part in sorted(power, reverse=True):
        while done + part <= k:
            out = out * U(pow(base, part, 1 << 64)) + power[part][done : done + n]
            done += part
    return mix(out)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, v
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(m) - (w - size)], m[w - size :])


def anchors(b: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): an anchor's gram, and the first and last start of the strings it stands for."""
    out: list[tuple] = []
    part = int(PLACE) // 2
    for low in range(0, len(b) - width + 1, part):
        x = b[low : low + part + width - 1]
        h = gram_hashes(x, gram)
        m = sliding_min((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), width - gram + 1)
        at = (m & PLACE).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        out.append((h[at[first]], at[first] + low, first + low, np.concatenate([cut, [len(at)]]) - 1 + low))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# suffix sorting


class BlindTrie:
    """Orders strings that share a prefix: inner nodes hold only a length and branch bytes.

    A string goes down by branch bytes alone; one comparison, with the leaf it comes to, gives the true common
    length, and so the node where it branches off."""

    def __init__(self, data: bytes, width: int):
        self.data, self.width, self.root = data, width, None

    def insert(self, name: int, at: int) -> None:
        data, width = self.data, self.width
        if self.root is None:
            self.root = [width, at, [name]]
            return
        node, path = self.root, []
        while node[0] < width:
            path.append(node)
            child = node[2].get(data[at + node[0]])
            node = child if child is not None else next(iter(node[2].values()))
        leaf = node
        while leaf[0] < width:
            leaf = next(iter(leaf[2].values()))
        other, n = leaf[1], 0
        while n < width and data[at + n] == data[other + n]:
            n += 1
        if n == width:
            leaf[2].append(name)
            return
        parent, node = None, self.root
        while node[0] < n:
            parent, node = node, node[2][data[at + node[0]]] if data[at + node[0]] in node[2] else None
            if node is None:
                break
        fresh = [width, at, [name]]
        if node is not None and node[0] == n:
            node[2][data[at + n]] = fresh
            return
        inner = [n, at, {data[at + n]: fresh}]
        if node is not None:
            inner[2][data[other + n]] = node
        if parent is None:
            self.root = inner
        else:
            parent[2][data[at + parent[0]]] = inner

    def leaves(self) -> Iterator[list[int]]:
        """Names of equal strings, in string order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] >= self.width:
                yield node[2]
            else:
                stack += [node[2][c] for c in sorted(node[2], reverse=True)]


def deep_shallow(data: np.ndarray, pos: np.ndarray, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): places of `pos` sorted by the `width` bytes there, and for each place in that order a
    number that equal strings share. `data` must reach `width` bytes beyond every position."""
    if width < 8:
        raise ValueError("strings of 8 bytes or more are sorted")
    n = len(pos)
    order, head = np.arange(n), np.ones(n, bool)
    if n < 2:
        return order, np.zeros(n, np.int64)
    word = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << U(8 * size)) | word[size:]
    shallow = min(shallow, width) // 8 * 8
    deep: list[tuple[int, int]] = []
    # rows of the open groups in group order; each group has where it starts in `order`, its size and depth
    rows, start, size, depth = np.arange(n), np.array([0]), np.array([n]), np.array([0])
    while len(rows):
        if (done := depth >= shallow).any():
            keep = np.repeat(~done, size)
            at = np.repeat(start, size) + (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))
            order[at[~keep]] = rows[~keep]
            deep += list(zip(start[done].tolist(), size[done].tolist(), strict=True))
            rows, start, size, depth = rows[keep], start[~done], size[~done], depth[~done]
            continue
        own = np.repeat(np.arange(len(size)), size)
        key = word[pos[rows] + depth[own]]
        low = np.cumsum(size) - size
        three = np.sort(np.stack([key[low], key[low + size // 2], key[low + size - 1]]), 0)
        pivot = three[1][own]
        code = own * 3 + np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        by = np.argsort(code, kind="stable")
        rows, code = rows[by], code[by]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        new_size = np.diff(np.concatenate([first, [len(rows)]]))
        parent = code[first] // 3
        new_start = start[parent] + first - low[parent]
        head[new_start] = True
        new_depth = depth[parent] + 8 * (code[first] % 3 == 1)
        alone = new_size == 1
        order[new_start[alone]] = rows[first[alone]]
        keep = np.repeat(~alone, new_size)
        rows, start, size, depth = rows[keep], new_start[~alone], new_size[~alone], new_depth[~alone]
    # from here `head` marks where a group of equal prefixes starts
    head[:] = True
    if deep:
        deep.sort()
        lows, sizes = np.array([a for a, _ in deep]), np.array([s for _, s in deep])
        inside = np.repeat(lows, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        lead = pos[order[np.repeat(lows, sizes)]]
        mine, same = pos[order[inside]], np.ones(len(inside), bool)
        for d in [*range(shallow, width - 7, 8), *([width - 8] if (width - shallow) % 8 else [])]:
            same &= word[mine + d] == word[lead + d]
        at = np.cumsum(sizes) - sizes
        equal = np.logical_and.reduceat(same, at)
        head[inside] = False
        head[lows] = True
        raw = data.tobytes() if not equal.all() else b""
        for a, s in zip(lows[~equal].tolist(), sizes[~equal].tolist(), strict=True):
            trie = BlindTrie(raw, width)
            for name in order[a : a + s].tolist():
                trie.insert(name, int(pos[name]))
            for names in trie.leaves():
                order[a : a + len(names)] = names
                head[a] = True
                a += len(names)
    return order, np.cumsum(head) - 1


# the filter on anchors


def packed(hashes: np.ndarray, rows: np.ndarray, places: np.ndarray) -> bytes:
    names, ref = np.unique(rows, return_inverse=True)
    return b"".join([np.array([len(hashes), len(names)], np.uint32).tobytes(), names.astype(np.int64).tobytes(), hashes.tobytes(), ref.astype(np.uint32).tobytes(), places.astype(np.uint32).tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    names = np.frombuffer(blob, np.int64, m, 8)
    hashes = np.frombuffer(blob, np.uint64, n, 8 + 8 * m)
    ref = np.frombuffer(blob, np.uint32, n, 8 + 8 * (m + n))
    return hashes, names[ref], np.frombuffer(blob, np.uint32, n, 8 + 8 * m + 12 * n)


def repeated(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, mask in that order): whether a hash occurs with two documents or more."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    return order, np.repeat(many, np.diff(np.concatenate([first, [len(h)]])))


def by_row(rows: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(rows, kind="stable")
    rows, places = rows[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(rows)]]).astype(np.int32)), pa.array(places.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(rows[first], pa.int64()), lists], ["row", "places"])


def shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(row, places) of (row, text): anchors whose gram occurs in two rows or more. A row may come more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn
            h, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, many = repeated(h, r)
            h, r, p = h[order], r[order], p[order]
            lead = many & np.concatenate([[True], h[1:] != h[:-1]])
            to, known, blobs = [], [], []
            for mask, sure in ((~many | lead, False), (many, True)):
                x, y, z = h[mask], r[mask], p[mask]
                bucket = x >> U(64 - max(1, (buckets - 1).bit_length()))
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for a, e in zip([0, *cuts], [*cuts, len(x)], strict=True):
                    if e > a:
                        to.append((int(bucket[a]) + turn) % buckets if sure else int(bucket[a]))
                        known.append(sure)
                        blobs.append(packed(x[a:e], y[a:e], z[a:e]))
                turn += sure
            return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(known), pa.array(blobs, pa.binary())], ["bucket", "known", "blob"])

        for b in batches:
            for row, text in zip(b.column(0), b.column(1), strict=True):
                h, place, _, _ = anchors(np.frombuffer(text.as_buffer(), np.uint8))
                held.append((h, np.full(len(h), row.as_py()), place))
                n += len(h)
                if n >= HELD:
                    yield flush()
                    n = 0
        if n:
            yield flush()
        give_back()

    sent = texts.mapInArrow(send, "bucket int, known boolean, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, r, p = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order, many = repeated(h, r)
                at = order[many]
                if len(at):
                    yield by_row(r[at], p[at])

        for b in batches:
            for bucket, known, blob in zip(*b.columns, strict=True):
                h, r, p = unpacked(blob.as_buffer().to_pybytes())
                if known.as_py():
                    yield by_row(r, p)
                    continue
                if bucket.as_py() != last:
                    yield from flush()
                    last = bucket.as_py()
                held.append((h, r, p))
        yield from flush()
        give_back()

    return sent.mapInArrow(meet, "row long, places array<bigint>")


# contexts and their strings


def one_each(raw: np.ndarray, h: np.ndarray, offset: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """(places to keep, packed other starts of each): a text's equal contexts are sent once, as repeated words give many."""
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[inverse] > 1)
    if not len(often):
        return np.arange(len(h)), [None] * len(h)
    same: dict[tuple, list[int]] = {}
    for i in often.tolist():
        same.setdefault((int(h[i]), int(offset[i]), raw[first[i] : first[i] + size[i]].tobytes()), []).append(i)
    others = {p[0]: first[p[1:]].astype(np.int64).tobytes() for p in same.values() if len(p) > 1}
    drop = [i for p in same.values() for i in p[1:]]
    keep = np.delete(np.arange(len(h)), drop)
    return keep, [others.get(i) for i in keep.tolist()]


def contexts(texts: DataFrame) -> DataFrame:
    """(gram, doc, row, first, offset, context, more) of (row, doc, text, places): an anchor's strings lie within the
    context, which starts at `first`; `more` packs the other places where the row has the same context. A null context
    says that the `offset` bytes from `first` go, as a smaller doc has the same in this task; its gram is any number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        smallest: dict[tuple[int, bytes], int] = {}  # the smallest doc sent on for a context
        for b in batches:
            found: list[tuple] = []
            bodies: list[np.ndarray] = []
            more: list[bytes | None] = []
            gone: list[np.ndarray] = []
            for row, doc, text, places in zip(*b.columns, strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                h, at, first, last = anchors(raw)
                keep = np.isin(at, np.asarray(places.values))
                h, at, first, size = h[keep], at[keep], first[keep], (last - first + WIDTH)[keep]
                if not len(h):
                    continue
                keep, again = one_each(raw, h, at - first, first, size)
                h, at, first, size = h[keep], at[keep], first[keep], size[keep]
                more += again
                own, data, known = doc.as_py(), raw.tobytes(), np.zeros(len(h), bool)
                offset = (at - first).astype(np.int32)
                for i, (o, a, n) in enumerate(zip(offset.tolist(), first.tolist(), size.tolist(), strict=True)):
                    c = (o, data[a : a + n])
                    seen = smallest.get(c)
                    if seen is not None and seen < own:
                        known[i] = True
                    elif seen is None or own < seen:
                        smallest[c] = own
                if len(smallest) > REMEMBERED:
                    smallest.clear()
                gram = h.view(np.int64)
                if known.any():
                    gram = np.where(known, mix(np.full(len(h), row.as_py()).view(np.uint64)).view(np.int64), gram)
                    offset = np.where(known, size, offset).astype(np.int32)
                    size = np.where(known, 0, size)
                if (end := np.cumsum(size))[-1]:
                    bodies.append(raw[np.repeat(first - (end - size), size) + np.arange(end[-1])])
                gone.append(known)
                found.append((gram, np.full(len(h), own), np.full(len(h), row.as_py()), first, offset, size))
            if not found:
                continue
            *columns, size = (np.concatenate(x) for x in zip(*found, strict=True))
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            there = pa.py_buffer(np.packbits(~np.concatenate(gone), bitorder="little").tobytes())
            ctx = pa.Array.from_buffers(pa.binary(), len(size), [there, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(x.tobytes() for x in bodies))])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ctx, pa.array(more, pa.binary())], ["gram", "doc", "row", "first", "offset", "context", "more"])

    return texts.select("row", "doc", "text", "places").mapInArrow(run, "gram long, doc long, row long, first long, offset int, context binary, more binary")


def sorted_strings(held: list[tuple[int, int, bytes]], width: int = WIDTH) -> list[np.ndarray]:
    """For each context (doc, offset, bytes), which of its strings occur in a context of a smaller doc."""
    data = np.frombuffer(b"".join(c for _, _, c in held) + b"\0" * 8, np.uint8)
    count = np.array([len(c) - width + 1 for _, _, c in held])
    begin = np.cumsum([0, *(len(c) for _, _, c in held[:-1])])
    owner = np.repeat(np.arange(len(held)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    doc = np.array([d for d, _, _ in held])[owner]
    out = np.zeros(len(owner), bool)
    # strings with different anchor offsets can't be equal, so a large set may be sorted offset by offset
    offset = np.array([o for _, o, _ in held])[owner] - nth
    sets = [np.arange(len(owner))] if len(owner) <= AT_ONCE else np.split(np.argsort(offset, kind="stable"), np.flatnonzero(np.diff(np.sort(offset))) + 1)
    for some in sets:
        order, group = deep_shallow(data, (begin[owner] + nth)[some], width)
        ranked = some[order]
        least = np.full(group[-1] + 1 if len(group) else 0, LAST)
        np.minimum.at(least, group, doc[ranked])
        out[ranked] = doc[ranked] > least[group]
    return np.split(out, np.cumsum(count)[:-1])


def removed_spans(ctx: DataFrame, parts: int) -> DataFrame:
    """(row, start, stop) of the strings to remove, some of them overlapping."""

    ordered = ctx.repartition(parts, "gram").sortWithinPartitions("gram", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        waiting: list[tuple[tuple[int, int, bytes], list[tuple[int, int]]]] = []
        strings = 0

        def flush() -> pa.RecordBatch:
            nonlocal strings
            if waiting:
                for (_, places), gone in zip(waiting, sorted_strings([c for c, _ in waiting]), strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    for a, z in edge.reshape(-1, 2).tolist():
                        out.extend((row, first + a, first + z - 1 + WIDTH) for row, first in places)
                waiting.clear()
                strings = 0
            rows = list(zip(*out, strict=True)) if out else [[], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["row", "start", "stop"])
            out.clear()
            return batch

        seen: dict[tuple[int, bytes], tuple[int, list]] = {}
        last = None

        def close() -> None:
            nonlocal strings
            if len(seen) > 1:
                for (offset, c), (doc, places) in seen.items():
                    waiting.append(((doc, offset, c), places))
                    strings += len(c) - WIDTH + 1
            seen.clear()

        for b in batches:
            gram, doc, row, first, offset = (b.column(i).to_numpy().tolist() for i in range(5))
            for g, d, r, f, o, c, m in zip(gram, doc, row, first, offset, b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                starts = [f] if m is None else [f, *np.frombuffer(m, np.int64).tolist()]
                if c is None:
                    out.extend((r, x, x + o) for x in starts)
                    continue
                if g != last:
                    close()
                    last = g
                    if strings >= AT_ONCE:
                        yield flush()
                known = seen.get((o, c))
                if known is None:
                    seen[o, c] = (d, [(r, x) for x in starts])
                elif known[0] == d:
                    known[1].extend((r, x) for x in starts)
                else:
                    out.extend((r, x, x + len(c)) for x in starts)
            if len(out) > 1 << 16:
                yield flush()
        close()
        yield flush()
        give_back()

    return ordered.mapInArrow(run, "row long, start long, stop long")


def dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): removed is array<struct<start, stop>> of byte spans, kept the bytes left."""
    spark = documents.sparkSession
    bounded_batches(spark, 128)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(LAST)), "key": F.md5(F.col("text").cast("binary")), "row": F.xxhash64("doc_id", "text"), "n_bytes": F.octet_length("text").cast("long")})
    copies = written(docs.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "copies")
    docs = docs.join(broadcast_if_small(copies), "key", "left").withColumn("is_copy", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)) & (F.col("n_bytes") >= WIDTH))
    own = docs.where(~F.col("is_copy"))
    texts = own.where(F.col("n_bytes") >= WIDTH).select("row", "doc", "text")
    size = docs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = 1 << max(3, (size // BUCKET_BYTES).bit_length())
    shared = written(shared_anchors(texts.select("row", "text"), buckets), "anchors")
    places = shared.groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)
    spans = removed_spans(contexts(texts.join(places, "row")), parts)
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    per_row = written(per_row, "spans")
    ids = broadcast_if_small(per_row.select("row"))
    some = own.join(ids, "row", "left_semi").join(per_row, "row").select("doc_id", "n_bytes", "text", "spans")
    none = own.join(ids, "row", "left_anti").select("doc_id", "n_bytes", F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("removed"), F.col("text").cast("binary").alias("kept"))
    whole = docs.where("is_copy").select("doc_id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("removed"), F.lit(b"").alias("kept"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, spans in zip(b.column(2), b.column(3), strict=True):
                raw, flat = text.as_buffer().to_pybytes(), spans.values.flatten()
                merged: list[list[int]] = []
                for a, z in zip(flat[0].to_numpy().tolist(), flat[1].to_numpy().tolist(), strict=True):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                left, at = [], 0
                for a, z in merged:
                    left.append(raw[at:a])
                    at = z
                removed.append([{"start": a, "stop": z} for a, z in merged])
                kept.append(b"".join([*left, raw[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    part = some.mapInArrow(cut, none.schema)
    return part.unionByName(none).unionByName(whole)
