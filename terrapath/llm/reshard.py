"""Resharding by minimum-cost flow.

Old shard sizes and new capacities make a transport problem: a byte that stays costs nothing, one
that moves costs 1. Documents are grouped into blocks (BLOCKS per old shard, by hash of the text,
so equal texts stay together); the solver sees at most old shards x BLOCKS sizes however large the
data. Groups of equal texts above half a shard are split over blocks by doc_id, so one text may
hold a third of all rows. Every step but the solver is a Spark plan, and only shards that gain or
lose blocks are rewritten: their rows go through one shuffle, by new shard, that serves the slots and
the files; the new files lie ready beside the old ones, and a journal lets `recover` finish a swap
that broke off.

Defined cases: a null text has size 8 and the CRC of no bytes (0); repeated rows and null or repeated
doc_ids are all kept and get slots of their own; an empty table gives no rows; other columns are ignored,
but for those that `carry` names."""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table

#: Blocks per old shard, and parts that the rows of a frequent text are ranked in.
BLOCKS, PARTS = 1024, 32
#: Bytes of a shard's file, about.
FILE_BYTES = 256 << 20


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """Bytes per (old shard, new shard), moving the fewest, by successive shortest paths with potentials.

    The total capacity must be at least the total supply."""
    if sum(capacity.values()) < sum(supply.values()):
        raise ValueError("the new capacities hold less than the old shards")
    source, sink = ("s",), ("t",)
    graph: dict = {}

    def arc(u, v, cap, cost):
        graph.setdefault(u, []).append([v, cap, cost, len(graph.setdefault(v, []))])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for i, s in sorted(supply.items()):
        arc(source, ("o", i), s, 0)
        for j in sorted(capacity):
            arc(("o", i), ("n", j), s, 0 if i == j else 1)
    for j, c in sorted(capacity.items()):
        arc(("n", j), sink, c, 0)
    left, potential = sum(supply.values()), dict.fromkeys(graph, 0)
    while left:
        dist, back, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                if cap and (nd := d + cost + potential[u] - potential[v]) < dist.get(v, 1 << 62):
                    dist[v], back[v] = nd, (u, k)
                    heapq.heappush(queue, (nd, v))
        far = max(dist.values())
        for v in graph:
            potential[v] += dist.get(v, far)
        path, v = [], sink
        while v != source:
            u, k = back[v]
            path.append((u, k))
            v = u
        push = min([left, *(graph[u][k][1] for u, k in path)])
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
        left -= push
    return {(u[1], v[1]): graph[v][r][1] for u in graph if u[0] == "o" for v, _, _, r in graph[u] if v[0] == "n" and graph[v][r][1]}


def assign_blocks(blocks: dict[tuple[int, int], int], capacity: dict[int, int]) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block): the flow's byte amounts are met largest block first.

    Whole blocks can't meet amounts exactly; what fits none goes to the emptiest shard, its own on ties."""
    supply: dict[int, int] = {}
    for (i, _), size in blocks.items():
        supply[i] = supply.get(i, 0) + size
    amounts = min_cost_flow(supply, capacity)
    room, to, rest = dict(capacity), {}, []
    by_old: dict[int, list] = {}
    for (i, b), size in blocks.items():
        by_old.setdefault(i, []).append((-size, b))
    for i, own in sorted(by_old.items()):
        open_arcs = {j: a for (o, j), a in amounts.items() if o == i}
        for size, b in sorted(own):
            fits = [j for j, a in open_arcs.items() if a >= -size]
            if not fits:
                rest.append((size, i, b))
                continue
            j = max(fits, key=lambda j: (open_arcs[j], j == i, -j))
            open_arcs[j] += size
            room[j] += size
            to[i, b] = j
    for size, i, b in sorted(rest):
        j = max(room, key=lambda j: (room[j], j == i, -j))
        room[j] += size
        to[i, b] = j
    return to


def sizes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def planned(documents: DataFrame, shards: int = 24, old_shards: int = 16, old: Column | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[int]]:
    """Rows (doc_id, size, text_crc32, old_shard, shard, slot, and the columns `carry` names), and the shards that gain
    or lose rows. The rows of a shard lie in few partitions, about FILE_BYTES each.

    `old` gives a row's present shard, 0 to old_shards - 1; without it, a hash of the text does."""
    spark = documents.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    kept = [F.col(c).alias(f"__{c}") for c in carry]
    rows = documents.select("doc_id", sizes(F.col("text")).alias("size"), crc.cast("long").alias("text_crc32"), th.alias("th"), (old if old is not None else F.pmod(th, F.lit(old_shards))).cast("int").alias("old_shard"), *kept)
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    share = rows.agg(F.sum("size")).first()[0]
    if not share:
        empty = rows.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
        return empty.select(*names, *[F.col(f"__{c}").alias(c) for c in carry]), []
    # texts whose copies weigh more than 1/64 of a shard (64 * shards of them at most) are ranked in parts, and those
    # above half a shard are dealt to all blocks
    weight = rows.groupBy("th").agg(F.sum("size").alias("all")).where(F.col("all") > share / (64 * shards)).select("th", (F.col("all") > share / (2 * shards)).alias("dealt"))
    one = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))
    rows = rows.join(F.broadcast(weight), "th", "left")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("th", F.when(F.col("dealt"), F.col("doc_id"))), F.lit(BLOCKS)).cast("int"), "part": F.when(F.col("dealt").isNotNull(), one).otherwise(0).cast("int")})
    table = rows.groupBy("old_shard", "block", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # bounded, see above
    blocks: dict[tuple[int, int], int] = {}
    for r in table:
        blocks[r.old_shard, r.block] = blocks.get((r.old_shard, r.block), 0) + r.size
    each = -(-share // shards)
    to = assign_blocks(blocks, dict.fromkeys(range(shards), each))
    offset, moves = dict.fromkeys(range(shards), 0), []
    for r in sorted(table, key=lambda r: (r.old_shard, r.block, r.part)):
        j = to[r.old_shard, r.block]
        moves.append((r.old_shard, r.block, r.part, j, offset[j]))
        offset[j] += r.n
    plan = F.broadcast(spark.createDataFrame(moves, "old_shard int, block int, part int, shard int, first long"))
    files = -(-each // FILE_BYTES)
    placed = rows.join(plan, ["old_shard", "block", "part"]).withColumn("file", F.pmod(F.xxhash64("old_shard", "block", "part"), F.lit(files)).cast("int"))
    # dealt by shard and file already, so the ranking needs no shuffle of its own
    rank = F.row_number().over(Window.partitionBy("shard", "file", "old_shard", "block", "part").orderBy("doc_id", "th"))
    ranked = placed.repartition("shard", "file").withColumn("slot", (F.col("first") + rank - 1).cast("long"))
    affected = {s for o, b, _, j, _ in moves if o != j for s in (o, j)}
    return ranked.select(*names, *[F.col(f"__{c}").alias(c) for c in carry]), sorted(affected)


def reshard(documents: DataFrame, shards: int = 24, old_shards: int = 16, old: Column | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) with shards of near equal bytes."""
    return planned(documents, shards, old_shards, old)[0]


def store(documents: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Write documents to files under `path`, one folder `shard=N` each, by hash of the text, and return them read back."""
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    documents.withColumn("shard", F.pmod(th, F.lit(shards)).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(documents.schema.add("shard", "integer")).parquet(path)


def files_of(spark, path: str):
    """The file system of `path`, and its constructor of paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def rewrite(rows: DataFrame, affected: list[int], path: str) -> list[int]:
    """Bring the files under `path` (one folder `shard=N` each) in line with `rows`, as `planned` gives them with the
    columns to store; returns the shards rewritten.

    Only `affected` shards are written again. They are staged under `path` in a folder that readers skip; then a
    journal is left and the folders are swapped. Whatever breaks off before the journal leaves the old files whole,
    and what breaks off after it is finished by `recover`."""
    if not affected:
        return []
    spark = rows.sparkSession
    stage = f"{path}/_stage-{uuid.uuid4().hex}"
    rows.where(F.col("shard").isin(affected)).drop("old_shard").write.partitionBy("shard").option("compression", "zstd").parquet(stage)
    fs, make = files_of(spark, path)
    full = [s for s in affected if fs.exists(make(f"{stage}/shard={s}"))]
    out = fs.create(make(f"{stage}.json.new"))
    out.write(bytearray(json.dumps({"stage": stage, "full": full, "empty": sorted(set(affected) - set(full))}).encode()))
    out.close()
    fs.rename(make(f"{stage}.json.new"), make(f"{stage}.json"))
    recover(spark, path)
    return affected


def recover(spark, path: str) -> None:
    """Finish the swaps whose journals lie under `path`; may be called again after any failure."""
    fs, make = files_of(spark, path)
    for status in fs.globStatus(make(f"{path}/_stage-*.json")) or []:
        journal = status.getPath().toString()
        text = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        stream, size = fs.open(make(journal)), status.getLen()
        todo = json.loads(bytes(stream.readNBytes(size)).decode())
        text.closeStream(stream)
        for s in todo["full"]:
            if fs.exists(make(f"{todo['stage']}/shard={s}")):  # else it is in place already
                drop_table(spark, f"{path}/shard={s}")
                move(fs, make(f"{todo['stage']}/shard={s}"), make(f"{path}/shard={s}"))
        for s in todo["empty"]:
            drop_table(spark, f"{path}/shard={s}")
        drop_table(spark, todo["stage"])
        drop_table(spark, journal)


def move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source.toString()} can't be moved to {target.toString()}")
