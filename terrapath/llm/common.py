"""What the corpus operators share: the shared folder, size-checked broadcasts,
bounded Arrow batches and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates words: whatever is neither a letter nor a number.
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A table of at most this many bytes may be broadcast.
BROADCAST_BYTES = 48 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing (a local session) is a temporary one made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrapath-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_table(spark, path)
        except Exception:  # the session may be gone; the folder's owner cleans up then
            return


atexit.register(_drop_all)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/terrapath-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """What a row weighs: 16 bytes, 8 per column, and what its strings and arrays hold."""
    size = F.lit(16 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            size += 16 * F.coalesce(F.size(f.name), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast an already written table if its bytes, counted first, are few; else leave the join to Spark."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most else df


def bounded_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> None:
    """Arrow batches of few rows and bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Return freed memory to the system: Python workers are used again, and their memory adds to the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Stretches of rows with equal keys of a sorted stream, and whether one carries on the stretch before it.

    With `most`, a stretch comes in parts of about that many rows."""
    held, n, last, part = [], 0, None, False
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        for a, z in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            now = tuple(c[a] for c in cols)
            if held and (now != last or most and n >= most):
                yield pa.Table.from_batches(held), part
                part = now == last
                held, n = [], 0
            elif now != last:
                part = False
            held.append(b.slice(a, z - a))
            n, last = n + int(z - a), now
    if held:
        yield pa.Table.from_batches(held), part


def words(text: Column) -> Column:
    """Lower-case words of a text, [] for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of longs: (id, component), the component being its smallest id.

    Each round every node takes its smallest neighbour (or itself), labels jump once, and the edges are drawn
    anew between labels, loops and copies left out. So edges shrink by half or more each round, and the rounds'
    maps, composed from the last to the first, give the components. Every round is a written table; only whether
    edges are left reaches the driver."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = written(edges.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not maps or e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("up")), "hook")
        above = hook.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jump = written(hook.join(above, "up").select("id", F.col("top").alias("up")), "jump")
        maps.append(jump)
        one = e.join(jump.select(F.col("id").alias("a"), F.col("up").alias("x")), "a").join(jump.select(F.col("id").alias("b"), F.col("up").alias("y")), "b")
        e = written(one.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    label = maps.pop().withColumnRenamed("up", "component")
    while maps:
        label = maps.pop().join(label.select(F.col("id").alias("up"), "component"), "up", "left").select("id", F.coalesce("component", "up").alias("component"))
    return label
