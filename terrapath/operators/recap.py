"""Recaps, zonal tables, agreement, scores and greedy choices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import Selection
from ..sources.scratch import few, written


def class_recap(cells: DataFrame, levels: DataFrame, value: str = "value", volume: str | None = None, res: float = 5.0) -> DataFrame:
    """(class, cells, area_ha, volume): every level, at 0 too, and a row `undetermined` for null, so areas add up.

    levels: (value, class), a small dimension. volume sums the layer as it is."""
    n = cells.groupBy(value).agg(F.count("*").alias("cells"), (F.sum(volume) if volume else F.lit(None).cast("double")).alias("volume"))
    every = levels.select(F.col("value").alias("__v"), "class").unionByName(levels.sparkSession.createDataFrame([(None, "undetermined")], "__v int, class string"))
    out = F.broadcast(every).join(n, F.col("__v").eqNullSafe(F.col(value)), "left")
    return out.select("class", F.coalesce("cells", F.lit(0)).cast("long").alias("cells"), (F.coalesce("cells", F.lit(0)) * (res * res) / 10000).alias("area_ha"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def medians(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median) of the values that are not null; the mean of the two middle ones where their number is even."""
    return rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.median(value).alias("median"))


def summary_lines(recap: DataFrame, title: str) -> DataFrame:
    """(line): a class recap (class, area_ha) for people to read, the classes' areas and their shares of the whole."""
    total = recap.agg(F.sum("area_ha").alias("total"))
    share = F.when(F.col("total") > 0, 100 * F.col("area_ha") / F.col("total")).otherwise(0.0)
    return recap.join(F.broadcast(total)).select(F.format_string("%s: %s %.4f ha (%.3f %%)", F.lit(title), "class", "area_ha", share).alias("line"))


def safe_name(x: str) -> str:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    out = "".join(c if c.isalnum() and c.isascii() else "_" for c in x.lower())
    return "_".join(p for p in out.split("_") if p)


def zonal_table(cells: DataFrame, zones: DataFrame, levels: Sequence[tuple[int, str]], zone: str = "zone", value: str = "value", volume: str | None = None, res: float = 5.0) -> DataFrame:
    """zones plus surface_<class>_ha and volume_<class>_m3 per class and surface_total_ha; zones without cells get 0.

    One aggregation with a conditional sum per class: no pivot pass to find the classes."""
    area = res * res / 10000
    sums = [F.sum(F.when(F.col(value) == v, 1).otherwise(0)).alias(f"__n{i}") for i, (v, _) in enumerate(levels)]
    if volume:
        sums += [F.sum(F.when(F.col(value) == v, F.col(volume))).alias(f"__v{i}") for i, (v, _) in enumerate(levels)]
    by = cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(*sums, F.count("*").alias("__all"))
    out = zones.join(by, zone, "left")
    cols = [(F.coalesce(f"__n{i}", F.lit(0)) * area).alias(f"surface_{safe_name(name)}_ha") for i, (_, name) in enumerate(levels)]
    if volume:
        cols += [F.coalesce(f"__v{i}", F.lit(0.0)).alias(f"volume_{safe_name(name)}_m3") for i, (_, name) in enumerate(levels)]
    return out.select(*zones.columns, *cols, (F.coalesce("__all", F.lit(0)) * area).alias("surface_total_ha"))


def confusion(pairs: DataFrame, ours: str, theirs: str, res: float = 5.0) -> DataFrame:
    """(ours, theirs, area_ha) over rows where both are known."""
    both = pairs.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    return both.groupBy(F.col(ours).alias("ours"), F.col(theirs).alias("theirs")).agg((F.count("*") * (res * res) / 10000).alias("area_ha"))


def agreement(pairs: DataFrame, ours: str, theirs: str, positive: Column, positive_theirs: Column, res: float = 5.0) -> DataFrame:
    """One row: overall and two-class agreement on the common mask, Jaccard of the positive class, and areas known to one side only."""
    area = res * res / 10000
    a, b = F.col(ours), F.col(theirs)
    both = a.isNotNull() & b.isNotNull()
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    p, q = F.coalesce(positive, F.lit(False)), F.coalesce(positive_theirs, F.lit(False))
    ratio = lambda x, y: F.when(y > 0, x / y)
    return pairs.agg(
        ratio(n(both & (a == b)), n(both)).alias("agreement"), ratio(n(both & (p == q)), n(both)).alias("agreement_two"), ratio(n(both & p & q), n(both & (p | q))).alias("jaccard"),
        (n(both) * area).alias("common_ha"), (n(a.isNotNull() & b.isNull()) * area).alias("ours_only_ha"), (n(a.isNull() & b.isNotNull()) * area).alias("theirs_only_ha"),
    )


def compare(actual: DataFrame, oracle: DataFrame, key: str, value: str, tol_abs: float = 0.0, tol_rel: float = 1e-6, eps: float = 1e-12) -> DataFrame:
    """One row (ok, same_nulls, max_abs, max_rel, n): nulls must match, and each value be within either tolerance."""
    j = actual.select(key, F.col(value).alias("a")).join(oracle.select(key, F.col(value).alias("o")), key, "full")
    diff = F.abs(F.col("a") - F.col("o"))
    rel = diff / F.greatest(F.abs("o"), F.lit(eps))
    same = F.coalesce(F.bool_and(F.col("a").isNull() == F.col("o").isNull()), F.lit(True))
    near = F.coalesce(F.bool_and((diff <= tol_abs) | (rel <= tol_rel)), F.lit(True))
    return j.agg((same & near).alias("ok"), same.alias("same_nulls"), F.max(diff).alias("max_abs"), F.max(rel).alias("max_rel"), F.count(diff).alias("n"))


def in_order(df: DataFrame, order: Sequence[Column], amount: str | None = None) -> DataFrame:
    """df plus __before: how many rows, or how much of `amount`, come before a row in a total order.

    Rows are dealt to ranges of the order, each a task; totals per range (one row each) shift the ranges, so no
    task sees all rows, as a window without partitions would."""
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    names = [f"__o{i}" for i in range(len(order))]
    # descending columns were turned by the caller, so all sort upward
    t = df.select("*", *keys).repartitionByRange(*names).withColumn("__p", F.spark_partition_id())
    t = written(t, "order")
    value = F.col(amount) if amount else F.lit(1)
    totals = t.groupBy("__p").agg(F.sum(value).alias("__t"))
    shift = totals.alias("a").join(totals.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.__t"), F.lit(0)).alias("__shift"))
    w = Window.partitionBy("__p").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    out = t.join(F.broadcast(shift), "__p").withColumn("__before", F.coalesce(F.sum(value).over(w), F.lit(0)) + F.col("__shift"))
    return out.drop("__p", "__shift", *names)


def line_scores(lines: DataFrame, choice: Selection) -> DataFrame:
    """lines within the limits plus score and rank. Lines: depart, azimuth, length_m, surface_ha, direction, supports, volume_m3, ipc.

    surface, volume and ipc count as share of their 98th percentile, supports and length as 1 less their share of
    the maximum; without volumes, volume and ipc do not count. Preferred direction first, then score, ties by depart and azimuth."""
    known = lines.agg(F.coalesce(F.max(F.col("volume_m3") > 0), F.lit(False))).first()[0]
    ok = (F.col("surface_ha") >= choice.surface_min) & (F.col("supports") <= choice.supports_max) & F.col("length_m").between(choice.length_min, choice.length_max)
    if known:
        ok = ok & (F.col("volume_m3") >= choice.volume_min) & (F.col("ipc") >= choice.ipc_min)
    kept = lines.where(ok)
    more = [("surface_ha", "surface"), *([("volume_m3", "volume"), ("ipc", "ipc")] if known else [])]
    more = [(c, choice.weights[k]) for c, k in more if choice.weights[k] > 0]
    less = [(c, choice.weights[k]) for c, k in (("supports", "supports"), ("length_m", "length")) if choice.weights[k] > 0]
    stats = kept.agg(F.count("*").alias("__n"), *[F.percentile(c, F.lit(0.98)).alias(f"__p_{c}") for c, _ in more], *[F.max(c).alias(f"__m_{c}") for c, _ in less])
    j = kept.join(F.broadcast(stats))
    score = F.lit(0.0)
    for c, w in more:
        score = score + F.when(F.col(f"__p_{c}") > 0, F.coalesce(F.col(c) / F.col(f"__p_{c}"), F.lit(0.0)) * w).otherwise(0.0)
    for c, w in less:
        score = score + F.when(F.col(f"__m_{c}") > 0, (1 - F.col(c) / F.col(f"__m_{c}")) * w).otherwise(0.0)
    scored = j.withColumn("score", score).select(*lines.columns, "score")
    first = (F.col("direction") != choice.direction).cast("int") if choice.direction else F.lit(0)
    ranked = in_order(scored, [first, -F.col("score"), F.col("depart"), F.col("azimuth")])
    return ranked.withColumn("rank", (F.col("__before") + 1).cast("long")).drop("__before")


def greedy_cover(ranked: DataFrame, footprint: DataFrame, contribution_min: float) -> DataFrame:
    """ranked lines that add enough new ground: in rank order, kept if the uncovered share of their cells is large enough.

    footprint: (depart, azimuth, cell), or a row per line (depart, azimuth, cells). Choices along the ranking depend on each other, but only where lines meet:
    lines that share no cell, directly or through others, are settled in different tasks."""
    from .graph import components

    met, rank = footprint.join(ranked.select("depart", "azimuth", "rank"), ["depart", "azimuth"]), F.col("rank").cast("long").alias("rank")
    if "cells" in footprint.columns:
        lines = met.select(rank, F.array_distinct(F.array_compact("cells")).cast("array<long>").alias("cells")).where("size(cells) > 0")
    else:
        lines = met.where("cell is not null").groupBy(rank).agg(F.sort_array(F.collect_set(F.col("cell").cast("long"))).alias("cells"))
    lines = written(lines, "lines")
    # cells of a line belong together, each to the next; there are fewer of them than of meetings of lines
    pairs = F.explode(F.expr("transform(slice(cells, 2, size(cells)), (x, i) -> struct(least(x, cells[i]) AS a, greatest(x, cells[i]) AS b))"))
    edges = lines.select(pairs.alias("e")).select("e.*").distinct()
    group = few(written(components(edges), "parts"))
    rows = lines.join(group, F.col("cells")[0] == F.col("id"), "left").select("rank", "cells", F.coalesce("component", F.col("cells")[0]).alias("part"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, covered = None, set()
        for b in batches:
            kept = []
            for own, rank, cells_of in zip(b["part"].tolist(), b["rank"].tolist(), b["cells"], strict=True):
                if own != part:
                    part, covered = own, set()
                mine = cells_of.tolist()
                if sum(c not in covered for c in mine) / len(mine) >= contribution_min:
                    kept.append(rank)
                    covered.update(mine)
            yield pd.DataFrame({"rank": np.array(kept, np.int64)})

    # a row per line, in order: a task holds a batch and what is covered, however many lines meet
    kept = rows.select("part", "rank", "cells").repartition("part").sortWithinPartitions("part", "rank").mapInPandas(choose, "rank long")
    return ranked.join(kept, "rank", "left_semi")


def convert_until(edges: DataFrame, budget_m: float, first: Column) -> DataFrame:
    """edges (id, length_m) plus converted: zone rows first, longest first, while the length before a row is under the budget."""
    ordered = in_order(edges, [(~first).cast("int"), -F.col("length_m"), F.col("id")], "length_m")
    return ordered.withColumn("converted", F.col("__before") < budget_m).drop("__before")


def threshold_sweep(segments: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, n, km, overlap_km, overlap_pct) of segments (score, length_m, overlap_m) at or above each threshold."""
    t = segments.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))).withColumn("__in", F.col("score") >= F.col("threshold"))
    s = lambda c: F.sum(F.when(F.col("__in"), F.col(c)).otherwise(0.0)) / 1000
    out = t.groupBy("threshold").agg(F.sum(F.col("__in").cast("long")).alias("n"), s("length_m").alias("km"), s("overlap_m").alias("overlap_km"))
    return out.withColumn("overlap_pct", F.when(F.col("km") > 0, 100 * F.col("overlap_km") / F.col("km")))


def adaptive_buffer(measure, first: float = 100, largest: float = 3000, factor: float = 2, gain_min: float = 0.05) -> list[tuple[float, float]]:
    """(buffer, value) as the buffer grows until the relative gain falls below gain_min or the largest is reached."""
    out = [(first, measure(first))]
    while out[-1][0] < largest:
        size = min(largest, out[-1][0] * factor)
        value = measure(size)
        gain = abs(value - out[-1][1]) / max(abs(out[-1][1]), 1e-12)
        out.append((size, value))
        if gain < gain_min:
            break
    return out
