"""Closed forms, conservation, and tiles against the whole."""

import heapq
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrapath.functions import scalars
from terrapath.functions.config import Alignment, Cable, Config, Selection, build, cable_constants, cable_slopes
from terrapath.operators import alignment, cable, engines, graph, neighbours, propagation, rays, recap, relief, terrain, tiles, vector

CONFIG = Config()


def plane(spark, n=21, slope=0.0, res=5.0, **layers):
    g = spark.range(n * n).select(F.col("id").alias("cell"), F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    g = g.withColumns({"z": F.lit(100.0) + F.col("c") * res * slope, "forest": F.lit(True), "obstacle": F.lit(False), "partial": F.lit(False), "public": F.lit(False), "road": F.lit(None).cast("int"), "volume": F.lit(1.0)})
    return g.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in layers.items()})


def prepared(g, res=5.0):
    s = terrain.slope_aspect(g, "z", res)
    return neighbours.focal(s, "slope_pct", "max", "slope_max")


def test_slope_of_a_plane(spark):
    rows = terrain.slope_aspect(plane(spark, 9, 0.2)).collect()
    inner = [r for r in rows if 0 < r.r < 8 and 0 < r.c < 8]
    assert all(math.isclose(r.slope_pct, 20) and math.isclose(r.aspect_deg, 270) for r in inner)
    assert all(r.slope_pct is None for r in rows if r not in inner)
    flat = terrain.slope_aspect(plane(spark, 5)).where("r = 2 and c = 2").first()
    assert flat.slope_pct == 0 and flat.aspect_deg is None


def test_stencil_across_tiles(spark):
    g = plane(spark, 13).withColumn("v", (F.col("r") * 31 + F.col("c") * 17) % 23)
    whole = {r.cell: r.m for r in neighbours.focal(g, "v", "max", "m", tile=64).collect()}
    cut = {r.cell: r.m for r in neighbours.focal(g, "v", "max", "m", tile=4).collect()}
    v = np.array([[(r * 31 + c * 17) % 23 for c in range(13)] for r in range(13)])
    want = {r * 13 + c: v[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].max() for r in range(13) for c in range(13)}
    assert whole == cut == want


def octile(a, b):
    return max(a, b) - min(a, b) + math.sqrt(2) * min(a, b)


def test_uniform_cost_is_octile_distance(spark):
    g = plane(spark)
    out = propagation.propagate(g, F.lit(1.0), F.when(F.col("cell") == 220, F.lit(7)), res=1.0, tile=8).collect()
    assert len(out) == 441 and {r.alloc for r in out} == {7}
    assert all(math.isclose(r.cost, octile(abs(r.r - 10), abs(r.c - 10))) for r in out)
    near = propagation.propagate(g, F.lit(1.0), F.when(F.col("cell") == 220, F.lit(7)), cap=3.0, res=1.0).collect()
    assert {r.cell for r in near} == {r.cell for r in out if r.cost <= 3.0}


def heap_labels(n, price, sources, res):
    best = {}
    heap = [(0.0, s, s) for s in sources]
    while heap:
        d, s, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = (d, s)
        r, c = divmod(v, n)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                x, y = r + a, c + b
                if (a or b) and 0 <= x < n and 0 <= y < n and price[x * n + y] is not None and x * n + y not in best:
                    heapq.heappush(heap, (d + price[x * n + y] * (res * (math.sqrt(2) if a and b else 1.0)), s, x * n + y))
    return best


def test_tiles_equal_one_heap(spark):
    n, rng = 30, random.Random(4)
    price = [None if rng.random() < 0.25 else rng.choice((1.0, 1.5, 4.0)) for _ in range(n * n)]
    sources = [37, 411, 880]
    rows = [(i, i // n, i % n, price[i], i if i in sources else None) for i in range(n * n)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, price double, s long")
    want = heap_labels(n, price, sources, 5.0)
    for tile in (6, 11, 64):
        got = {r.cell: (r.cost, r.alloc) for r in propagation.propagate(df, F.col("price"), F.col("s"), tile=tile).collect()}
        assert got == want


def test_certified_windows_equal_the_whole(spark):
    n = 40
    g = plane(spark, n).withColumns({"price": F.when((F.col("c") == 20) & (F.col("r") > 4), F.lit(50.0)).otherwise(1.0), "source": (F.col("cell") % 391 == 3)})
    w = g.select("cell", "r", "c", "price", "source")
    out = tiles.run_by_tiles(w, tiles.least_cost_engine(5.0), "cell long, cost double, certified boolean", n, n, 5.0, 40, 10, 40).collect()
    whole = {r.cell: r.cost for r in propagation.propagate(g, F.col("price"), F.when(F.col("source"), F.col("cell") + 1)).collect()}
    assert len(out) == n * n and any(r.certified for r in out)
    assert all(whole[r.cell] == r.cost for r in out if r.certified)


def test_veto_is_never_below_least_cost():
    rng = np.random.default_rng(1)
    n = 15
    r, c = np.divmod(np.arange(n * n), n)
    price = np.where(rng.random(n * n) < 0.2, np.nan, rng.choice([1.0, 3.0], n * n))
    source = np.where(np.isin(np.arange(n * n), (20, 130, 200)), np.arange(n * n), -1)
    d, s, _ = propagation.veto_labels(r, c, price, source, np.where(source == 20, 500.0, 0.0), 5.0, 0.5)
    plain, _, _ = propagation.solve_tile(r, c, np.arange(n * n), price, np.where(source >= 0, 0.0, np.inf), source, 5.0, math.inf)
    assert np.all(d[s >= 0] >= plain[s >= 0] - 1e-9)


def test_trace_follows_predecessors(spark):
    g = plane(spark)
    labels = propagation.propagate(g, F.lit(1.0), F.when(F.col("cell") == 0, F.lit(1)), res=1.0).cache()
    path = sorted((r.hop, r.cell) for r in propagation.trace(labels, g.where("cell in (440, 9999)")).collect())
    assert path == [(k, 440 - 22 * k) for k in range(21)]


def test_winch_law_constants(spark):
    law = scalars.winch_law(CONFIG)
    assert math.isclose(law.coeff, -1.007829, abs_tol=1e-6) and math.isclose(law.base, 80.2349, abs_tol=1e-4)
    at = lambda s: spark.range(1).select(scalars.winch_reach(F.lit(s), law)).first()[0]
    assert at(-0.5) == 100 and at(1.0) == 50 and math.isclose(at(0.0), 80.2349, abs_tol=1e-4) and 50 < at(0.3) < 80
    same = scalars.winch_law(build(skidder={"uphill_max_m": 70, "downhill_max_m": 70}))
    assert (same.coeff, same.base) == (0, 70)


def loop_winch(n, z, ok, sources, config, res):
    """The sweep as plain loops over sources, azimuths and steps."""
    law, s = scalars.winch_law(config), config.skidder
    found = {}
    by_az = {}
    for az, step, dr, dc, hd in rays.straight_rays(res, max(law.uphill_m, law.downhill_m)):
        by_az.setdefault(az, []).append((step, dr, dc, hd))
    for src in sources:
        for az, cells in by_az.items():
            lo, hi = -math.inf, math.inf
            for step, dr, dc, hd in cells:
                r, c = src // n + dr, src % n + dc
                if not (0 <= r < n and 0 <= c < n) or not ok[r * n + c]:
                    break
                dz = z[r * n + c] - z[src]
                slope, d3 = dz / hd, math.sqrt(hd * hd + dz * dz)
                reach = law.downhill_m if slope <= law.down else law.uphill_m if slope > law.up else law.base / (1 - law.coeff * slope / math.sqrt(1 + slope**2))
                if not lo <= slope <= hi or d3 > law.always_m and d3 > reach:
                    break
                found[r * n + c] = min(found.get(r * n + c, (math.inf,)), (d3, az, step, -src))
                lo, hi = max(lo, (dz - s.winch_anchor_m) / hd), min(hi, (dz - s.winch_anchor_m + s.clearance_max_m) / hd)
    return {k: (0.0, k) if k in sources else (v[0], -v[3]) for k, v in found.items()} | {k: (0.0, k) for k in sources}


def test_winch_against_loops(spark):
    n, rng = 25, random.Random(5)
    z = [float(rng.randrange(0, 25)) for _ in range(n * n)]
    ok = [rng.random() > 0.1 for _ in range(n * n)]
    sources = [312, 88]
    df = spark.createDataFrame([(i, i // n, i % n, z[i], ok[i]) for i in range(n * n)], "cell long, r long, c long, z double, winchable boolean")
    src = spark.createDataFrame([(s, s // n, s % n, z[s], 0.0) for s in sources], "src long, r0 long, c0 long, z0 double, start double")
    got = {r.cell: (r.distance, r.alloc) for r in rays.winch(df, src, CONFIG).collect()}
    assert got == loop_winch(n, z, ok, sources, CONFIG, 5.0)


def test_winching_goes_farther_downhill(spark):
    g = plane(spark, 61, 0.4).withColumn("winchable", F.lit(True))
    src = g.where("cell = 30 * 61 + 30").selectExpr("cell as src", "r as r0", "c as c0", "z as z0", "0D as start")
    got = rays.winch(g, src, CONFIG, azimuths=[90, 270]).join(g.select("cell", "c"), "cell").collect()
    up, down = max(r.c for r in got) - 30, 30 - min(r.c for r in got)
    assert 0 < up < down


def test_longer_hose_reaches_more(spark):
    g = plane(spark, 41, 0.1).withColumn("usable", F.col("c") != 25)
    src = g.where("cell = 20 * 41 + 20").selectExpr("cell as src", "r as r0", "c as c0", "z as z0", "0D as start")
    short, far = ({r.cell for r in rays.hose(g, src, m).collect()} for m in (40, 80))
    assert short < far and 20 * 41 + 20 in short
    assert max(x % 41 for x in far) == 24 and min(x % 41 for x in far) < 10


def test_forwarder_refuses_cross_slopes(spark):
    g = terrain.slope_aspect(plane(spark, 31, 0.22)).withColumn("drivable", F.lit(True))
    src = g.where("cell = 15 * 31 + 15").selectExpr("cell as src", "r as r0", "c as c0", "z as z0", "0D as start")
    got = {(r.r, r.c) for r in rays.forward(g, src, CONFIG, azimuths=[0, 90, 180, 270]).join(g.select("cell", "r", "c"), "cell").collect()}
    assert (15, 20) in got and (15, 10) in got and (10, 15) not in got and (20, 15) not in got


def test_check_line_against_a_loop(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for src in range(60):
        n = rng.randrange(5, 120)
        forest = [rng.random() < 0.8 for _ in range(n)]
        slope = [rng.choice((10.0, 50.0)) for _ in range(n)]
        z = np.cumsum([rng.choice((-2.0, 0.0, 2.0)) for _ in range(n)]).tolist()
        aspect = [rng.choice((None, 5.5, 95.2)) for _ in range(n)]
        rows += [(src, 0, k, 5.0 * k, z[k], forest[k], aspect[k], slope[k]) for k in range(n)]
        a = b = 0
        crossed = bare = 0.0
        for k in range(n):
            if math.hypot(5.0 * k, z[k] - z[0]) > 750:
                break
            t = None if aspect[k] is None else abs((0 - int(aspect[k]) + 180) % 360 - 180)
            aligned = t is None or t > 150 or t < 30
            if k and not aligned and not int(slope[k]) < 30:
                crossed += 5.0
            if k and crossed > 75:
                break
            if k and crossed / (5.0 * k) < 0.15:
                b = k
            if forest[k]:
                a, bare = k, 0.0
            else:
                bare += 5.0 if k else 0.0
                if bare >= 75:
                    break
        if 5.0 * min(a, b) > 150:
            want[src] = min(a, b) + 1
    df = spark.createDataFrame(rows, "src long, az int, step int, hd double, z double, forest boolean, aspect_deg double, slope_pct double")
    assert {r.src: r.cells for r in rays.check_lines(df, CONFIG).collect()} == want and want


def test_catenary_closes(spark):
    hw = cable.Hardware(Cable())
    lo, th, tv = hw.at_full_tension(200.0, 60.0, 0.0)
    w, f = hw.c.carrier_kg_m * cable.G * lo, hw.force(lo, lo / 2)
    x, z = cable.gaps(th, tv, lo, hw.eao, w, f, lo / 2, 200.0, 60.0)
    assert abs(x) < 0.05 and abs(z) < 0.05 and abs(math.hypot(th, tv) - hw.tmax) <= 50
    cols = [F.lit(float(v)) for v in (th, tv, lo, hw.eao, w, f, lo / 2)]
    row = spark.range(1).select(scalars.catenary_x(*cols, F.lit(lo)), scalars.catenary_z(*cols, F.lit(lo)), scalars.catenary_gap_x(*cols, F.lit(200.0)), scalars.catenary_gap_z(*cols, F.lit(60.0))).first()
    assert abs(row[0] - 200) < 0.05 and abs(row[1] - 60) < 0.05 and abs(row[2]) < 0.05 and abs(row[3]) < 0.05


def test_supports_bridge_a_hump():
    hw = cable.Hardware(Cable())
    x = np.arange(0, 401, 5.0)
    easy = 100 - 0.3 * x
    slopes = cable_slopes(hw.c)[:2]
    assert cable.place_supports(hw, x, easy, slopes, hw.c.mast_m, 1)[0] == len(x) - 1
    hump = easy + 14 * np.exp(-(((x - 200) / 25) ** 2))
    last, supports = cable.place_supports(hw, x, hump, slopes, hw.c.mast_m, 3)
    assert last == len(x) - 1 and supports
    other = cable.place_supports_by_graph(hw, x, hump, slopes, hw.c.mast_m, 1)
    assert other and other[0] == last
    assert cable_constants(hw.c).tension_max == hw.tmax


def test_components_contraction_and_flow(spark):
    rng = random.Random(7)
    e = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(50)})
    e = [(a, b, float(1 + (a + b) % 9)) for a, b in e if a != b]
    df = spark.createDataFrame(e, "a long, b long, length_m double")
    label = {x: x for a, b, _ in e for x in (a, b)}
    for _ in range(60):
        for a, b, _ in e:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in graph.components(df).collect()} == label
    assert {r.id: r.component for r in graph.components(df, local=0).collect()} == label
    outlets = spark.createDataFrame([(min(label),)], "node long")
    nodes, short = graph.contract(df, outlets)
    marked = {r.node for r in nodes.collect()}
    rows = short.collect()
    assert {x for r in rows for x in (r.a, r.b)} <= marked
    # every edge is in one chain, but for rings of passages alone
    assert sum(r.pieces for r in rows) <= len(e)
    paths = graph.shortest_to_outlets(df, outlets).cache()
    assert sorted(map(tuple, paths.collect()), key=str) == sorted(map(tuple, graph.shortest_to_outlets(df, outlets, local=0).collect()), key=str)
    amounts = spark.createDataFrame([(x, 1.5) for x in label], "node long, amount double")
    flow = {r.node: r.flow for r in graph.accumulate(paths, amounts).collect()}
    assert math.isclose(flow[min(label)], 1.5 * sum(v == label[min(label)] for v in label.values()))


def test_long_chains_and_rings(spark):
    """A way of 700 legs, a ring of passages, a loop on a junction and a dead end, in the plan for large graphs."""
    chain = [(i, i + 1, 1.0 + i % 3) for i in range(700)]
    ring = [(1000, 1001, 1.0), (1001, 1002, 1.0), (1000, 1002, 1.0)]
    loop = [(700, 800, 1.0), (800, 801, 5.0), (700, 801, 2.0), (700, 900, 4.0), (900, 901, 1.0)]
    df = spark.createDataFrame(chain + ring + loop, "a long, b long, length_m double")
    outlets = spark.createDataFrame([(0,), (350,)], "node long")
    few, many = (graph.shortest_to_outlets(df, outlets, **k).collect() for k in ({}, {"local": 0}))
    assert sorted(map(tuple, few), key=str) == sorted(map(tuple, many), key=str) and len(few) == 705
    label = {r.id: r.component for r in graph.components(df, local=0).collect()}
    assert label == {x: 0 if x < 1000 else 1000 for e in chain + ring + loop for x in e[:2]}


def test_rows_are_numbered_once(spark):
    """Lines that come within a distance, from a plan whose row order is not fixed."""
    p = lambda x, y: {"x": float(x), "y": float(y)}
    lines = spark.range(400).selectExpr("id", "id * 10.0 AS y").repartition(7, "y").collect()
    df = spark.createDataFrame([(r.id, [p(0, r.y), p(5, r.y)]) for r in lines], "id long, vertices array<struct<x:double,y:double>>")
    df = df.groupBy("id").agg(F.first("vertices").alias("vertices"))
    other = spark.createDataFrame([(1, [p(2, 95), p(2, 125)])], "id long, vertices array<struct<x:double,y:double>>")
    assert sorted(r.id for r in vector.lines_within(df, other, 6).collect()) == [9, 10, 11, 12, 13]
    assert {(r.id, r.x, r.y) for r in vector.point_at(df, F.lit(2.0)).collect()} == {(i, 2.0, 10.0 * i) for i in range(400)}


def test_integrity_causes(spark):
    s = spark.createDataFrame([(1, "track", 1, 2), (2, "main", 2, 3), (3, "track", 10, 11), (4, None, 20, 21), (5, "public", 3, 4)], "id long, class string, a long, b long")
    got = {r.id: (r.reaches_public, r.violates) for r in graph.integrity(s).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, None), 5: (True, False)}
    checked = graph.integrity(s).withColumn("near_border", F.col("id") == 3)
    loose = graph.integrity(s).select("id", "violates")
    assert {r.id: r.cause for r in graph.violation_causes(checked, loose).collect()}[3] == "border"


def test_recap_conserves_area(spark):
    g = plane(spark, 12).withColumn("value", F.when(F.col("c") < 10, F.col("c") % 3 + 1).cast("int"))
    levels = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "none")], "value int, class string")
    rows = {r["class"]: r for r in recap.class_recap(g, levels, volume="volume").collect()}
    assert sum(r.cells for r in rows.values()) == 144 and rows["none"].cells == 0 and rows["undetermined"].cells == 24


def test_greedy_cover_against_a_loop(spark):
    rng = random.Random(8)
    lines = [(i, i % 7, rng.sample(range(150), 8)) for i in range(60)]
    ranked = spark.createDataFrame([(d, a, k + 1) for k, (d, a, _) in enumerate(lines)], "depart long, azimuth long, rank int")
    foot = spark.createDataFrame([(d, a, c) for d, a, cs in lines for c in cs], "depart long, azimuth long, cell long")
    covered, want = set(), []
    for k, (_, _, cs) in enumerate(lines):
        if sum(c not in covered for c in cs) / 8 >= 0.6:
            want.append(k + 1)
            covered.update(cs)
    assert sorted(r["rank"] for r in recap.greedy_cover(ranked, foot, 0.6).collect()) == want
    assert recap.safe_name("Été -- 0/250 m") == "t_0_250_m"


def test_scores_without_volume(spark):
    lines = spark.createDataFrame([(1, 0, 200.0, 2.0, 1, 0, None, None), (2, 0, 300.0, 1.0, -1, 2, None, None)], "depart long, azimuth int, length_m double, surface_ha double, direction int, supports int, volume_m3 double, ipc double")
    out = recap.line_scores(lines, Selection(direction=-1)).orderBy("rank").collect()
    assert [r.depart for r in out] == [2, 1]


def test_adaptive_buffer():
    assert recap.adaptive_buffer(lambda b: 10 if b < 400 else 10.1)[-1][0] == 200
    assert recap.adaptive_buffer(lambda b: b)[-1][0] == 3000


def test_flat_ground_sees_the_whole_sky(spark):
    r = relief.horizon(plane(spark, 9), radius_m=10, directions=8).where("cell = 40").first()
    assert r.svf == 1 and math.isclose(r.openness_pos, 90) and math.isclose(r.openness_neg, 90)
    null = plane(spark, 3).withColumn("z", F.lit(None).cast("double"))
    assert relief.horizon(null, radius_m=10, directions=8).where("svf is not null").count() == 0


def test_lengths_and_polygons(spark):
    line = spark.createDataFrame([(1, [(0.0, 0.0), (30.0, 40.0), (30.0, 40.0), (30.0, 60.0)])], "id long, vertices array<struct<x:double,y:double>>")
    assert vector.segments(line).agg(F.sum("length_m")).first()[0] == 70
    assert math.isclose(vector.length_in_cells(line, 5.0).agg(F.sum("length_m")).first()[0], 70)
    p = vector.point_at(line, F.lit(60.0)).first()
    assert (p.x, p.y) == (30, 50)
    square = spark.createDataFrame([(9, 1.0, [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)])], "rank int, v double, ring array<struct<x:double,y:double>>")
    assert vector.last_zone(plane(spark, 12), square, 5.0).count() == 16


def hilly(n=40, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:n, 0:n]
    z = 100 + 0.25 * x + 2 * np.sin(y / 6) + rng.normal(0, 0.02, (n, n))
    blocked = np.zeros((n, n), bool)
    blocked[10:30, 20] = True
    return alignment.Ground(z, blocked, np.full((n, n), 10.0), np.ones((n, n)))


def test_alignment_keeps_its_limits():
    g, p = hilly(), Alignment(grade_min_pct=0)
    r = alignment.route(g, [(5, 5)], [(35, 35)], p)
    assert r and r.cells[0] == (5, 5) and r.cells[-1] == (35, 35)
    for (a, b), (c, d) in zip(r.cells, r.cells[1:], strict=False):
        step = 5 * math.hypot(c - a, d - b)
        assert step <= p.neighbourhood_m and abs(g.z[c, d] - g.z[a, b]) / step <= 0.12 + 1e-9
        assert not g.blocked[c, d]
    assert alignment.route(g, [(5, 5)], [(35, 35)], p).cells == r.cells
    wall = hilly()
    wall.blocked[:, 20] = True
    assert alignment.route(wall, [(5, 5)], [(35, 35)], p) is None
    routes, whole = alignment.trace(wall, [(5, 5), (9, 9), (35, 35)], p)
    assert len(routes) == 1 and not whole


def test_optimisers_are_never_worse_than_greedy():
    g, p = hilly(), Alignment(grade_min_pct=0)
    roads = [(r, 2) for r in range(40)]
    parcels = [(5, 30), (30, 33), (20, 12), (36, 10)]
    base = alignment.order_by(g, parcels, roads, "nearest")
    build_ = lambda o: alignment.greedy(g, parcels, roads, p, o)
    first = build_(base)
    assert not first.unserved and build_(alignment.start_order(base, 0, 3)).score == first.score
    hot, journal = alignment.anneal(build_, base, 6, 0, 0.9, 2)
    again, _ = alignment.anneal(build_, base, 6, 0, 0.9, 2)
    rip, moves = alignment.rip_up(build_, base, 1)
    assert hot.score <= first.score and rip.score <= first.score and hot.score == again.score
    assert journal == sorted(journal, reverse=True) and moves == sorted(moves, reverse=True)
    assert sorted(alignment.shuffled(9, 4)) == list(range(9)) and alignment.shuffled(9, 4) == alignment.shuffled(9, 4)
    assert alignment.prim(4, {(0, 1): 5.0, (0, 2): 1.0, (1, 2): 1.0, (0, 3): math.inf}) == [0, 2, 1]


def test_skidder_on_a_plane(spark):
    g = prepared(plane(spark, 31, 0.1, road="CASE WHEN c = 15 THEN 1 END", obstacle="r = 5 AND c > 18"))
    rows = engines.skidder(g, CONFIG, azimuths=[0, 90, 180, 270]).collect()
    inner = [r for r in rows if r.slope_pct is not None]
    assert all(r.access == 1 and r.distance_m == 0 for r in inner if r.c == 15)
    assert all(r.access in (1, 2) for r in inner if not r.obstacle)
    assert all(r.access == 3 for r in inner if r.obstacle and r.c > 19)
    assert all((r.alloc is None) == (r.access in (3, None)) for r in inner)
    # tracks that reach no road give no access
    orphan = prepared(plane(spark, 15, 0.0, road="CASE WHEN c = 7 THEN 2 END"))
    assert {r.access for r in engines.skidder(orphan, CONFIG, azimuths=[90, 270]).where("slope_pct is not null").collect()} <= {1, 3}


def test_fire_truck_codes(spark):
    g = prepared(plane(spark, 41, 0.1, road="CASE WHEN c = 20 THEN 3 END", forest="c > 4"))
    rows = engines.fire_truck(g, CONFIG, F.col("road") == 3, azimuths=[90, 270]).collect()
    assert {r.defence for r in rows if r.c <= 4} == {6}
    assert {r.defence for r in rows if 5 <= r.c and r.slope_pct is not None} == {3}


@pytest.mark.parametrize("bad", [{"skidder": {"clearance_max_m": 5}}, {"cable": {"line_max_m": 1}}, {"road": {"cost": {"slope_table": ((0, 15, 0), (20, 30, 1))}}}, {"general": {"halo_max_m": 1}}, {"skidder": {"option": 2}}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        build(**bad)


def test_config_round_trip(tmp_path):
    from terrapath.functions import config as c

    own = build(skidder={"uphill_max_m": 80}, road={"cost": {"base": 21}, "alignment": {"goal_m": 3}}, cable={"selection": {"contribution_min": 0.5}})
    for name in ("a.json", "a.yml"):
        c.write(own, str(tmp_path / name))
        assert c.read(str(tmp_path / name)) == own
    assert pd.notna(own.cable.load_kg)


def test_inputs_are_checked(spark):
    from terrapath.operators import preprocess as pp

    g = plane(spark, 5)
    roads = spark.createDataFrame([("track",), ("off_road",)], "class string")
    pp.check_inputs(g, roads, 5.0, [g.where("r < 2")], [2154, None, 2154])
    for bad in (lambda: pp.check_inputs(g.where("cell <> 7"), roads, 5.0), lambda: pp.check_inputs(g.limit(0), roads, 5.0), lambda: pp.check_inputs(g, roads, 0.0), lambda: pp.check_inputs(g, roads.selectExpr("class as k"), 5.0),
                lambda: pp.check_inputs(g, spark.createDataFrame([("path",)], "class string"), 5.0), lambda: pp.check_inputs(g, roads, 5.0, [plane(spark, 6)]), lambda: pp.check_inputs(g, roads, 5.0, crs=[2154, 4326])):
        with pytest.raises(ValueError):
            bad()
    assert pp.on_road(roads).count() == 1
    v = spark.createDataFrame([(1, True, "real"), (2, True, "border"), (3, None, None)], "id int, violates boolean, cause string")
    assert {r.id for r in pp.drop_real_violations(v).collect()} == {2, 3}


def test_road_classes(spark):
    from terrapath.operators import preprocess as pp

    df = spark.createDataFrame([("Route à 1 chaussée", 5, False), ("Route empierrée", 6, False), ("Chemin", 6, False), ("Chemin", 6, True), ("Rond-point", 2, False), ("Autoroute", 1, False), (None, None, None)], "n string, i int, f boolean")
    of = lambda how: [r.c for r in df.select(pp.classify_roads(F.col("n"), how, F.col("i"), F.col("f")).alias("c")).collect()]
    assert of("annex") == ["public", "main", "track", "main", "off_road", "off_road", "off_road"]
    assert of("importance") == ["main", "main", "track", "track", "public", "public", "main"]
    assert of("words") == ["main", "track", "track", "track", "main", "main", "main"]
    with pytest.raises(ValueError):
        of("other")


def test_prepare_from_lines(spark):
    from terrapath.operators import preprocess as pp

    roads = spark.createDataFrame([("main", [(2.5, 12.5), (47.0, 12.5)]), ("public", [(22.5, 1.0), (22.5, 24.0)]), ("off_road", [(1.0, 1.0), (4.0, 4.0)])], "class string, vertices array<struct<x:double,y:double>>")
    p = {(r.r, r.c): r for r in pp.prepare(plane(spark, 10, 0.2), CONFIG, roads=roads).collect()}
    assert p[2, 3].road == 1 and p[2, 4].road == 4 and p[0, 0].road is None and math.isclose(p[5, 5].slope_max, 20) and p[5, 5].excluded is False


def test_clip_keeps_rings_right(spark):
    """Closed and open rings, rings outside, within and around the box, and rings without area."""
    p = lambda x, y: {"x": float(x), "y": float(y)}
    around = [p(-9, -9), p(99, -9), p(99, 99), p(-9, 99), p(-9, -9)]
    rings = [around, [p(1, 1), p(3, 1), p(3, 3)], [p(50, 50), p(60, 50), p(60, 60)], [p(1, 1), p(2, 2)], [p(1, 1), p(2, 2), p(3, 3)], [p(8, 5), p(12, 5), p(12, 7), p(8, 7)]]
    df = spark.createDataFrame(list(enumerate(rings)), "id long, ring array<struct<x:double,y:double>>")
    got = {r.id: (r.area, {(q.x, q.y) for q in r.ring}) for r in vector.clip(df, 0, 0, 10, 10).collect()}
    assert got == {0: (100.0, {(0, 0), (10, 0), (10, 10), (0, 10)}), 1: (2.0, {(1, 1), (3, 1), (3, 3)}), 5: (4.0, {(8, 5), (10, 5), (10, 7), (8, 7)})}


def test_projection_at_the_origin(spark):
    x, y = vector.lambert_conic(F.lit(3.0), F.lit(46.5))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (round(r.x, 6), round(r.y, 6)) == (700000.0, 6600000.0)


def test_grid_of_tensions_agrees_with_newton():
    lo, eao, w, f, s, d, h = 100.0, 2e7, 1500.0, 5000.0, 45.0, 96.0, 25.0
    th, tv, feasible = cable.tension_by_grid(lo, eao, w, f, s, d, h, 30000, 20)
    exact = cable.solve_tension(lo, eao, w, f, s, d, h, np.array([th]), np.array([tv]))
    assert feasible and exact[2].all() and abs(th - exact[0][0]) < 500 and abs(tv - exact[1][0]) < 500
    assert all(abs(x) < 0.05 for x in cable.gaps(th, tv, lo, eao, w, f, s, d, h))
    assert cable.tension_by_grid(lo, eao, w, f, s, 300.0, h, 5000, 100)[:2] == (-1.0, -1.0)
