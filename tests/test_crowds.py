"""Crowded places: the work follows the rows, not the pairs of what lies close together."""

import math
import random

from terrapath.operators import vector


def segs(spark, rows):
    return spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")


def gap(x, y, s):
    dx, dy = s[2] - s[0], s[3] - s[1]
    n = dx * dx + dy * dy
    t = min(max(((x - s[0]) * dx + (y - s[1]) * dy) / n, 0.0), 1.0) if n else 0.0
    return math.hypot(x - s[0] - t * dx, y - s[1] - t * dy)


def test_within_compares_only_what_no_segment_passes(spark, monkeypatch):
    g = random.Random(3)
    some = [tuple(g.uniform(-40, 40) for _ in range(4)) for _ in range(30)] + [(5.0, 5.0, 5.0, 5.0)]
    spots = [(i, g.uniform(-60, 60), g.uniform(-60, 60)) for i in range(600)] + [(600, 5.0, 8.0), (601, 5.0, 8.0), (602, None, 1.0)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    want = [i for i, x, y in spots if x is not None and any(gap(x, y, s) <= 3 for s in some)]
    assert sorted(r.id for r in vector.within(points, segs(spark, some), 3).collect()) == want
    left = []
    real = vector.numbered
    monkeypatch.setattr(vector, "numbered", lambda df, *a: left.append(df.count()) or real(df, *a))
    crowd = spark.range(500).selectExpr("id", "1.0 + id / 1000 AS x", "1.0 AS y")
    assert vector.within(crowd, segs(spark, [(0.0, 1.0, 9.0, 1.0)] * 50), 3).count() == 500
    assert left == [0]


def test_points_beside_a_crowd_are_settled_by_squares(spark, monkeypatch):
    left = []
    real = vector.written
    monkeypatch.setattr(vector, "written", lambda df, name: left.append(df.count()) or real(df, name) if name == "rest" else real(df, name))
    crowd = spark.range(500).selectExpr("id", "1.0 + id / 1000 AS x", "IF(id < 499, 2.2D, 4.1D) AS y")
    assert vector.within(crowd, segs(spark, [(0.0, 0.05, 9.0, 0.05)] * 50), 3).count() == 499
    assert left == [1]


def test_lines_compare_only_what_no_other_passes(spark, monkeypatch):
    g = random.Random(5)
    p = lambda x, y: {"x": float(x), "y": float(y)}
    kind = "id long, vertices array<struct<x:double,y:double>>"
    lines = [(i, [p(g.uniform(-60, 60), g.uniform(-60, 60)) for _ in range(2)]) for i in range(150)] + [(150, [p(0, 3), p(9, 3)]), (151, [p(0, -9), p(9, -9)])]
    some = [(i, [p(g.uniform(-20, 20), g.uniform(-20, 20)) for _ in range(2)]) for i in range(6)] + [(9, [p(0, 0), p(9, 0)])]
    flat = lambda v: tuple(q[k] for q in v for k in ("x", "y"))

    def near(a, b):
        turn = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
        crossed = turn(a, *b[:2]) * turn(a, *b[2:]) < 0 and turn(b, *a[:2]) * turn(b, *a[2:]) < 0
        return crossed or min(gap(*a[:2], b), gap(*a[2:], b), gap(*b[:2], a), gap(*b[2:], a)) <= 3

    want = [i for i, v in lines if any(near(flat(v), flat(w)) for _, w in some)]
    assert sorted(r.id for r in vector.lines_within(spark.createDataFrame(lines, kind), spark.createDataFrame(some, kind), 3).collect()) == want
    met = []
    monkeypatch.setattr(vector, "spread_buckets", lambda df, *a, real=vector.spread_buckets: met.append(df) or real(df, *a))
    crowd = spark.createDataFrame([(i, [p(0, i / 1000), p(9, i / 1000)]) for i in range(100)], kind)
    assert vector.lines_within(crowd, crowd.limit(50), 3).count() == 100
    assert met[1].count() == 0


def test_far_points_find_their_nearest_in_one_pass(spark, monkeypatch):
    g = random.Random(7)
    spots = [(g.randrange(1000), float(g.randrange(20)), float(g.randrange(6))) for _ in range(400)] + [(1001, None, 1.0)]
    points = [(i, g.uniform(-10, 30) * 10 ** g.randrange(4), float(g.randrange(-3, 9))) for i in range(500)] + [(500, 2.5, 2.5), (501, None, 2.0), (502, 1e6, 1e6)]
    want = {}
    for i, x, y in points:
        want[i] = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in spots if a is not None)[::-1] if x is not None else (None, None)
    p, t = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(spots, "node long, tx double, ty double")
    for most in (48 << 20, 0):
        got = {r.id: (r.node, r.distance) for r in vector.nearest_any(p, t, 8.0, most=most).collect()}
        assert got == {i: (k, d and math.sqrt(d)) for i, (k, d) in want.items()}
    monkeypatch.setattr(vector, "nearest_within", None)  # no rounds: the targets are few
    assert vector.nearest_any(p, t, 8.0).count() == len(points)


def test_landings_carry_no_vertices(spark, monkeypatch):
    """As many points as the lines are long, each found as by point_at; no plan beyond the first step holds a line."""
    from terrapath.operators import roads

    g = random.Random(11)
    p = lambda x, y: {"x": float(x), "y": float(y)}
    kind = "id long, vertices array<struct<x:double,y:double>>"
    lines = [(i, [p(g.uniform(0, 60), g.uniform(0, 60)) for _ in range(g.randrange(1, 9))]) for i in range(40)] + [(40, None), (41, [p(1, 1), p(1, 1), p(4, 5)])]
    df = spark.createDataFrame(lines, kind)
    got = vector.places_along(df, 7, 3)
    base = vector.points_along(df.where("size(vertices) >= 2"), 7).selectExpr("*", "greatest(at_m - 3, 0D) AS a_m", "least(at_m + 3, line_m) AS b_m")
    want = {(r.id, r.at_m, r.a_m, r.b_m) for r in base.collect()}
    assert {(r.id, r.at_m, r.a_m, r.b_m) for r in got.collect()} == want and len(want) == got.count()
    for end in ("at", "a", "b"):
        at = "x_m, y_m" if end == "at" else f"{end}_x, {end}_y"
        places = vector.point_at(base, base[f"{end}_m"]).select("id", "at_m", "x", "y").collect()
        assert sorted(map(tuple, got.selectExpr("id", "at_m", *at.split(", ")).collect())) == sorted(map(tuple, places))
    cells = spark.range(400).selectExpr("id AS cell", "id div 20 AS r", "id % 20 AS c", "CAST(id % 3 AS DOUBLE) AS z", "id % 7 = 0 AS forest")
    monkeypatch.setattr(vector, "point_at", None)
    monkeypatch.setattr(vector, "points_along", None)
    out = roads.landings(df.selectExpr("*", "'track' AS class", "false AS fire"), cells, 5.0, grade_max_pct=50, window=6, spacing=7, forest_max_m=9)
    assert 0 < out.count() < len(want)


def test_lines_of_a_batch_are_solved_together(monkeypatch):
    """The same lines as one by one, with far fewer solver calls than spans."""
    import numpy as np

    from terrapath.functions.config import Cable
    from terrapath.operators import cable

    g = np.random.default_rng(2)
    hw = cable.Hardware(Cable(length_max_m=220, length_min_m=60, span_min_m=30))
    x = np.arange(0, 200, 5.0)
    lines = [0.3 * x + 6 * np.sin(x / g.uniform(10, 40)) + g.uniform(0, 1, len(x)) for _ in range(24)]
    one = [cable.settled(hw, [cable.line_of(hw, x, z, 3)])[0] for z in lines]
    calls, spans = [], []
    real = hw.spans
    monkeypatch.setattr(hw, "spans", lambda asked: calls.append(1) or spans.extend(asked) or real(asked))
    assert cable.settled(hw, [cable.line_of(hw, x, z, 3) for z in lines]) == one and any(one)
    assert len(calls) * 3 < len(spans)
    lo, th, tv, ok = hw.at_full_tensions(np.array([90.0, 150.0]), np.array([20.0, 3.0]), np.array([0.0, 40.0]))
    assert ok.all() and np.all(np.abs(np.hypot(th, tv) - hw.tmax) <= 50)


def test_cover_streams_lines_that_all_meet(spark, monkeypatch):
    from terrapath.operators import graph, recap
    from terrapath.sources.scratch import written

    g = random.Random(4)
    ranked = spark.createDataFrame([(i, 0, i + 1) for i in range(300)], "depart long, azimuth int, rank long")
    own = {i: sorted({0, *(g.randrange(60) for _ in range(4))}) for i in range(300)}
    foot = spark.createDataFrame([(i, 0, c) for i, cells in own.items() for c in cells], "depart long, azimuth int, cell long")
    covered, want = set(), []
    for i in range(300):
        if sum(c not in covered for c in own[i]) / len(own[i]) >= 0.6:
            want.append(i)
            covered.update(own[i])
    real = graph.components
    monkeypatch.setattr(graph, "components", lambda e: written(real(e), "parts"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = recap.greedy_cover(ranked, foot, 0.6)
        assert sorted(r.depart for r in out.collect()) == want
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spans_that_hang_low_are_not_solved(monkeypatch):
    """Every span told too low fails when solved; lines are the same, and few spans are left that fail."""
    import numpy as np

    from terrapath.functions.config import Cable
    from terrapath.operators import cable

    g = np.random.default_rng(8)
    x = np.array([5.0 * math.hypot(k, k // 2) for k in range(44)])
    lines = [g.uniform(-0.6, 0.6) * x + g.uniform(0, 9) * np.sin(x / g.uniform(10, 60)) + g.uniform(0, 2, len(x)) for _ in range(120)]
    hw = cable.Hardware(Cable(length_max_m=220, length_min_m=60, span_min_m=30))
    told = hw.hangs_low
    low, asked = [], []

    def tell(x, z, i, js, zi, zj, before):
        out = told(x, z, i, js, zi, zj, before)
        low.extend((x, z, i, j, zi - z[i], top - z[j], before) for j, top, k in zip(js.tolist(), zj.tolist(), out.tolist(), strict=True) if k)
        return out

    monkeypatch.setattr(hw, "hangs_low", tell)
    real = hw.spans
    monkeypatch.setattr(hw, "spans", lambda some: [asked.append(r) or r for r in real(some)])
    found = cable.settled(hw, [cable.line_of(hw, x, z, 3) for z in lines])
    assert len(low) > 500 and not any(real(low))
    assert sum(r is None for r in asked) * 5 < len(low)
    monkeypatch.setattr(hw, "hangs_low", lambda x, z, i, js, *_: np.zeros(len(js), bool))
    assert cable.settled(hw, [cable.line_of(hw, x, z, 3) for z in lines]) == found and any(found)


def test_full_tension_takes_few_solutions(monkeypatch):
    """The lengths that halving comes to when every half is solved."""
    import numpy as np

    from terrapath.functions.config import Cable
    from terrapath.operators import cable

    g = np.random.default_rng(9)
    n = 400
    d, before = g.uniform(5, 700, n), g.uniform(0, 400, n) * (np.arange(n) % 3 > 0)
    h = d * g.uniform(0, 1.5, n) * (np.arange(n) % 5 > 0)
    hw = cable.Hardware(Cable())
    solved = []
    real = cable.solve_tensions
    monkeypatch.setattr(cable, "solve_tensions", lambda lo, *a: solved.append(len(lo)) or real(lo, *a))
    few = hw.at_full_tensions(d, h, before)
    assert sum(solved) < 6 * n
    solved.clear()
    every = hw.at_full_tensions(d, h, before, math.inf)
    assert sum(solved) > 12 * n and few[3].all()
    assert all(np.array_equal(a, b) for a, b in zip(few, every, strict=True))
    w, f = hw.c.carrier_kg_m * cable.G * few[0], hw.force(few[0], few[0] / 2, before)
    at = few[1], few[2], few[0], hw.eao, w, f, few[0] / 2, d, h
    a, b, e = cable.gaps(*at), cable.closing(*at), 1e-4 * few[1]
    assert np.allclose(a, b[:2], atol=1e-8)
    th, tv = ([(p - q) / (2 * e) for p, q in zip(cable.gaps(few[1] + k, few[2] + v, *at[2:]), cable.gaps(few[1] - k, few[2] - v, *at[2:]), strict=True)] for k, v in ((e, 0), (0, e)))
    assert np.allclose([th[0], tv[0], tv[1]], b[2:], rtol=1e-5) and np.allclose(th[1], tv[0], rtol=1e-4, atol=1e-12)


def test_lines_are_checked_by_rows(spark):
    """As check_lines, with nulls and missing cells."""
    import numpy as np

    from terrapath.functions.config import Config
    from terrapath.operators import rays

    g = random.Random(12)
    rows, n = [], 60
    for src in range(150):
        turn, z = g.choice((0, 37, 181, 350)), 0.0
        for k in range(g.randrange(2, n)):
            z += g.choice((-9.0, -2.0, 0.0, 2.0, 9.0))
            if src % 3 or g.random() < 0.9:
                rows.append((src, turn, k, 5.0 * k + k % 3, None if src % 5 == 0 and g.random() < 0.1 else z, None if g.random() < 0.02 else g.random() < 0.85, g.choice((None, 5.5, 95.2, -4.5)), g.choice((None, 10.0, 50.0)) if src % 7 else 10.0))
    df = spark.createDataFrame(rows, "src long, az int, step int, hd double, z double, forest boolean, aspect_deg double, slope_pct double")
    config = Config(cable=cable_of(length_max_m=250, length_min_m=40, cross_length_max_m=60, cross_share_max=0.4))
    want = {r.src: r.cells - 1 for r in rays.check_lines(df.where("z is not null"), config).collect()}
    wide = {x: np.full((150, n), np.nan) for x in ("hd", "z", "forest", "aspect_deg", "slope_pct")}
    az = np.zeros(150, np.int32)
    for src, turn, k, *values in rows:
        az[src] = turn
        for v, x in zip(wide.values(), values, strict=True):
            v[src, k] = np.nan if x is None else float(x)
    got = rays.check_rows(az, *wide.values(), config)
    assert {k: v for k, v in enumerate(got.tolist()) if v >= 0} == want and len(want) > 30


def cable_of(**kw):
    from terrapath.functions.config import Cable

    return Cable(**({"length_max_m": 220, "length_min_m": 60, "span_min_m": 30} | kw))


def test_searches_of_lines_run_as_arrays(monkeypatch):
    """The lines that one search after the other finds, for any beam, without a search per line."""
    import numpy as np

    from terrapath.operators import cable

    g = np.random.default_rng(3)
    n = g.integers(2, 45, 150)
    x, z = np.zeros((150, 45)), np.full((150, 45), 7.0)
    for k, m in enumerate(n.tolist()):
        x[k, :m] = np.cumsum(np.append(0, g.uniform(3, 7, m - 1)))
        z[k, :m] = g.uniform(-0.6, 0.6) * x[k, :m] + g.uniform(0, 9) * np.sin(x[k, :m] / g.uniform(10, 60)) + g.uniform(0, 2, m)
    z[5, 3] = np.nan
    for kw, precision in (({}, 3), ({}, 2), ({"direction": 1, "machine": 3}, 3), ({"line_max_m": 14.0, "support_angle_deg": 6.0}, 2)):
        hw = cable.Hardware(cable_of(**kw))
        want = cable.settled(hw, [cable.line_of(hw, x[k, :m], z[k, :m], precision) for k, m in enumerate(n.tolist())])
        with monkeypatch.context() as m:
            m.setattr(cable, "settled", None)
            assert cable.lines_of(hw, x, z, n, precision) == want and any(want)
        assert kw or any(w and w[1] for w in want)


def test_scan_holds_windows_not_rows_of_rays(spark):
    """Lines and cover of a grid with holes over many tiles, as from rows of rays; the plan has none of them."""
    import numpy as np
    from pyspark.sql import functions as F

    from terrapath.functions.config import Config
    from terrapath.operators import cable, rays, terrain

    g = random.Random(6)
    wide = 70
    cells = [(r * wide + c, r, c, 100 + 0.9 * r + 0.6 * c + g.random() * 2, g.random() < 0.8, None if g.random() < 0.1 else 2.0 * g.randrange(9)) for r in range(wide) for c in range(wide) if (r, c) != (35, 35) and g.random() < 0.99]
    df = spark.createDataFrame(cells, "cell long, r long, c long, z double, forest boolean, volume double")
    df = terrain.slope_aspect(df, "z", 5.0)
    starts = df.where("cell % 97 = 2").selectExpr("cell AS src", "r AS r0", "c AS c0", "z AS z0", "0D AS start")
    config = Config(cable=cable_of(cross_slope_max_pct=60, precision=2))
    az = [0, 45, 100, 133, 270, 311]
    lines, cover = cable.scan(df, starts, config, 5.0, az)
    plan = lines._jdf.queryExecution().toString() + cover._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan
    layers = ["z", "forest", "aspect_deg", "slope_pct", "volume"]
    t = rays.along_rays(df, starts, rays.template(spark, [(a, 0, 0, 0, 0.0) for a in az] + rays.straight_rays(5.0, 220, az)), layers)
    t = t.join(rays.check_lines(t.where("z is not null"), config).select("src", "az", "cells"), ["src", "az"]).where("step < cells")
    hw, want, best = cable.Hardware(config.cable), {}, {}
    rows = t.groupBy("src", "az").agg(F.array_sort(F.collect_list(F.struct("step", "hd", "z", "cell", "forest", "volume"))).alias("p")).collect()
    for src, a, p in sorted(map(tuple, rows)):
        x, z = np.array([q.hd for q in p]), np.array([q.z for q in p])
        f = cable.settled(hw, [cable.line_of(hw, x, z, 2)])[0]
        under = [q for q in p[: f[0] + 1] if q.forest] if f else []
        if under:
            want[src, a] = (x[f[0]], len(f[1]), f[2], f[1], round(len(under) * 0.0025, 6), round(sum(q.volume or 0 for q in under) * 0.0025, 6))
            for q in under:
                best[q.cell] = max(best.get(q.cell, (0,)), (x[f[0]], -src, -a))
    got = {(r.depart, r.azimuth): (r.length_m, r.supports, r.direction, r.support_steps, round(r.surface_ha, 6), round(r.volume_m3, 6)) for r in lines.collect()}
    assert got == want and len(want) > 50 and any(len(x[3]) for x in want.values())
    assert {r.cell: (r.length_m, -r.depart, -r.azimuth) for r in cover.collect()} == best


def test_components_end_in_one_task(spark, monkeypatch):
    """Rounds stop as soon as one task can hold what is left."""
    from terrapath.operators import graph

    g = random.Random(14)
    e = spark.createDataFrame([(a, a + 1 if g.random() < 0.9 else g.randrange(900)) for a in range(900)] + [(2000, 2000)], "a long, b long")
    steps = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: steps.append(name) or real(df, name))
    found = []
    for local in (0, 400, 10_000):
        steps.clear()
        found.append((sorted(map(tuple, graph.components(e, local=local).collect())), steps.count("hook")))
    assert found[0][0] == found[1][0] == found[2][0] and len(found[0][0]) == 902
    assert found[0][1] > found[1][1] > found[2][1] == 0


def test_cover_takes_lines_with_their_cells(spark):
    """As from a row per cell; the scan gives the cells that the footprint of its lines has."""
    from pyspark.sql import functions as F

    from terrapath.functions.config import Config, Selection
    from terrapath.operators import cable, recap, roads, terrain

    g = random.Random(15)
    cells = [(r * 40 + c, r, c, 100 + 0.9 * r + 0.6 * c + g.random() * 2, g.random() < 0.8, float(g.randrange(9))) for r in range(60) for c in range(40) if g.random() < 0.99]
    df = terrain.slope_aspect(spark.createDataFrame(cells, "cell long, r long, c long, z double, forest boolean, volume double"), "z", 5.0)
    starts = df.where("cell % 50 = 2").selectExpr("cell AS src", "r AS r0", "c AS c0", "z AS z0", "0D AS start")
    lines, _ = cable.scan(df, starts, Config(cable=cable_of(cross_slope_max_pct=60)), 5.0, list(range(0, 360, 20)), footprint=True)
    foot = roads.line_footprint(df, lines, 5.0)
    under = {(r.depart, r.azimuth): sorted(r.cells) for r in lines.collect()}
    assert {(r.depart, r.azimuth): r.cells for r in foot.groupBy("depart", "azimuth").agg(F.sort_array(F.collect_list("cell")).alias("cells")).collect()} == under and len(under) > 50
    ranked = recap.line_scores(lines.drop("cells", "support_steps"), Selection()).localCheckpoint()
    want = sorted(r["rank"] for r in recap.greedy_cover(ranked, foot, 0.6).collect())
    out = recap.greedy_cover(ranked, lines.select("depart", "azimuth", "cells"), 0.6)
    assert sorted(r["rank"] for r in out.collect()) == want and 0 < len(want) < len(under)
