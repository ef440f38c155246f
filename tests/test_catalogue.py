"""Every query runs on the smallest tables; those with a statement must agree with DuckDB."""

import math

import duckdb
import pytest

from terrapath.plans.registry import oracle_sql, queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=str)
    r = duck.execute(oracle_sql()[name])
    names = [x[0] for x in r.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in at] == cols
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    df = queries()[name](spark, D)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = {r["class"]: r for r in entry.entry(spark).collect()}
    assert sum(r.cells for r in rows.values()) == 200


@pytest.mark.parametrize("name", ["skidder", "skidder_recap", "skidder_classes", "forwarder", "fire_truck", "cable_scan", "cable_cover", "cable_selection"])
def test_engines_sweep_all_directions(spark, monkeypatch, name):
    from terrapath.operators import rays

    seen = []
    for law in ("straight_rays", "connected_rays"):
        made = getattr(rays, law)
        monkeypatch.setattr(rays, law, lambda res, reach, azimuths=None, made=made: seen.append(azimuths) or made(res, reach, azimuths))
    queries()[name](spark, D)
    assert seen and all(a is None or len(a) >= 360 // 5 and len({y - x for x, y in zip(a, a[1:], strict=False)}) == 1 for a in seen)


@pytest.mark.parametrize("name", ["road_network", "road_multistart", "road_steiner", "road_annealed", "road_ripped_up"])
def test_roads_take_all_rows_of_the_landscape(spark, monkeypatch, name):
    from terrapath.operators import roads

    got = {}
    for f in ("network", "multistart", "steiner", "improve"):
        monkeypatch.setattr(roads, f, lambda cells, parcels, *_, **__: got.update(cells=cells, parcels=parcels) or cells)
    queries()[name](spark, "/root/testdata/sf0.1")
    most = 20_000 // 50 - 1
    assert got["cells"].agg({"r": "max"}).first()[0] == most
    assert got["parcels"].where("r >= 60").count() > 0


def test_greedy_cover_ranks_lines_of_all_departures(spark, monkeypatch):
    from terrapath.operators import recap
    from terrapath.plans.catalogue import cable_lines

    monkeypatch.setattr(recap, "greedy_cover", lambda ranked, foot, least: ranked.withColumn("rank", ranked["depart"]))
    assert queries()["greedy_cover"](spark, D).select("depart").distinct().count() == cable_lines(spark, D).select("depart").distinct().count()


def test_landings_take_all_events(spark, monkeypatch):
    from terrapath.operators import roads

    got = {}
    real = roads.landings
    monkeypatch.setattr(roads, "landings", lambda t, *a, **k: got.update(t=t) or real(t, *a, **k))
    queries()["landing_candidates"](spark, D)
    assert got["t"].selectExpr("sum(size(vertices))").first()[0] == spark.read.parquet(f"{D}/events.parquet").count()


def asked_of_improve(spark, monkeypatch, name):
    from inspect import signature

    from terrapath.operators import roads

    got, form = {}, signature(roads.improve)

    def improve(*a, **k):
        b = form.bind(*a, **k)
        b.apply_defaults()
        got.update(b.arguments)
        return b.arguments["cells"]

    monkeypatch.setattr(roads, "improve", improve)
    queries()[name](spark, D)
    return got


def test_roads_are_ripped_up_for_all_passes_of_the_method(spark, monkeypatch):
    got = asked_of_improve(spark, monkeypatch, "road_ripped_up")
    assert got["how"] == "rip_up" and got["passes"] >= 6


def test_roads_are_annealed_for_all_steps_of_the_method(spark, monkeypatch):
    got = asked_of_improve(spark, monkeypatch, "road_annealed")
    assert got["how"] == "anneal" and got["steps"] >= 200
