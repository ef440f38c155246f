import json

import pytest
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from terrapath.sources import features, layers, provenance, registry, remote


def test_folder_store(spark, tmp_path):
    s = layers.FolderStore(spark, f"file://{tmp_path}/store")
    assert s.names() == []
    s.write("a", spark.range(3))
    s.write("a", spark.range(5))
    s.write("b", spark.range(1))
    assert s.names() == ["a", "b"] and s.read("a").count() == 5
    assert set(s.read_known(["a", "c"])) == {"a"}
    with pytest.raises(KeyError):
        s.read("zz")
    with pytest.raises(FileNotFoundError):
        s.read_known(["zz"])
    assert layers.as_layer(spark, f"{tmp_path}/store/a").count() == 5 and layers.as_layer(spark, None, optional=True) is None
    with pytest.raises(TypeError):
        layers.as_layer(spark, 3)


def test_jdbc_statements(spark):
    s = layers.JdbcStore(spark, "jdbc:postgresql://h/db", "forest")
    assert s.ensure_schema_sql() == 'CREATE SCHEMA IF NOT EXISTS "forest"' and "GIST" in s.index_sql("roads") and "forest" in s.list_sql()


def test_provenance(tmp_path):
    f = str(tmp_path / "x.parquet")
    assert not provenance.usable(f, "roads")
    open(f, "w").close()
    assert not provenance.usable(f, "roads") and provenance.usable(f, "roads", policy="accept")
    provenance.write_sidecar(f, "roads", "wfs", {"res": 5, "box": (1, 2)})
    assert provenance.usable(f, "roads", "wfs", {"res": 5, "box": (1, 2)})
    assert provenance.differences(provenance.read_sidecar(f), "roads", "wfs", {"res": 5}) == ["box"]
    said = []
    assert provenance.usable(f, "roads", "wfs", {"res": 1, "box": (1, 2)}, "warn", said.append) and "res" in said[0]
    with pytest.raises(RuntimeError):
        provenance.usable(f, "roads", "osm", policy="refuse")
    with pytest.raises(ValueError):
        provenance.usable(f, "roads", policy="maybe")


def test_registry(tmp_path):
    (tmp_path / "XX.json").write_text(json.dumps({"crs": 2154, "services": {"w": {"url": "u", "type": "wfs"}}, "layers": {"roads": {"service": "w", "typename": "t"}}, "sources": {"dtm": {"a": 1}}}))
    d = str(tmp_path)
    assert registry.countries(d) == ["XX"] and registry.national_crs("xx", d) == 2154 and registry.source("dtm", "XX", d) == {"a": 1}
    assert registry.layer_service("roads", "XX", d) == {"url": "u", "type": "wfs", "service": "w", "typename": "t"}
    for call in (lambda: registry.country("YY", d), lambda: registry.source("q", "XX", d), lambda: registry.layer_service("q", "XX", d)):
        with pytest.raises(KeyError):
            call()
    registry.clear()


def test_tiles_cover_and_overlap():
    t = remote.tiles(remote.Box(0, 0, 5000, 3000), 2000)
    assert len(t) == 6 and min(b.x0 for b in t) < 0 and max(b.x1 for b in t) > 5000
    assert t[0].x1 > t[1].x0


def test_retry():
    seen = []

    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("later")
        return "ok"

    assert remote.retry(flaky, sleep=lambda s: None) == "ok"
    with pytest.raises(ZeroDivisionError):
        remote.retry(lambda: 1 / 0, sleep=lambda s: None)


def test_overpass_verdicts_and_quarters():
    ok = json.dumps({"elements": [{"type": "way", "id": 1}]}).encode()
    assert [remote.verdict(*q) for q in ((429, b""), (504, b""), (500, b""), (200, b'{"elem'), (200, b'{"remark": "runtime error: Query timed out"}'), (200, ok))] == ["quota", "quota", "failed", "too_much", "too_much", "ok"]
    asked = []

    def transport(url):
        asked.append(url)
        return (200, {}, b'{"cut') if len(asked) == 1 else (200, {}, ok)

    got = remote.overpass(remote.Box(0, 0, 1, 1), "highway", ["track", "service"], transport, ["http://m"], sleep=lambda s: None)
    assert got == [{"type": "way", "id": 1}] and len(asked) == 5
    waits = []
    with pytest.raises(remote.Unreachable):
        remote.overpass(remote.Box(0, 0, 1, 1), "k", None, lambda u: (429, {"Retry-After": "99"}, b""), ["http://m"], sleep=waits.append)
    assert waits and max(waits) <= 10
    with pytest.raises(remote.TooMuch):
        remote.overpass(remote.Box(0, 0, 1, 1), "k", None, lambda u: (200, {}, b"{"), ["http://m"], depth=1, sleep=lambda s: None)
    with pytest.raises(ValueError):
        remote.wms_url("http://w", "bad", remote.Box(0, 0, 1, 1), 2154, 10, 10, ("bad",))
    assert remote.enough_finite([1.0] * 9 + [float("nan")]) and not remote.enough_finite([1.0, None])


def answer(url):
    x = url.split("BBOX=")[1].split(",")[0]
    return 200, {}, json.dumps({"features": [{"id": f"f{round(float(x))}", "properties": {}, "geometry": None}, {"id": "seam", "properties": {}, "geometry": None}]}).encode()


def test_tiled_source(spark):
    spark.dataSource.register(remote.TiledFeatures)
    df = spark.read.format("tiled_features").options(url="http://w", typename="t", x0=0, y0=0, x1=4000, y1=2000, waits="", transport="tests.test_sources:answer").load()
    assert df.rdd.getNumPartitions() == 2 and df.count() == 4
    assert features.keep_first(df, "id", ["id"]).count() == 3


def paged(url):
    """A server with 2,345 features, at most 1,000 a page; with `short` it announces one more than it has."""
    ask = {k: v for k, v in (x.split("=", 1) for x in url.split("?", 1)[1].split("&"))}
    low, count = int(ask["STARTINDEX"]), min(1000, int(ask["COUNT"]))
    found = [{"id": f"f{i}", "properties": {}, "geometry": None} for i in range(low, min(low + count, 2345))]
    matched = {"t": 2345, "short": 2346}.get(ask["TYPENAMES"], "unknown")
    return 200, {}, json.dumps({"features": found, "numberMatched": matched}).encode()


@pytest.mark.parametrize(("typename", "count"), [("t", 1000), ("t", 5000), ("unknown", 1000), ("t", 7)])
def test_a_tile_is_read_to_its_last_page(typename, count):
    schema = StructType().add("id", "string")
    options = {"url": "http://w", "typename": typename, "waits": "", "count": count, "transport": "tests.test_sources:paged"}
    rows = list(remote.TiledReader(schema, options).read(remote.TilePartition(remote.Box(0, 0, 1, 1))))
    assert [r[0] for r in rows] == [f"f{i}" for i in range(2345)]
    with pytest.raises(remote.Unreachable, match="2345 of 2346"):
        list(remote.TiledReader(schema, {**options, "typename": "short"}).read(remote.TilePartition(remote.Box(0, 0, 1, 1))))


def test_unify_keeps_what_does_not_convert(spark):
    a = spark.createDataFrame([(1, "x7")], "id int, v string")
    b = spark.createDataFrame([(2, 5)], "id int, v int")
    assert dict(features.unify([a, b]).dtypes)["v"] == "string"


def test_unqualified_roads_fail_when_read(spark):
    df = spark.createDataFrame([("osm", False), ("map", None)], "origin string, ok boolean")
    with pytest.raises(Exception, match="qualified"):
        features.require_qualified(df, "origin", "ok").collect()
    assert features.require_qualified(df.where("origin = 'map'"), "origin", "ok").count() == 1
    assert df.select(features.first_match([(F.lit(None).cast("boolean"), "a"), (F.col("origin") == "osm", "b")], "c").alias("x")).collect()[1].x == "c"


def test_archives_are_pruned():
    import struct

    from terrapath.sources import archives

    box = remote.Box(701000, 6596000, 702000, 6597000)
    names = ["d/T_0700_6600_MNT.asc", "d/T_0710_6600_MNT.asc", "d/readme.txt"]
    assert archives.by_name(names, box) == names[:1]
    head = lambda x0, x1: b"LASF".ljust(179, b"\0") + struct.pack("<4d", x1, x0, 6597000.0, 6595000.0) + b"\0" * 20
    heads = {"in": head(700000.0, 701500.0), "out": head(0.0, 10.0), "odd": b"?"}
    assert archives.by_header(["in", "out", "odd"], box, heads.__getitem__) == ["in", "odd"]
    assert archives.station_key(12.4, b=2, a=1) == "12_a=1_b=2"


def test_membership(spark):
    from terrapath.functions import membership as m

    specs = {"slope": m.Ramp(False, 5, 15, 2), "svf": m.Ramp(True, 0.8, 0.9, 1)}
    df = spark.createDataFrame([(10.0, 0.9), (20.0, None), (None, None)], "slope double, svf double")
    got = [r.s for r in df.select(m.score(specs, {"slope": F.col("slope"), "svf": F.col("svf")}).alias("s")).collect()]
    assert got == [pytest.approx((0.5 * 2 + 1) / 3), 0.0, None]
    assert set(m.normalise({"terrain": m.TERRAIN})) == {"terrain"} and set(m.normalise(specs)) == {"terrain", "surface"}
    for bad in ({}, {"x": 3}):
        with pytest.raises(ValueError):
            m.normalise(bad)


def test_acquire(spark, tmp_path):
    from terrapath.sources import acquire as aq

    store, known, asked = layers.FolderStore(spark, f"file://{tmp_path}/s"), {}, []

    def fetch(box):
        asked.append(box)
        return spark.range(len(asked))

    def down(box):
        raise remote.Unreachable("no")

    box = remote.Box(0, 0, 10, 10)
    assert aq.acquire(box, {"a": fetch}, store, known)["a"].count() == 1 and asked[0].x0 == -100
    assert aq.acquire(box, {"a": fetch}, store, known)["a"].count() == 1 and len(asked) == 1
    assert aq.acquire(box, {"a": fetch}, store, known, buffer_m=5)["a"].count() == 2
    assert aq.acquire(box, {"a": fetch}, store, known, policy="accept")["a"].count() == 2
    with pytest.raises(RuntimeError):
        aq.acquire(box, {"a": fetch}, store, known, policy="refuse")
    with pytest.raises(remote.Unreachable):
        aq.acquire(box, {"b": down}, store, known)
    assert aq.acquire(box, {"b": down}, store, known, optional=("b",)) == {}
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, None), (1, 1, 5.0)], "r long, c long, z double")
    assert aq.coarse_dtm(grid, 2, 0.7).first().z == 3.0
    with pytest.raises(ValueError):
        aq.coarse_dtm(grid, 2)


def test_precomputed_relief_reuses_what_covers_the_box(spark, tmp_path):
    from terrapath.sources import acquire
    from terrapath.sources.layers import FolderStore

    calls = []

    def fetch():
        calls.append(1)
        return spark.range(400).selectExpr("id AS cell", "id div 20 AS r", "id % 20 AS c", "IF(id % 20 < 19, 100.0 + id % 20, NULL) AS z")

    store = FolderStore(spark, f"file://{tmp_path}/store")
    out = acquire.precomputed_relief(store, 0, 9, 0, 9, fetch)
    assert out.count() == 100 and out.dtypes[-1] == ("relief", "smallint")
    assert out.selectExpr("min(relief) >= 0 AND max(relief) <= 255 AS ok").first().ok
    assert acquire.precomputed_relief(store, 5, 14, 5, 14, fetch).count() == 100 and len(calls) == 1
    with pytest.raises(ValueError, match="does not cover"):
        acquire.precomputed_relief(store, 0, 30, 0, 9, fetch)
