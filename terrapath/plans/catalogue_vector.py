"""Queries on lines, polygons, graphs, relief and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import graph, preprocess, recap, relief, tiles, vector
from .catalogue import Query, long, points, r6
from .catalogue import POINTS as POINTS_SQL
from .inputs import RES, SQL_GRID, grid, prepared, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# tracks: the places of each user's events, in order of time; x follows the event type and value, y the user

TRACK_SQL = """v0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), v AS (SELECT user_id AS id, k, (event_id * 37 % 240) + 2.5e0 AS x, (user_id % 20) * 10 + (event_id * 11 % 17) * 1e0 + 0.25e0 AS y FROM v0)"""
SEG_SQL = f"{TRACK_SQL}, seg AS (SELECT id, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY id ORDER BY k)), sg AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS len FROM seg WHERE x1 IS NOT NULL)"


def tracks(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    e = e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.select(F.col("user_id").alias("id"), "k", (F.col("event_id") * 37 % 240 + F.lit(2.5)).alias("x"), (F.col("user_id") % 20 * 10 + F.col("event_id") * 11 % 17 * F.lit(1.0) + F.lit(0.25)).alias("y"))
    v = e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x", "y"))).alias("v"))
    return v.select("id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("vertices"))


@query("segment_lengths", f"WITH {SEG_SQL} SELECT id, count(*) AS n, round(sum(len), 6) AS length_m FROM sg GROUP BY id")
def segment_lengths(spark, d):
    return vector.segments(tracks(spark, d)).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("length_m"), 6).alias("length_m"))


@query("chainage_interp", f"WITH {SEG_SQL}, c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, sum(len) OVER (PARTITION BY id) AS tot FROM sg), h AS (SELECT *, least(100e0, tot) AS d, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS rn FROM c WHERE s0 <= least(100e0, tot)) SELECT id, round(x0 + CASE WHEN len > 0 THEN least((d - s0) / len, 1e0) ELSE 0 END * (x1 - x0), 6) AS x, round(y0 + CASE WHEN len > 0 THEN least((d - s0) / len, 1e0) ELSE 0 END * (y1 - y0), 6) AS y FROM h WHERE rn = 1")
def chainage_interp(spark, d):
    return vector.point_at(tracks(spark, d), F.lit(100.0)).select("id", r6("x", "x"), r6("y", "y"))


CLIP = """lo AS (SELECT sg.*, r, c, CASE WHEN x1 = x0 THEN 0e0 ELSE greatest(0e0, least((c * 5 - x0) / (x1 - x0), (c * 5 + 5 - x0) / (x1 - x0))) END AS ax, CASE WHEN x1 = x0 THEN 1e0 ELSE least(1e0, greatest((c * 5 - x0) / (x1 - x0), (c * 5 + 5 - x0) / (x1 - x0))) END AS bx,
CASE WHEN y1 = y0 THEN 0e0 ELSE greatest(0e0, least((r * 5 - y0) / (y1 - y0), (r * 5 + 5 - y0) / (y1 - y0))) END AS ay, CASE WHEN y1 = y0 THEN 1e0 ELSE least(1e0, greatest((r * 5 - y0) / (y1 - y0), (r * 5 + 5 - y0) / (y1 - y0))) END AS by1 FROM sg, range(0, 60) a(r), range(0, 60) b(c)
WHERE r BETWEEN floor(least(y0, y1) / 5) AND floor(greatest(y0, y1) / 5) AND c BETWEEN floor(least(x0, x1) / 5) AND floor(greatest(x0, x1) / 5))"""


@query("touched_cells", f"WITH {SEG_SQL}, {CLIP} SELECT DISTINCT id, r, c FROM lo WHERE greatest(ax, ay) <= least(bx, by1)")
def touched_cells(spark, d):
    return vector.touched_cells(tracks(spark, d), RES).select("id", "r", "c")


@query("length_in_cells", f"WITH {SEG_SQL}, {CLIP} SELECT r, c, round(sum(greatest(least(bx, by1) - greatest(ax, ay), 0e0) * len), 5) AS length_m FROM lo GROUP BY r, c HAVING sum(greatest(least(bx, by1) - greatest(ax, ay), 0e0) * len) > 0")
def length_in_cells(spark, d):
    return vector.length_in_cells(tracks(spark, d), RES).select("r", "c", F.round("length_m", 5).alias("length_m"))


@query("road_rank_rasterised", f"WITH {SEG_SQL}, {CLIP} SELECT r, c, max(id % 4 + 1) AS code FROM lo WHERE greatest(ax, ay) <= least(bx, by1) GROUP BY r, c")
def road_rank_rasterised(spark, d):
    return vector.strongest_class(vector.touched_cells(tracks(spark, d).withColumn("code", F.col("id") % 4 + 1), RES))


# parcels: a triangle and a box per supplier

BOX_SQL = "b AS (SELECT s_suppkey AS id, s_acctbal AS value, (s_suppkey * 13 % 200) + 1.75e0 AS x, (s_suppkey * 7 % 180) + 1.25e0 AS y, 20e0 + s_suppkey % 30 AS s FROM supplier)"
IN_SQL = "(g.c + 0.5e0) * 5 > b.x AND (g.r + 0.5e0) * 5 > b.y AND ((g.c + 0.5e0) * 5 - b.x) + ((g.r + 0.5e0) * 5 - b.y) < b.s"


def parcels(spark, d) -> DataFrame:
    """Right triangles with legs along the axes."""
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"), (F.col("s_suppkey") * 13 % 200 + F.lit(1.75)).alias("x"), (F.col("s_suppkey") * 7 % 180 + F.lit(1.25)).alias("y"), (F.lit(20.0) + F.col("s_suppkey") % 30).alias("s"))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return b.select("id", "value", F.col("id").alias("rank"), F.array(p(F.col("x"), F.col("y")), p(F.col("x") + F.col("s"), F.col("y")), p(F.col("x"), F.col("y") + F.col("s"))).alias("ring"))


@query("zone_rasterised", f"WITH {SQL_GRID}, {BOX_SQL} SELECT g.cell, max(b.id) AS zone FROM g JOIN b ON {IN_SQL} GROUP BY g.cell")
def zone_rasterised(spark, d):
    return vector.last_zone(grid(spark, d), parcels(spark, d), RES)


@query("volume_rasterised", f"WITH {SQL_GRID}, {BOX_SQL} SELECT g.cell, round(avg(b.value), 6) AS value FROM g LEFT JOIN b ON {IN_SQL} GROUP BY g.cell")
def volume_rasterised(spark, d):
    return vector.mean_of_polygons(grid(spark, d), parcels(spark, d), RES, "value").select("cell", r6("value", "value"))


SEG_D = "sqrt(pow(px - (x0 + t * (x1 - x0)), 2) + pow(py - (y0 + t * (y1 - y0)), 2))"
SEG_T = "CASE WHEN len > 0 THEN least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (len * len), 0e0), 1e0) ELSE 0e0 END AS t"


@query("within_distance_semi", f"WITH {SEG_SQL}, {POINTS_SQL}, n AS (SELECT event_id, px, py, x0, y0, x1, y1, {SEG_T} FROM (SELECT event_id, x AS px, y AS py FROM pt) JOIN sg ON px BETWEEN least(x0, x1) - 6 AND greatest(x0, x1) + 6 AND py BETWEEN least(y0, y1) - 6 AND greatest(y0, y1) + 6) SELECT DISTINCT event_id FROM n WHERE {SEG_D} <= 6")
def within_distance_semi(spark, d):
    return vector.within(points(spark, d), vector.segments(tracks(spark, d)), 6).select("event_id")


NODES_SQL = "nd AS (SELECT c_custkey AS node, (c_custkey * 29 % 251) * 1.1e0 AS tx, (c_custkey * 17 % 23) * 1.3e0 AS ty FROM customer)"


@query("nearest_node", f"WITH {POINTS_SQL}, {NODES_SQL}, x AS (SELECT event_id, node, pow(x - tx, 2) + pow(y - ty, 2) AS d2 FROM pt, nd), m AS (SELECT event_id, min({{'d': d2, 'n': node}}) AS k FROM x GROUP BY event_id) SELECT event_id, k.n AS node, round(sqrt(k.d), 6) AS distance FROM m")
def nearest_node(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") * 29 % 251 * F.lit(1.1)).alias("tx"), (F.col("c_custkey") * 17 % 23 * F.lit(1.3)).alias("ty"))
    return vector.nearest_any(points(spark, d), nodes, 8.0).select("event_id", "node", r6("distance", "distance"))


@query("nearest_within", f"WITH {POINTS_SQL}, {NODES_SQL}, x AS (SELECT event_id, node, pow(x - tx, 2) + pow(y - ty, 2) AS d2 FROM pt, nd), m AS (SELECT event_id, min({{'d': d2, 'n': node}}) AS k FROM x WHERE d2 <= 9 GROUP BY event_id) SELECT event_id, k.n AS node FROM pt LEFT JOIN m USING (event_id)")
def nearest_within(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_custkey") * 29 % 251 * F.lit(1.1)).alias("tx"), (F.col("c_custkey") * 17 % 23 * F.lit(1.3)).alias("ty"))
    return vector.nearest_within(points(spark, d), nodes, 3).select("event_id", "node")


@query("endpoint_degree", f"WITH {TRACK_SQL}, e AS (SELECT id, arg_min({{'x': round_even(x / 20, 0), 'y': round_even(y / 20, 0)}}, k) AS a, arg_max({{'x': round_even(x / 20, 0), 'y': round_even(y / 20, 0)}}, k) AS b FROM v GROUP BY id), n AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM e UNION ALL SELECT b FROM e) GROUP BY k) SELECT id, na.n AS start_degree, nb.n AS end_degree FROM e JOIN n na ON na.k = a JOIN n nb ON nb.k = b")
def endpoint_degree(spark, d):
    return vector.end_degrees(tracks(spark, d), 20.0).select("id", "start_degree", "end_degree")


@query("fire_flags", f"WITH {TRACK_SQL}, e AS (SELECT id, arg_min({{'x': x, 'y': y}}, k) AS pa, arg_max({{'x': x, 'y': y}}, k) AS pb FROM v GROUP BY id), r AS (SELECT *, {{'x': round_even(pa.x, 0), 'y': round_even(pa.y, 0)}} AS a, {{'x': round_even(pb.x, 0), 'y': round_even(pb.y, 0)}} AS b FROM e), n AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM r UNION ALL SELECT b FROM r) GROUP BY k), j AS (SELECT r.*, na.n AS da, nb.n AS db FROM r JOIN n na ON na.k = a JOIN n nb ON nb.k = b), s AS (SELECT (s_suppkey * 13 % 240) * 1e0 AS x, (s_suppkey * 7 % 200) * 1e0 AS y FROM supplier)\nSELECT id, id % 3 <> 0 AND ((da >= 2 AND db >= 2 AND id % 13 >= 10) OR (da = 1 AND EXISTS (SELECT 1 FROM s WHERE pow(s.x - pa.x, 2) + pow(s.y - pa.y, 2) <= 100)) OR (db = 1 AND EXISTS (SELECT 1 FROM s WHERE pow(s.x - pb.x, 2) + pow(s.y - pb.y, 2) <= 100))) AS fire FROM j")
def fire_flags(spark, d):
    t = tracks(spark, d).withColumns({"class": F.when(F.col("id") % 3 == 0, "main").otherwise("track"), "width": F.col("id") % 13})
    spots = table(spark, d, "supplier").select((F.col("s_suppkey") * 13 % 240 * F.lit(1.0)).alias("x"), (F.col("s_suppkey") * 7 % 200 * F.lit(1.0)).alias("y"))
    return vector.fire_flags(t, spots, 10, 10).select("id", "fire")


@query("corridor_outside", f"WITH {SEG_SQL}, a AS (SELECT *, CAST(ceil(len / 4) AS BIGINT) AS n FROM sg WHERE id % 2 = 0 AND len > 0), p0 AS (SELECT id % 3 AS class, n, len, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by1, unnest(range(0, n)) AS i FROM a), p AS (SELECT class, len / n AS piece, ax + (i + 0.5e0) / n * (bx - ax) AS px, ay + (i + 0.5e0) / n * (by1 - ay) AS py, row_number() OVER () AS pid FROM p0), o AS (SELECT * FROM sg WHERE id % 2 = 1), m AS (SELECT DISTINCT pid FROM (SELECT pid, px, py, x0, y0, x1, y1, {SEG_T} FROM p, o) WHERE {SEG_D} <= 3)\nSELECT class, round(sum(piece), 4) AS length_m, round(greatest(sum(piece) - coalesce(sum(piece) FILTER (pid IN (SELECT pid FROM m)), 0), 0), 4) AS outside_m FROM p GROUP BY class")
def corridor_outside(spark, d):
    t = tracks(spark, d).withColumn("class", F.col("id") % 3)
    out = vector.length_outside(t.where("id % 2 = 0"), t.where("id % 2 = 1"), 3, 4)
    return out.select("class", F.round("length_m", 4).alias("length_m"), F.round("outside_m", 4).alias("outside_m"))


# graphs: an edge per order, from its own node to another of the same 400 nodes

EDGE_SQL = "e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT o_orderkey AS a, o_orderkey // 400 * 400 + (o_orderkey * 7 + o_custkey) % 400 AS b FROM orders) WHERE a <> b), ed AS (SELECT a, b, 1e0 + (a * 7 + b * 3) % 50 AS length_m FROM e)"


def edges(spark, d) -> DataFrame:
    own = F.col("o_orderkey")
    o = table(spark, d, "orders").select(own.alias("x"), (own - own % 400 + (own * 7 + F.col("o_custkey")) % 400).alias("y")).where("x <> y")
    e = o.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return e.withColumn("length_m", F.lit(1.0) + (F.col("a") * 7 + F.col("b") * 3) % 50)


@query("graph_components", f"WITH RECURSIVE {EDGE_SQL}, n AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT b, a FROM ed), k(id, lab) USING KEY (id) AS (SELECT DISTINCT a, a FROM n UNION SELECT x.id, x.lab FROM (SELECT n.b AS id, min(k.lab) AS lab FROM k JOIN n ON n.a = k.id GROUP BY n.b) x JOIN recurring.k o ON o.id = x.id WHERE x.lab < o.lab) SELECT id, lab AS component FROM k")
def graph_components(spark, d):
    return graph.components(edges(spark, d))


@query("graph_node_types", f"WITH {EDGE_SQL}, n AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ed UNION ALL SELECT b FROM ed) GROUP BY node) SELECT node, degree, CASE WHEN node % 50 = 0 THEN 'outlet' WHEN degree >= 3 THEN 'junction' WHEN degree = 1 THEN 'leaf' ELSE 'passage' END AS type FROM n")
def graph_node_types(spark, d):
    e = edges(spark, d)
    outlets = graph.degrees(e).where("node % 50 = 0").select("node")
    return graph.node_types(e, outlets)


@query("graph_contract", f"""WITH RECURSIVE {EDGE_SQL}, n AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM ed UNION ALL SELECT b FROM ed) GROUP BY node), p AS MATERIALIZED (SELECT node FROM n WHERE degree = 2 AND node % 50 <> 0),
m AS MATERIALIZED (SELECT a, b FROM ed WHERE a IN (SELECT node FROM p) AND b IN (SELECT node FROM p) UNION SELECT b, a FROM ed WHERE a IN (SELECT node FROM p) AND b IN (SELECT node FROM p)),
k(id, lab) USING KEY (id) AS (SELECT node, node FROM p UNION SELECT x.id, x.lab FROM (SELECT m.b AS id, min(k.lab) AS lab FROM k JOIN m ON m.a = k.id GROUP BY m.b) x JOIN recurring.k o ON o.id = x.id WHERE x.lab < o.lab),
c AS (SELECT ed.*, coalesce(ka.lab, kb.lab) AS lab, ka.id AS pa, kb.id AS pb, row_number() OVER (ORDER BY a, b) AS rn FROM ed LEFT JOIN k ka ON ka.id = a LEFT JOIN k kb ON kb.id = b),
x AS (SELECT coalesce(lab, -rn) AS chain, sum(length_m) AS length_m, count(*) AS pieces, list_sort(flatten(list(list_filter([CASE WHEN pa IS NULL THEN a END, CASE WHEN pb IS NULL THEN b END], lambda q: q IS NOT NULL)))) AS ends FROM c GROUP BY chain)
SELECT ends[1] AS a, ends[2] AS b, length_m, pieces FROM x WHERE len(ends) = 2""")
def graph_contract(spark, d):
    e = edges(spark, d)
    return graph.contract(e, graph.degrees(e).where("node % 50 = 0").select("node"))[1]


PATH_SQL = f"""{EDGE_SQL}, arc AS MATERIALIZED (SELECT a, b, length_m FROM ed UNION ALL SELECT b, a, length_m FROM ed),
t(node, dist) USING KEY (node) AS (SELECT DISTINCT a, 0e0 FROM arc WHERE a % 50 = 0 UNION SELECT x.node, x.dist FROM (SELECT arc.b AS node, min(t.dist + arc.length_m) AS dist FROM t JOIN arc ON arc.a = t.node GROUP BY arc.b) x LEFT JOIN recurring.t o ON o.node = x.node WHERE o.node IS NULL OR x.dist < o.dist),
tree AS MATERIALIZED (SELECT t.node, t.dist, (SELECT min(u.node) FROM arc JOIN t u ON u.node = arc.a WHERE arc.b = t.node AND u.dist + arc.length_m = t.dist AND t.dist > 0) AS parent FROM t)"""


@query("flow_paths", f"WITH RECURSIVE {PATH_SQL} SELECT node, round(dist, 6) AS distance, parent FROM tree")
def flow_paths(spark, d):
    e = edges(spark, d)
    return graph.shortest_to_outlets(e, graph.degrees(e).where("node % 50 = 0").select("node")).select("node", r6("distance", "distance"), "parent")


@query("flow_accumulate", f"WITH RECURSIVE {PATH_SQL}, am AS (SELECT o_orderkey AS node, sum(o_totalprice) AS amount FROM orders GROUP BY 1), up(place, amount) AS (SELECT tree.node, amount FROM am JOIN tree USING (node) UNION ALL SELECT tree.parent, up.amount FROM up JOIN tree ON tree.node = up.place WHERE tree.parent IS NOT NULL), f AS (SELECT place, sum(amount) AS flow FROM up GROUP BY place) SELECT tree.node, parent, round(coalesce(flow, 0), 3) AS flow FROM tree LEFT JOIN f ON f.place = tree.node")
def flow_accumulate(spark, d):
    from ..sources.scratch import written

    e = edges(spark, d)
    paths = written(graph.shortest_to_outlets(e, graph.degrees(e).where("node % 50 = 0").select("node")), "tree")
    amounts = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("amount"))
    return graph.accumulate(paths, amounts).select("node", "parent", F.round("flow", 3).alias("flow"))


@query("network_edges", f"WITH {SQL_GRID}, n AS (SELECT cell, r, c FROM g WHERE road IS NOT NULL) SELECT a.cell AS a, b.cell AS b, round(CASE WHEN a.r <> b.r AND a.c <> b.c THEN 5 * sqrt(2) ELSE 5 END, 6) AS length_m FROM n a JOIN n b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.cell < b.cell")
def network_edges(spark, d):
    return graph.fine_edges(grid(spark, d), F.col("road").isNotNull(), RES).select("a", "b", r6("length_m", "length_m"))


CLASS_SQL = "CASE WHEN a % 41 = 0 THEN 'public' WHEN a % 7 = 0 THEN 'main' WHEN a % 11 = 0 THEN NULL ELSE 'track' END"


@query("component_violations", f"WITH RECURSIVE {EDGE_SQL}, n AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT b, a FROM ed), k(id, lab) USING KEY (id) AS (SELECT DISTINCT a, a FROM n UNION SELECT x.id, x.lab FROM (SELECT n.b AS id, min(k.lab) AS lab FROM k JOIN n ON n.a = k.id GROUP BY n.b) x JOIN recurring.k o ON o.id = x.id WHERE x.lab < o.lab), s AS (SELECT a * 400 + b % 400 AS id, {CLASS_SQL} AS class, lab AS component FROM ed JOIN k ON k.id = ed.a), w AS (SELECT *, coalesce(bool_or(class = 'public') OVER p, false) AS pub, coalesce(bool_or(class IN ('public', 'main')) OVER p, false) AS srv FROM s WINDOW p AS (PARTITION BY component)) SELECT id, component, pub AS reaches_public, CASE WHEN class = 'track' THEN NOT srv WHEN class = 'main' THEN NOT pub WHEN class IS NOT NULL THEN false END AS violates FROM w")
def component_violations(spark, d):
    s = edges(spark, d).select((F.col("a") * 400 + F.col("b") % 400).alias("id"), F.expr(CLASS_SQL).alias("class"), "a", "b")
    return graph.integrity(s).select("id", "component", "reaches_public", "violates")


@query("road_typing", f"WITH {EDGE_SQL}, t AS (SELECT a * 400 + b % 400 AS id, length_m, a % 2 = 0 AS z, CAST(greatest(1, (b % 400 >= 100)::INT + (b % 400 >= 200)::INT) AS BIGINT) AS type FROM ed), s AS (SELECT *, sum(length_m) OVER (ORDER BY z DESC, length_m DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t WHERE type = 1) SELECT id, type, coalesce(before, 0) < 500 AS converted FROM s UNION ALL SELECT id, type, false FROM t WHERE type <> 1")
def road_typing(spark, d):
    e = edges(spark, d).select((F.col("a") * 400 + F.col("b") % 400).alias("id"), "length_m", (F.col("b") % 400).cast("double").alias("flow"), (F.col("a") % 2 == 0).alias("z"))
    return graph.type_roads(e, (100, 200), 500, F.col("z")).select("id", long("type", "type"), "converted")


# relief

SHIFTS = [s for s in relief.horizon_shifts(8, 4.0) if s[1] or s[2]]
HORIZON_SQL = f"""sh(dir, dr, dc, dist) AS (VALUES {", ".join(f"({i}, {a}, {b}, {x!r}e0)" for i, a, b, x in SHIFTS)}), mx AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM g),
q0 AS (SELECT cell, dir, dist, z, ((r - dr) % greatest(2 * (nr - 1), 1) + greatest(2 * (nr - 1), 1)) % greatest(2 * (nr - 1), 1) AS rr, ((c - dc) % (2 * (nc - 1)) + 2 * (nc - 1)) % (2 * (nc - 1)) AS cc, nr, nc FROM g, sh, mx),
q1 AS (SELECT cell, dir, dist, z, CASE WHEN rr >= nr THEN 2 * (nr - 1) - rr ELSE rr END AS r, CASE WHEN cc >= nc THEN 2 * (nc - 1) - cc ELSE cc END AS c FROM q0),
q2 AS (SELECT q1.cell, dir, max((b.z - q1.z) / dist / 5e0) AS up, max(-((b.z - q1.z) / dist / 5e0)) AS down FROM q1 JOIN g b ON b.r = q1.r AND b.c = q1.c GROUP BY q1.cell, dir),
hz AS (SELECT cell, avg(1 - sin(greatest(atan(up), 0e0))) AS svf, avg(degrees(pi() / 2 - atan(up))) AS opos, avg(degrees(pi() / 2 - atan(down))) AS oneg FROM q2 GROUP BY cell)"""


@query("sky_view_8dir", f"WITH {SQL_GRID}, {HORIZON_SQL} SELECT cell, round(svf, 6) AS svf FROM hz")
def sky_view_8dir(spark, d):
    return relief.horizon(grid(spark, d), "z", RES, 20, directions=8).select("cell", r6("svf", "svf"))


@query("openness_8dir", f"WITH {SQL_GRID}, {HORIZON_SQL} SELECT cell, round(opos, 6) AS openness_pos, round(oneg, 6) AS openness_neg FROM hz")
def openness_8dir(spark, d):
    return relief.horizon(grid(spark, d), "z", RES, 20, directions=8).select("cell", r6("openness_pos", "openness_pos"), r6("openness_neg", "openness_neg"))


BLEND_SQL = """x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, least(greatest((0.6e0 + l_quantity / 120 - 0.7e0) / (1.0e0 - 0.7e0), 0e0), 1e0) AS a, least(greatest((65e0 + l_quantity * 0.6e0 - 68e0) / 25e0, 0e0), 1e0) AS b, 1 - least(greatest((l_quantity * 1.1e0) / 50e0, 0e0), 1e0) AS s, l_discount * 10 AS h FROM lineitem),
y AS (SELECT *, s * 0.5e0 + h * (1 - 0.5e0) AS v1 FROM x), z AS (SELECT *, CASE WHEN v1 > 0.5e0 THEN 1 - (1 - 2 * (v1 - 0.5e0)) * (1 - b) ELSE 2 * v1 * b END AS v2 FROM y), w AS (SELECT *, (a * v2) * 0.25e0 + v2 * (1 - 0.25e0) AS v FROM z)"""


def channels(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q.alias("q"), F.col("l_extendedprice").alias("p"), (F.lit(0.6) + q / 120).alias("svf"), (F.lit(65.0) + q * F.lit(0.6)).alias("openness_pos"), (q * F.lit(1.1)).alias("slope_deg"), (F.col("l_discount") * 10).alias("hillshade"))


@query("blend_stack", f"WITH {BLEND_SQL} SELECT k, n, q, p, round(v, 6) AS v FROM w")
def blend_stack(spark, d):
    return channels(spark, d).withColumn("v", relief.blend_stack()).select("k", "n", "q", "p", r6("v", "v"))


@query("byte_scale", "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, CAST(CASE WHEN l_linenumber = 3 THEN 255 ELSE floor(least(greatest(l_quantity / 40, 0e0), 1e0) * 255.9999e0) END AS BIGINT) AS b FROM lineitem")
def byte_scale(spark, d):
    x = table(spark, d, "lineitem")
    v = F.when(F.col("l_linenumber") != 3, F.col("l_quantity") / 40)
    return x.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), long(relief.as_byte(v), "b"))


@query("relief_picture")
def relief_picture(spark, d):
    return relief.relief_picture(prepared(spark, d), "z", RES).select("cell", r6("relief", "relief"))


@query("combined_relief")
def combined_relief(spark, d):
    return relief.combined_relief(grid(spark, d), "z", RES).select("cell", long("relief", "relief"))


# tiles

PLAN_SQL = """t AS (SELECT i + 1 AS id, (i // 4) * 14 AS r1, (i % 4) * 14 AS c1, nr FROM (SELECT CAST(max(floor(p_partkey / 50)) AS BIGINT) + 1 AS nr FROM part), range(0, 100000) x(i) WHERE i < ((nr + 13) // 14) * 4),
u AS (SELECT *, least(r1 + 13, nr - 1) AS r2, least(c1 + 13, 49) AS c2 FROM t), w AS (SELECT *, greatest(r1 - 5, 0) AS hr1, least(r2 + 5, nr - 1) AS hr2, greatest(c1 - 5, 0) AS hc1, least(c2 + 5, 49) AS hc2 FROM u)"""


def plan(spark, d):
    rows = grid(spark, d).agg(F.max("r")).first()[0] + 1
    return tiles.tile_plan(spark, rows, 50, RES, 70, 25)


@query("tile_plan", f"WITH {PLAN_SQL} SELECT id, r1, r2, c1, c2, hr1, hr2, hc1, hc2, hr1 > 0 AS open_top, hr2 < nr - 1 AS open_bottom, hc1 > 0 AS open_left, hc2 < 49 AS open_right FROM w")
def tile_plan(spark, d):
    return plan(spark, d)


@query("tile_overhead", f"WITH {PLAN_SQL} SELECT round(sum((hr2 - hr1 + 1) * (hc2 - hc1 + 1)) / sum((r2 - r1 + 1) * (c2 - c1 + 1)), 6) AS overhead FROM w")
def tile_overhead(spark, d):
    return tiles.halo_overhead(plan(spark, d)).select(r6("overhead", "overhead"))


@query("greedy_cover")
def greedy_cover(spark, d):
    from .catalogue import cable_lines
    from ..functions.config import Selection

    ranked = recap.line_scores(cable_lines(spark, d), Selection())
    foot = ranked.select("depart", "azimuth", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("depart", "azimuth", ((F.col("depart") * 7 + F.col("i") * F.col("azimuth")) % 9000).alias("cell"))
    return recap.greedy_cover(ranked, foot, 0.6).select("depart", "azimuth", long("rank", "rank"))


CROSS = lambda a, b, p: f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


def _gap(px: str, py: str, a: str, b: str) -> str:
    t = f"CASE WHEN pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2) > 0 THEN least(greatest((({px} - {a}x) * ({b}x - {a}x) + ({py} - {a}y) * ({b}y - {a}y)) / (pow({b}x - {a}x, 2) + pow({b}y - {a}y, 2)), 0e0), 1e0) ELSE 0e0 END"
    return f"sqrt(pow({px} - ({a}x + ({t}) * ({b}x - {a}x)), 2) + pow({py} - ({a}y + ({t}) * ({b}y - {a}y)), 2))"


@query("fire_lines_near", f"WITH {SEG_SQL}, a AS (SELECT id, x0 AS pax, y0 AS pay, x1 AS pbx, y1 AS pby FROM sg WHERE id % 50 <> 0), o AS (SELECT x0 AS pcx, y0 AS pcy, x1 AS pdx, y1 AS pdy FROM sg WHERE id % 50 = 0), h AS (SELECT DISTINCT id FROM a, o WHERE ({CROSS('pa', 'pb', 'pc')} * {CROSS('pa', 'pb', 'pd')} < 0 AND {CROSS('pc', 'pd', 'pa')} * {CROSS('pc', 'pd', 'pb')} < 0) OR least({_gap('pax', 'pay', 'pc', 'pd')}, {_gap('pbx', 'pby', 'pc', 'pd')}, {_gap('pcx', 'pcy', 'pa', 'pb')}, {_gap('pdx', 'pdy', 'pa', 'pb')}) <= 3) SELECT DISTINCT sg.id, h.id IS NOT NULL AS fire FROM sg LEFT JOIN h USING (id) WHERE sg.id % 50 <> 0")
def fire_lines_near(spark, d):
    t = tracks(spark, d).withColumns({"class": F.lit("track"), "width": F.lit(5.0)})
    return vector.flag_fire(t.where("id % 50 <> 0"), t.where("id % 50 = 0"), None, 3).select("id", "fire")


@query("near_border", f"WITH {TRACK_SQL} SELECT id, bool_or(x <= 12 OR x >= 230 OR y <= 12 OR y >= 198) AS near_border FROM v GROUP BY id")
def near_border(spark, d):
    return vector.near_border(tracks(spark, d), 2, 2, 240, 208, 10).select("id", "near_border")


@query("road_classification", """WITH x AS (SELECT p_partkey, p_size, CASE p_size % 6 WHEN 0 THEN 'Route à 1 chaussée' WHEN 1 THEN 'Route empierrée' WHEN 2 THEN 'Chemin' WHEN 3 THEN 'Sentier' WHEN 4 THEN 'Autoroute' END AS n FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'main' WHEN n = 'Chemin' THEN 'track' WHEN n = 'Route empierrée' THEN 'main' WHEN n = 'Route à 1 chaussée' THEN 'public' ELSE 'off_road' END AS annex,
CASE WHEN n = 'Autoroute' OR p_size <= 3 THEN 'public' WHEN n IN ('Chemin', 'Sentier') THEN 'track' ELSE 'main' END AS importance, CASE WHEN n IN ('Chemin', 'Sentier', 'Route empierrée') THEN 'track' ELSE 'main' END AS words FROM x""")
def road_classification(spark, d):
    s = F.col("p_size") % 6
    n = F.when(s == 0, "Route à 1 chaussée").when(s == 1, "Route empierrée").when(s == 2, "Chemin").when(s == 3, "Sentier").when(s == 4, "Autoroute")
    p = table(spark, d, "part").withColumn("n", n)
    return p.select("p_partkey", *[preprocess.classify_roads(F.col("n"), how, F.col("p_size"), F.col("p_size") % 7 == 0).alias(how) for how in ("annex", "importance", "words")])
