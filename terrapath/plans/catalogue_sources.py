"""Queries of the acquisition side: tags, types, unions, first copies, sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import membership
from ..sources import features
from .catalogue import Query, long
from .inputs import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


TAGS_SQL = """SELECT event_id, concat('"kind"=>"', event_type, '","n"=>"', CAST(user_id AS VARCHAR), '"') AS tags FROM events"""


@query("tag_unfold", f"""WITH t AS ({TAGS_SQL}) SELECT event_id, CASE WHEN contains(tags, '"kind"=>"') THEN regexp_extract(tags, '"kind"=>"([^"]*)"', 1) END AS kind, CASE WHEN contains(tags, '"n"=>"') THEN regexp_extract(tags, '"n"=>"([^"]*)"', 1) END AS n, CAST(NULL AS VARCHAR) AS missing FROM t""")
def tag_unfold(spark, d):
    tags = F.concat(F.lit('"kind"=>"'), "event_type", F.lit('","n"=>"'), F.col("user_id").cast("string"), F.lit('"'))
    e = table(spark, d, "events").withColumn("tags", tags)
    return e.select("event_id", *[features.unfold_tag(F.col("tags"), k).alias(k) for k in ("kind", "n", "missing")])


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("obstacle_types", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'building' WHEN p_size % 4 = 0 OR p_type LIKE 'S%' THEN 'water' WHEN p_size % 3 = 0 THEN 'railway' WHEN p_size > 30 THEN 'cliff' END AS obstacle FROM part")
def obstacle_types(spark, d):
    p = table(spark, d, "part")
    has = lambda cond: F.when(cond, "yes")
    natural = F.when(F.col("p_type").like("S%"), "water").when(F.col("p_size") > 30, "cliff")
    return p.select("p_partkey", features.obstacle_type(has(F.col("p_size") % 5 == 0), has(F.col("p_size") % 4 == 0), has(F.col("p_size") % 3 == 0), natural).alias("obstacle"))


@query("keep_first", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first(spark, d):
    return features.keep_first(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("type_unify", "SELECT id, v FROM (SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS v FROM orders UNION ALL SELECT p_partkey, CAST(p_size AS DOUBLE) FROM part)")
def type_unify(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("v"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return features.unify([a, b])


@query("type_unify_time", "SELECT id, strftime(v, '%Y-%m-%d') AS v FROM (SELECT o_orderkey AS id, o_orderdate AS v FROM orders UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 3 = 0)")
def type_unify_time(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("v"))
    text = o.where("id % 3 = 0").withColumn("v", F.date_format("v", "dd/MM/yyyy HH:mm:ss"))
    return features.unify([o, text]).select("id", F.date_format("v", "yyyy-MM-dd").alias("v"))


@query("union_columns", "SELECT id, a, b FROM (SELECT n_nationkey::BIGINT AS id, n_name AS a, NULL AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region)")
def union_columns(spark, d):
    a = table(spark, d, "nation").select(long("n_nationkey", "id"), F.col("n_name").alias("a"))
    b = table(spark, d, "region").select(long("r_regionkey", "id"), F.col("r_name").alias("b"))
    return features.unify([a, b], common_only=False).select("id", "a", "b")


@query("label_fold", "SELECT doc_id, translate(lower(text), 'àâäéèêëîïôöùûüç', 'aaaeeeeiioouuuc') AS label FROM documents")
def label_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", features.plain(F.col("text")).alias("label"))


@query("obstacle_filter", "SELECT p_partkey FROM part WHERE NOT (p_size % 4 = 0) AND NOT (p_brand LIKE '%3') AND p_size - 10 >= 0")
def obstacle_filter(spark, d):
    nature = F.when(F.col("p_brand").like("%3"), "Sans Objet").otherwise("Bâti")
    persistence = F.when(F.col("p_size") % 4 == 0, "Temporaire").when(F.col("p_size") % 4 == 1, "Permanente")
    return table(spark, d, "part").where(features.obstacle_filter(nature, persistence, F.col("p_size") - 10)).select("p_partkey")


@query("forest_without_heath", "SELECT p_partkey FROM part WHERE p_size % 6 NOT IN (4, 5)")
def forest_without_heath(spark, d):
    p = table(spark, d, "part").withColumn("code", F.when(F.col("p_size") % 6 == 4, "LA4").when(F.col("p_size") % 6 == 5, "LA6").when(F.col("p_size") % 6 == 3, "FF1"))
    return features.drop_heath(p, "code").select("p_partkey")


@query("road_membership", """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_extendedprice AS p, least(greatest((l_quantity - 4.4913660574e0) / (20.256017850e0 - 4.4913660574e0), 0e0), 1e0) AS s, CASE WHEN l_linenumber > 2 THEN least(greatest((l_discount * 10 - 0.8552256750e0) / (0.914393904e0 - 0.8552256750e0), 0e0), 1e0) END AS v FROM lineitem)
SELECT k, n, q, p, round(((1 - s) * 2 + coalesce(v, 0)) / (2 + CASE WHEN v IS NULL THEN 0 ELSE 1 END), 6) AS score FROM x""")
def road_membership(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.when(F.col("l_linenumber") > 2, F.col("l_discount") * 10).alias("svf"))
    return x.select("k", "n", "q", "p", F.round(membership.score({"terrain": membership.TERRAIN}, {"slope": F.col("q"), "svf": F.col("svf")}), 6).alias("score"))
