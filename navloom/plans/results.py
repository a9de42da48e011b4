"""Paths, results and stores: ordered folds, comparisons, searches with fixed costs, and store round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.operators import mesh as m
from navloom.operators import search, store
from navloom.plans.base import query
from navloom.plans.mesh import LINKS
from navloom.plans.tiles import nav_tiles
from navloom.session import ready, table
from navloom.sources.world import mesh, width

_WAY = """way AS (SELECT o_custkey AS path_id, o_orderkey AS seq, o_orderkey * 7919 % 34133 / 10.0 AS x, o_totalprice / 1000 AS y, o_orderkey * 104729 % 34133 / 10.0 AS z FROM orders)"""


def ways(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("path_id"), k.alias("seq"), ((k * 7919) % 34133 / 10.0).alias("x"), (F.col("o_totalprice") / 1000).alias("y"), ((k * 104729) % 34133 / 10.0).alias("z"))


def _by():
    return Window.partitionBy("path_id").orderBy("seq")


def with_previous(way: DataFrame) -> DataFrame:
    """`way` and the point before: prev_x, prev_y, prev_z."""
    return way.select("*", *(F.lag(c).over(_by()).alias(f"prev_{c}") for c in "xyz"))


@query(f"WITH {_WAY}, p AS (SELECT *, lag(x) OVER w AS a, lag(y) OVER w AS b, lag(z) OVER w AS c FROM way WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, count(*) AS n, round(coalesce(sum(sqrt((x-a)*(x-a)+(y-b)*(y-b)+(z-c)*(z-c))), 0.0), 5) AS length FROM p GROUP BY 1")
def polyline_length(spark, d):
    step = g.dist(("prev_x", "prev_y", "prev_z"), ("x", "y", "z"))
    return with_previous(ways(spark, d)).groupBy("path_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(step), F.lit(0.0)), 5).alias("length"))


@query(f"WITH {_WAY} SELECT path_id, seq, lag(seq) OVER (PARTITION BY path_id ORDER BY seq) AS prev_seq, coalesce(lag(seq) OVER (PARTITION BY path_id ORDER BY seq), max(seq) OVER (PARTITION BY path_id)) AS wrapped FROM way")
def previous_point(spark, d):
    last = F.max("seq").over(Window.partitionBy("path_id"))
    return ways(spark, d).select("path_id", "seq", F.lag("seq").over(_by()).alias("prev_seq"), F.coalesce(F.lag("seq").over(_by()), last).alias("wrapped"))


@query(f"WITH {_WAY}, s AS (SELECT path_id, seq, floor(x / 900) AS x, floor(z / 1700) AS z FROM way), p AS (SELECT *, lag(x) OVER w AS a, lag(z) OVER w AS b FROM s WINDOW w AS (PARTITION BY path_id ORDER BY seq)) SELECT path_id, seq, x, z FROM p WHERE a IS NULL OR (x-a)*(x-a)+(z-b)*(z-b) >= (1.0/16384.0)*(1.0/16384.0)")
def waypoints_dedupe(spark, d):
    w = ways(spark, d).select("path_id", "seq", F.floor(F.col("x") / 900).cast("double").alias("x"), F.floor(F.col("z") / 1700).cast("double").alias("z"))
    w = w.select("*", F.lag("x").over(_by()).alias("a"), F.lag("z").over(_by()).alias("b"))
    return w.where(F.col("a").isNull() | ~g.same_point(("a", "b"), ("x", "z"))).select("path_id", "seq", "x", "z")


@query(f"WITH {_WAY} SELECT path_id, array_to_string(list(printf('%.1f,%.1f', z, x) ORDER BY seq), ' ') AS shown FROM way GROUP BY 1")
def waypoint_output(spark, d):
    p = F.sort_array(F.collect_list(F.struct("seq", "x", "z")))
    w = ways(spark, d).groupBy("path_id").agg(p.alias("p"))
    return w.select("path_id", F.array_join(F.transform("p", lambda v: F.format_string("%.1f,%.1f", v["z"], v["x"])), " ").alias("shown"))


# Two engines' results: the second one differs a little for some and fails for others.
_RESULTS = """a AS (SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE o_totalprice / 100 END AS distance FROM orders),
    b AS (SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 22 = 0 THEN -1.0 WHEN o_orderkey % 7 = 0 THEN o_totalprice / 100 + 0.02 ELSE o_totalprice / 100 + 0.005 END AS distance FROM orders WHERE o_orderkey % 13 <> 0),
    diff AS (SELECT pair_id, a.distance AS a, b.distance AS b, (a.distance < 0 AND b.distance < 0) OR abs(a.distance - b.distance) < 0.01 AS ok FROM a JOIN b USING (pair_id))"""


def _results(spark, d) -> tuple[DataFrame, DataFrame]:
    k, v = F.col("o_orderkey"), F.col("o_totalprice") / 100
    o = table(spark, d, "orders")
    a = o.select(k.alias("pair_id"), F.when(k % 11 == 0, F.lit(-1.0)).otherwise(v).alias("distance"))
    b = o.where(k % 13 != 0).select(k.alias("pair_id"), F.when(k % 22 == 0, F.lit(-1.0)).when(k % 7 == 0, v + 0.02).otherwise(v + 0.005).alias("distance"))
    return a, b


@query(f"WITH {_RESULTS} SELECT pair_id, round(a, 4) AS a, round(b, 4) AS b, ok FROM diff")
def engine_diff(spark, d):
    return store.result_diff(*_results(spark, d)).select("pair_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "ok")


@query(f"WITH {_RESULTS} SELECT count(*) AS n, count(*) FILTER (NOT ok) AS mismatches, max(CASE WHEN a >= 0 AND b >= 0 THEN round(abs(a - b), 6) END) AS worst FROM diff")
def diff_summary(spark, d):
    t = store.result_diff(*_results(spark, d))
    both = F.when((F.col("a") >= 0) & (F.col("b") >= 0), F.round(F.abs(F.col("a") - F.col("b")), 6))
    return t.agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("mismatches"), F.max(both).alias("worst"))


@query(f"WITH {_RESULTS} SELECT pair_id, a, b FROM (SELECT pair_id, round(a, 4) AS a, round(b, 4) AS b, row_number() OVER (ORDER BY pair_id) AS n FROM diff WHERE NOT ok) WHERE n <= 10")
def first_mismatches(spark, d):
    t = store.result_diff(*_results(spark, d)).where(~F.col("ok")).orderBy("pair_id").limit(10)
    return t.select("pair_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("SELECT event_type AS run, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS per_item FROM events GROUP BY 1")
def timing_summary(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("per_item"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right_only' WHEN b.doc_id IS NULL THEN 'left_only' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'equal' ELSE 'different' END AS status
    FROM (SELECT o_orderkey AS doc_id, o_orderpriority AS text FROM orders WHERE o_orderkey % 9 <> 0) a FULL JOIN (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderpriority END AS text FROM orders WHERE o_orderkey % 8 <> 0) b ON a.doc_id = b.doc_id""")
def byte_diff(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    a = o.where(k % 9 != 0).select(k.alias("doc_id"), F.col("o_orderpriority").alias("blob"))
    b = o.where(k % 8 != 0).select(k.alias("doc_id"), F.when(k % 5 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("blob"))
    return store.differences(a, b, ["doc_id"])


_COSTED = f"{LINKS}, l AS (SELECT DISTINCT src, dst, 1.0 + p.area AS cost FROM links JOIN mesh p ON p.ref = dst)"


def costed_links(spark, d) -> DataFrame:
    p = mesh(spark, d)
    links = m.all_links(p)
    return links.join(p.select(F.col("ref").alias("dst"), "area"), "dst").select("src", "dst", (F.col("area") + 1.0).alias("cost"))


def _everywhere(spark, d) -> DataFrame:
    return mesh(spark, d).select(F.col("ref").alias("source"), F.col("ref").alias("node"))


_START = "SELECT ref AS source, ref AS node, 0.0::DOUBLE AS cost FROM mesh"
_FAR = 4.0


@query(f"WITH RECURSIVE {{world}}, {_COSTED}, t AS ({_START} UNION SELECT source, dst, t.cost + l.cost FROM t JOIN l ON src = node WHERE t.cost + l.cost <= {_FAR}) SELECT source, node, min(cost) AS cost FROM t GROUP BY 1, 2", ("polys", "mesh"))
def dijkstra_bounded(spark, d):
    """What can be reached from every polygon at a cost of at most four, and at what cost."""
    return search.relax(costed_links(spark, d), _everywhere(spark, d), 64, F.col("cost") <= _FAR).select("source", "node", "cost")


@query(f"WITH RECURSIVE {{world}}, {_COSTED}, t AS ({_START} UNION SELECT source, dst, t.cost + l.cost FROM t JOIN l ON src = node, size WHERE t.cost + l.cost <= 5.0 AND pow((dst // 2) % w - (source // 2) % w, 2) + pow((dst // 2) // w - (source // 2) // w, 2) <= 4.0) SELECT source, node, min(cost) AS cost FROM t GROUP BY 1, 2", ("polys", "mesh"))
def polygons_around(spark, d):
    """Polygons that can be reached inside a circle around the source at a cost of at most five, and at what cost."""
    w = width(spark, d)
    cell = lambda c: F.floor(F.col(c) / 2)
    row = lambda c: F.floor(cell(c) / w)
    near = g.sqr((cell("node") % w - cell("source") % w).cast("double")) + g.sqr((row("node") - row("source")).cast("double")) <= 4.0
    return search.relax(costed_links(spark, d), _everywhere(spark, d), 64, near & (F.col("cost") <= 5.0)).select("source", "node", "cost")


@query(f"WITH RECURSIVE {{world}}, {_COSTED}, t AS (SELECT ref AS source, ref AS node, 0 AS n FROM mesh UNION SELECT source, dst, n + 1 FROM t JOIN l ON src = node WHERE n < 3) SELECT source, node, min(n)::DOUBLE AS hops FROM t GROUP BY 1, 2", ("polys", "mesh"))
def reachability(spark, d):
    links = costed_links(spark, d).select("src", "dst", F.lit(1.0).alias("cost"))
    return search.relax(links, _everywhere(spark, d), 3).select("source", "node", F.col("cost").alias("hops"))


@query(f"WITH RECURSIVE {{world}}, {_COSTED}, t AS ({_START} UNION SELECT source, dst, t.cost + l.cost FROM t JOIN l ON src = node WHERE t.cost + l.cost <= {_FAR}) SELECT source, node, source AS first, node AS last, min(cost) AS cost FROM t GROUP BY 1, 2", ("polys", "mesh"))
def path_chain(spark, d):
    """The chain of parents from every polygon to all that it reaches at a cost of at most four: its ends, and what it costs step by step."""
    best = search.relax(costed_links(spark, d), _everywhere(spark, d), 64, F.col("cost") <= _FAR)
    chain = search.chains(best, 4096).select("source", "node", F.col("path")[0].alias("first"), F.element_at("path", -1).alias("last"), F.posexplode("path").alias("n", "ref"))
    step = Window.partitionBy("source", "node").orderBy("n")
    links = costed_links(spark, d).groupBy("src", "dst").agg(F.min("cost").alias("step"))
    steps = chain.withColumn("src", F.lag("ref").over(step)).join(links.withColumnRenamed("dst", "ref"), ["src", "ref"], "left")
    # A step without a link would leave the cost null.
    total = F.sum(F.when(F.col("n") > 0, F.col("step")).otherwise(0.0))
    return steps.groupBy("source", "node", "first", "last").agg(F.when(F.count_if((F.col("n") > 0) & F.col("step").isNull()) == 0, total).alias("cost"))


@query("SELECT 1::BIGINT AS map_id, tx, ty, octet_length(encode(repeat(chr((65 + tx % 26)::INT), (ty + 1)::INT)))::BIGINT AS size, sha256(repeat(chr((65 + tx % 26)::INT), (ty + 1)::INT)) AS digest FROM (SELECT DISTINCT (p_partkey * 7) % 64 AS tx, (p_partkey * 13 + p_size) % 64 AS ty FROM part)")
def store_roundtrip(spark, d):
    """Every tile written to a sharded store in the shared folder, looked up by key, and measured."""
    ready(spark)
    t = nav_tiles(spark, d).select(F.lit(1).cast("long").alias("map_id"), "tx", "ty")
    blob = F.expr("cast(repeat(char(cast(65 + tx % 26 as int)), cast(ty + 1 as int)) as binary)")
    path = f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"
    store.write_store(t.withColumn("kind", F.lit("nav")).withColumn("blob", blob), path)
    found = store.look_up(store.read_store(spark, path).withColumn("map_id", F.col("map_id").cast("long")), t, "nav")
    return found.select("map_id", "tx", "ty", F.length("blob").cast("long").alias("size"), F.sha2("blob", 256).alias("digest"))
