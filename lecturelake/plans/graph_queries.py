"""Graph queries: regions, nations, customers, orders, parts and suppliers as labelled nodes and typed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recommend
from .tables import Tables, query

_NODES = """nodes AS (
SELECT 'region/' || r_regionkey AS node, 'Region' AS label FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'Nation' FROM nation
UNION ALL SELECT 'customer/' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'Supplier' FROM supplier)"""
_EDGES = """edges AS (
SELECT 'nation/' || n_nationkey AS src, 'IN_REGION' AS rel, 'region/' || n_regionkey AS dst FROM nation
UNION ALL SELECT 'customer/' || c_custkey, 'LIVES_IN', 'nation/' || c_nationkey FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'BASED_IN', 'nation/' || s_nationkey FROM supplier)"""


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def nodes(t: Tables):
    parts = [(t.region, "region", "r_regionkey"), (t.nation, "nation", "n_nationkey"), (t.customer, "customer", "c_custkey"), (t.supplier, "supplier", "s_suppkey")]
    out = [df.select(_id(kind, key).alias("node"), F.lit(kind.title()).alias("label")) for df, kind, key in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def edges(t: Tables):
    parts = [(t.nation, "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey"), (t.customer, "customer", "c_custkey", "LIVES_IN", "nation", "c_nationkey"), (t.supplier, "supplier", "s_suppkey", "BASED_IN", "nation", "s_nationkey")]
    out = [df.select(_id(a, x).alias("src"), F.lit(rel).alias("rel"), _id(b, y).alias("dst")) for df, a, x, rel, b, y in parts]
    return out[0].union(out[1]).union(out[2])


@query("set_node_edge_split", f"WITH {_NODES}, {_EDGES} SELECT node AS id, label AS kind, NULL AS target FROM nodes UNION ALL SELECT src, rel, dst FROM edges")
def _(t: Tables):
    triples = nodes(t).select(F.col("node").alias("s"), F.lit("type").alias("p"), F.col("label").alias("o")).union(edges(t).select("src", "rel", "dst"))
    is_node = F.col("p") == "type"
    return triples.select(F.col("s").alias("id"), F.when(is_node, F.col("o")).otherwise(F.col("p")).alias("kind"), F.when(~is_node, F.col("o")).alias("target"))


@query("agg_graph_counts", f"WITH {_NODES}, {_EDGES} SELECT label AS kind, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT rel, count(*) FROM edges GROUP BY 1")
def _(t: Tables):
    return nodes(t).select(F.col("label").alias("kind")).union(edges(t).select("rel")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("join_orphan_nodes", f"WITH {_NODES}, {_EDGES}, bad AS (SELECT src, 'nation/' || (CAST(split_part(dst, '/', 2) AS INT) + 20) AS dst FROM edges WHERE rel = 'LIVES_IN') SELECT DISTINCT dst AS node, 'orphan' AS label FROM bad WHERE dst NOT IN (SELECT node FROM nodes)")
def _(t: Tables):
    bad = t.customer.select(F.concat(F.lit("nation/"), (F.col("c_nationkey") + 20).cast("string")).alias("node")).distinct()
    return bad.join(nodes(t), "node", "left_anti").select("node", F.lit("orphan").alias("label"))


@query("join_graph_path", f"WITH {_EDGES} SELECT a.dst AS nation, b.dst AS region, count(*) AS customers FROM edges a JOIN edges b ON a.dst = b.src AND b.rel = 'IN_REGION' WHERE a.rel = 'LIVES_IN' GROUP BY 1, 2")
def _(t: Tables):
    e = edges(t)
    a = e.filter("rel = 'LIVES_IN'").groupBy(F.col("dst").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    b = e.filter("rel = 'IN_REGION'").select(F.col("src").alias("nation"), F.col("dst").alias("region"))
    return a.join(b, "nation").select("nation", "region", "customers")


@query("graph_fix_direction", f"WITH {_EDGES}, d AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1) SELECT CASE WHEN coalesce(a.o, 0) < coalesce(b.o, 0) THEN dst ELSE src END AS src, CASE WHEN coalesce(a.o, 0) < coalesce(b.o, 0) THEN src ELSE dst END AS dst FROM edges LEFT JOIN d a ON a.node = src LEFT JOIN d b ON b.node = dst")
def _(t: Tables):
    e = edges(t)
    d = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    x = e.join(d.select("src", F.col("n").alias("a")), "src", "left").join(d.select(F.col("src").alias("dst"), F.col("n").alias("b")), "dst", "left")
    swap = F.coalesce("a", F.lit(0)) < F.coalesce("b", F.lit(0))
    return x.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"))


@query("graph_contrast_ratio", "SELECT l_orderkey, round(count(*) FILTER (l_returnflag = 'R') / count(*), 4) AS ratio FROM lineitem GROUP BY 1")
def _(t: Tables):
    """Of a lecture's relations, the share of those that set two concepts against each other."""
    kind = F.when(F.col("l_returnflag") == "R", recommend.CONTRAST_TYPES[0]).otherwise("PART_OF")
    x = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"), kind.alias("type"))).alias("relations"))
    return x.select("l_orderkey", F.round(recommend.contrast_ratio(), 4).alias("ratio"))


@query("graph_fragmentation", """WITH r AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_quantity >= 25 THEN l_partkey END) AS core, count(DISTINCT CASE WHEN l_quantity < 25 THEN l_partkey END) AS introduced FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(introduced / (core + introduced) * (1 - core / (core + introduced)), 6) AS score FROM r""")
def _(t: Tables):
    """How much of a lecture's concepts is introduced only, from its two lists of roles."""
    role = lambda test: F.collect_set(F.when(test, F.col("l_partkey")))
    x = t.lineitem.groupBy("l_orderkey").agg(role(F.col("l_quantity") >= 25).alias("core"), role(F.col("l_quantity") < 25).alias("introduced"))
    return x.select("l_orderkey", F.round(recommend.fragmentation(), 6).alias("score"))
