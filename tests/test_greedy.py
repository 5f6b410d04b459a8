"""Greedy groups against the loop that reads them row by row."""

import random

from pyspark.sql import functions as F

from lecturelake.operators.build import greedy_groups
from lecturelake.operators.greedy import greedy_clusters, greedy_cliques
from lecturelake.plans import build_queries
from lecturelake.plans.tables import QUERIES, Tables
from tests.oracle import SF


def loop(items, links, complete):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    clusters, out = [], {}
    for item in items:
        linked = near.get(item, set()) - {item}
        for i, members in enumerate(clusters):
            if members <= linked if complete else members & linked:
                break
        else:
            i = len(clusters)
            clusters.append(set())
        clusters[i].add(item)
        out[item] = i
    return out


def test_both_equal_the_loop(spark):
    rng = random.Random(3)
    groups = {}
    for g, n, p in (("a", 60, 0.5), ("b", 60, 0.05), ("c", 1, 0), ("d", 40, 0.9), (7, 50, 0.2)):
        items = [f"{g}{i}" for i in range(n)]
        rng.shuffle(items)
        groups[str(g)] = (items, [(a, b) for a in items for b in items if a < b and rng.random() < p] + [(items[0], items[0]), (items[0], "unknown")])
    chain = [f"e{i}" for i in range(200)]
    groups["e"] = (chain, list(zip(chain, chain[1:])))
    items = spark.createDataFrame([(g, x, i * 3, "z") for g, (own, _) in groups.items() for i, x in enumerate(own)], "grp string, item string, place int, cluster string").drop("cluster")
    links = spark.createDataFrame([(g, *l) for g, (_, own) in groups.items() for l in own], "grp string, a string, b string")
    for complete, results in ((False, [greedy_clusters(items, links, "grp")]), (True, [greedy_cliques(items, links, "grp"), greedy_cliques(items, links, "grp", block=7)])):
        want = {(g, x): c for g, (own, tied) in groups.items() for x, c in loop(own, tied, complete).items()}
        for df in results:
            rows = df.collect()
            assert len(rows) == len(want) and {(r.grp, r.item): r.cluster for r in rows} == want
    empty = items.limit(0)
    assert greedy_clusters(empty, links, "grp").count() == 0 and greedy_cliques(empty, links, "grp").count() == 0


def test_queries_decide_every_line(spark):
    t = Tables(spark, SF)
    items, links = build_queries._alike_lines(t)
    for name, complete in (("graph_clique_greedy", True), ("graph_cluster_greedy", False)):
        got = {(r.g, r.item): r.cluster for r in QUERIES[name](spark, SF).collect()}
        assert len(got) == t.lineitem.count()
        assert got == {(r.g, r.item): r.cluster for r in greedy_groups(items, links, "g", complete).collect()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    from lecturelake.operators import greedy

    names = []
    keep = greedy.stored
    monkeypatch.setattr(greedy, "stored", lambda df, name: names.append(name) or keep(df, name))
    n = 5000
    items = spark.range(n).select(F.lit("hot").alias("grp"), F.col("id").alias("item"), F.col("id").alias("place"))
    links = spark.range(n - 1).select(F.lit("hot").alias("grp"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert greedy_clusters(items, links, "grp").filter("cluster = 0").count() == n
    assert names.count("greedy-labels") < 20


def test_small_groups_take_no_rounds(spark, monkeypatch):
    from lecturelake.operators import greedy

    names, keep = [], greedy.stored
    monkeypatch.setattr(greedy, "stored", lambda df, name: names.append(name) or keep(df, name))
    big = 2**53
    items = spark.range(4000).selectExpr("id div 8 as grp", f"id % 8 + {big} as item", "7 - id % 8 as place")
    links = spark.range(3500).selectExpr("id div 7 as grp", f"id % 7 + {big} as a", f"id % 7 + {big + 1} as b").union(spark.createDataFrame([(0, None, big), (-1, 1, 2)], "grp long, a long, b long"))
    for complete, run in ((False, greedy.greedy_clusters), (True, greedy.greedy_cliques)):
        want = loop([big + i for i in range(7, -1, -1)], [(big + i, big + i + 1) for i in range(7)], complete)
        rows = run(items, links, "grp").collect()
        assert len(rows) == 4000 and all(r.cluster == want[r.item] for r in rows)
    assert set(names) <= {"greedy-large"}


def test_large_groups_beside_small_ones(spark):
    rng = random.Random(5)
    groups = {}
    for g, n, p in (("a", 30, 0.3), ("b", 9, 0.4), ("c", 10, 0.5), ("d", 11, 0.8)):
        own = [f"{g}{i}" for i in range(n)]
        groups[g] = (own, [(a, b) for a in own for b in own if a < b and rng.random() < p])
    items = spark.createDataFrame([(g, x, i) for g, (own, _) in groups.items() for i, x in enumerate(own)], "grp string, item string, place int")
    links = spark.createDataFrame([(g, *l) for g, (_, own) in groups.items() for l in own], "grp string, a string, b string")
    for complete, run in ((False, greedy_clusters), (True, greedy_cliques)):
        want = {(g, x): c for g, (own, tied) in groups.items() for x, c in loop(own, tied, complete).items()}
        assert {(r.grp, r.item): r.cluster for r in run(items, links, "grp", block=10).collect()} == want
