"""Graph operators over node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..storage import discard, stored


def roots(pairs: DataFrame) -> DataFrame:
    """id, to: for all whole numbers that pairs (a, b) name, the one that stands for what hangs together. Stored.

    In each round every node names the one of most neighbours among itself and its neighbours (ties by hashes that are
    drawn anew each round), and each edge moves on to what its ends have named. A node stays tied to the one it has named,
    as the edge between them moves as well, so what hangs together still does, but on a part of the nodes: the edges left
    shrink round by round and a round's work is done on them alone. A star is one node after a round, however many leaves
    it has, and a chain half as long.
    """
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = stored(pairs.select(*pair(F.col("a").cast("long"), F.col("b").cast("long"))).filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = [F.struct(F.col(x).alias("id"), F.col(y).alias("near")) for x in "ab" for y in "ab"]
        closed = left.select(F.explode(F.array(*both)).alias("e")).select("e.*")  # each node is its own neighbour as well
        degree = closed.groupBy("near").agg(F.count(F.lit(1)).alias("n"))
        named = closed.join(degree, "near").groupBy("id").agg(F.max_by("near", F.struct("n", F.xxhash64(F.lit(len(rounds)), "near"), "near")).alias("to"))
        named = stored(named, "named")
        moved = left.join(named.select(F.col("id").alias("a"), F.col("to").alias("to_a")), "a").join(named.select(F.col("id").alias("b"), F.col("to").alias("to_b")), "b")
        moved = stored(moved.select(*pair(F.col("to_a"), F.col("to_b"))).filter("a <> b").distinct(), "edges")
        discard(left)
        left = moved
        rounds.append(named)
    if not rounds:
        return left.select(F.col("a").alias("id"), F.col("b").alias("to"))
    discard(left)
    last = rounds[-1]
    for named in reversed(rounds[:-1]):
        last = named.join(last.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to"))
    if len(rounds) > 1:
        last = stored(last, "roots")
        discard(*rounds)
    return last


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that undirected edges (src, dst) reach. Nodes that only edges name count too. Nodes are
    whole numbers, or told by ids of 64 bits without clash."""
    known = edges.select("src", "dst").filter("src is not null and dst is not null")
    every = nodes.select("node").filter("node is not null").union(known.select(F.explode(F.array("src", "dst")))).distinct()
    every, seed = stored(every, "nodes"), 0
    kind = every.schema["node"].dataType
    whole = isinstance(kind, IntegralType)
    code = lambda c: F.col(c).cast("long") if whole else F.xxhash64(F.lit(seed), F.col(c).cast(kind))
    while not whole and not every.groupBy(code("node")).count().filter("count > 1").isEmpty():
        seed += 1
    ends = roots(known.select(code("src").alias("a"), code("dst").alias("b")))
    named = every.select("node", code("node").alias("id")).join(ends, "id", "left").select("node", F.coalesce("to", "id").alias("to"))
    named = stored(named, "labels")
    discard(every)
    return named.join(named.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def bfs(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, depth of what seeds (node) reach over undirected edges within a number of hops."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = seeds.select("node", F.lit(0).cast("long").alias("depth"))
    last = seen
    for d in range(1, hops + 1):
        new = last.join(both, last.node == both.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        last = stored(new.withColumn("depth", F.lit(d).cast("long")), "depth")
        seen = seen.unionByName(last)
    return seen
