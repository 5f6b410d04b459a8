"""Greedy groups in order.

Items join the first cluster that has any linked member, or all of whose members are linked; else they found one. Groups of
up to BLOCK items are decided each by itself, once its items have met their links; larger ones all together, in rounds of joins,
so that a hot group is many tasks' work and is not read row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, stored
from .folds import fold
from .windows import running_total

#: Items of a group that a task decides in one go, and places that a stretch of a group covers.
BLOCK, STRETCH = 1000, 10_000


def _by_size(items: DataFrame, links: DataFrame, group: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Items and links of the groups of up to `block` items, and those of the others, as stored tables; None if there are no others."""
    large = stored(items.groupBy(F.col(group).alias("large")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("large"), "greedy-large")
    if large.isEmpty():
        discard(large)
        return None
    met = lambda df, how: df.join(large, F.col(group).eqNullSafe(F.col("large")), how)
    return met(items, "left_anti"), met(links, "left_anti"), met(items, "left_semi"), met(links, "left_semi")


def _in_one_go(items: DataFrame, links: DataFrame, group: str, complete: bool) -> DataFrame:
    """group, item, cluster of groups of few items: each item comes with what it is linked to, a group's items in order."""
    kind, item_kind = (items.schema[c].dataType.simpleString() for c in (group, "item"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("other")), F.struct(F.col("b").alias("item"), F.col("a").alias("other"))))
    near = links.filter("a is not null and b is not null and a <> b").select(F.col(group).alias("g"), ends.alias("e"))
    near = near.groupBy("g", "e.item").agg(F.collect_list(F.col("e.other").cast(item_kind)).alias("near"))
    own = items.select(F.col(group).alias("g"), "item", F.col("place").cast("long").alias("p")).join(near, ["g", "item"], "left")
    own = own.withColumn("near", F.coalesce("near", F.array().cast(f"array<{item_kind}>")))

    def step(state, row):
        _, item, near = row
        cluster, size = state or ({}, [])
        met: dict[int, int] = {}
        for x in set(near):
            if x in cluster:
                met[cluster[x]] = met.get(cluster[x], 0) + 1
        c = min((c for c, n in met.items() if not complete or n == size[c]), default=len(size))
        if c == len(size):
            size.append(0)
        size[c] += 1
        cluster[item] = c
        return (cluster, size), [(item, c)]

    return fold(own, "g", ["p"], ["p", "item", "near"], step, lambda state: [], f"g {kind}, item {item_kind}, cluster int").withColumnRenamed("g", group)


def greedy_clusters(items: DataFrame, links: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """group, item, cluster (from 0): items (item, place; both unique in a group) in order of place each join the first cluster
    with any member that links (group, a, b; in either order) tie to it, else found one.

    The cluster of an item is that of the least place that it reaches by links that each lead to an earlier item, so the
    places spread over the links and every item then takes what the one it has got has reached: rounds grow with the
    logarithm of a chain, and a hot group's links are many tasks' work. Links of or between unknown items, and of an item to itself,
    are none. This is how groups of more than `block` items are decided.
    """
    parts = _by_size(items, links, group, block)
    if parts is None:
        return _in_one_go(items, links, group, False)
    return _in_one_go(*parts[:2], group, False).union(_spread(*parts[2:], group))


def _spread(items: DataFrame, links: DataFrame, group: str) -> DataFrame:
    node = stored(items.select(F.col(group).alias("g"), "item", F.col("place").cast("long").alias("p")), "greedy-nodes")
    both = links.select(F.col(group).alias("g"), "a", "b").union(links.select(group, "b", "a"))
    ends = both.join(node.select("g", F.col("item").alias("a"), F.col("p").alias("pa")), ["g", "a"]).join(node.select("g", F.col("item").alias("b"), F.col("p").alias("pb")), ["g", "b"])
    down = stored(ends.filter("pb < pa").select("g", "pa", "pb").distinct(), "greedy-links")
    now = stored(node.select("g", "p", F.col("p").alias("to")), "greedy-labels")
    while True:
        near = down.join(now.select("g", F.col("p").alias("pb"), "to"), ["g", "pb"]).groupBy("g", F.col("pa").alias("p")).agg(F.min("to").alias("near"))
        best = now.join(near, ["g", "p"], "left").select("g", "p", F.col("to").alias("was"), F.least("to", F.coalesce("near", "to")).alias("to"))
        jump = now.select("g", F.col("p").alias("to"), F.col("to").alias("far"))
        new = stored(best.join(jump, ["g", "to"]).select("g", "p", F.col("far").alias("to"), (F.col("far") < F.col("was")).alias("moved")), "greedy-labels")
        discard(now)
        now = new
        if now.filter("moved").isEmpty():
            break
    discard(down)
    founders = running_total(now.filter("p = to").select("g", "p", F.lit(1).alias("one")), "g", "p", "one", STRETCH)
    numbered = now.join(founders.select("g", F.col("p").alias("to"), (F.col("total") - 1).cast("int").alias("cluster")), ["g", "to"])
    return node.join(numbered, ["g", "p"]).select(F.col("g").alias(group), "item", "cluster")


def greedy_cliques(items: DataFrame, links: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """group, item, cluster (from 0): items (item, place; both unique in a group) in order of place each join the first cluster
    all of whose members links (group, a, b; in either order) tie to it, else found one.

    Groups of more than `block` items advance together, `block` items of each a round. What a block's items are linked to among the items before it is
    a join and a count for each of their clusters; one task then decides a group's block from the clusters that are linked
    in full and the links inside the block, row by row, so it holds no more than these. Self-links and unknown items do nothing.
    """
    parts = _by_size(items, links, group, block)
    if parts is None:
        return _in_one_go(items, links, group, True)
    return _in_one_go(*parts[:2], group, True).union(_by_blocks(*parts[2:], group, block))


def _by_blocks(items: DataFrame, links: DataFrame, group: str, block: int) -> DataFrame:
    kind, item_kind = items.schema[group].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    x = items.select(F.col(group).alias("g"), "item", F.col("place").cast("long").alias("p"), F.lit(1).alias("one"))
    x = running_total(x, "g", "p", "one", STRETCH).select("g", "item", (F.col("total") - 1).alias("i"))
    x = stored(x.withColumn("b", F.floor(F.col("i") / block)), "greedy-items")
    both = stored(links.filter("a <> b").select(F.col(group).alias("g"), "a", "b").union(links.filter("a <> b").select(group, "b", "a")).distinct(), "greedy-links")

    def step(state, row):
        _, item, open_, inner, first = row
        joined, founded = state or ({}, 0)
        linked = set(inner)
        for c in [*(int(c) for c in open_), *range(int(first), int(first) + founded)]:
            if linked.issuperset(joined.get(c, ())):
                break
        else:
            c, founded = int(first) + founded, founded + 1
        joined.setdefault(c, []).append(item)
        return (joined, founded), [(item, c)]

    done: list[DataFrame] = []
    last = x.agg(F.max("b")).first()[0]
    for b in range(0 if last is None else last + 1):
        now = x.filter(F.col("b") == b).select("g", "item", "i")
        met = now.select("g", F.col("item").alias("a")).join(both, ["g", "a"])
        inner = met.join(now.select("g", F.col("item").alias("b")), ["g", "b"], "left_semi").groupBy("g", F.col("a").alias("item")).agg(F.collect_list("b").alias("inner"))
        now = now.join(inner, ["g", "item"], "left").withColumn("inner", F.coalesce("inner", F.array().cast(f"array<{item_kind}>")))
        if done:
            before = reduce(DataFrame.union, done)
            sizes = before.groupBy("g", "cluster").agg(F.count(F.lit(1)).alias("size"))
            counts = met.join(before.select("g", F.col("item").alias("b"), "cluster"), ["g", "b"]).groupBy("g", "a", "cluster").agg(F.count(F.lit(1)).alias("tied"))
            full = counts.join(sizes, ["g", "cluster"]).filter("tied = size").groupBy("g", F.col("a").alias("item")).agg(F.sort_array(F.collect_list("cluster")).alias("open"))
            number = sizes.groupBy("g").agg((F.max("cluster") + 1).alias("n"))
            now = now.join(full, ["g", "item"], "left").join(number, "g", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "open": F.coalesce("open", F.array().cast("array<int>"))})
        else:
            now = now.withColumns({"n": F.lit(0), "open": F.array().cast("array<int>")})
        done.append(stored(fold(now, "g", ["i"], ["i", "item", "open", "inner", "n"], step, lambda state: [], f"g {kind}, item {item_kind}, cluster int"), "greedy-decided"))
        if len(done) == 16:
            done = [stored(reduce(DataFrame.union, done), "greedy-decided")]
    discard(both)
    every = reduce(DataFrame.union, done) if done else x.select("g", "item", F.lit(0).alias("cluster")).limit(0)
    return every.withColumnRenamed("g", group)
