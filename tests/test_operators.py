from lecturelake.operators import graph
from lecturelake.operators.intervals import nearest_join, overlap_join, window_join
from lecturelake.operators.windows import gap_sessions, runs


def test_overlap_join_on_bucket_edges(spark):
    a = spark.createDataFrame([("u", 1, 0.0, 10.0), ("u", 2, 10.0, 35.0), ("v", 3, 0.0, 50.0)], "k string, i int, ls double, le double")
    b = spark.createDataFrame([("u", 7, 5.0, 12.0), ("u", 8, 35.0, 36.0), ("v", 9, 49.0, 90.0), ("w", 10, 0.0, 1.0)], "k string, j int, rs double, re double")
    assert sorted((r.i, r.j) for r in overlap_join(a, b, ["k"], 10).collect()) == [(1, 7), (2, 7), (3, 9)]


def test_window_join_takes_each_pair_once(spark):
    a = spark.createDataFrame([("u", 1, 100.0), ("u", 2, 0.0)], "k string, i int, at double")
    b = spark.createDataFrame([("u", 7, 95.0), ("u", 8, 102.0), ("u", 9, 102.1), ("u", 10, -5.0)], "k string, j int, o double")
    assert sorted((r.i, r.j) for r in window_join(a, b, ["k"], "at", "o", 5, 2).collect()) == [(1, 7), (1, 8), (2, 10)]


def test_nearest_without_pairs(spark):
    import random

    rng = random.Random(7)
    marks = [(i, rng.choice(["u", "v", None]), rng.choice([None, *(0.5 * rng.randint(-60, 60) for _ in range(20))])) for i in range(150)]
    others = [(i, rng.choice(["u", "v", None]), rng.choice([None, *(0.5 * rng.randint(-90, 90) for _ in range(20))])) for i in range(60)]
    a, b = spark.createDataFrame(marks, "i long, k string, x double"), spark.createDataFrame(others, "j long, k string, y double")
    near = nearest_join(a, b, ["k"], "i", "j", "x", "y", 4.0)
    met = {i: min(((abs(y - x), j) for j, q, y in others if k and k == q and None not in (x, y) and abs(y - x) <= 4), default=None) for i, k, x in marks}
    assert sorted((r.i, r.gap, r.j) for r in near.collect()) == sorted((i, *m) for i, m in met.items() if m)
    assert len({m for m in met.values() if m}) > 20 and "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_sessions_runs_and_empty_tables(spark):
    rows = spark.createDataFrame([("u", 0.0, "a"), ("u", 1.0, "a"), ("u", 9.0, None), ("u", 10.0, None), ("v", 3.0, "b")], "k string, at double, v string")
    assert sorted((r.k, r.at, r.session) for r in gap_sessions(rows, ["k"], ["at"], "at", 5).collect()) == [("u", 0.0, 0), ("u", 1.0, 0), ("u", 9.0, 1), ("u", 10.0, 1), ("v", 3.0, 0)]
    assert sorted((r.k, r.at, r.run) for r in runs(rows, ["k"], ["at"], "v").collect()) == [("u", 0.0, 0), ("u", 1.0, 0), ("u", 9.0, 1), ("u", 10.0, 1), ("v", 3.0, 0)]
    assert gap_sessions(rows.limit(0), ["k"], ["at"], "at", 5).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n + 2).withColumnRenamed("id", "node")
    edges = spark.range(n - 1).selectExpr("id + 1 as src", "id as dst")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n + 1}


def test_components_work_on_fewer_edges_each_round(spark, monkeypatch):
    kept, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: kept.append((name, store(df, name))) or kept[-1][1])
    monkeypatch.setattr(graph, "discard", lambda *tables: None)
    n = 3000
    edges = spark.range(n - 1).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst").union(spark.createDataFrame([("x", "x"), ("y", None)], "src string, dst string"))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([("z",)], "node string"), edges).collect()}
    assert got == {f"n{i}": "n0" for i in range(n)} | {"x": "x", "z": "z"}
    sizes = [df.count() for name, df in kept if name == "edges"]
    assert sizes[0] == n - 1 and sizes[-1] == 0 and sum(sizes) < 3 * n and all(b < 0.8 * a for a, b in zip(sizes, sizes[1:], strict=False) if a > 100)


def test_components_of_a_star_take_a_round(spark, monkeypatch):
    names, store = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or store(df, name))
    edges = spark.range(1, 4000).selectExpr("id as src", "2000L * 10000 as dst").union(spark.createDataFrame([(-5, -5), (-7, None)], "src long, dst long"))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame([(-9,)], "node int"), edges).collect()}
    assert got == {i: 1 for i in [*range(1, 4000), 2000 * 10000]} | {-5: -5, -9: -9}
    assert names.count("named") == 1


def test_overlaps_of_short_and_very_long_intervals(spark):
    import random

    from lecturelake.operators.intervals import overlap_join, point_join

    rng = random.Random(3)
    spans = [(rng.randint(0, 1), s, s + rng.choice([0.0, 0.5, 10.0, 40.0, 41.0, 1e3, 3e7])) for s in (rng.uniform(-100, 4000) for _ in range(120))]
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)] + [(900, 0, None, 1.0)], "i int, k int, ls double, le double")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(spans[::2])] + [(901, 0, 1.0, None)], "j int, k int, rs double, re double")
    got = sorted((r.i, r.j) for r in overlap_join(left, right, ["k"], 10.0).collect())
    assert got == sorted((i, j) for i, (k, a, b) in enumerate(spans) for j, (q, c, d) in enumerate(spans[::2]) if k == q and a < d and c < b)
    points = spark.createDataFrame([(i, k, a) for i, (k, a, _) in enumerate(spans)] + [(902, 1, None)], "i int, k int, at double")
    got = sorted((r.i, r.j) for r in point_join(points, right, ["k"], "at", "rs", "re", 10.0).collect())
    assert got == sorted((i, j) for i, (k, a, _) in enumerate(spans) for j, (q, c, d) in enumerate(spans[::2]) if k == q and c <= a <= d)
    assert overlap_join(left, right.limit(0), ["k"], 10.0).count() == 0
