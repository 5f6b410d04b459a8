"""Pairs by bands of hashes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lecturelake.operators import duplicates
from lecturelake.plans import build_queries
from lecturelake.plans.tables import Tables
from tests.oracle import SF


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("words, most", [(1, 0), (1, 7), (4, 30)])
def test_near_hashes_equal_all_pairs(spark, words, most):
    rng = random.Random(words * 100 + most)
    rows, frames = [], {}
    for g in ("a", "b", None):
        seeds = [[rng.getrandbits(64) for _ in range(words)] for _ in range(6)]
        for i in range(60):
            h = list(rng.choice(seeds))
            for _ in range(rng.choice([0, most // 2, most, most + 1, 3 * most])):
                h[rng.randrange(words)] ^= 1 << rng.randrange(64)
            frames[g, i] = h
            rows.append((g, i, [signed(x) for x in h], 1))
    df = spark.createDataFrame(rows, "grp string, id long, h array<long>, cell int")
    got = [tuple(r) for r in duplicates.near_hashes(df, "grp", "h", words, most).collect()]
    distance = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
    want = {(g, a, b) for g, a in frames for h, b in frames if g == h and g is not None and a < b and distance(frames[g, a], frames[g, b]) <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_group_makes_few_candidates(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("hot", i, [signed(rng.getrandbits(64))]) for i in range(1500)], "g string, id long, h array<long>")
    bands = duplicates.bands(F.col("h"), 1, 7)
    n = len(bands)
    x = df.select("id", F.array(*bands).alias("v"))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("v", F.lit(i)).alias("x"), F.get("v", F.lit(j)).alias("y")) for i in range(n) for j in range(i)]
    met = x.select(F.explode(F.array(*pairs)).alias("c")).groupBy("c").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert met < 0.01 * 1500 * 1499 / 2 and duplicates.near_hashes(df, "g", "h", 1, 7).count() == 0


def test_edges_equal_all_pairs(spark):
    frames = build_queries._scene_frames(Tables(spark, SF)).cache()
    got = {tuple(r) for r in duplicates.duplicate_edges(frames, "g", build_queries._frame_metrics, duplicates.Profiles(bits=64)).collect()}
    side = lambda s: frames.select("g", F.struct("id", "scene", "base", "v").alias(s))
    every = side("fa").join(side("fb"), "g").filter("fa.id < fb.id")
    m = build_queries._frame_metrics(F.col("fa"), F.col("fb"))
    every = every.select("g", F.col("fa.id").alias("a"), F.col("fb.id").alias("b"), (F.col("fa.base") & F.col("fb.base")).alias("bases"), *[c.alias(n) for n, c in m.items()])
    p, m = duplicates.Profiles(bits=64), {n: F.col(n) for n in every.columns}
    every = every.withColumn("reason", p.reason(m)).filter("reason is not null").filter(~(m["agenda_like"] & (m["agenda_mismatch"] > 0.18)))
    want = {tuple(r) for r in every.select("g", "a", "b", "reason", (F.col("bases") & F.col("reason").isin("strict", "near-identical") & p.sure(m)).alias("sure")).collect()}
    assert got == want and any(x[4] for x in want) and len({x[3] for x in want}) > 1


def test_bits_that_never_differ_are_in_no_band(spark):
    """Hashes of 32 bits in words of 64: before, half of the bands were zero everywhere, and all pairs of a group met."""
    from unittest import mock

    rng = random.Random(2)
    df = spark.createDataFrame([("hot", i, [rng.getrandbits(32)]) for i in range(1500)], "g string, id long, h array<long>")
    tried = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (tried.add(1), x)[1], "int").asNondeterministic()
    with mock.patch.object(duplicates, "hamming", lambda a, b, f=duplicates.hamming: count(f(a, b))):
        got = {tuple(r)[1:] for r in duplicates.near_hashes(df, "g", "h", 1, 4).collect()}
    h = [r.h[0] for r in df.orderBy("id").collect()]
    assert got == {(i, j) for j in range(1500) for i in range(j) if (h[i] ^ h[j]).bit_count() <= 4}
    assert 0 < tried.value < 0.03 * 1500 * 1499 / 2


def test_frames_of_one_hash_meet_others_as_one(spark):
    """300 frames of three hashes: before, each two of a hash were compared in all of its cells."""
    from unittest import mock

    rng = random.Random(3)
    near = rng.getrandbits(62)
    hashes = [near, near ^ 5, rng.getrandbits(62)]
    df = spark.createDataFrame([("hot", i, [hashes[i % 3]]) for i in range(300)] + [("hot", 300, None), ("hot", 301, [None])], "g string, id long, h array<long>")
    tried = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (tried.add(1), x)[1], "int").asNondeterministic()
    with mock.patch.object(duplicates, "hamming", lambda a, b, f=duplicates.hamming: count(f(a, b))):
        got = [tuple(r)[1:] for r in duplicates.near_hashes(df, "g", "h", 1, 7).collect()]
    want = {(i, j) for j in range(300) for i in range(j) if (i % 3 == 2) == (j % 3 == 2)}
    assert len(got) == len(set(got)) and set(got) == want and tried.value < 300


def test_vectors_that_have_no_metrics(spark):
    """Nulls, two lengths and zeros: no metric, or the value that the SQL has; NaN is more than any number, as in SQL."""
    v = [0.2, -0.1] * 32
    nan = [float("nan"), *v[1:]]
    rows = [(0, v, v), (1, v, [None, *v[1:]]), (2, v, v[:60]), (3, v, None), (4, [0.0] * 64, [0.0] * 64), (5, v[:16], v[:16]), (6, nan, nan), (7, [], [])]
    df = spark.createDataFrame([(i, (a,), (b,)) for i, a, b in rows], "i int, fa struct<v: array<double>>, fb struct<v: array<double>>")
    m = build_queries._frame_metrics(F.col("fa"), F.col("fb"))
    got = {r.i: [r[c] for c in duplicates.METRICS] for r in df.select("i", *[m[c].alias(c) for c in duplicates.METRICS]).collect()}
    same = [0.0, 0.0, 0.0, 1.0, 0.0, pytest.approx(1.0)]
    assert got[0] == same * 2 and got[1] == got[2] == got[3] == got[7] == [None] * 12
    assert got[4] == [0.0, 0.0, 0.0, 1.0, 0.0, None] * 2 and got[5] == same + [None] * 6
    assert got[6][:2] == [0.0, 0.0] and got[6][4] != got[6][4] and got[6][6:] == same
