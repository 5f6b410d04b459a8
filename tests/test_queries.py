import pytest

from lecturelake.plans import registry
from tests.oracle import SF, compare, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    compare(con, registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def test_streams_equal_batch(spark):
    from pyspark.sql import functions as F

    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    batch = e.groupBy(F.window("at", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    want = {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in batch.select(F.col("w.start").alias("start"), "event_type", "n", "total").collect()}
    assert {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in registry.QUERIES["stream_tumbling"](spark, SF).collect()} == want
    batch = e.groupBy(F.session_window("at", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    want = sorted((r.user_id, r.s, r.n) for r in batch.select("user_id", F.col("w.start").alias("s"), "n").collect())
    assert sorted((r.user_id, r.start, r.n) for r in registry.QUERIES["stream_session_gap"](spark, SF).collect()) == want


def test_mmr_equals_a_plain_loop(spark):
    import numpy as np

    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    rel = {k: round(float(v @ unit[0]), 6) for k, v in unit.items()}
    left = sorted(rel, key=lambda k: (-rel[k], k))[:96]
    chosen = []
    while len(chosen) < 18:
        best = max(left, key=lambda k: (round(0.78 * rel[k] - 0.22 * max([float(unit[k] @ unit[c]) for c in chosen], default=0.0), 12), rel[k], -k))
        chosen.append(best)
        left.remove(best)
    got = {r.place: r.vec_id for r in registry.QUERIES["topk_mmr"](spark, SF).collect()}
    assert [got[i] for i in range(1, 19)] == chosen
