"""Machines that wait for the watermark, fed out of order in many micro-batches, against the table in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from lecturelake.operators import folds, timeline
from lecturelake.operators.windows import running_total
from lecturelake.plans import registry
from lecturelake.streaming.ordered import micros, ordered_machine, replayed, run
from tests.oracle import SF


@pytest.mark.parametrize("stream, table", [("stream_slide_change_timed", "win_slide_change"), ("stream_annotation_stability_timed", "win_annotation_stability_end")])
def test_queries_equal_their_table_twins(spark, stream, table):
    rows = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect())
    assert rows(stream) == rows(table)


def arriving(spark, tmp_path, batches, schema):
    """A stream of lists of rows, each a micro-batch."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("at", F.timestamp_seconds("t"))


def test_shuffled_arrival_equals_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c"]), t, i, rng.choice([10.0, 900.0]), rng.choice([0, 12])) for i, t in enumerate(sorted(rng.uniform(0, 90_000) for _ in range(400)))]
    rows[5] = (rows[5][0], rows[6][1], *rows[5][2:])  # a tie in time
    schema = "k string, t double, i long, mse double, hash long"
    late = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 3000))  # out of order by up to 50 minutes, across batches
    batches = [late[i : i + 45] for i in range(0, 400, 45)] + [[(None, t, None, None, None)] for t in (4e5, 8e5)]
    frame = lambda df: df.select("k", "t", "i", "mse", "hash", F.col("mse").alias("bm"), F.col("hash").alias("bh"), (F.col("mse") / 1000).alias("ch"), F.lit(0.0).alias("fm"), F.lit(0).alias("fh"), *[c for c in df.columns if c == "at"])
    columns = ["i", "mse", "hash", "bm", "bh", "ch", "fm", "fh"]
    step = timeline.scene_step(2, 4, 3)
    got = run(ordered_machine(frame(arriving(spark, tmp_path, batches, schema)), "k", "at", "i", columns, step, timeline.scene_flush, "a long, b long, c long, d long", "k string, i long, reason string", "1 hour", "2 days"))
    want = folds.fold(frame(spark.createDataFrame(rows, schema)), "k", ["t", "i"], [*columns, "t"], lambda s, r: step(s, r[:8]), timeline.scene_flush, "k string, i long, reason string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert any(r.reason == "end_flush" for r in want.collect())


def test_a_session_expires_without_another_event_and_is_forgotten(spark, tmp_path):
    hour = micros("1 hour")
    step, last = folds.heartbeat_step(hour)
    # a falls silent; b goes on, and its later heartbeats alone let a expire
    batches = [[("a", 0.0, 1), ("a", 600.0, 2), ("b", 100.0, 3)], [("b", 3000.0, 4)], [("b", 6000.0, 5)], [("b", 20_000.0, 6)], [("b", 20_100.0, 7)]]
    batches = [[(k, 1e6 + t, i) for k, t, i in b] for b in batches]
    stream = arriving(spark, tmp_path, batches, "k string, t double, i long").withColumn("us", F.unix_micros("at"))
    machine = ordered_machine(stream, "k", "at", "i", ["us"], step, last, "s long, l long, n long", "k string, s long, l long, n long, e long", "10 minutes", "1 hour")
    got = {(r.k, r.s // 1_000_000 - 10**6, r.l // 1_000_000 - 10**6, r.n, r.e // 1_000_000 - 10**6) for r in run(machine).collect()}
    # b's last session is still alive when the stream ends
    assert got == {("a", 0, 600, 2, 4200), ("b", 100, 6000, 3, 9600)}


def test_a_part_is_many_files_and_one_batch_and_keys_share_buckets(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", "d", "e"]), t, (1 << 40) + i) for i, t in enumerate(sorted(rng.sample(range(60_000), 300)))]
    table = spark.createDataFrame(rows, "k string, t long, i long").select("k", "i", F.timestamp_seconds("t").alias("at"))
    stream = replayed(table, "at", 3, "2 days", per_file=25).withColumn("us", F.unix_micros("at"))
    step, last = folds.heartbeat_step(micros("10 minutes"))
    # the state holds the id of the last heartbeat too, which must come back as it was
    with_id = lambda state, row: (lambda s, sent: ((*s, row[1]), [(*x, state[3]) for x in sent]))(*step(state and state[:3], row[:1]))
    flush = lambda state: [(*x, state[3]) for x in last(state[:3])]
    schema = "k string, s long, l long, n long, e long, i long"
    got = run(ordered_machine(stream, "k", "at", "i", ["us", "i"], with_id, flush, "s long, l long, n long, i long", schema, "1 hour", "10 minutes", buckets=2))
    want = folds.fold(table.withColumn("us", F.unix_micros("at")), "k", ["us", "i"], ["us", "i"], with_id, flush, schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_totals_over_stretches(spark):
    rng = random.Random(5)
    rows = [(k, at, rng.choice([-1, 1, 5])) for k in ("hot", "u", None) for at in rng.sample(range(5000), 300)]
    df = spark.createDataFrame(rows, "k string, at long, d int")
    for width in (10.0, 1e9):
        got = {(r.k, r.at): r.total for r in running_total(df, "k", "at", "d", width).collect()}
        assert got == {(k, at): sum(d for j, a, d in rows if j == k and a <= at) for k, at, _ in rows}
    assert running_total(df.limit(0), "k", "at", "d", 10.0).count() == 0
