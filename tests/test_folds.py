import pytest

from lecturelake.operators import folds
from lecturelake.plans import registry
from tests.oracle import SF


def by_user(spark):
    out = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        out.setdefault(r.user_id, []).append((r.event_id, r.value))
    return out


def test_packing_equals_a_plain_loop(spark):
    want = []
    for user, rows in by_user(spark).items():
        chunks = []
        for event, length in rows:
            if chunks and chunks[-1][1] + length <= 180:
                chunks[-1] = (chunks[-1][0], chunks[-1][1] + length, chunks[-1][2] + 1)
            else:
                chunks.append((event, length, 1))
        want += [(user, *c) for c in chunks]
    assert sorted(tuple(r) for r in registry.QUERIES["win_chunk_pack"](spark, SF).collect()) == sorted(want)


def captures(rows, ratio, active, quiet):
    """What stands in the definition, over a list."""
    out, i = [], 1
    base = rows[0][1]
    while i < len(rows):
        if abs(rows[i][1] - base) < ratio:
            i += 1
            continue
        began, last, rest = i, i, 0
        i += 1
        while i < len(rows) and rest < quiet and abs(rows[i][1] - base) >= ratio:
            if abs(rows[i][1] - rows[i - 1][1]) >= active:
                last, rest = i, 0
            else:
                rest += 1
            i += 1
        if rest == quiet:
            out.append((rows[last][0], i - began))
            base = rows[i - 1][1]
    return out


@pytest.mark.parametrize("name", ["win_annotation_stability", "stream_annotation_stability"])
def test_annotations_equal_the_definition(spark, name):
    want = [(u, *c) for u, rows in by_user(spark).items() for c in captures(rows, 40.0, 15.0, 2)]
    assert want
    assert sorted(tuple(r) for r in registry.QUERIES[name](spark, SF).collect()) == sorted(want)


def test_fold_of_nothing_and_of_null_keys(spark):
    schema = "k long, start long, seconds double, pieces long"
    step, last = folds.pack_speech(10.0)
    df = spark.createDataFrame([(None, 1, 4.0), (None, 2, 4.0), (None, 3, 4.0), (7, 4, 40.0)], "k long, start long, seconds double")
    run = lambda d: sorted((tuple(r) for r in folds.fold(d, "k", ["start"], ["start", "seconds"], step, last, schema).collect()), key=str)
    assert run(df) == sorted([(None, 1, 8.0, 2), (None, 3, 4.0, 1), (7, 4, 40.0, 1)], key=str)
    assert run(df.limit(0)) == []
