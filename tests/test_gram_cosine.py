import pytest

from lecturelake.operators import build


def test_grams_stay_off_the_driver_and_repeated_pairs_count_once(spark):
    """The tables of grams and texts are merged, not broadcast, however small the optimizer takes them for."""
    texts = spark.createDataFrame([(1, "Abcd e"), (2, "abcde!"), (3, "abxx"), (4, None), (5, "ab"), (6, "ab")], "id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 4), (5, 6), (1, 7)], "a long, b long")
    out = build.gram_cosine(pairs, texts)
    got = sorted((r.a, r.b, r.cosine) for r in out.collect())
    assert [x[:2] for x in got] == [(1, 2), (1, 2), (1, 4), (1, 7), (2, 3), (5, 6)]
    assert [x[2] for x in got] == pytest.approx([1, 1, 0, 0, 0, 1])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") >= 4
