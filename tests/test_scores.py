from pyspark.sql import functions as F

from lecturelake.operators import scores


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_levels_and_caps(spark):
    summary = lit(0, 0, 0.2, 0, 0, 0)
    assert value(spark, scores.match_level(*summary)) == scores.LEVELS.index("summary")
    assert value(spark, scores.centrality(*summary)) < 0.5
    core = lit(1, 0, 0, 0, 0, 0)
    assert value(spark, scores.match_level(*core)) == scores.LEVELS.index("core")
    cap = lambda level, central, every: value(spark, scores.topic_cap(F.lit(scores.LEVELS.index(level)), F.lit(central), F.lit(every)))
    assert (cap("summary", 0.2, True), cap("summary", 0.1, True), cap("core", 1.0, False), cap("none", 0.0, True)) == (0.42, 0.35, 1.0, 0.30)


def test_display(spark):
    show = lambda a, b, c=None: value(spark, scores.display_score(F.lit(a), F.lit(b), F.lit(c).cast("double")))
    assert (show(0.8, 0.8), show(0.0, 0.0), show(0.4, 0.4), show(0.8, 0.8, 0.0)) == (100, 0, 50, 80)


def test_times(spark):
    at = lambda x: value(spark, F.unix_seconds(scores.iso_utc(F.lit(x).cast("string"))))
    assert at("1970-01-01T00:00:10Z") == at("1970-01-01T00:00:10") == at("1970-01-01T09:00:10+09:00") == 10
    assert at("soon") is at(None) is None
