from pyspark.sql import functions as F

from lecturelake.functions import boxes, terms


def test_terms(spark):
    rows = [("운영체제의 강의 추천해줘",), ("운영 체제에 대해 알려줘",), ("",), (None,)]
    df = spark.createDataFrame(rows, "q string")
    assert [r[0] for r in df.select(terms.base(F.col("q"))).collect()] == ["운영체제", "운영 체제", "", None]
    pairs = spark.createDataFrame([("운영체제는", "운영 체제"), ("운영체제", "네트워크"), ("", "네트워크"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(terms.concept_match(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_boxes(spark):
    one = lambda x, y, w, h: boxes.box(*map(F.lit, (x, y, w, h)))
    df = spark.range(1).select(one(0, 0, 2, 2).alias("a"), one(1, 1, 2, 2).alias("b"), one(5, 6, 0, 0).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    got = df.select(boxes.iou(a, b), boxes.share_of_smaller(a, b), boxes.gap(a, c), boxes.iou(c, c), boxes.near(a, b), boxes.near(a, c)).first()
    assert [round(x, 6) for x in got[:4]] == [round(1 / 7, 6), 0.25, 5.0, 0.0] and got[4] and not got[5]
