"""The JDBC source against a database in memory that comes with Spark."""

import contextlib

from pyspark.sql import functions as F

from lecturelake.sources.jdbc import read_table
from tests.oracle import SF

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_a_table_is_read_in_ranges_with_filters_pushed_down(spark):
    url = "jdbc:derby:memory:catalog;create=true"
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_retailprice", "p_size")
    part.write.format("jdbc").options(url=url, dbtable="part", **DERBY).mode("overwrite").save()
    part.limit(0).write.format("jdbc").options(url=url, dbtable="nothing", **DERBY).mode("overwrite").save()
    try:
        own = lambda name: f'"{name}"'  # noqa: E731  the names that were written are in lower case
        read = read_table(spark, url, "part", own("p_partkey"), 4, **DERBY)
        assert read.rdd.getNumPartitions() == 4 and sorted(map(tuple, read.collect())) == sorted(map(tuple, part.collect()))
        some = read.filter("p_size > 20 AND p_name IS NOT NULL").select("p_partkey")
        plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PushedFilters" in plan and "GreaterThan(p_size,20)" in plan and "p_retailprice" not in plan.split("ReadSchema")[1]
        assert sorted(r[0] for r in some.collect()) == sorted(r[0] for r in part.filter("p_size > 20").select("p_partkey").collect())
        assert read_table(spark, url, "nothing", own("p_partkey"), 4, **DERBY).count() == 0
        joined = read_table(spark, url, "(SELECT \"p_size\" AS size, count(*) AS n FROM part GROUP BY \"p_size\") sizes", **DERBY)
        assert joined.agg(F.sum("n")).first()[0] == part.count()
    finally:
        with contextlib.suppress(Exception):  # dropping a database in memory ends in an error by design
            spark._jvm.java.sql.DriverManager.getConnection("jdbc:derby:memory:catalog;drop=true")
