import datetime
import itertools

from lecturelake.plans import registry
from tests.oracle import compare, connection


def test_mean_on_the_threshold_and_tied_fixes(spark, tmp_path):
    """Status and fix are the same in whatever order an order's lines are read."""
    day = lambda d: datetime.datetime(2020, 1, d)
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_tax double, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string"
    rows = []
    for k, order in enumerate(itertools.permutations([(0.07, day(3)), (0.10, day(1)), (0.07, day(2))])):
        rows += [(k, 1, 1_000_005, d, 0.05, at, "R", "F") for d, at in order]
    rows += [(9, 2, 1, 0.0, 0.05, day(9), "A", "O"), (9, 1, 1_500_000, 0.0, 0.05, day(5), "A", "O")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.l_orderkey: (r.status, r.fix.day) for r in registry.QUERIES["vf_view"](spark, str(tmp_path)).collect()}
    assert got == {**{k: ("confirmed", 1) for k in range(6)}, 9: ("rejected", 5)}
    con = connection(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    compare(con, registry.QUERIES["vf_view"](spark, str(tmp_path)), registry.ORACLES["vf_view"])
