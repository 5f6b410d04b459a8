"""Ordered operators: sessions, runs, visits, ranks and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def seconds(c: str) -> Column:
    """Seconds since the start of 2024."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {c})") / 1e6


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], start: str, gap: float) -> DataFrame:
    """Add session (from 0): a new one begins where the time since the row before reaches gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(start).over(w)
    opens = (before.isNotNull() & (F.col(start) - before >= gap)).cast("long")
    return df.withColumn("opens", opens).withColumn("session", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Add run (from 0): rows in order that share a value are one run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    turns = (F.row_number().over(w) > 1) & ~before.eqNullSafe(F.col(value))
    return df.withColumn("turns", turns.cast("long")).withColumn("run", F.sum("turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("turns")


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= n)


def with_fallback(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass the test, or all if none does. The flag is one aggregate, not a window over everything."""
    any_pass = df.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("x")).scalar()
    return df.filter(F.coalesce(test, F.lit(False)) | ~any_pass)


def running_total(df: DataFrame, key: str, at: str, amount: str, width: float) -> DataFrame:
    """Add total: the sum of amount over the key's rows up to at (unique in a key). A key's time is cut into stretches of width,
    which are summed by themselves and take the sum of those before, so that a hot key is many tasks' work."""
    x = df.withColumn("stretch", F.floor(F.col(at) / width))
    so_far = Window.partitionBy("sum_key").orderBy("sum_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy(F.col(key).alias("sum_key"), F.col("stretch").alias("sum_stretch")).agg(F.sum(amount).alias("sum_all"))
    sums = sums.withColumn("earlier", F.coalesce(F.sum("sum_all").over(so_far), F.lit(0))).drop("sum_all")
    own = F.sum(amount).over(Window.partitionBy(key, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    met = x.withColumn("own", own).join(sums, F.col(key).eqNullSafe(F.col("sum_key")) & (F.col("stretch") == F.col("sum_stretch")))
    return met.withColumn("total", F.col("own") + F.col("earlier")).drop("sum_key", "sum_stretch", "earlier", "own", "stretch")
