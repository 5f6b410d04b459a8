"""Tables of a relational database, read in ranges of a key with filters pushed down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a read fetches at once.
FETCH = 1000


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table, or a query in parentheses with a name, as a DataFrame; filters and columns asked of it reach the database.

    With a key (a number, date or timestamp) the rows are read as so many ranges of it, between the least and the greatest,
    which a query of its own asks for; rows beyond them, added since, and null keys are in the outer ranges. An empty table, or one
    without a key given, is one range. options: of Spark's JDBC source, such as user, password, driver.
    """
    read = lambda what: spark.read.format("jdbc").options(url=url, dbtable=what, fetchsize=str(FETCH), **options)
    if key is None:
        return read(table).load()
    low, high = read(f"(SELECT min({key}) AS low, max({key}) AS high FROM {table} bounded) bounds").load().first()
    if low is None:
        return read(table).load()
    return read(table).options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()
