"""JSON, Parquet and log files as sources and sinks. Writes go through Spark's committer, so a failed job leaves nothing half-written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import new_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not yet used, in the shared folder."""
    return new_path(spark, f"files/{name}")


def read_optional(spark: SparkSession, paths: list[str], schema: str, fmt: str = "json") -> DataFrame:
    """The first of the candidate paths that exists and holds rows, else no rows. Broken JSON lines are dropped."""
    for path in paths:
        try:
            df = spark.read.schema(schema).option("mode", "DROPMALFORMED").format(fmt).load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if not df.isEmpty():
            return df
    return spark.createDataFrame([], schema)


def read_latest(spark: SparkSession, pattern: str, schema: str, key: str, multi_line: bool = False) -> DataFrame:
    """Objects or arrays, one a line (or one a file); of rows with one key, that of the last path wins. Rows without a key go."""
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(pattern).select("*", F.col("_metadata.file_path").alias("from_path"))
    held = [c for c in rows.columns if c not in (key, "from_path")]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*held), "from_path").alias("row"))
    return best.select(key, "row.*")


def silences(log: DataFrame, key: str, line: str, place: str) -> DataFrame:
    """Silent intervals of logs: the k-th silence_start goes with the k-th silence_end of the same key; key, start_sec, end_sec, duration_sec.

    Starts or ends without a partner, and intervals without length, are dropped.
    """
    number = r"\s*(-?\d+(?:\.\d+)?)"
    value = lambda name: F.regexp_extract(line, f"{name}:{number}", 1).try_cast("double")
    x = log.select(key, place, value("silence_start").alias("s"), value("silence_end").alias("e"), value("silence_duration").alias("d"))
    x = x.filter("s IS NOT NULL OR (e IS NOT NULL AND d IS NOT NULL)").withColumn("opens", F.col("s").isNotNull())
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(key, "opens").orderBy(place)))
    pairs = x.groupBy(key, "k").agg(F.max("s").alias("start_sec"), F.max(F.when(~F.col("opens"), F.col("e"))).alias("end_sec"), F.max(F.when(~F.col("opens"), F.col("d"))).alias("duration_sec"))
    return pairs.filter("end_sec > start_sec AND duration_sec > 0").drop("k")


def write_json(df: DataFrame, path: str, keep_nulls: bool = True) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)
    return path


def write_bundle(tables: dict[str, DataFrame], path: str, by: str | None = None) -> dict[str, str]:
    """A Parquet folder for each table; partitioned by a column where one is named."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in tables}


def write_manifest(spark: SparkSession, bundle: dict[str, str], path: str) -> str:
    """A JSON file with a line for each table of a bundle: name, path, rows, columns."""
    parts = []
    for name, at in bundle.items():
        df = spark.read.parquet(at)
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(at).alias("path"), "rows", F.lit(len(df.columns)).alias("columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return write_json(out, path)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in gone: a table after a cascading delete."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def read_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, n (rows), status: ok, or missing where there is no such table."""
    out = []
    for name, path in paths.items():
        try:
            n, status = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select("n"), "ok"
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            n, status = spark.range(1).select(F.lit(0).cast("long").alias("n")), "missing"
        out.append(n.select(F.lit(name).alias("name"), "n", F.lit(status).alias("status")))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def replace_partitions(new: DataFrame, path: str, key: str) -> None:
    """Write new over those partitions of the table at path that it has rows of; the others stay."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, created: str) -> DataFrame:
    """old with the rows of new by key: values of new win, but what `created` was stays where a row was there."""
    rest = [c for c in old.columns if c not in (key, created)]
    x = old.withColumn("there", F.lit(True)).alias("o").join(new.withColumn("there", F.lit(True)).alias("n"), key, "full")
    pick = [F.when(F.col("n.there"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest]
    return x.select(key, *pick, F.when(F.col("o.there"), F.col(f"o.{created}")).otherwise(F.col(f"n.{created}")).alias(created))


def fingerprints(df: DataFrame, part: str, key: str) -> DataFrame:
    """part, fingerprint: SHA-256 over a partition's rows as JSON in the order of their keys, whose hashes are joined."""
    row = F.struct(F.col(key).alias("k"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    return df.groupBy(part).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row))["h"], ""), 256).alias("fingerprint"))


def changed(old: DataFrame, new: DataFrame, part: str, key: str) -> DataFrame:
    """part, changed: whether a partition's rows differ between two tables, or it is in one alone."""
    a, b = fingerprints(old, part, key), fingerprints(new, part, key).withColumnRenamed("fingerprint", "other")
    return a.join(b, part, "full").select(part, (~F.col("fingerprint").eqNullSafe(F.col("other"))).alias("changed"))
