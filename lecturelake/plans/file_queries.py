"""Queries that write the given tables as JSON, logs or Parquet and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from .tables import Tables, query

CLAIM = "claim_id long, kind string, score double"


def _claims(t: Tables):
    return t.events.select(F.col("event_id").alias("claim_id"), F.col("event_type").alias("kind"), F.col("value").alias("score"))


@query("scan_jsonl", "SELECT event_id AS claim_id, event_type AS kind, value AS score FROM events")
def _(t: Tables):
    return t.spark.read.schema(CLAIM).json(files.write_json(_claims(t), files.new_folder(t.spark, "claims")))


@query("scan_json_optional", "SELECT event_id AS claim_id, event_type AS kind, value AS score FROM events WHERE event_type = 'click'")
def _(t: Tables):
    at = files.write_json(_claims(t).filter("kind = 'click'"), files.new_folder(t.spark, "claims"))
    return files.read_optional(t.spark, [f"{at}-missing", at], CLAIM)


@query("scan_glob_multi", "SELECT o_orderkey, o_orderstatus, 'second' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'first' FROM orders WHERE o_orderkey % 2 = 1")
def _(t: Tables):
    """Every order is an object of the first files; those with even keys are in arrays, one a customer, of the second, which win."""
    at, o = files.new_folder(t.spark, "orders"), t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    files.write_json(o.withColumn("origin", F.lit("first")), f"{at}/a_metadata")
    row = F.struct("o_orderkey", "o_orderstatus", F.lit("second").alias("origin"))
    o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.to_json(F.collect_list(row)).alias("value")).select("value").write.text(f"{at}/b_metadata")
    return files.read_latest(t.spark, f"{at}/*_metadata", "o_orderkey long, o_orderstatus string, origin string", "o_orderkey")


@query("scan_text_log", "SELECT event_id // 100 AS recording, CAST(event_id * 1.5 AS DOUBLE) AS start_sec, CAST(event_id * 1.5 + 0.5 AS DOUBLE) AS end_sec, CAST(0.5 AS DOUBLE) AS duration_sec FROM events WHERE event_type = 'click'")
def _(t: Tables):
    """A log with two lines an event; recordings are hundreds of events."""
    start = F.col("event_id") * 1.5
    lines = F.array(F.concat(F.lit("[silencedetect] silence_start: "), start), F.concat(F.lit("[silencedetect] silence_end: "), start + 0.5, F.lit(" | silence_duration: 0.5")), F.lit("size=N/A time=00:00:01"))
    log = t.events.filter("event_type = 'click'").select(F.floor(F.col("event_id") / 100).alias("recording"), "event_id", F.posexplode(lines).alias("i", "line"))
    at = files.new_folder(t.spark, "log")
    log.select(F.concat_ws("\t", "recording", F.col("event_id") * 3 + F.col("i"), "line")).write.text(at)
    part = F.split("value", "\t", 3)
    back = t.spark.read.text(at).select(F.get(part, F.lit(0)).cast("long").alias("recording"), F.get(part, F.lit(1)).cast("long").alias("place"), F.get(part, F.lit(2)).alias("line"))
    return files.silences(back, "recording", "line", "place")


def _bundle(t: Tables):
    tables = {"nodes": t.part.select("p_partkey", "p_name", F.col("p_brand").alias("stem")), "edges": t.lineitem.select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("stem"))}
    return files.write_bundle(tables, files.new_folder(t.spark, "bundle"), "stem")


@query("sink_parquet_bundle", "SELECT 'edges' AS name, l_returnflag AS stem, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'nodes', p_brand, count(*) FROM part GROUP BY 2")
def _(t: Tables):
    parts = [t.spark.read.parquet(at).groupBy(F.lit(name).alias("name"), F.col("stem").cast("string").alias("stem")).agg(F.count(F.lit(1)).alias("n")) for name, at in _bundle(t).items()]
    return parts[0].unionByName(parts[1])


@query("sink_manifest", "SELECT 'edges' AS name, count(*) AS rows, 3 AS columns FROM lineitem UNION ALL SELECT 'nodes', count(*), 3 FROM part")
def _(t: Tables):
    at = files.write_manifest(t.spark, _bundle(t), files.new_folder(t.spark, "manifest"))
    return t.spark.read.schema("name string, rows long, columns int").json(at)


@query("sink_cascade_delete", "SELECT o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t: Tables):
    """Lines that are left once customers in debt go with their orders."""
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    left = files.without(t.orders, gone, "o_custkey").select("o_orderkey")
    return t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").join(left, "o_orderkey").select("o_orderkey", "l_linenumber", "l_partkey")


@query("sink_overwrite_table", "SELECT p_partkey, p_size + 1 AS p_size FROM part")
def _(t: Tables):
    """A table is built twice at one path; the second build is what is read."""
    at = files.new_folder(t.spark, "index")
    for more in (0, 1):
        t.part.select("p_partkey", (F.col("p_size") + more).alias("p_size")).write.mode("overwrite").parquet(at)
    return t.spark.read.parquet(at)


@query("sink_text_document", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) || '---' || chr(10) ORDER BY turn, role, text) AS body FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY 1")
def _(t: Tables):
    """One document a conversation, its turns in order between rules."""
    turns = t.conversations.filter("text IS NOT NULL AND role IS NOT NULL").select("conv_id", F.struct("turn", "role", "text").alias("x"))
    block = lambda x: F.concat(x["role"], F.lit(": "), x["text"])
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), block), "\n---\n").alias("body"))
