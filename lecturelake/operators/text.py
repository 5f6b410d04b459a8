"""Text operators: terms, tokens, weighted term statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[0-9A-Za-z가-힣_#+./-]+"
#: BM25 parameters and field weights of a lecture's title and summary.
K1, B, TITLE_WEIGHT, SUMMARY_WEIGHT = 1.2, 0.75, 1.5, 0.5


def normalize_term(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(normalize_term(c), " ", "")


def tokens(c: Column) -> Column:
    """Lower-case tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda x: F.length(x) > 1)


def hits(haystack: Column, keywords: list[str]) -> Column:
    """How many keywords occur in the haystack, as it is or without blanks."""
    low, tight = F.lower(haystack), F.replace(F.lower(haystack), F.lit(" "), F.lit(""))
    one = lambda k: (F.contains(low, F.lit(k.lower())) | F.contains(tight, F.lit(k.lower().replace(" ", "")))).cast("long")
    return sum((one(k) for k in keywords[1:]), one(keywords[0]))


def document_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, irf = ln(N / df), idf = ln(1 + (N - df + .5) / (df + .5))."""
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    out = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("n", n)
    return out.select("term", "df", F.log(F.col("n") / F.col("df")).alias("irf"), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25(docs: DataFrame, key: str, title: str, summary: str, query: dict[str, float]) -> DataFrame:
    """key, score > 0 for documents that hold a weighted query term; keys are unique.

    A scan tokenizes each text once, leaves a row for each occurrence of a query term and sums those up before they are
    shuffled; a second scan takes the number and mean length of documents.
    """
    sized = docs.select(key, tokens(F.col(title)).alias("t"), tokens(F.col(summary)).alias("s"))
    length = (F.coalesce(F.size("t"), F.lit(0)) * TITLE_WEIGHT + F.coalesce(F.size("s"), F.lit(0)) * SUMMARY_WEIGHT).alias("dl")
    wanted = lambda a, w: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isin(*query)), lambda x: F.struct(x.alias("term"), F.lit(w).alias("w")))
    # the outer form, since for the inner one the optimizer would tokenize once more to see whether there is a hit
    hits = sized.select(key, length, F.explode_outer(F.concat(wanted(F.col("t"), TITLE_WEIGHT), wanted(F.col("s"), SUMMARY_WEIGHT))).alias("m"))
    tf = hits.filter("m is not null").groupBy(key, "dl", F.col("m.term").alias("term")).agg(F.sum("m.w").alias("tf"))
    totals = sized.select(length).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).select(F.struct("n", "avgdl")).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("c", totals)
    weight = F.element_at(F.create_map(*[x for q, w in query.items() for x in (F.lit(q), F.lit(float(w)))]), F.col("term"))
    rows = tf.join(F.broadcast(df), "term")  # a row for each query term at most
    idf = F.log(1 + (F.col("c.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("c.avgdl")))
    return rows.groupBy(key).agg(F.sum(gain).alias("score")).filter("score > 0")
