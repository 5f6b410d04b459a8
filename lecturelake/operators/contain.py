"""Terms contained in texts, as equi-joins on short substrings with the containment verified after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a term by which it meets texts; shorter terms meet by all of theirs.
GRAM = 3
#: Bytes of terms that go to every task, and parts of terms that are looked up in a text beside it.
BROADCAST, BESIDE = 4 << 20, 8192


def grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def contained(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """key, term, n: the terms that occur in each text, without regard to case, and how often (not overlapping).

    Each term is found by its rarest-looking part, its last GRAM characters, so that a text's substrings, of those lengths
    alone that some part has, are looked up once for all terms. Terms of up to BROADCAST bytes in all, counted first, go to the
    texts: of at most BESIDE different parts those that a text has are told in its row, and nothing is shuffled; of more, only
    what is found is. Beyond that substrings are, and one that many texts have is split by adaptive execution. Null and empty
    ones match nothing.
    """
    asked = terms.select(F.col(term).alias("term"), F.lower(term).alias("low")).filter("low <> ''").distinct()
    asked = asked.withColumn("gram", F.substring("low", F.greatest(F.length("low") - GRAM + 1, F.lit(1)), F.lit(GRAM)))
    rows = texts.select(key, F.lower(text).alias("t")).filter("t is not null")
    told = asked.agg(F.sort_array(F.collect_set(F.length("gram"))), F.coalesce(F.sum(F.length("term") * 2 + 64), F.lit(0)), F.count_distinct("gram")).first()
    lengths, size, parts = told[0] or [GRAM], told[1], told[2]
    short = F.concat(*[grams(F.col("t"), n) for n in lengths])
    if size <= BROADCAST and parts <= BESIDE:
        known = asked.agg(F.collect_set("gram").alias("known")).scalar()
        met = rows.select(key, "t", F.explode(F.array_intersect(known, short)).alias("gram")).join(F.broadcast(asked), "gram")
    else:
        met = rows.select(key, F.xxhash64("t").alias("h"), F.explode(short).alias("gram")).join(F.broadcast(asked) if size <= BROADCAST else asked, "gram").select(key, "h", "term", "low")
        met = met.join(rows.withColumn("h", F.xxhash64("t")), [key, "h"])
    met = met.filter(F.contains("t", F.col("low")))
    n = (F.length("t") - F.length(F.replace("t", F.col("low"), F.lit("")))) / F.length("low")
    return met.select(key, "term", n.cast("long").alias("n"))
