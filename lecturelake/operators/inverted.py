"""A stored inverted index over fields, for BM25: built once, and read by term.

A row is a term's block: the documents of one slice of the keys that hold the term, with their weighted frequencies and
lengths, and the highest gain among them. Rows lie in folders by a hash of the term, so that a query reads the folders of its
own terms, and of their files what their statistics don't rule out. A frequent term has a block for each slice, so no
block grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_path
from .text import B, K1, SUMMARY_WEIGHT, TITLE_WEIGHT, normalize_term, tokens

# The weight of the keyword field, and that of a keyword's single tokens beside the keyword itself.
KEYWORD_WEIGHT, TOKEN_SHARE = 2.0, 0.5
#: Folders of terms, and documents in a slice.
PARTS, SLICE = 64, 65_536


@dataclass
class Index:
    """The stored blocks, where they lie, the number of documents and their mean length."""

    path: str
    blocks: DataFrame
    n: int
    mean: float


def entries(title: Column, keywords: Column, summary: Column) -> Column:
    """array<struct<term, title, keyword, summary>>: what each field adds to a term's frequency. keywords:
    array<struct<term, weight>>."""
    one = lambda term, a, b, c: F.struct(term.alias("term"), a.alias("title"), b.alias("keyword"), c.alias("summary"))
    zero, unit = F.lit(0.0), F.lit(1.0)
    words = lambda c: F.coalesce(tokens(c), F.array().cast("array<string>"))
    whole = F.filter(F.transform(keywords, lambda k: one(normalize_term(k.term), zero, k.weight.cast("double"), zero)), lambda e: e.term != "")
    split = F.flatten(F.transform(keywords, lambda k: F.transform(words(normalize_term(k.term)), lambda w: one(w, zero, k.weight * TOKEN_SHARE, zero))))
    none = F.array().cast("array<struct<term string, title double, keyword double, summary double>>")
    keyword_entries = F.coalesce(F.concat(whole, split), none)
    return F.concat(F.transform(words(title), lambda w: one(w, unit, zero, zero)), keyword_entries, F.transform(words(summary), lambda w: one(w, zero, zero, unit)))


def gain(tf: Column, length: Column, mean: float) -> Column:
    """What an occurrence adds, before the term's idf and the query's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.coalesce(F.nullif(length, F.lit(0.0)), F.lit(mean)) / (mean or 1.0)))


def build(docs: DataFrame, key: str, title: str, keywords: str, summary: str, parts: int = PARTS, per_slice: int = SLICE) -> Index:
    """The index of documents (unique key, title, keywords array<struct<term, weight>>, summary); nulls are empty.

    A document's length is the sum of what its fields add, without the fields' weights; documents without a term count too.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "lecturelake/inverted")

    def sized(df: DataFrame) -> DataFrame:
        x = df.select(F.col(key).alias("key"), entries(F.col(title), F.col(keywords), F.col(summary)).alias("e"))
        return x.withColumn("length", F.aggregate("e", F.lit(0.0), lambda a, e: a + e.title + e.keyword + e.summary))

    n, mean = sized(docs).agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    slices = max(1, -(-n // per_slice))
    # documents are dealt out by key, so that entries are summed where they are and only postings are shuffled; the outer form,
    # since for the inner one the optimizer would make all entries once more to see whether there are any
    each = sized(docs.repartition(F.col(key))).select("key", "length", F.explode_outer("e").alias("e"))
    tf = F.sum(F.col("e.title") * TITLE_WEIGHT + F.col("e.keyword") * KEYWORD_WEIGHT + F.col("e.summary") * SUMMARY_WEIGHT)
    each = each.groupBy("key", "length", F.col("e.term").alias("term")).agg(tf.alias("tf")).filter("tf > 0")
    slot = F.pmod(F.xxhash64("key"), F.lit(slices)).alias("slice")
    each = each.select("*", slot, _part(F.col("term"), parts).alias("part")).repartition("part", "slice")
    blocks = each.groupBy("part", "slice", "term").agg(F.collect_list(F.struct("key", "tf", "length")).alias("postings"), F.max(gain(F.col("tf"), F.col("length"), mean)).alias("top"), F.count(F.lit(1)).alias("df"))
    blocks = blocks.select("term", "slice", "postings", "top", "df", "part").sortWithinPartitions("part", "term")
    blocks.write.partitionBy("part").parquet(path)
    return Index(path, spark.read.schema(blocks.schema).parquet(path), n, float(mean))


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def blocks_of(index: Index, query: dict[str, float], parts: int = PARTS) -> DataFrame:
    """The blocks of a query's terms, with w: the term's weight times its idf. The terms' folders alone are listed and read."""
    spark = index.blocks.sparkSession
    # where a term lies is told by the same function that dealt it out; a row for each term of the query
    at = spark.createDataFrame([(t,) for t in query], "term string").select(_part(F.col("term"), parts)).distinct().collect()
    rows = index.blocks.filter(F.col("part").isin([r[0] for r in at]) & F.col("term").isin(list(query)))
    df = rows.groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.element_at(F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))]), F.col("term"))
    idf = F.log(1 + (index.n - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return rows.join(F.broadcast(df.select("term", (weight * idf).alias("w"))), "term")


def scores(index: Index, query: dict[str, float], key: str, parts: int = PARTS) -> DataFrame:
    """key, score > 0 of all documents that hold a term of the query (term: weight)."""
    if not query:
        return index.blocks.select(F.get("postings", F.lit(0)).key.alias(key), F.lit(0.0).alias("score")).limit(0)
    return _scored(blocks_of(index, query, parts), index.mean, key)


def _scored(blocks: DataFrame, mean: float, key: str) -> DataFrame:
    rows = blocks.select("w", F.explode("postings").alias("p"))
    return rows.groupBy(F.col("p.key").alias(key)).agg(F.sum(F.col("w") * gain(F.col("p.tf"), F.col("p.length"), mean)).alias("score")).filter("score > 0")


def top(index: Index, query: dict[str, float], key: str, k: int, parts: int = PARTS) -> DataFrame:
    """The k best of scores, ties to the smaller key. The slice with the highest bound (its blocks' highest gains in sum) is
    scored first; slices whose bound is under its k-th score are not read on."""
    if not query:
        return scores(index, query, key, parts)
    rows = blocks_of(index, query, parts)
    bounds = rows.groupBy("slice").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    first = bounds.orderBy(F.desc("bound"), "slice").first()
    if first is None:
        return scores(index, query, key, parts)
    probe = _scored(rows.filter(F.col("slice") == first["slice"]), index.mean, key).orderBy(F.desc("score")).limit(k).agg(F.count(F.lit(1)), F.min("score")).first()
    least = probe[1] if probe[0] == k else 0.0
    # bounds and scores are sums in different orders, so the bound has a little slack
    open_ = bounds.filter(F.col("bound") * (1 + 1e-9) >= least).select("slice")
    return _scored(rows.join(open_, "slice", "left_semi"), index.mean, key).orderBy(F.desc("score"), key).limit(k)
