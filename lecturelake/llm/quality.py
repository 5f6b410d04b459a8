"""Quality rules in DataFrame functions alone: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over buckets of hashed word unigrams and bigrams are counted: one over trusted documents (the
target), one over all (the raw corpus). A document's score is the mean over its n-grams of log(target / raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Buckets of the multinomials, pseudo-count of each, and the score that a kept document has at least.
BUCKETS, PSEUDO, LEAST_SCORE = 1 << 14, 0.5, -0.1
#: Trusted documents that the target multinomial is counted over at most; the raw one is counted over all documents.
TRUSTED = 5000
#: Columns that a score adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def neighbours(hashes: Column, step: int) -> Column:
    """Hashes of each hash with the one `step` places later."""
    rest = F.greatest(F.lit(0), F.size(hashes) - step)
    return F.zip_with(F.slice(hashes, F.lit(1), rest), F.slice(hashes, F.lit(1 + step), rest), lambda a, b: F.xxhash64(a, b))


def buckets_of(hashes: Column, pairs: Column, buckets: int) -> Column:
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def gram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of pairs of neighbours, from the words' hashes."""
    return buckets_of(hashes, neighbours(hashes, 1), buckets)


def base_counts(texts: DataFrame) -> DataFrame:
    """texts with a text column t (null: empty) to the counts, hashes (of its words) and pairs (of neighbours)."""
    t = F.coalesce("t", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = texts.withColumn("words", words_of(t)).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long")).withColumn("hashes", word_hashes(F.col("words"))).drop("words")
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"))
    out = out.withColumn("dup_lines", lines).withColumn("n_dup_lines", (F.size("dup_lines") - F.size(F.array_distinct("dup_lines"))).cast("long")).drop("dup_lines", "t")
    # hashes of all windows of eight words, by doubling; where none repeats, nothing more is looked at
    out = out.withColumn("pairs", neighbours(F.col("hashes"), 1)).withColumn("fours", neighbours(F.col("pairs"), 2)).withColumn("windows", neighbours(F.col("fours"), 4)).drop("fours")
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))))
    out = out.withColumn("ordered", ordered).drop("windows")
    s = F.col("ordered")
    same = lambda x, i: F.coalesce(F.get(s, i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, i + 1).h == x.h, F.lit(False))
    found = F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(same(x, i), x.i)), lambda i: i.isNotNull()))
    # a window adds its eight words, less those that the one before has covered
    start = F.struct(F.lit(-8).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(found, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n")), lambda a: a["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("ordered")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, pseudo: float = PSEUDO, documents: int = TRUSTED) -> DataFrame:
    """One row, `weights`: log(target / raw) of every bucket in order.

    The raw corpus is all documents. The target is at most `documents` of those whose key trusted names (nulls and
    repeats are ignored), of least hash: keys and hashes alone meet the trusted keys, and the sample's are broadcast, so
    that texts stay where they are scanned and the shuffle carries a row per bucket and task. Without trusted documents
    all weights are those of a uniform target.
    """
    good = trusted.select(F.col(key).alias("k")).filter(F.col("k").isNotNull()).distinct()
    rows = docs.select(docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"), F.coalesce(docs[text], F.lit("")).alias("t"))
    sample = rows.select("k", "h").join(good, "k").distinct().orderBy("h", "k").limit(documents).withColumn("good", F.lit(1).cast("long"))
    flagged = rows.join(F.broadcast(sample), ["k", "h"], "left")
    grams = flagged.select(F.coalesce("good", F.lit(0)).alias("good"), word_hashes(words_of(F.col("t"))).alias("w")).select("good", F.explode(gram_buckets(F.col("w"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.sum("good").alias("target"), F.count(F.lit(1)).alias("raw"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["target", "raw"])
    rows = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("c"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    rest = F.lit(pseudo * buckets)
    ratio = lambda x: F.log((x.target + pseudo) / (F.col("t") + rest)) - F.log((x.raw + pseudo) / (F.col("r") + rest))
    return rows.select(F.transform("c", ratio).alias("weights"))


def score(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", least_score: float = LEAST_SCORE, buckets: int = BUCKETS) -> DataFrame:
    """docs with the base counts, base_failed, score and kept added (columns of these names, ADDED, are replaced).

    kept: not base_failed, and the mean log-likelihood ratio of the document's n-grams is at least least_score. The
    threshold is a number, so the verdict on a document depends on its text and the counts alone. A null or empty text
    has no words, fails the base rules and has score null. Repeated rows and all other columns stay.
    """
    names = [c for c in docs.columns if c not in ADDED]
    weights = log_ratios(docs, trusted, text, key, buckets).scalar()
    own = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[text].alias("t"))
    out = base_counts(own).withColumn("base_failed", base_failed())
    out = out.withColumn("grams", buckets_of(F.col("hashes"), F.col("pairs"), buckets)).withColumn("weights", weights)
    total = F.aggregate("grams", F.lit(0.0), lambda a, i: a + F.get(F.col("weights"), i))
    out = out.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")))
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= least_score, F.lit(False)))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *ADDED)
