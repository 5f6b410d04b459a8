"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates, and queries in a block of queries: what one task holds at a time. Candidates are copied
#: once for each block of queries and queries once for each block of candidates, so blocks are as large as memory allows.
CANDIDATE_BLOCK, QUERY_BLOCK = 32_768, 65_536


def quantized(vectors: DataFrame, key: str, vector: str, scale: float = 1024.0) -> DataFrame:
    """key, terms array<int>, weights array<bigint>: the non-zero floor(scale * x) of every component, as sparse rows.

    Vectors that are null, or hold null or non-finite components, and rows without a key are left out; a vector of
    zeros alone (or without components) stays, with no terms.
    """
    x = F.col(vector)
    usable = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v, i: F.struct(i.alias("term"), F.floor(v.cast("double") * scale).alias("weight")))
    kept = F.filter(whole, lambda s: s.weight != 0)
    return vectors.filter(usable).select(F.col(key).alias("id"), kept.term.alias("terms"), kept.weight.alias("weights"))


def in_blocks(rows: DataFrame, per_block: int, name: str) -> DataFrame:
    """Rows with a block number; equal keys share a block, and blocks have about per_block keys."""
    n = max(1, -(-rows.count() // per_block))
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))


def _postings(terms: list, weights: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> rows and weights, in the order of rows."""
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    row = np.repeat(np.arange(len(terms)), sizes)
    term = np.concatenate([np.asarray(t, np.int64) for t in terms]) if len(row) else np.zeros(0, np.int64)
    weight = np.concatenate([np.asarray(w, np.int64) for w in weights]) if len(row) else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    term, row, weight = term[order], row[order], weight[order]
    cut = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cut), np.split(row, cut), np.split(weight, cut), strict=True) if len(t)}


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, tied = np.flatnonzero(scores > bound), np.flatnonzero(scores == bound)
        if len(tied) > k - len(above):
            tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]
        rows = np.concatenate([above, tied])
    else:
        rows = np.arange(len(scores))
    return rows[np.lexsort((ids[rows], -scores[rows]))]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query by integer inner product.

    A query's candidates are all usable rows with another key (so rows that repeat the query's key are its own); ties
    go to the smaller key, then to any of the rows that repeat it. Queries that repeat a key are answered once, for
    the least of the vectors under that key. Every block of queries meets every block of candidates: a query row scatters
    its weight times the postings of each term into one array of scores for the block, the block's k best are
    selected by partition, and the blocks' lists are merged by rank. Columns other than key and vector are ignored.
    """
    base = quantized(vectors, key, vector, scale)
    asked = quantized(vectors.filter(is_query), key, vector, scale).groupBy("id").agg(F.min(F.struct("terms", "weights")).alias("v")).select("id", "v.*")
    candidates, asked = in_blocks(base, CANDIDATE_BLOCK, "cb"), in_blocks(asked, QUERY_BLOCK, "qb")
    c_blocks = candidates.agg(F.max("cb")).scalar()
    q_blocks = asked.agg(F.max("qb")).scalar()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))))
    left = asked.withColumn("cb", every(c_blocks))
    right = candidates.withColumn("qb", every(q_blocks))

    def run(key_: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy(np.int64)
            postings = _postings(list(rows["terms"]), list(rows["weights"]))
            scores = np.zeros(len(ids), np.int64)
            for q, terms, weights in zip(queries["id"], queries["terms"], queries["weights"], strict=True):
                scores[:] = 0
                for t, w in zip(terms, weights, strict=True):
                    if (found := postings.get(int(t))) is not None:
                        at, weight = found
                        if len(at) == len(scores):
                            scores += weight * w  # the term is in every row
                        else:
                            scores[at] += weight * w
                other = np.flatnonzero(ids != q)
                best = other[_best(scores[other], ids[other], k)]
                out += [(q, int(ids[i]), int(scores[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
