"""Ranking operators: vector similarity, rank fusion, thresholds, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def soft_threshold(v: Column, threshold: float, floor: float) -> Column:
    """0 up to the floor, the value from the threshold on, a ramp times the value between; a hard cut if threshold <= floor."""
    if threshold <= floor:
        return F.when(v >= threshold, v).otherwise(0.0)
    return F.when(v >= threshold, v).when(v <= floor, 0.0).otherwise(v * (v - floor) / (threshold - floor))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_fusion(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """key, score = sum of 1 / (k + rank) over lists (key, rank), best_rank; ties go to the best rank, then the key."""
    every = lists[0].select(key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks of a short list (a top-k result)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def mmr(candidates: DataFrame, group: str, key: str, vector: str, relevance: str, k: int, trade: float = 0.78) -> DataFrame:
    """Maximal marginal relevance within each group of candidates (a top-k list, at most a hundred or so): key, place.

    Greedy, so imperative: the next is the one with the largest trade * relevance - (1 - trade) * similarity to what is
    chosen. Ties go to the higher relevance, then the smaller key.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        v = np.array(pdf[vector].tolist(), float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        near, left, out = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        for _ in range(min(k, len(pdf))):
            value = np.where(left, np.round(trade * pdf[relevance].to_numpy() - (1 - trade) * near, 12), -np.inf)
            i = int(value.argmax())
            out.append(i)
            left[i] = False
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({group: pdf[group].iloc[out].to_numpy(), key: pdf[key].iloc[out].to_numpy(), "place": np.arange(1, len(out) + 1)})

    g, i = (candidates.schema[c].dataType.simpleString() for c in (group, key))
    return candidates.select(group, key, vector, relevance).groupBy(group).applyInPandas(choose, f"{group} {g}, {key} {i}, place long")


def clamp01(c: Column, default: float = 0.0) -> Column:
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


__all__ = ["clamp01", "cosine", "dot", "l2", "mmr", "rank_fusion", "ranked", "soft_threshold", "top"]
