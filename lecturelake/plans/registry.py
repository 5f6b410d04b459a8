"""All queries of the library without the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import build_queries, ensemble_queries, evidence_queries, file_queries, graph_queries, keyword_queries, recommend_queries, record_queries, scene_queries, score_queries, speech_queries, stream_queries, string_queries, table_queries, term_queries, text_queries, time_queries, timeline_queries, view_queries  # noqa: F401  they register themselves
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vector candidates fused by rank."""
    return QUERIES["fuse_rrf"](spark, sf_dir)
