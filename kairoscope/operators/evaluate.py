"""Retrieval metrics and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, k: int) -> DataFrame:
    """hits (query_id, rank, relevant) to one row: queries, recall at k (any relevant within k), mean reciprocal rank."""
    per = hits.groupBy("query_id").agg(F.max(((F.col("rank") <= k) & F.col("relevant")).cast("int")).alias("hit"), F.coalesce(1 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    return per.agg(F.count("*").alias("queries"), F.avg("hit").alias("recall_at_k"), F.avg("rr").alias("mrr"))


def temporal_iou(pairs: DataFrame) -> DataFrame:
    """pairs (a_start, a_end, b_start, b_end) with iou, 0 where they are apart."""
    shared = F.greatest(F.lit(0.0), F.least("a_end", "b_end") - F.greatest("a_start", "b_start"))
    both = F.greatest("a_end", "b_end") - F.least("a_start", "b_start")
    return pairs.withColumn("iou", F.coalesce(shared / F.nullif(both, F.lit(0.0)), F.lit(0.0)))


def benchmark_stats(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """runs (latency_ms, confidence) to average, least and largest latency and average confidence, of each `by` if given."""
    return runs.groupBy(*(by or [])).agg(F.count("*").alias("runs"), F.avg("latency_ms").alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.avg("confidence").alias("avg_confidence"))
