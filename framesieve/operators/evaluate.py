"""Evaluation of ranked answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 20, 50, 100)


def r_at(k: int, score: str = "r_score") -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.coalesce(F.max(F.when(F.col("rank") <= k, F.col(score))), F.lit(0.0))


def ranking_profile(scored: DataFrame, ks: tuple[int, ...] = KS, key: str = "query_id") -> DataFrame:
    """R@k for every k and their mean, of answers (key, rank, r_score)."""
    if not ks:
        raise ValueError("ks is empty")
    made = scored.groupBy(key).agg(*(r_at(k).alias(f"r_at_{k}") for k in dict.fromkeys(ks)))
    return made.withColumn("final_score", sum((F.col(f"r_at_{k}") for k in ks), F.lit(0.0)) / len(ks))


def reciprocal_rank() -> Column:
    return F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0))


def recall_at(k: int, hit: str = "relevant") -> Column:
    if k <= 0:
        raise ValueError("k must be positive")
    return F.coalesce(F.max(F.when(F.col("rank") <= k, F.col(hit).cast("double"))), F.lit(0.0))


def frame_hit(predicted: Column, frames: Column, tolerance: int = 10) -> Column:
    return F.coalesce(F.exists(frames, lambda f: F.abs(predicted - f) <= tolerance), F.lit(False))


def per_query(ranked: DataFrame, ks: tuple[int, ...] = KS, key: str = "query_id") -> DataFrame:
    """Candidates, first two scores and their gap, reciprocal rank, recall and frame recall of every query.
    ranked: (key, rank, rank_score, relevant, frame_hit, has_ground_truth)."""
    top = lambda n: F.max(F.when(F.col("rank") == n, F.col("rank_score")))
    graded = lambda c: F.when(F.max("has_ground_truth"), c)
    return ranked.groupBy(key).agg(
        F.count("*").alias("candidates"), top(1).alias("top1_score"), top(2).alias("top2_score"), (top(1) - top(2)).alias("top1_top2_gap"), F.max("has_ground_truth").alias("has_ground_truth"),
        graded(reciprocal_rank()).alias("mrr"), *(graded(recall_at(k)).alias(f"recall_at_{k}") for k in ks), *(graded(recall_at(k, "frame_hit")).alias(f"frame_recall_at_{k}") for k in ks),
    )


def summary(queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row: counts, mean gap, and means over the queries with ground truth (null without any)."""
    names = ["mrr", *(f"recall_at_{k}" for k in ks), *(f"frame_recall_at_{k}" for k in ks)]
    return queries.agg(F.count("*").alias("queries"), F.count_if("has_ground_truth").alias("with_ground_truth"), F.avg("top1_top2_gap").alias("mean_gap"), *(F.avg(n).alias(n) for n in names))
