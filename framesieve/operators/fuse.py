"""Fusion of channels and evidence, reranking, submission lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import FusionWeights, RankingWeights
from ..functions.scores import clean, minmax, rrf
from ..functions.text import overlap, tokens
from ..schemas import require
from ..steps import written
from . import evidence as evidence_index
from .evidence import EvidenceIndex


def fuse_channels(first: DataFrame, second: DataFrame, weight: float = 0.35, key: str = "query_id") -> DataFrame:
    """Full outer join of two channels' videos; min-max of each, a missing score counting as 0, then a blend."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must be in [0, 1]")
    shared = [c for c in first.columns if c in second.columns and c not in (key, "video_id")]
    two = second.withColumnsRenamed({c: f"{c}_2" for c in shared})
    other = lambda c: F.lit(0) if c == "best_frame_idx" else F.col(f"{c}_2")  # noqa: E731  a keyframe's number is the first channel's, or 0
    joined = first.join(two, [key, "video_id"], "full").withColumns({c: F.coalesce(F.col(c), other(c)) for c in shared}).drop(*(f"{c}_2" for c in shared))
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in joined.columns if c.endswith(("_score", "_topk_mean", "_score_std"))})
    w = W.partitionBy(key)
    return joined.withColumn("clip_score", F.col("retrieval_score")).withColumn("retrieval_score", (1 - weight) * minmax(F.col("retrieval_score"), w) + weight * minmax(F.col("channel2_score"), w))


def rrf_scores(scores: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, video_id, evidence_score): reciprocal ranks summed over stores, in order of their names.
    scores: (query_id, video_id, modality, score, pos); pos decides ties."""
    w = W.partitionBy("query_id", "modality").orderBy(F.desc("score"), "pos")
    terms = scores.withColumn("term", rrf(F.col("score"), w, k))
    ordered = F.array_sort(F.collect_list(F.struct("modality", "term")))
    return terms.groupBy("query_id", "video_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, t: a + t["term"]).alias("evidence_score"))


def multimodal(candidates: DataFrame, evidence: DataFrame | EvidenceIndex | Callable[[DataFrame], DataFrame] | None, weights: FusionWeights = FusionWeights(), rrf_k: int = 60, stores: tuple[str, ...] | None = None) -> DataFrame:
    """Fused score of candidates (query_id, video_id, query_text, retrieval_score, object_text, metadata_text,
    best_frame_id): the retrieval score and the evidence, each min-maxed within the query, and the overlaps with
    objects and metadata as they are.  With evidence the candidates are written first, as several steps read them.
    evidence: texts, their index, or a function that gives the texts about videos (video_id).
    stores: the names of the evidence stores at hand, empty ones included; without them those that have rows are listed."""
    w = W.partitionBy("query_id")
    if evidence is not None:
        candidates = written(candidates)
        evidence = evidence(candidates.select("video_id").distinct()) if callable(evidence) else evidence
    q = tokens(F.col("query_text"))
    rows = candidates.withColumn("object_score", overlap(q, tokens(F.col("object_text")))).withColumn("metadata_score", overlap(q, tokens(F.col("metadata_text"))))
    rows = rows.withColumn("clip_norm", minmax(F.col("retrieval_score"), w))
    if evidence is None:
        rows = rows.withColumn("evidence_score", F.lit(0.0)).withColumn("evidence_modalities", F.lit(",".join(sorted(stores or ()))))
    else:
        index = evidence if isinstance(evidence, EvidenceIndex) else evidence_index.build(evidence)
        places = candidates.select("query_id", "video_id", F.row_number().over(w.orderBy(F.desc("retrieval_score"), "video_id")).alias("pos"))
        found = rrf_scores(evidence_index.scores(candidates, index).join(places, ["query_id", "video_id"]), rrf_k)
        rows = rows.join(found, ["query_id", "video_id"], "left").withColumn("evidence_score", minmax(F.coalesce("evidence_score", F.lit(0.0)), w))
        names = index.modalities().agg(F.array_join(F.array_sort(F.collect_set("modality")), ",").alias("evidence_modalities"))
        rows = rows.withColumn("evidence_modalities", F.lit(",".join(sorted(stores)))) if stores is not None else rows.join(F.broadcast(names))  # one row is broadcast
    fused = weights.clip * F.col("clip_norm") + weights.objects * F.col("object_score") + weights.metadata * F.col("metadata_score") + weights.evidence * F.col("evidence_score")
    return rows.withColumn("fused_score", fused).withColumn("multimodal_score", F.col("fused_score"))


def rerank(df: DataFrame, weights: RankingWeights = RankingWeights(), key: str = "query_id") -> DataFrame:
    """rank_score: min-maxed retrieval, temporal and multimodal scores, weighted; absent ones count as 0."""
    w = W.partitionBy(key)
    part = lambda name: minmax(F.col(name), w) if name in df.columns else F.lit(0.0)
    require(df, "retrieval_score")
    return df.withColumn("rank_score", weights.retrieval * part("retrieval_score") + weights.temporal * part("temporal_score") + weights.multimodal * part("multimodal_score"))


def submission(df: DataFrame, k: int = 100, key: str = "query_id", score: str = "rank_score") -> DataFrame:
    """The first k videos of every query by score, ties by video_id, with their rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    require(df, score)
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), "video_id"))).where(F.col("rank") <= k)


FEATURES = ("retrieval_score", "retrieval_best_score", "retrieval_topk_mean", "retrieval_score_std", "multimodal_score", "temporal_score")


def ltr_features(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Cleaned features, standardised over the table with the population deviation (below 1e-8: 1)."""
    require(df, *features)
    cleaned = df.withColumns({f: clean(F.col(f)) for f in features})
    sums = cleaned.agg(*(x for f in features for x in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))))
    scaled = {f: (F.col(f) - F.col(f"{f}__m")) / F.when(F.col(f"{f}__s") < 1e-8, 1.0).otherwise(F.col(f"{f}__s")) for f in features}
    return cleaned.join(F.broadcast(sums)).withColumns(scaled).select(*df.columns)  # one row is broadcast


def ordered_pairs(df: DataFrame, relevance: str = "relevance", item: str = "video_id", key: str = "query_id") -> DataFrame:
    """(key, better, worse) of every pair of one query's items with different relevance."""
    a = df.select(key, F.col(item).alias("better"), F.col(relevance).alias("ra"))
    b = df.select(key, F.col(item).alias("worse"), F.col(relevance).alias("rb"))
    return a.join(b, key).where("ra > rb").select(key, "better", "worse")


#: Rows of one fit: the pairs of these are walked on the driver.
FIT_ROWS = 4096


def fit_pairwise(features: list[list[float]], relevance: list[float], lr: float = 0.05, epochs: int = 100, l2: float = 1e-4, seed: int = 42) -> tuple[list[float], list[float], list[float]]:
    """Weights, means and deviations of a linear ranker trained on pairs by stochastic gradient descent, from small
    random weights; for judged sets of at most FIT_ROWS rows."""
    import numpy as np

    x, y = np.nan_to_num(np.asarray(features, float), nan=0.0, posinf=0.0, neginf=0.0), np.asarray(relevance, float)
    if not 2 <= len(x) == len(y) or len(x) > FIT_ROWS:
        raise ValueError(f"as many relevances as rows are needed, 2 to {FIT_ROWS}")
    mean, std = x.mean(0), x.std(0)
    std = np.where(std < 1e-8, 1.0, std)
    x = (x - mean) / std
    better, worse = np.nonzero(y[:, None] > y[None, :])
    if not len(better):
        raise ValueError("no row is more relevant than another")
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 0.01, x.shape[1])
    order = list(range(len(better)))
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order:
            d = x[better[k]] - x[worse[k]]
            w += lr * (d / (1 + np.exp(np.clip(w @ d, -40, 40))) - l2 * w)
    return w.tolist(), mean.tolist(), std.tolist()


def ltr_score(df: DataFrame, weights: list[float], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """learned_rank_score: dot product of standardised features and fixed weights."""
    total: Column = F.lit(0.0)
    for f, w in zip(features, weights, strict=True):
        total = total + F.lit(float(w)) * F.col(f)
    return df.withColumn("learned_rank_score", total)
