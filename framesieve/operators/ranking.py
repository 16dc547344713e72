"""A linear pairwise ranker over judged rows of any number: its gradients are sums in tasks, one small vector per epoch.

Rows of a query are dealt by a hash into chunks, and every pair of a query's chunks is one row of a written table, so that a
query of many rows is spread over tasks.  In each epoch a task adds up, over its pairs of rows with different relevance, the
gradient of log(1 + exp(-(score of the better - score of the worse))); the driver adds one vector per task, and steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clean
from ..schemas import require
from ..steps import written
from .fuse import FEATURES

#: Rows of a chunk at most, about: a pair of chunks is a matrix of this many rows and columns.
CHUNK = 1024


def _chunk_pairs(judged: DataFrame, features: tuple[str, ...], relevance: str, key: str, mean: list[float], std: list[float]) -> DataFrame:
    """(xa, ra, xb, rb): standardised features and relevances of all pairs of a query's chunks; xb and rb are null where a
    chunk meets itself."""
    scaled = F.array(*((clean(F.col(f)) - m) / s for f, m, s in zip(features, mean, std, strict=True)))
    rows = judged.where(F.col(relevance).isNotNull()).select(F.col(key).alias("k"), scaled.alias("x"), F.col(relevance).cast("double").alias("r"))
    chunks = rows.groupBy("k").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = rows.join(chunks.withColumnRenamed("k", "of"), F.col("k").eqNullSafe(F.col("of"))).withColumn("chunk", F.pmod(F.xxhash64("x", "r"), "chunks"))
    packed = placed.groupBy("k", "chunk").agg(F.collect_list(F.struct("x", "r")).alias("rows"))
    packed = written(packed.select("k", "chunk", F.flatten(F.transform("rows", lambda t: t["x"])).alias("x"), F.transform("rows", lambda t: t["r"]).alias("r")))
    one = packed.select("k", "chunk", F.col("x").alias("xa"), F.col("r").alias("ra"))
    two = packed.select(F.col("k").alias("of"), F.col("chunk").alias("other"), F.col("x").alias("xb"), F.col("r").alias("rb"))
    apart = one.join(two, F.col("k").eqNullSafe(F.col("of")) & (F.col("chunk") < F.col("other"))).select("xa", "ra", "xb", "rb")
    alone = one.select("xa", "ra", F.lit(None).cast("array<double>").alias("xb"), F.lit(None).cast("array<double>").alias("rb"))
    return written(alone.unionByName(apart))


def block_gradient(xa: np.ndarray, ra: np.ndarray, xb: np.ndarray, rb: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of all pairs (row of a, row of b) of different relevance."""
    sign = np.sign(ra[:, None] - rb)
    margin = sign * ((xa @ w)[:, None] - xb @ w)
    away = 1 / (1 + np.exp(np.clip(margin, -40, 40)))
    pull = np.where(sign == 0, 0.0, -away * sign)
    loss = np.logaddexp(0, -margin)[sign != 0].sum()
    return xa.T @ pull.sum(axis=1) - xb.T @ pull.sum(axis=0), float(loss), int((sign != 0).sum())


def _gradient(pairs: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(len(w)), 0.0, 0
        for batch in batches:
            for xa, ra, xb, rb in zip(*(batch.column(c) for c in ("xa", "ra", "xb", "rb")), strict=True):
                a, r = np.asarray(xa.values).reshape(-1, len(w)), np.asarray(ra.values)
                if xb.is_valid:
                    g, o, k = block_gradient(a, r, np.asarray(xb.values).reshape(-1, len(w)), np.asarray(rb.values), w)
                else:  # every pair is met from both sides
                    g, o, k = block_gradient(a, r, a, r, w)
                    g, o, k = g / 2, o / 2, k // 2
                total, loss, n = total + g, loss + o, n + k
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n])], ["g", "loss", "n"])

    made = pairs.mapInArrow(run, "g array<double>, loss double, n long").collect()  # one row per task
    return np.sum([r.g for r in made], axis=0), sum(r.loss for r in made), sum(r.n for r in made)


def fit(judged: DataFrame, features: tuple[str, ...] = FEATURES, relevance: str = "relevance", key: str = "query_id", lr: float = 0.3, epochs: int = 40, l2: float = 1e-4, seed: int = 42) -> tuple[list[float], list[float], list[float]]:
    """Weights, means and deviations of a linear ranker (fuse.ltr_score) from judged rows (key, features, relevance): pairs
    of one query's rows, the mean logistic loss and l2, by gradient steps with momentum.  Without a pair of different
    relevance it is a ValueError.  Missing features count as 0, rows without a relevance don't count."""
    require(judged, key, relevance, *features)
    known = judged.where(F.col(relevance).isNotNull())
    sums = known.agg(*(x for f in features for x in (F.avg(clean(F.col(f))), F.stddev_pop(clean(F.col(f)))))).first()
    mean, std = [v or 0.0 for v in sums[::2]], [v if v and v >= 1e-8 else 1.0 for v in sums[1::2]]
    pairs = _chunk_pairs(judged, features, relevance, key, mean, std)
    w, speed = np.random.default_rng(seed).normal(0.0, 0.01, len(features)), np.zeros(len(features))
    for _ in range(epochs):
        gradient, _, n = _gradient(pairs, w)
        if not n:
            raise ValueError("no row is more relevant than another")
        speed = 0.9 * speed - lr * (gradient / n + l2 * w)
        w = w + speed
    return w.tolist(), mean, std
