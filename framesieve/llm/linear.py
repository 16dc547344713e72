"""Hashed sparse linear models: FTRL-proximal fitting on a bounded sample, sparse dot products for scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, text_chunks

#: features(buf, offsets) -> (text of each feature, its index, its value); a pair may occur repeatedly and then adds up.
Extract = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Ftrl:
    """Parameters of follow-the-regularised-leader; max_rows bounds the sample that one task fits on."""

    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 3
    max_rows: int = 12_000


def compact(doc: np.ndarray, index: np.ndarray, value: np.ndarray, presence: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each text and feature, in order of the text."""
    key, where = np.unique(doc.astype(np.int64) << 32 | index.astype(np.int64), return_inverse=True)
    total = np.ones(len(key)) if presence else np.bincount(where, weights=value, minlength=len(key))
    return key >> 32, (key & 0xFFFFFFFF).astype(np.int64), total


def fit(sample: DataFrame, extract: Extract, bits: int, params: Ftrl, presence: bool = False) -> np.ndarray:
    """Weights (the last one is the bias) from a bounded sample of rows (text, target in 0..1); where repeated
    ids make it larger than params.max_rows, that many of them count.

    Features are extracted in parallel; one task then runs the sequential updates in the order of a
    hash of the text, so that the result depends neither on partitions nor on row order.  That task holds features,
    not texts: 8 bytes for each different one, so a text of 20,000 words costs it 640 KB at most, and one of any length
    8 << bits.  Without rows all weights are 0.
    """
    bound_batches(sample.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                doc, index, value = compact(*extract(buf, offsets), presence)
                cut = np.searchsorted(doc, np.arange(len(offsets)))
                rows = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column("order"), part.column("target").cast(pa.float64()),
                    pa.array([index[a:b].astype("<i4").tobytes() for a, b in rows], pa.binary()),
                    pa.array([value[a:b].astype("<f4").tobytes() for a, b in rows], pa.binary()),
                ], ["order", "target", "index", "value"])

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "target"], kind="stable")
        rows = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), t) for i, v, t in zip(pdf["index"], pdf["value"], pdf["target"], strict=True)]
        weights = ftrl(rows, (1 << bits) + 1, params)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})

    rows = sample.select(F.xxhash64("text").alias("order"), F.col("target").cast("double"), "text")
    made = rows.mapInArrow(featurise, "order long, target double, index binary, value binary").orderBy("order", "target").limit(params.max_rows)
    got = made.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(train, "weights binary").collect()
    return np.frombuffer(got[0][0], "<f4").copy() if got else np.zeros((1 << bits) + 1, np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int, p: Ftrl) -> np.ndarray:
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= p.l1, 0.0, -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for index, value, target in rows:
            at, x = np.append(index, size - 1), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - target) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weight(np.arange(size))


def score(docs: DataFrame, extract: Extract, weights: np.ndarray, keep: list[str], out: str = "score", presence: bool = False) -> DataFrame:
    """The kept columns of every row and its probability: the logistic of the sparse dot product."""
    spark = docs.sparkSession
    bound_batches(spark)
    (body,) = fresh([*keep, out], "__text")
    model = spark.sparkContext.broadcast(weights)  # (1 << bits) + 1 numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            for part, buf, offsets in text_chunks(batch, body):
                doc, index, value = extract(buf, offsets)
                used = w[index] != 0
                doc, index, value = doc[used], index[used], value[used]
                if presence:
                    doc, index, value = compact(doc, index, value, True)
                total = np.bincount(doc, weights=w[index] * value, minlength=len(offsets) - 1) + w[-1]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*keep, out])

    rows = docs.select(*keep, F.col("text").alias(body))
    return rows.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.select(*keep).schema), T.StructField(out, T.DoubleType())]))
