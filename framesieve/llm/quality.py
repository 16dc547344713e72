"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring.

Tokens are runs of letters and digits and runs of other visible characters.  Features are hashed
token unigrams and bigrams, and the same n-grams over token shapes (case pattern, sort of character,
"repeats the token before"); a feature's value is its count over the square root of the text's tokens.

Defined results: null, empty and blank texts have no features and score the bias; equal texts score
alike; other columns, whatever their names, are not read; no labelled row at all gives 0.5.
Labels that are null are ignored; a document with several labels counts with each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Tokens, bounded_sample, gram_hashes, mix
from .linear import Ftrl, fit, score

BITS = 18
PARAMS = Ftrl()
THRESHOLD = 0.3


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature index and value of every n-gram."""
    tokens = Tokens(buf, offsets, "runs")
    n = len(tokens.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    words = tokens.hashes()
    first, last = buf[tokens.starts], buf[tokens.ends - 1]
    upper = lambda b: (b >= 0x41) & (b <= 0x5A)
    same = np.zeros(n, bool)
    same[1:] = (words[1:] == words[:-1]) & (tokens.doc[1:] == tokens.doc[:-1])
    sort = np.select([upper(last), upper(first), (first >= 0x30) & (first <= 0x39), (first >= 0x61) | (first >= 0x80)], [1, 2, 3, 4], 5)
    symbol = (first < 0x30) | ((first > 0x39) & (first < 0x41)) | ((first > 0x5A) & (first < 0x61)) | ((first > 0x7A) & (first < 0x80))
    shapes = np.where(symbol, words, mix((sort + 8 * same).astype(np.uint64)))
    inside = tokens.doc[1:] == tokens.doc[:-1]
    doc = np.concatenate([tokens.doc, tokens.doc, tokens.doc[1:][inside], tokens.doc[1:][inside]])
    hashes = np.concatenate([words, mix(shapes + U(1)), gram_hashes(words, 2)[inside], gram_hashes(shapes, 2)[inside]])
    size = np.sqrt(np.diff(tokens.first))
    return doc, (hashes >> U(64 - BITS)).astype(np.int64), 1 / size[doc]


def train(docs: DataFrame, labels: DataFrame, learn_from=None, params: Ftrl = PARAMS) -> np.ndarray:
    """Weights from the labelled rows that learn_from (a condition on doc_id) admits: a sample of at most
    params.max_rows labels, chosen by hash, fits the model."""
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("double").alias("target"))
    if learn_from is not None:
        rows = rows.where(learn_from)
    rows = bounded_sample(rows, ["doc_id"], params.max_rows, rows.count())
    return fit(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), features, BITS, params)


def classify(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns, score (probability of good quality) and predicted (score >= 0.3)."""
    return score(docs, features, weights, keep).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
