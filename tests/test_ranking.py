"""The spread pairwise ranker: its gradients by brute force, its ranking beside the one that is fitted on the driver."""

import numpy as np
import pytest

from framesieve.operators import fuse, ranking

NAMES = ("f0", "f1", "f2")


def table(spark, data):
    return spark.createDataFrame(data, "query_id string, relevance int, f0 double, f1 double, f2 double")


def judged(rng, queries, rows):
    out = []
    for q in range(queries):
        x = rng.normal(size=(rows, 3)) * [1, 50, 0.01] + [0, 9, 0]
        level = x @ [1.0, -0.03, 20.0] + rng.normal(scale=0.3, size=rows)
        out += [(f"q{q}", int(k), *map(float, v)) for k, v in zip(np.digitize(level, [-0.5, 0.5]), x, strict=True)]
    return out


def accuracy(data, w, mean, std):
    """Share of one query's pairs of different relevance that the weights put right."""
    right = n = 0
    for q in {r[0] for r in data}:
        own = [r for r in data if r[0] == q]
        s = ((np.array([r[2:] for r in own]) - mean) / std) @ np.array(w)
        level = np.array([r[1] for r in own])
        better = level[:, None] > level
        right, n = right + (better & (s[:, None] > s)).sum(), n + better.sum()
    return right / n


@pytest.mark.parametrize("chunk", [7, 1024])
def test_gradient_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    data = judged(rng, 3, 40) + [("alone", 1, 0.0, 0.0, 0.0), ("q0", None, 1.0, 1.0, 1.0), (None, 0, 0.5, 1.0, 0.0), (None, 1, 0.1, 3.0, 0.0)]
    mean, std, w = [0.1, 8.0, 0.0], [1.0, 40.0, 0.02], rng.normal(size=3)
    made, loss, n = ranking._gradient(ranking._chunk_pairs(table(spark, data), NAMES, "relevance", "query_id", mean, std), w)
    wanted, total, pairs = np.zeros(3), 0.0, 0
    for a in data:
        for b in data:
            if a[0] == b[0] and a[1] is not None and b[1] is not None and a[1] > b[1]:
                d = (np.array(a[2:]) - np.array(b[2:])) / std
                wanted, total, pairs = wanted - d / (1 + np.exp(w @ d)), total + np.log1p(np.exp(-w @ d)), pairs + 1
    assert n == pairs and loss == pytest.approx(total) and made == pytest.approx(wanted)


def test_ranks_as_well_as_on_the_driver(spark):
    """Within a hundredth of the accuracy of stochastic steps over all pairs of one query."""
    rng = np.random.default_rng(5)
    one, other = judged(rng, 1, 150), judged(rng, 5, 100)
    x, y = [list(r[2:]) for r in one], [r[1] for r in one]
    here = accuracy(other, *fuse.fit_pairwise(x, y, epochs=5))
    spread = accuracy(other, *ranking.fit(table(spark, one), NAMES))
    assert spread > here - 0.01 and spread > 0.9


def test_many_rows(spark):
    """Half of all rows judge one query."""
    rng = np.random.default_rng(6)
    data = judged(rng, 400, 25) + [("hot", *r[1:]) for r in judged(rng, 1, 10_000)]
    w, mean, std = ranking.fit(table(spark, data).repartition(8), NAMES, epochs=15)
    assert accuracy(data[:2000], w, mean, std) > 0.9
    scored = fuse.ltr_score(fuse.ltr_features(table(spark, data[:50]), NAMES), w, NAMES)
    assert scored.where("learned_rank_score IS NULL").count() == 0


def test_nothing_to_learn(spark):
    for data in ([], [("q", 1, 1.0, 2.0, 3.0)], [("q", 1, 1.0, 2.0, 3.0), ("p", 2, 0.0, 0.0, 0.0)]):
        with pytest.raises(ValueError, match="more relevant"):
            ranking.fit(table(spark, data), NAMES)
    with pytest.raises(ValueError, match="missing"):
        ranking.fit(table(spark, []), ("other",))
