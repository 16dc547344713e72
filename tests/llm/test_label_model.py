"""The label model's steps against sums over single rows, written as the formulas say."""

import itertools
import math
import random

import numpy as np
import pytest

from framesieve.llm.toxicity import LabelModel

VOTERS = 4


def given(seed):
    """Mask counts of rows whose votes depend on a class, and the last one on the one before."""
    rng = random.Random(seed)
    groups = {}
    for _ in range(800):
        y = rng.random() < 0.3
        votes = [rng.random() < (0.8 if y else 0.1) for _ in range(VOTERS - 1)]
        votes.append(votes[-1] if rng.random() < 0.9 else not votes[-1])
        key = (sum(v << k for k, v in enumerate(votes)), int(y) if rng.random() < 0.2 else -1)
        groups[key] = groups.get(key, 0) + 1
    masks, known, counts = (np.array(x) for x in zip(*((m, k, n) for (m, k), n in groups.items()), strict=True))
    return masks, known, counts.astype(float)


def bit(mask, k):
    return int(mask) >> k & 1


@pytest.mark.parametrize("seed", range(3))
def test_posterior_is_bayes_rule(seed):
    model = LabelModel(*given(seed), voters=VOTERS)
    masks = np.arange(1 << VOTERS)
    for mask, made in zip(masks, model.posterior(masks), strict=True):
        joint = []
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for j in range(VOTERS):
                up = bit(mask, model.parent[j]) if model.parent[j] >= 0 else 0
                fires = model.table[y, j, up]
                p *= fires if bit(mask, j) else 1 - fires
            joint.append(p)
        assert made == pytest.approx(joint[1] / sum(joint))
    total = sum(joint_of(model, m) for m in masks)
    assert total == pytest.approx(1)  # it is a distribution over all votes


def joint_of(model, mask):
    out = 0.0
    for y in (0, 1):
        p = model.prior if y else 1 - model.prior
        for j in range(VOTERS):
            fires = model.table[y, j, bit(mask, model.parent[j]) if model.parent[j] >= 0 else 0]
            p *= fires if bit(mask, j) else 1 - fires
        out += p
    return out


@pytest.mark.parametrize("seed", range(3))
def test_maximising_counts_row_by_row(seed):
    masks, known, counts = given(seed)
    model = LabelModel(masks, known, counts, voters=VOTERS, rounds=8)
    p = np.random.default_rng(seed).random(len(masks))
    v = (masks[:, None] >> np.arange(VOTERS)) & 1
    model._maximise(v, counts, p)
    assert model.prior == pytest.approx((sum(n * q for n, q in zip(counts, p, strict=True)) + 0.5) / (sum(counts) + 1))
    for y, j, u in itertools.product((0, 1), range(VOTERS), (0, 1)):
        fired = seen = 0.0
        for mask, n, q in zip(masks, counts, p, strict=True):
            if (bit(mask, model.parent[j]) if model.parent[j] >= 0 else 0) == u:
                weight = n * (q if y else 1 - q)
                seen, fired = seen + weight, fired + weight * bit(mask, j)
        assert model.table[y, j, u] == pytest.approx((fired + 0.5) / (seen + 1))


@pytest.mark.parametrize("seed", range(3))
def test_tree_is_the_heaviest(seed):
    masks, known, counts = given(seed)
    model = LabelModel(masks, known, counts, voters=VOTERS, rounds=8)
    p = np.where(known >= 0, known, np.random.default_rng(seed).random(len(masks)))
    v = (masks[:, None] >> np.arange(VOTERS)) & 1
    parent = model._tree(v, counts, p)
    info = np.zeros((VOTERS, VOTERS))
    for a, b in itertools.permutations(range(VOTERS), 2):
        for y in (0, 1):
            w = [n * (q if y else 1 - q) for n, q in zip(counts, p, strict=True)]
            mass = sum(w) + 1
            for s, t in itertools.product((0, 1), repeat=2):
                joint = (sum(x for x, m in zip(w, masks, strict=True) if bit(m, a) == s and bit(m, b) == t) + 0.25) / mass
                one = (sum(x for x, m in zip(w, masks, strict=True) if bit(m, a) == s) + 0.5) / mass
                two = (sum(x for x, m in zip(w, masks, strict=True) if bit(m, b) == t) + 0.5) / mass
                info[a, b] += mass / (sum(counts) + 1e-9) * joint * math.log(joint / (one * two))
    off = ~np.eye(VOTERS, dtype=bool)
    assert model.correlation_[off] == pytest.approx(info[off])
    best = max(  # of all trees
        sum(info[a, b] for a, b in edges) for edges in itertools.combinations(itertools.combinations(range(VOTERS), 2), VOTERS - 1)
        if len({x for e in edges for x in e}) == VOTERS and connected(edges)
    )
    assert sum(info[j, parent[j]] for j in range(VOTERS) if parent[j] >= 0) == pytest.approx(best)


def connected(edges):
    seen, grows = {0}, True
    while grows:
        more = {x for e in edges if seen & set(e) for x in e}
        grows = not more <= seen
        seen |= more
    return len(seen) == VOTERS


@pytest.mark.parametrize("seed", range(3))
def test_rounds_do_not_lower_the_likelihood(seed):
    """Of the votes and the classes that are known, once the tree stands (up to the half counts that smooth the tables)."""
    masks, known, counts = given(seed)

    def likelihood(rounds):
        model = LabelModel(masks, known, counts, voters=VOTERS, rounds=40)
        v = (masks[:, None] >> np.arange(VOTERS)) & 1
        p = np.where(known >= 0, known, 0.5)
        for _ in range(rounds):
            model._maximise(v, counts, p)
            p = np.where(known >= 0, known, model.posterior(masks))
        total = 0.0
        for mask, k, n in zip(masks, known, counts, strict=True):
            one = model.posterior(np.array([mask]))[0]
            total += n * math.log(joint_of(model, mask) * (1 if k < 0 else one if k else 1 - one))
        return total

    made = [likelihood(r) for r in (1, 3, 10, 30)]
    assert all(b >= a - 0.5 for a, b in itertools.pairwise(made))
