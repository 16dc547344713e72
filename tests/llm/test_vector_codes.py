"""Vector codes against brute force in Python's integers, bounds against full scans, and edges."""

import math
import random

import numpy as np
import pytest

from framesieve.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, row string, vector int, code int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "clash", 1, 2) for i, v, k in rows], SCHEMA)


def brute(rows, parts=4, entries=256, rounds=4):
    """codes, errors and codebooks by looking at every entry for every part."""
    kept = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * 1024) if abs(x) < 1e15 else int(x) * 1024 for x in v] for _, v in kept]
    each = -(-len(whole[0]) // parts)
    cut = [[(v + [0] * (each * parts - len(v)))[p * each : (p + 1) * each] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        at = [[nearest(v[p], books[p])[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, k in zip(cut, at[p], strict=True) if k == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for v in cut:
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return [i for i, _ in kept], out, books


def check(spark, rows, **how):
    codes = vector_codes.encode(table(spark, rows).repartition(3), ["vec_id", "row", "code"], **how)
    ids, wanted, books = brute(rows, **how)
    made = [(r.row.vec_id, (r.code, r.error)) for r in codes.rows.collect()]
    assert sorted(made, key=str) == sorted(zip(ids, ((c, e if e < 1 << 63 else None) for c, e in wanted), strict=True), key=str)
    assert [b.tolist() for b in codes.codebooks] == books
    return codes


@pytest.mark.parametrize("scale", [0.002, 0.3, 5e5, 1e12, 1e300])
def test_against_brute_force(spark, scale):
    """Small scales make ties, large ones need 64 bits and more."""
    rng = random.Random(scale)
    rows = [(i, [rng.gauss(0, scale) for _ in range(8)], i % 3) for i in range(150)]
    check(spark, rows, entries=12)


def test_repeats_nulls_and_widths(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(10)], None if i % 2 else 1) for i in range(40)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[5][1], 2), (50, None, 1), (51, [None] * 10, 1), (52, [math.nan] * 10, 1), (53, [math.inf] + [0.0] * 9, 1), (54, [-math.inf] * 10, None)]
    check(spark, rows, entries=9)
    ragged = vector_codes.encode(table(spark, [*rows, (60, [0.5], 1), (61, [], 1)]), ["vec_id"]).rows.where("code IS NULL").collect()
    assert sorted(r.row.vec_id for r in ragged) == [60, 61] and all(r.error is None for r in ragged)
    assert vector_codes.encode(table(spark, []), ["vec_id"]).rows.count() == 0
    assert vector_codes.encode(table(spark, [(1, None, 1)]), ["vec_id"]).rows.count() == 0
    assert [r.code for r in vector_codes.encode(table(spark, [(1, [], 1), (2, [], 1)]), ["vec_id"]).rows.collect()] == ["00000000"] * 2
    one = vector_codes.encode(table(spark, [(5, [0.25] * 8, 1)]), ["vec_id"])
    assert one.decode("00000000") == [256] * 8 and one.rows.first().error == 0


def test_entries_are_two_digits(spark):
    for wrong in ({"entries": 257}, {"entries": 0}, {"parts": 0}):
        with pytest.raises(ValueError):
            vector_codes.encode(table(spark, []), ["vec_id"], **wrong)


def test_label_errors(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, 1, 7), (4, 1, None), (5, 2, None)], "vec_id long, label int, error long")
    made = {r.vec_id: r.label_error for r in vector_codes.label_errors(rows, rows.label).collect()}
    assert made == {1: 11, 2: 11, 3: 7, 4: 7, 5: None}


def test_bounds_spare_scans_and_keep_ties():
    """Rounds by bounds end as rounds by full scans do, and look up fewer parts in full."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-300, 300, (40, 16))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-9, 10, (4000, 16))
    x[:50] = 0
    books = x[:64].copy()
    code, upper, lower = vector_codes.scan(x, books)
    spared = 0
    for _ in range(4):
        total, n = vector_codes.part_sums(x, code, 64), np.bincount(code, minlength=64)
        new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], books)
        code, upper, lower, full = vector_codes.reassign(x, new, vector_codes.moved(books, new), code, upper, lower)
        books = new
        d = ((x[:, None].astype(int) - books) ** 2).sum(2)
        assert (code == d.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= d[np.arange(4000), code]).all()
        d[np.arange(4000), code] = 1 << 60
        assert (np.maximum(lower, 0).astype(float) ** 2 <= d.min(1)).all()
        spared += 4000 - full
    assert spared > 4000


def test_limbs():
    for v in (0, -1, 5, 1 << 62, -(1 << 62), (1 << 200) + 12345, -(1 << 200) - 12345):
        assert sum(x << (62 * k) for k, x in enumerate(vector_codes.limbs(v))) == v and all(abs(x) < 1 << 62 for x in vector_codes.limbs(v))


def test_registered(spark, sf):
    made = queries.op13_vector_codes(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, wanted, _ = brute([(r.vec_id, list(r.embedding), r.label) for r in docs])
    assert sorted((r.vec_id, r.code, r.error) for r in made) == sorted((i, *w) for i, w in zip(ids, wanted, strict=True))
