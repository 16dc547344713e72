"""The divergence audit against brute force in Python's integers, its hash against the library's, and edges."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

from framesieve.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, k, s, 1, "clash", 2) for i, (t, k, s) in enumerate(rows)], SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {k for _, k, _ in rows}:
        held, sources = collections.Counter(), collections.defaultdict(collections.Counter)
        for text, k, s in rows:
            if k == lang:
                words = [lower(w) for w in TERM.findall(text)]
                sources[s].update(words)
                held.update(set(words))
        kept = sorted(w for w, n in held.items() if n >= least)
        v = len(kept)

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * v) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in sources.items()}, shares(sum(sources.values(), collections.Counter()))
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -d, r) for r, (d, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if sources[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "term", w, -d, r) for r, (d, _, w) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def made(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "été", "文字", "don't", "x1y", "UP_down", "Ünï", "\u0080", "é" * 40, "w" * 33, "w" * 32, "w" * 31, "ab\0cd", "🙂"]
    rows = []
    for _ in range(n):
        s = rng.choice(["web", "web", "book", "é", None, ""])
        rows.append((" ".join(rng.choices(words, [1 + (len(w) * (s or "x").__len__()) % 5 for w in words], k=rng.randint(0, 12))), rng.choice(["en", "de", None]), s))
    return [*rows, (None, "en", "web"), ("", "xx", "none"), ("rare words", "yy", "one"), ("rare", "yy", "two"), *[("same text", "zz", "copies")] * 12]


@pytest.mark.parametrize("block", [divergence.BLOCK, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = texts(1, 300)
    assert made(divergence.audit(table(spark, rows).repartition(3))) == brute(rows)
    assert made(divergence.audit(table(spark, rows), least=1, top=2)) == brute(rows, 1, 2)


def test_edges(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    alone = [("one two", None, None)] * 10
    assert made(divergence.audit(table(spark, alone))) == brute(alone) == []
    long = [("x" * 2_000_000 + " Word" * 100_000, "en", "a"), *[("word x", "en", "b")] * 9]
    assert made(divergence.audit(table(spark, long))) == brute(long)


def test_hash_is_the_librarys():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3800, 500)
    ends = starts + rng.integers(0, 70, 500)
    assert divergence.slice_hashes(np.append(buf, np.zeros(32, np.uint8)), starts, ends).tolist() == [xxhash.xxh64_intdigest(buf[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_terms_of_one_hash_are_told_apart():
    data = b"abc abd abc abe abd " + b"y" * 40 + b"a " + b"y" * 40 + b"b " + bytes(32)
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = divergence.terms(buf, np.array([0, len(buf)]))
    first, group = divergence.group_slices(buf, starts, ends, np.zeros(len(starts), np.uint64))
    words = [data[starts[i] : ends[i]] for i in first]
    assert len(set(words)) == len(words) == 5 and [words[g] for g in group] == [data[a:b] for a, b in zip(starts, ends, strict=True)]


def test_shares_are_exact():
    rng = random.Random(4)
    for _ in range(300):
        total = rng.randint(1, 8 * 10**15)
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), total).tolist() == [1 + 10**9 * count // total]
