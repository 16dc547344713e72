"""Ids beyond doubles, missing ids, and texts of one word over and over."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve.llm import chat, decontaminate

TURNS = "conv_id long, turn long, role string, text string"
FAR = 1 << 53


def test_chat_keeps_ids_and_order_exact(spark, monkeypatch):
    rows = [(c, t, r, f"{c} {t} {r}") for c in (FAR, FAR + 1, -FAR - 1, -FAR, None, (1 << 63) - 1) for t in (FAR + 1, FAR, None, -5, -FAR - 1) for r in ("a", "b")]
    rows += rows[:7]
    monkeypatch.setattr(chat, "CHUNK", 3)
    for speakers in (chat.SPEAKERS, 0):
        monkeypatch.setattr(chat, "SPEAKERS", speakers)
        made = chat.rotate(spark.createDataFrame(rows, TURNS).repartition(3)).where("speaker = 'a'").orderBy("chunk").collect()
        whole = {c: "".join(r.text for r in made if r.conv_id == c) for c in {r[0] for r in rows}}
        assert len({r.conv_id for r in made}) == 6
        for c, text in whole.items():
            order = sorted({r for r in rows if r[0] == c}, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
            assert text == "".join(f"{'<|assistant|>' if r == 'a' else '<|user name=b|>'}\n{body}<|end|>\n" for _, _, r, body in order)


def test_items_without_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(None, passage), (3, passage), (None, passage), (-2, passage), (4, "other words entirely in this one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + passage), (2, "nothing of it"), (None, passage)], "doc_id long, text string")
    made = {r.doc_id: [m.item_id for m in r.matches] for r in decontaminate.decontaminate(docs, items, ["doc_id"]).collect()}
    assert made == {1: [None, None, -2, 3], 2: [], None: [None, None, -2, 3]}


def greedy(a, b, least):
    """Tokens covered by marking the longest match again and again, the first of equal ones."""
    fa, fb, out = [1] * len(a), [1] * len(b), []
    while True:
        best = (0, 0, 0)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            k = 0
            while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return sorted(out)
        fa[i : i + k], fb[j : j + k] = [0] * k, [0] * k
        out.append((i, j, k))


@pytest.mark.parametrize("words", [1, 2, 3])
def test_tiles_of_few_words_against_brute_force(words):
    rng = random.Random(words)
    for _ in range(60):
        a, b = ([rng.randrange(words) for _ in range(rng.randint(1, 30))] for _ in "ab")
        made = decontaminate.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3, rng.choice([3, 5, 20]))
        assert sorted(k for _, _, k in made) == sorted(k for _, _, k in greedy(a, b, 3)), (a, b)
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in made)


def test_a_million_repeated_words(spark):
    items = spark.createDataFrame([(1, "again " * 2000), (2, "again and " * 1000), (3, "never said")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "again " * 1_000_000), (2, "and again " * 500_000), (3, "once again")], "doc_id long, text string")
    began = time.time()
    made = {r.doc_id: [(m.item_id, m.coverage) for m in r.matches] for r in decontaminate.decontaminate(docs, items, ["doc_id"]).withColumn("n", F.lit(1)).collect()}
    assert made == {1: [(1, 1.0)], 2: [(2, 1.0)], 3: []}
    assert time.time() - began < 60


def test_scratch_of_two_threads(spark):
    """A thread's end of scratch deletes its own steps only."""
    import os
    import threading

    from framesieve.llm import common

    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        with common.scratch(spark):
            kept.append(common.materialize(spark.range(5)))
            inside.set()
            done.wait(60)
            assert kept[0].count() == 5

    thread = threading.Thread(target=other)
    thread.start()
    inside.wait(60)
    with common.scratch(spark):
        own = common.materialize(spark.range(3))
        folder = own.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert not os.path.exists(folder) and kept[0].count() == 5
    done.set()
    thread.join()
    assert not common._open()
