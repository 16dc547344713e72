"""Benchmark decontamination by greedy string tiling (running Karp-Rabin matching).

Tokens are lower-cased runs of letters and digits.  Documents and benchmark items are joined on shared
seeds, hashed runs of SEED tokens; between the seeded parts of a document and each item so found, the
longest matches without overlap are marked again and again until none of SEED tokens is left.  An
item's coverage is the share of its tokens in marked tiles, in whatever order they stand; a document is
contaminated where some item's coverage reaches the threshold.

A benchmark is cut into shards of bounded size.  Each is broadcast for a pass of its own, which ends, with its matches
written, before the next shard is read; documents are never grouped or shuffled by seed, so a passage that many
documents hold makes no hot key.

Defined results: null and empty texts match nothing; items shorter than SEED tokens, the tiling's least match, can't
match (a word or two would contaminate nearly everything); repeated items count separately, those without an id are listed
first, repeated documents are judged alike; an empty benchmark contaminates nothing; other columns are kept only on request, whatever
their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, bound_batches, discard, fresh, gram_hashes, materialize, text_chunks

SEED = 5
THRESHOLD = 0.5
#: Characters of benchmark text that one broadcast holds.
SHARD_CHARS = 8 << 20


def _free_runs(free: np.ndarray, tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which size unmarked tokens begin, and their hashes."""
    hashes = gram_hashes(tokens, size)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[: len(taken) - size])
    return at, hashes[at]


def _before(free: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each place, and whether there is none that could be matched."""
    token, none = np.concatenate((tokens[:1], tokens[:-1])), np.ones(len(tokens), bool)
    none[1:] = ~free[:-1]
    return token, none


def _run_ends(free: np.ndarray) -> np.ndarray:
    """Where the run of unmarked tokens that holds a place ends."""
    marked = np.append(np.flatnonzero(~free), len(free))
    return marked[np.searchsorted(marked, np.arange(len(free)))]


def _starts(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i in doc, j in item) at which equal runs of size begin and that don't go on before them: a match is
    found from its first token only.  Within one hash, places are told apart by the token before, so that a token
    repeated n times makes n pairs and not n squared."""
    at_doc, hash_doc = _free_runs(free_doc, doc, size)
    at_item, hash_item = _free_runs(free_item, item, size)
    order, order_item = np.argsort(hash_doc, kind="stable"), np.argsort(hash_item, kind="stable")
    at_doc, hash_doc, at_item, hash_item = at_doc[order], hash_doc[order], at_item[order_item], hash_item[order_item]
    (token_doc, none_doc), (token_item, none_item) = _before(free_doc, doc), _before(free_item, item)
    each, first, times = np.unique(hash_item, return_index=True, return_counts=True)
    low, high = np.searchsorted(hash_doc, each, "left"), np.searchsorted(hash_doc, each, "right")
    single = (times == 1) & (high - low == 1)
    i, j = at_doc[low[single]], at_item[first[single]]
    begins = none_doc[i] | none_item[j] | (token_doc[i] != token_item[j])
    yield i[begins], j[begins]
    for k in np.flatnonzero(~single & (high > low)).tolist():
        in_doc, in_item = at_doc[low[k] : high[k]], at_item[first[k] : first[k] + times[k]]
        open_ = none_item[in_item]
        tokens = token_item[in_item]
        for group, others in [(in_item[open_], in_doc), *((in_item[~open_ & (tokens == t)], in_doc[none_doc[in_doc] | (token_doc[in_doc] != t)]) for t in np.unique(tokens[~open_]))]:
            for j in group.tolist():
                yield others, np.full(len(others), j)


def _scan(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least size unmarked tokens, found by hashes of runs of size tokens; the length
    of one at least twice as long ends the scan, for it should be sought first."""
    found, longest = [], 0
    ends_doc, ends_item = _run_ends(free_doc), _run_ends(free_item)
    for many, of in _starts(doc, item, free_doc, free_item, size):
        for i, j in zip(many.tolist(), of.tolist(), strict=True):
            room = int(min(ends_doc[i] - i, ends_item[j] - j))
            k, step = 0, max(64, size)
            while k < room:  # compared in steps that double
                step = min(step, room - k)
                wrong = np.flatnonzero(doc[i + k : i + k + step] != item[j + k : j + k + step])
                if len(wrong):
                    k += int(wrong[0])
                    break
                k, step = k + step, 2 * step
            if k >= size:
                longest = max(longest, k)
                if k >= 2 * size:
                    return longest, []
                found.append((k, i, j))
    return longest, found


def _left(free: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and length of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))
    return zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist(), strict=True)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of token hashes: (position in doc, in item, length) of every tile.  The longest
    match is marked first, of equal ones the first in doc, then in item; what is left of a match that a tile covers in
    part waits for its turn among the others."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    out, size = [], max(start, least)
    while True:
        longest, found = _scan(doc, item, free_doc, free_item, size)
        if longest >= 2 * size:
            size = longest
            continue
        heap = [(-k, i, j) for k, i, j in found]
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            k = -k
            free = free_doc[i : i + k] & free_item[j : j + k]
            if free.all():
                free_doc[i : i + k] = False
                free_item[j : j + k] = False
                out.append((i, j, k))
            elif free.any():
                for at, n in _left(free):
                    if n >= size:
                        heapq.heappush(heap, (-n, i + at, j + at))
        if size <= least:
            return sorted(out)
        size = max(least, size // 2)


class Shard:
    """Seeds of some benchmark items: sorted hashes with their items, and the items' tokens."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.tokens, seeds, owner = [], [], [], []
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"])
        k = 0
        for _, buf, offsets in text_chunks(batch, lower=True):
            tokens = Tokens(buf, offsets, "alnum")
            hashes = tokens.hashes()
            for d in range(len(offsets) - 1):
                own = hashes[tokens.first[d] : tokens.first[d + 1]]
                self.ids.append(items[k][0])
                self.tokens.append(own)
                grams = np.unique(gram_hashes(own, SEED))  # a seed that an item repeats names it once
                seeds.append(grams)
                owner.append(np.full(len(grams), k))
                k += 1
        seed, own = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (seeds, owner))
        order = np.argsort(seed, kind="stable")
        self.seeds, self.owner = seed[order], own[order].astype(np.int64)

    def judge(self, hashes: np.ndarray, hit: np.ndarray, grams: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items of which the seeded part of a document covers enough: (item, coverage)."""
        low = np.searchsorted(self.seeds, grams[hit], "left")
        size = np.searchsorted(self.seeds, grams[hit], "right") - low
        ends = np.cumsum(size)
        items = self.owner[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        order = np.argsort(items, kind="stable")
        named, cut = np.unique(items[order], return_index=True)
        out = []
        for item, places in zip(named.tolist(), np.split(np.repeat(hit, size)[order], cut[1:]), strict=True):
            own = self.tokens[item]
            grams_own = gram_hashes(own, SEED)
            shared = np.isin(grams_own, grams[places])
            covered = np.zeros(len(own), bool)
            for d in range(SEED):
                covered[d : d + len(shared)] |= shared
            if covered.mean() < threshold:  # tiles cover no more than the seeds do
                continue
            inside = np.zeros(len(hashes) + 1, bool)
            for d in range(SEED):
                inside[places + d] = True
            # parts between seeded runs can't be in a tile; one foreign token keeps the runs apart
            gap = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
            part = np.insert(np.where(inside[:-1], hashes, 0), gap[gap < len(hashes)], 0)
            flag = np.insert(inside[:-1], gap[gap < len(hashes)], True)
            got = sum(k for _, _, k in tiles(part[flag], own)) / len(own)
            if got >= threshold:
                out.append((self.ids[item], got))
        return out


def _pass(rows: DataFrame, shard: Shard, text: str, threshold: float) -> tuple[DataFrame, Broadcast]:
    """rows with their text (the last column) replaced by matches; and the broadcast shard."""
    data = rows.sparkSession.sparkContext.broadcast(shard)
    kept = [f for f in rows.schema.fields if f.name != text]
    match = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("matches", T.ArrayType(match))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = data.value
        for batch in batches:
            for part, buf, offsets in text_chunks(batch, text, lower=True):
                tokens = Tokens(buf, offsets, "alnum")
                hashes = tokens.hashes()
                grams = gram_hashes(hashes, SEED)
                place = np.minimum(np.searchsorted(bench.seeds, grams), max(len(bench.seeds) - 1, 0))
                hits = np.flatnonzero(bench.seeds[place] == grams) if len(bench.seeds) else np.zeros(0, np.int64)
                hits = hits[tokens.doc[hits] == tokens.doc[hits + SEED - 1]]
                found: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
                owners = tokens.doc[hits]
                for d in np.unique(owners):
                    a, b = tokens.first[d], tokens.first[d + 1]
                    got = bench.judge(hashes[a:b], hits[owners == d] - a, grams[a : b - SEED + 1], threshold)
                    found[d] = [{"item_id": i, "coverage": c} for i, c in sorted(got, key=lambda m: (m[0] is not None, m[0] or 0, m[1]))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(kept))), pa.array(found, kind)], [*(f.name for f in kept), "matches"])

    return rows.mapInArrow(run, schema), data


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns of every document and matches, an array of (item_id, coverage) of the benchmark
    items that it covers to the threshold, by item; a document without any is clean."""
    spark = docs.sparkSession
    bound_batches(spark)
    body, key, twin, id_, check, found = fresh([*keep, "matches"], "__text", "__key", "__twin", "__id", "__check", "__found")
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // SHARD_CHARS

    def shard(k: int) -> Shard:
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        return Shard([tuple(r) for r in own.toLocalIterator()])

    if n == 1:
        made, _ = _pass(docs.select(*keep, F.col("text").alias(body)), shard(0), body, threshold)
        return made
    # a row is known by two hashes of its kept columns and text; rows equal in these match alike
    keys = [F.xxhash64(*keep, "text").alias(key), F.hash(F.lit(1), *keep, "text").alias(twin)]
    rows = docs.select(*keys, F.col("text").alias(body))
    passes = []
    for k in range(n):
        made, data = _pass(rows, shard(k), body, threshold)
        passes.append(materialize(made.where("size(matches) > 0")))
        data.unpersist()
    one = [p.dropDuplicates([key, twin]) for p in passes]
    every = reduce(DataFrame.unionByName, one).groupBy(F.col(key).alias(id_), F.col(twin).alias(check))
    every = materialize(every.agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias(found)))
    discard(*passes)
    joined = docs.select(*keep, *keys).join(every, (F.col(key) == F.col(id_)) & (F.col(twin) == F.col(check)), "left")
    return joined.select(*keep, F.coalesce(F.col(found), F.array().cast(every.schema[found].dataType)).alias("matches"))
