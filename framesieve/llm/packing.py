"""Best-fit packing by minimum bin slack.

Texts are tokenised, ended with id 0 and, only where longer than a sequence, cut into pieces of its
length (the first may be shorter).  Each bin is filled around the longest remaining length by a
bitset subset-sum over the other available lengths; the fullest combination is removed and repeated as
often as the stock lasts.  A bin's contents depend only on how many pieces of each length there are:
the plan comes from a histogram of at most `capacity` rows, and every combination leaves of some length
fewer than it took, so there are a few times `capacity` of them, whatever the corpus.  Pieces find their place by their rank within
their length, counted in two levels so that a common length isn't one task's.

Defined results: a null text is empty and gives the piece [0]; pieces of equal length are ranked by a hash of
the row's columns, in parts, and within a part by the columns in their order; ties among identical rows are
arbitrary; an empty table gives no rows; other columns are kept only on request, and none of these may have
the name of one that is made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import bound_batches, fresh, materialize
from .words import tokenizer

CAPACITY = 2048
END = 0


def pieces(docs: DataFrame, path: str, keep: list[str], capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The kept columns, piece, start, length, ids_crc32 and (on request) ids of every piece of every text."""
    bound_batches(docs.sparkSession)
    extra = [("piece", T.IntegerType(), pa.int32()), ("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("ids_crc32", T.LongType(), pa.int64())]
    if with_ids:
        extra.append(("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    (body,) = fresh(keep, "__text")
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, k) for n, k, _ in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, forget = tokenizer(path)
        try:
            for batch in batches:
                rows, cells = [], []
                for row, ids in enumerate(encode(batch.column(body))):
                    array = np.append(ids, np.uint32(END))
                    at, to, k = 0, len(array) % capacity or min(len(array), capacity), 0
                    while at < len(array):
                        part = array[at:to]
                        cells.append((k, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                        rows.append(row)
                        at, to, k = to, to + capacity, k + 1
                columns = list(zip(*cells, strict=True)) if cells else [()] * 5
                taken = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in range(len(keep))), *(pa.array(v, k) for v, (_, _, k) in zip(columns, extra, strict=False))], [*keep, *(n for n, _, _ in extra)])
        finally:
            forget()

    return docs.select(*keep, F.col("text").alias(body)).mapInArrow(run, schema)


def fullest(stock: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how many of each that fill the room best: bitset subset-sum with bounded counts, stopped at
    an exact fit; the longest lengths are tried first, so that short ones last."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in stock.items() if n and x <= room), reverse=True):
        left, part = min(stock[length], room // length), 1
        while left > 0:
            size = min(part, left)
            steps.append((length, size, reach))
            reach |= reach << (length * size) & full
            left, part = left - size, part * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + size
            total -= length * size
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (how many pieces of each length, how often)."""
    stock = {k: n for k, n in histogram.items() if n}
    out = []
    while stock:
        top = max(stock)
        stock[top] -= 1
        use = fullest(stock, capacity - top)
        stock[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(stock[k] // n for k, n in use.items())
        for k, n in use.items():
            stock[k] -= n * times
            if not stock[k]:
                del stock[k]
        out.append((use, times))
    return out


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row of cut (a written table with a length in 1..capacity) with sequence_id and offset."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    starts, keys, sequence, slots, offset = [], [], 0, [], []
    seen: dict[int, int] = {}
    for use, times in plan(histogram, capacity):
        at = 0
        for length in sorted(use, reverse=True):
            n, rank = use[length], seen.get(length, 0)
            keys.append(length << 40 | rank)
            starts.append(sequence)
            slots.append(n)
            offset.append(at)
            seen[length] = rank + n * times
            at += n * length
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    tables = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, starts, slots, offset)))

    part, before_, rank = fresh(cut.columns, "__part", "__before", "__rank")
    # as many parts as a length has rows in each: neither a part nor the list of parts is long
    parts = F.array(*(F.lit(1 + math.isqrt(histogram.get(k, 0))) for k in range(1, capacity + 1)))
    content = [c for c in cut.columns if c != "length"]
    rows = cut.withColumn(part, F.pmod(F.xxhash64(*content), F.element_at(parts, F.col("length").cast("int"))))
    sums = rows.groupBy("length", part).count()
    before = sums.select("length", part, F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before_))
    simple = [f.name for f in cut.schema if f.name != "length" and not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy("length", part).orderBy(*simple)) - 1).join(before, ["length", part]).withColumn(rank, F.col(rank) + F.col(before_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, slots, offset = tables.value
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", rank))
            at = np.searchsorted(keys, length << 40 | place, "right") - 1
            local = place - (keys[at] & ((1 << 40) - 1))
            names = [n for n in batch.schema.names if n != rank]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(starts[at] + local // slots[at]), pa.array(offset[at] + local % slots[at] * length)], [*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*cut.columns, F.col(rank).cast("long").alias(rank)).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, keep: list[str], capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Tokenises once, writes the pieces to the shared folder, and places them."""
    return place(materialize(pieces(docs, path, keep, capacity, with_ids)), capacity)
