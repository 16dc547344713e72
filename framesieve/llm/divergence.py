"""Source divergence audit: how the sources of each language differ in the words that they use.

Terms are runs of ASCII letters and of characters from U+0080 on, of which only A-Z are lower-cased.  A batch's texts are one
UTF-8 buffer: a table of 256 entries tells term bytes from others, so that boundaries come from one lookup; the slices
are grouped by their XXH64 (computed on arrays for slices of up to 31 bytes), and every slice is compared with its
group's first one byte by byte, so that terms of one hash are told apart.  Each batch counts its terms by language and source;
Spark adds these up.

Of every language, terms in at least `least` of its documents are kept, V of them.  A group is a source in a language, or the
language itself.  With N the group's occurrences of kept terms, each kept term has p = 1 + floor(10**9 (count + 2) / (N + 2 V))
there, and two groups differ in it by f = floor((p - q)**2 / (p + q)).  A language's kept terms are dealt by hash to blocks, each
a CSR matrix of sources by terms.  Most counts are zero, so a pair's sum over a block is made of the terms that one of
both has: for every source its p's are laid over the block and np.add.reduceat sums f along the rows of the matrix at once.

    sum f(p, q) = sum over b's terms of f(p, q) - f(p, z)  +  sum over a's terms of f(p, z)  +  f(y, z) for the others

(y and z: what a term without occurrences has in a and in b).  Sums and ranks over blocks are Spark's.

Defined results: null text, language and source are ''; a document counts once for a term, a repeated row again; groups
without terms have V or no occurrences and are compared all the same; V = 0 gives 0 to every pair; ties are ranked by the
item's UTF-8 bytes; very long terms are terms; other columns aren't looked at; an empty table gives no rows.  Arithmetic is exact
in 64 bits as long as a group has fewer than 9 * 10**15 occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import bound_batches, discard, materialize, text_chunks

LEAST, TOP = 10, 10
SCALE_STEPS = 3  # 10**9 in three long-division steps of 1000
#: Counts of a block's matrix, about, or the square of the language's sources where that is more: a block gives no more rows
#: than it gets, and a language has as many blocks as it needs.
BLOCK = 1 << 14
#: Different shares of one source that are compared with all sources at once.
CHUNK = 256

LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at every position of a buffer (which ends with at least seven more) as little-endian integers."""
    return np.ndarray((max(len(buf) - 7, 0),), "<u8", buf.data if len(buf) else b"", 0, (1,))


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of slices; buf has at least 32 bytes after the last of them."""
    size, word = ends - starts, lanes(buf)
    h = _P5 + size.astype(np.uint64)
    at = starts.copy()
    for k in range(3):
        sel = np.flatnonzero(size >= 8 * (k + 1))
        if not len(sel):
            break
        h[sel] = _rotl(h[sel] ^ (_rotl(word[at[sel]] * _P2, 31) * _P1), 27) * _P1 + _P4
        at[sel] += 8
    sel = np.flatnonzero(size % 8 >= 4)
    h[sel] = _rotl(h[sel] ^ ((word[at[sel]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[sel] += 4
    for k in range(3):
        sel = np.flatnonzero(size % 4 > k)
        h[sel] = _rotl(h[sel] ^ (buf[at[sel]].astype(np.uint64) * _P5), 11) * _P1
        at[sel] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]])
    return h


def equal_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether slices i have the bytes of the other slices i."""
    size, word = ends - starts, lanes(buf)
    same = size == other_ends - others
    for k in range(4):
        sel = np.flatnonzero(same & (size > 8 * k))
        if not len(sel):
            return same
        rest = np.minimum(size[sel] - 8 * k, 8).astype(np.uint64)
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - rest))
        same[sel] = ((word[starts[sel] + 8 * k] ^ word[others[sel] + 8 * k]) & mask) == 0
    for i in np.flatnonzero(same & (size > 32)).tolist():
        same[i] = np.array_equal(buf[starts[i] : ends[i]], buf[others[i] : other_ends[i]])
    return same


def group_slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the index of each different slice's first one, and of every slice its place in first."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~equal_slices(buf, starts, ends, starts[first[group]], ends[first[group]]))
    if len(wrong):  # another term of the same hash: by its bytes
        extra: dict[bytes, int] = {}
        first = first.tolist()
        for i in wrong.tolist():
            k = extra.setdefault(buf[starts[i] : ends[i]].tobytes(), len(first))
            if k == len(first):
                first.append(i)
            group[i] = k
        first = np.array(first, np.int64)
    return first, group


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all terms of consecutive texts."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = LETTER[buf]
    edge = np.zeros(n + 1, bool)
    edge[1:] = inside[1:] != inside[:-1]
    edge[0] = inside[0]
    # a text's end closes a term, and its begin opens another
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[inside[cut] & inside[cut - 1]]
    at = np.sort(np.concatenate((np.flatnonzero(edge), cut, cut)))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) by batch of documents; a group's row without a term says that it occurs."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in ("lang", "source", "term")), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch):
                names: dict[tuple[str, str], int] = {}
                group = np.array([names.setdefault(k, len(names)) for k in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)], np.int64)
                buf = np.zeros(len(data) + 32, np.uint8)
                buf[: len(data)] = LOWER[data]
                starts, ends, doc = terms(buf[: len(data)], offsets)
                first, term = group_slices(buf, starts, ends, slice_hashes(buf, starts, ends))
                in_doc, n = np.unique(doc * len(first) + term, return_counts=True)
                pair = group[in_doc // max(len(first), 1)] * len(first) + in_doc % max(len(first), 1)
                order = np.argsort(pair, kind="stable")
                pair, at = np.unique(pair[order], return_index=True)
                n, held = (np.add.reduceat(n[order], at), np.diff(np.append(at, len(order)))) if len(at) else (n, at)
                words = [buf[starts[i] : ends[i]].tobytes().decode() for i in first.tolist()]
                keys = list(names)
                of, what = np.divmod(pair, max(len(first), 1))
                langs, sources = (pa.array([k[j] for k in keys], pa.string()) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([langs, langs.take(pa.array(of))]), pa.concat_arrays([sources, sources.take(pa.array(of))]),
                    pa.concat_arrays([pa.nulls(len(keys), pa.string()), pa.array(words, pa.string()).take(pa.array(what))]),
                    pa.array(np.concatenate((np.zeros(len(keys), np.int64), n))), pa.array(np.concatenate((np.zeros(len(keys), np.int64), held))),
                ], schema.names)

    return rows.mapInArrow(run, schema)


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 count / total) for count <= total, by long division, exact below 9 * 10**15."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), np.asarray(count, np.int64)
    whole, rest = np.divmod(rest, total)
    out += whole
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def block_divergences(indptr: np.ndarray, indices: np.ndarray, p: np.ndarray, zero: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For every row of a CSR matrix of shares, the sums of f with every row over width columns; zero has each row's share where
    the matrix has no entry."""
    rows = len(zero)
    held = np.diff(indptr)
    row = np.repeat(np.arange(rows), held)

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        some = np.flatnonzero(held)
        if len(some):
            out[some] = np.add.reduceat(values, indptr[some])
        return out

    laid = np.empty(width, np.int64)
    for a in range(rows):
        own = p[indptr[a] : indptr[a + 1]]
        laid[:] = zero[a]
        laid[indices[indptr[a] : indptr[a + 1]]] = own
        at = laid[indices]
        sums = by_row(apart(at, p) - apart(at, zero[row]))
        values, times = np.unique(own, return_counts=True)
        for k in range(0, len(values), CHUNK):
            sums += (apart(values[k : k + CHUNK, None], zero) * times[k : k + CHUNK, None]).sum(axis=0)
        yield sums + (width - len(own)) * apart(np.broadcast_to(zero[a], rows), zero)


PAIR = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("part", T.StringType()), T.StructField("item", T.StringType()), T.StructField("value", T.LongType())])


def _block(key: tuple, counts: pa.Table, groups: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
    """A block's part of all pairs' sums, and each source's most typical terms in it."""
    lang, _ = (k.as_py() for k in key)
    groups = groups.sort_by("source")
    names, total = groups.column("source").combine_chunks(), groups.column("n").to_numpy()
    kept, lang_total = groups.column("kept")[0].as_py(), groups.column("lang_n")[0].as_py()
    zero = shares(np.full(len(total), 2), total + 2 * kept)
    coded = counts.column("term").combine_chunks().dictionary_encode()
    words, column = coded.dictionary, np.asarray(coded.indices)
    row = np.asarray(pc.index_in(counts.column("source").combine_chunks(), value_set=names)).astype(np.int64)
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], counts.column("n").to_numpy()[order]
    p = shares(n + 2, total[row] + 2 * kept)
    indptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(names)))))
    for a, sums in enumerate(block_divergences(indptr, column, p, zero, len(words))):
        others = np.flatnonzero(np.arange(len(names)) != a)
        if len(others):
            yield _rows(lang, names[a].as_py(), "pair", names.take(pa.array(others)), sums[others])
    q = shares(np.bincount(column, n, len(words)).astype(np.int64) + 2 if n.sum() < 1 << 53 else _exact_sums(column, n, len(words)) + 2, lang_total + 2 * kept)
    value, typical = apart(p, q[column]), p > q[column]
    for a in range(len(names)):
        own = np.flatnonzero(typical[indptr[a] : indptr[a + 1]]) + indptr[a]
        if not len(own):
            continue
        if len(own) > top:  # all that may be among the first, ties included
            own = own[value[own] >= np.partition(value[own], -top)[-top]]
        yield _rows(lang, names[a].as_py(), "term", words.take(pa.array(column[own])), value[own])


def _exact_sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


def _rows(lang: str, source: str, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    n = len(items)
    return pa.RecordBatch.from_arrays([*(pa.array([v] * n, pa.string()) for v in (lang, source, part)), items.cast(pa.string()), pa.array(values, pa.int64())], PAIR.names)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: every other source by how much it differs (`pair`), and the first `top`
    terms that a source has more often than its language (`term`)."""
    counts = materialize(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    occurring = counts.where("term IS NULL").select("lang", "source")
    whole = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    kept = materialize(counts.join(whole, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("cells"))
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(vocabulary, "lang", "left")
    groups = materialize(of.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "lang_n", "kept", "cells"))))
    discard(counts)
    langs = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.first("cells") / F.greatest(F.lit(BLOCK), F.count("*") * F.count("*")))).cast("int").alias("blocks"))
    per = groups.join(langs, "lang").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = kept.join(langs, "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from _block(key, left, right, top)

    made = dealt.groupBy("lang", "block").cogroup(per.groupBy("lang", "block")).applyInArrow(lambda key, left, right: _table(run(key, left, right)), PAIR)
    made = materialize(made)
    pairs = made.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    typical = made.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(typical)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    made = list(batches)
    fields = [(n, pa.int64() if n == "value" else pa.string()) for n in PAIR.names]
    return pa.Table.from_batches(made, pa.schema(fields)) if made else pa.table([pa.array([], k) for _, k in fields], names=PAIR.names)
