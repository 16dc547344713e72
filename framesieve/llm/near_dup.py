"""MinHash near-duplicates: ProbMinHash of weighted word shingles, banding, exact verification, components.

A text's shingles are its runs of five words (`[^\\x20\\x09-\\x0D]+`, unchanged; a text of one to four words has
one shingle of them all); one that occurs c times in the text weighs 1 + ln c.  Every shingle starts a Poisson process
whose rate is its weight; its arrivals fall on registers at random, and a register keeps its earliest
arrival.  A shingle's process ends as soon as its next arrival comes after the latest register.  Two texts agree on a
register with the probability of their probability Jaccard similarity,

    J(x, y) = sum over shingles i of both of 1 / (sum over all j of max(x_j / x_i, y_j / y_i)),

which is the similarity that candidates are verified by; where no shingle is repeated it is the Jaccard similarity.

Texts with the same shingles, equally often, are one class from the start.  Class representatives that share a
band are candidates.  In each band they are first compared with one pivot, not with each other, so that
a band of n copies costs n comparisons; bands with the same contents count once.  Where a band's members then are in
several components, whatever the band's size, its members get new keys, their rarest shingles by prefix
filtering, which similar texts share and texts with a common passage don't; texts of different components that share
such a key, with enough weight after it, are compared.  That leaves out no similar pair of these members: with P and Q the
parts of both texts' weights that their common shingles have, J is at most P, at most Q, and at most
(P / (2 - P) + Q / (2 - Q)) / 2, and the common shingles are at or after the first of them in one order of all.
Candidates are verified by their exact similarity (of 64-bit hashes of shingles), 0.8 or more.

Defined results: null, empty and blank texts have no shingles and form one class; repeated rows are in one
class; a class's id is its smallest non-null doc_id; other columns are kept only on request; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import U, Tokens, bound_batches, discard, fresh, gram_hashes, materialize, mix, text_chunks
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
#: What rounding may take from a sum: similarities count as the threshold's within it.
SLACK = 1e-9


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each different shingle, by text and hash, and how often it occurs there."""
    tokens = Tokens(buf, offsets, "words")
    words, count = tokens.hashes(), np.diff(tokens.first)
    grams = gram_hashes(words, k)
    inside = tokens.doc[: len(grams)] == tokens.doc[k - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
    doc, hashes = tokens.doc[: len(grams)][inside], grams[inside]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([gram_hashes(words[tokens.first[d] : tokens.first[d + 1]], count[d])[0] for d in short], np.uint64)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new], np.diff(np.append(np.flatnonzero(new), len(doc)))


def weight(times: np.ndarray) -> np.ndarray:
    return 1 + np.log(times)


def sketch(n: int, doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures of n texts: the hash whose arrival is earliest in each register (0: no shingle)."""
    earliest, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    time, step, block = np.zeros(len(doc)), 0, 1
    while len(doc):
        latest = None
        for _ in range(block):  # blocks of arrivals, once few processes are left
            step += 1
            seed = mix(hashes + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((seed >> U(11)).astype(float) + 0.5) / (1 << 53)) / weights
            slot = doc * registers + ((mix(seed) >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            np.minimum.at(earliest, slot, time)
            won = earliest[slot] == time
            winner[slot[won]] = hashes[won]
        latest = earliest.reshape(n, registers).max(1)
        live = time < latest[doc]
        doc, hashes, weights, time = doc[live], hashes[live], weights[live], time[live]
        block = 1 if step < 3 else 8
    return winner.reshape(n, registers)


def similarity(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two sorted arrays of different hashes with weights x and y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if x.max() == x.min() and y.max() == y.min():
        return len(i) / (len(a) + len(b) - len(i))
    p, q = x[i], y[j]
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    ratio = q / p
    upto = np.searchsorted(ratio, ratio, "right")
    # x counts where y / x is at most that of i, and y where it is more; equal ratios make both the same
    low = x.sum() - p.sum() + np.cumsum(p)[upto - 1]
    high = y.sum() - np.cumsum(q)[upto - 1]
    return float((1 / (low / p + high / q)).sum())


def _content(hashes: np.ndarray, times: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes() + (b"" if (times == 1).all() else times.astype("<i8").tobytes()), digest_size=16).digest()


def _row() -> Column:
    """A key of the text itself; with the doc_id it tells rows apart that share an id, or have none."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, row (key of the text), content (digest of the shingles) and band keys of every row."""
    band = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                n = len(offsets) - 1
                doc, hashes, times = shingles(buf, offsets)
                cut = np.searchsorted(doc, np.arange(n + 1))
                content = [_content(hashes[a:b], times[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                keys = np.zeros((n, BANDS), np.uint64)
                for row in sketch(n, doc, hashes, weight(times)).reshape(n, BANDS, ROWS).transpose(2, 0, 1):
                    keys = mix(keys * U(31) + row + band)
                flat = pa.array(keys.view(np.int64).reshape(-1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(content, pa.binary()), bands], ["doc_id", "row", "content", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").mapInArrow(run, "doc_id long, row binary, content binary, bands array<long>")


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, hashes, times) of the wanted (doc_id, row, content); times is null where each shingle occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                doc, hashes, times = shingles(buf, offsets)
                cut = np.searchsorted(doc, np.arange(len(offsets)))
                rows = []
                for c, a, b in zip(part.column("content").to_pylist(), cut[:-1], cut[1:], strict=True):
                    if c == _content(hashes[a:b], times[a:b]):
                        rows.append((c, hashes[a:b].tobytes(), None if (times[a:b] == 1).all() else times[a:b].astype("<i4").tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["content", "hashes", "times"])

    ids = wanted.withColumnsRenamed({"doc_id": "__id", "row": "__row"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text")
    texts = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row")))
    return texts.select("content", "text").mapInArrow(run, "content binary, hashes binary, times binary").dropDuplicates(["content"])


def _unpacked(hashes: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(hashes, "<u8")
    return own, np.ones(len(own)) if times is None else weight(np.frombuffer(times, "<i4"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of contents whose exact similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, left, m, right, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                (ha, wa), (hb, wb) = _unpacked(left, m), _unpacked(right, n)
                if similarity(ha, hb, wa, wb) >= threshold - SLACK:
                    rows.append((a, b))
            columns = list(zip(*rows, strict=True)) if rows else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["a", "b"])

    bound_batches(sets.sparkSession)
    left = sets.select(F.col("content").alias("a"), F.col("hashes").alias("ha"), F.col("times").alias("ta"))
    right = sets.select(F.col("content").alias("b"), F.col("hashes").alias("hb"), F.col("times").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ta", "hb", "tb").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row of docs (doc_id, text)."""
    signed, named = _classes(docs, threshold)
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of = named.join(classes, "label").select("content", "class_id")
    return signed.select("doc_id", "content").join(of, "content").select("doc_id", "class_id")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, row, content), and (content, doc_id, row, label) of every content: its first row by
    doc_id, nulls last, and its class.  All other steps' files are gone when this returns."""
    bound_batches(docs.sparkSession)
    banded = materialize(_signed(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    contents = banded.groupBy("content").agg(first, F.first("bands").alias("bands"))
    contents = materialize(contents.select("content", "first.doc_id", "first.row", "bands"))
    signed = materialize(banded.drop("bands"))
    discard(banded)
    known = materialize(_bands(contents.select("content", F.explode("bands").alias("key"))))
    involved = materialize(known.select("content").distinct())
    sets = materialize(_shingled(docs, involved.join(contents.select("content", "doc_id", "row"), "content")))
    labels, crowd = _linked(known, involved.select("content", F.col("content").alias("label")), sets, threshold)
    discard(known)
    rare = _rare(sets.join(crowd, "content"), threshold)
    last = _compared_rare(rare, labels, sets, threshold)
    discard(rare, crowd, sets, labels)
    named = contents.select("content", "doc_id", "row").join(last, "content", "left").withColumn("label", F.coalesce("label", "content"))
    named = materialize(named)
    discard(contents, involved, last)
    return signed, named


def _bands(keyed: DataFrame) -> DataFrame:
    """(key, content, pivot) of the keys that several contents share; of keys with the same
    contents one stays."""
    one, two = F.bit_xor(F.xxhash64("content")), F.bit_xor(F.xxhash64("content", F.lit(1)))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("pivot"), one.alias("one"), two.alias("two")).where("n > 1")
    kept = shared.groupBy("n", "one", "two").agg(F.min("key").alias("key"), F.first("pivot").alias("pivot")).select("key", "pivot")
    return keyed.join(kept, "key").select("key", "content", "pivot")


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (content, label) after joining the components that edges (a, b), a written table, link."""
    left = labels.select(F.col("content").alias("a"), F.col("label").alias("la"))
    right = labels.select(F.col("content").alias("b"), F.col("label").alias("lb"))
    between = edges.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = components(between)
    merged = found.select(F.col("node").alias("label"), F.col("label").alias("now"))
    made = materialize(labels.join(merged, "label", "left").select("content", F.coalesce("now", "label").alias("label")))
    discard(edges, found)
    return made


def _linked(known: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Compares the contents of every key with its pivot.  Labels after that, and the contents of those keys that
    hold several components, some members of which were compared with no other but the pivot."""
    pairs = known.where(F.col("content") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("content").alias("b")).distinct()
    labels = _joined(labels, materialize(_verified(pairs, sets, threshold)))
    named = known.join(labels, "content").withColumn("open", F.col("content") != F.col("pivot"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"), F.count_if("open").alias("open"))
    mains = sizes.groupBy("key").agg(F.max(F.struct("size", "label", "open")).alias("main"), F.sum("open").alias("all"), F.count("*").alias("labels"))
    split = materialize(mains.where((F.col("labels") > 1) & (F.col("all") > F.col("main.open"))).select("key"))
    crowd = materialize(known.join(split, "key").select("content").distinct())
    discard(split)
    return labels, crowd


def _rare(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, content, after, left, total, extra, repeated, most) by prefix filtering: texts of similarity t share a shingle
    from which on, under one order of all shingles by how many texts have them, each of both still has a part t of its
    weight.  after and left: that part at a shingle, itself included, and of how many shingles; total: the text's weight;
    repeated, extra and most: how many of its shingles occur again, their weight, and the largest weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, raw, times in zip(*(batch.column(c).to_pylist() for c in ("content", "hashes", "times")), strict=True):
                own, each = _unpacked(raw, times)
                n, again = len(own), each[each > 1]
                numbers = (each.sum(), again.sum(), len(again), each.max(initial=0))
                columns = [pa.array([content] * n, pa.binary()), pa.array(own.view(np.int64)), pa.array(each), *(pa.array(np.full(n, v, float)) for v in numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["content", "key", "own", "total", "extra", "repeated", "most"])

    each = materialize(sets.select("content", "hashes", "times").mapInArrow(run, "content binary, key long, own double, total double, extra double, repeated double, most double"))
    common = materialize(each.groupBy("key").agg(F.count("*").alias("among")).where("among > 1"))
    # shingles of one text alone come first and need not be listed
    upto = W.partitionBy("content").orderBy(F.desc("among"), F.desc("key")).rowsBetween(W.unboundedPreceding, 0)
    ranked = each.join(common, "key").withColumn("after", F.sum("own").over(upto) / F.col("total")).withColumn("left", F.count("*").over(upto))
    rare = materialize(ranked.where(F.col("after") >= threshold - SLACK).select("key", *PLACED))
    discard(each, common)
    return rare


PLACED = ("content", "after", "left", "total", "extra", "repeated", "most")


def _compared_rare(rare: DataFrame, labels: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Labels after comparing texts of different components that share a rare shingle, where enough weight
    follows it in both; of the shared shingles that is true of the first, if the texts are similar."""
    named = rare.join(labels, "content")
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("size"))
    mains = materialize(sizes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    open_ = materialize(named.join(mains, "key"))
    names = (*PLACED, "label")
    one = open_.where("label <> main").select("key", *(F.col(c).alias(f"{c}_a") for c in (*names, "main")))
    two = open_.select("key", *(F.col(c).alias(f"{c}_b") for c in names))
    common = F.least("left_a", "left_b")

    def part(x: str) -> Column:
        """At most so much of a text's weight have the common shingles: what is after, and as many of its heaviest."""
        heaviest = F.when(common >= F.col(f"repeated_{x}"), F.col(f"extra_{x}") + common - F.col(f"repeated_{x}")).otherwise(F.least(F.col(f"extra_{x}"), common * F.col(f"most_{x}")))
        return F.least(F.col(f"after_{x}"), heaviest / F.col(f"total_{x}"))

    of_a, of_b = part("a"), part("b")
    enough = (F.least(of_a, of_b) >= threshold - SLACK) & (of_a / (2 - of_a) + of_b / (2 - of_b) >= 2 * threshold - SLACK)
    once = (F.col("label_b") == F.col("main_a")) | (F.col("content_a") < F.col("content_b"))
    more = one.join(two, "key").where((F.col("label_a") != F.col("label_b")) & once & enough)
    more = more.select(F.least("content_a", "content_b").alias("a"), F.greatest("content_a", "content_b").alias("b")).distinct()
    made = _joined(labels, materialize(_verified(more, sets, threshold)))
    discard(mains, open_)
    return made


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each class one row stays, with all columns, whatever their names: that of its
    smallest doc_id, a null one last, and among rows of that id the first by content and text (one of them, where
    rows repeat)."""
    signed, named = _classes(docs, threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content", "row")).alias("first")
    row, id_, of, n = fresh(docs.columns, "__row", "__id", "__of", "__n")
    kept = materialize(named.groupBy("label").agg(first).select(F.col("first.doc_id").alias(id_), F.col("first.row").alias(of)))
    discard(signed, named)
    keyed = docs.withColumn(row, _row())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col(row).eqNullSafe(F.col(of))
    rows = keyed.join(kept, same, "left_semi")
    repeated = keyed.groupBy(F.col("doc_id").cast("long").alias(id_), F.col(row).alias(of)).agg(F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    single = rows.join(repeated, same, "left_anti")
    return single.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", row])).select(*docs.columns)
