"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans removed.

A window is `length` consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) of one text.  A word goes if a window
that covers it has a word sequence that also starts elsewhere, in any text.

1. Every window has an anchor, its smallest run of GRAM words by hash (the first such); equal windows have
   equal anchors.  Neighbouring windows with one anchor are a segment.  Segments whose anchor occurs once in the
   corpus, nearly all of them in fresh text, have no equal window anywhere and need no reference.
2. The other segments are the reference.  Equal ones are counted once, with how often they occur, so that a group of
   copies weighs no more than one text.  A reference shard is the different segments of one anchor.
3. A shard becomes a suffix automaton whose states know how often their runs of words occur in the shard,
   weighted by the segments' counts.  The segments stream past it, and wherever the matching statistic reaches the
   length in a state that occurs at least twice, the words are marked.  Nothing else decides.
4. Marked spans go back to the segments' texts, which keep the other words.

The reference grows with the corpus (README has its size), so that it is dealt to tasks by anchor rather than broadcast.
An anchor with more than SHARD different segments is cut further: each run of windows with the same part, a hash
of the window, becomes a segment of its own, and a shard is then one part of an anchor; equal windows have equal parts.

Defined results: null and empty texts have no words and are kept as the empty text; texts shorter than
a window are kept whole; equal rows are repeats of each other and lose all their windows; other
columns are kept only on request; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, bound_batches, discard, fresh, gram_hashes, materialize, text_chunks

WINDOW, GRAM = 35, 10
#: Different segments of one anchor that one automaton holds.
SHARD = 1024


class SuffixAutomaton:
    """The online automaton of several word sequences; a state's length is that of its longest suffix class, and its
    ends, once counted, are how often that class's words occur."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]
        self.last = 0

    def add(self, words: list[bytes], times: int = 1) -> None:
        self.last = 0
        for word in words:
            self._extend(word)
            self.ends[self.last] += times

    def count(self) -> None:
        """Adds every state's ends to those of its suffixes; once, after the last add()."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] += self.ends[state]

    def _extend(self, word: bytes) -> None:
        p, known = self.last, self.next[self.last].get(word)
        if known is not None and self.length[known] == self.length[p] + 1:
            self.last = known
            return
        if known is not None:
            self.last = self._clone(p, known, word)
            return
        now = self._state({}, -1, self.length[p] + 1)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = now
            p = self.link[p]
        if p < 0:
            self.link[now] = 0
        else:
            q = self.next[p][word]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        self.last = now

    def _state(self, edges: dict[bytes, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, word: bytes) -> int:
        made = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = made
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        return made

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """For each word the length of the longest run that ends there and occurs in the automaton, and its state."""
        state = matched = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            yield matched, state

    def repeated(self, words: list[bytes], length: int) -> Iterator[tuple[int, int]]:
        """Maximal [start, end) of words covered by runs of length words that occur at least twice."""
        low = high = 0
        for k, (matched, state) in enumerate(self.statistics(words)):
            if matched < length:
                continue
            while self.length[self.link[state]] >= length:  # to the state that the run of exactly length words is in
                state = self.link[state]
            if self.ends[state] < 2:
                continue
            if k + 1 - length > high or not high:
                if high:
                    yield low, high
                low = k + 1 - length
            high = k + 1
        if high:
            yield low, high


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of width values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _segments(tokens: Tokens, words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every segment; a window is known by its first word."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(words, gram)
    anchors = _sliding_min(grams, length - gram + 1)
    inside = tokens.doc[:n] == tokens.doc[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (grams[: n - 1] == anchors[:-1]) | ~inside[:-1]
    new |= ~inside
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    keep = inside[starts]
    return anchors[starts[keep]], starts[keep], sizes[keep]


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                tokens = Tokens(buf, offsets, "words")
                anchor, start, _ = _segments(tokens, tokens.hashes(), length, gram)
                key = part.column("key").to_numpy()[tokens.doc[start]] if len(start) else np.zeros(0, np.int64)
                order = np.lexsort((anchor, key))
                key, anchor = key[order], anchor[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(key[at]), pa.array(np.diff(np.append(at, len(key))))], ["anchor", "key", "n"])

    return rows.mapInArrow(run, "anchor long, key long, n long")


def _candidates(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Segments of the texts' wanted anchors: where they start, and their words as text."""
    names = ["anchor", "key", "twin", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                tokens = Tokens(buf, offsets, "words")
                anchor, start, size = _segments(tokens, tokens.hashes(), length, gram)
                wanted = part.column("anchors")
                at = np.asarray(wanted.offsets)
                values = np.asarray(wanted.values).view(np.uint64)
                doc = tokens.doc[start]
                keep = np.zeros(len(start), bool)
                cut = np.searchsorted(doc, np.arange(len(offsets)))
                for d in range(len(offsets) - 1):
                    keep[cut[d] : cut[d + 1]] = np.isin(anchor[cut[d] : cut[d + 1]], values[at[d] : at[d + 1]])
                anchor, start, size, doc = anchor[keep], start[keep], size[keep], doc[keep]
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(tokens.starts[start], tokens.ends[start + size + length - 2], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(anchor.view(np.int64)), pa.array(part.column("key").to_numpy()[doc]), pa.array(part.column("twin").to_numpy()[doc]),
                    pa.array(start - tokens.first[doc]), pa.array([b" ".join(t.split()) for t in texts], pa.binary()),
                ], names)

    return rows.mapInArrow(run, "anchor long, key long, twin int, start long, words binary")


def _parts(crowded: DataFrame, length: int) -> DataFrame:
    """(anchor, shard, whole, at, words, n): the segments (anchor, digest, words, n, parts) cut into runs of windows of
    the same part; whole, at: digest of the segment and place in it."""
    names = ["anchor", "shard", "whole", "at", "words", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, offsets in text_chunks(batch, "words"):
                tokens = Tokens(buf, offsets, "words")
                windows = gram_hashes(tokens.hashes(), length)
                inside = np.flatnonzero(tokens.doc[: len(windows)] == tokens.doc[length - 1 :][: len(windows)])
                doc = tokens.doc[inside]
                part = (windows[inside] % rows.column("parts").to_numpy().astype(np.uint64)[doc]).astype(np.int64)
                new = np.ones(len(inside), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                size, start, doc = np.diff(np.append(first, len(inside))), inside[first], doc[first]
                raw = buf.tobytes()
                texts = [raw[a:b] for a, b in zip(tokens.starts[start], tokens.ends[start + size + length - 2], strict=True)]
                of = rows.take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([of.column("anchor"), pa.array(part[first]), of.column("digest"), pa.array(start - tokens.first[doc]), pa.array(texts, pa.binary()), of.column("n")], names)

    return crowded.mapInArrow(run, "anchor long, shard long, whole long, at long, words binary, n long")


def _judged(reference: DataFrame, length: int) -> DataFrame:
    """(anchor, shard, digest, low, high): the spans that the automaton of its shard finds in every segment of the
    reference (anchor, shard, digest, words, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: tuple[list, ...] = ([], [], [], [], [])

        def judge() -> None:
            automaton = SuffixAutomaton()
            split = [(digest, words.split(b" "), n) for digest, words, n in held]
            for _, words, n in split:
                automaton.add(words, n)
            automaton.count()
            for digest, words, _ in split:
                for low, high in automaton.repeated(words, length):
                    for column, value in zip(out, (*now, digest, low, high), strict=True):
                        column.append(value)

        def found() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor", "shard", "digest", "low", "high"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for anchor, shard, digest, words, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "shard", "digest", "words", "n")), strict=True):
                if (anchor, shard) != now:
                    judge()
                    now, held = (anchor, shard), []
                held.append((digest, words, n))
            yield found()
        judge()
        yield found()

    dealt = reference.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return dealt.select("anchor", "shard", "digest", "words", "n").mapInArrow(run, "anchor long, shard long, digest long, low long, high long")


def _marked(segments: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, low, high): spans of every different segment."""
    classes = materialize(segments.groupBy("anchor", "digest", "words").agg(F.count("*").alias("n")))
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("size"), F.sum("n").alias("all")).where("all > 1")
    sizes = materialize(sizes.select("anchor", F.when(F.col("size") > SHARD, F.ceil(F.col("size") * length / SHARD)).otherwise(0).alias("parts")))
    known = classes.join(sizes, "anchor")
    marked = _judged(known.where("parts = 0").withColumn("shard", F.lit(-1).cast("long")), length).drop("shard")
    if sizes.where("parts > 0").limit(1).count():
        pieces = materialize(_parts(known.where("parts > 0"), length).withColumn("digest", F.xxhash64("words")))
        again = pieces.groupBy("anchor", "shard", "digest", "words").agg(F.sum("n").alias("n"))
        spans = _judged(again, length)
        joined = pieces.select("anchor", "shard", "digest", "whole", "at").join(spans, ["anchor", "shard", "digest"])
        whole = joined.select("anchor", F.col("whole").alias("digest"), (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))
        marked = materialize(marked.unionByName(whole))
        discard(classes, sizes, pieces)
        return marked
    marked = materialize(marked)
    discard(classes, sizes)
    return marked


def dedup(docs: DataFrame, keep: list[str], length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The kept columns, n_words, n_removed, text (the kept words, joined by one space) and spans (the removed
    word ranges) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    made = ["n_words", "n_removed", "text", "spans"]
    body, key, twin, marks, id_, check = fresh([*keep, *made], "__text", "__key", "__twin", "__marks", "__id", "__check")
    # a row is known by two hashes of its kept columns and text; rows equal in these are treated alike
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias(body), F.xxhash64(*keep, "text").alias(key), F.hash(F.lit(1), *keep, "text").alias(twin))
    texts = rows.select(F.col(key).alias("key"), F.col(twin).alias("twin"), F.col(body).alias("text"))
    anchors = materialize(_anchors(texts, length, gram))
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    wanted = materialize(anchors.join(again, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors")))
    discard(anchors)
    segments = materialize(_candidates(texts.join(wanted, "key"), length, gram).withColumn("digest", F.xxhash64("words")))
    discard(wanted)
    marked = _marked(segments, length)
    placed = segments.select("anchor", "digest", "key", "twin", "start").join(marked, ["anchor", "digest"])
    placed = placed.select(F.col("key").alias(id_), F.col("twin").alias(check), F.struct((F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end")).alias("mark"))
    spans = materialize(placed.groupBy(id_, check).agg(F.array_sort(F.collect_set("mark")).alias(marks)))
    discard(segments, marked)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept, merged = [], [], [], []
            for text, spans in zip(batch.column(body).to_pylist(), batch.column(marks).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                runs: list[dict] = []
                for m in spans or ():
                    if runs and m["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], m["end"])
                    else:
                        runs.append(dict(m))
                at, left = 0, []
                for r in runs:
                    left += words[at : r["start"]]
                    at = r["end"]
                left += words[at:]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                merged.append(runs)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(merged, kind)], [*keep, *made])

    return rows.join(spans, (F.col(key) == F.col(id_)) & (F.col(twin) == F.col(check)), "left").select(*keep, body, marks).mapInArrow(cut, schema)
