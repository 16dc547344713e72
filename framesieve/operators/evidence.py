"""Lexical evidence: candidates meet the words that they share with a text, never the texts of their video in pairs of rows.

A document is a text of a store at a video's frame; equal ones are one.  The index has a posting (video_id, token, modality,
frame_id, document) for every different word of a document, and of each video the stores that have a text about it.  It can be
written once, bucketed by video and word, so that a video of many texts lies in all buckets, and read by any number of plans
without dealing the postings anew.

Candidates are dealt into blocks, each of which is broadcast for one scan of the documents.  There, tasks count the words that
their documents share with the candidates of the same video and keep each candidate's best score only: what is shuffled grows
with the candidates and the tasks, not with the pairs of a candidate and a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens
from ..steps import written

#: Buckets of a written index.
BUCKETS = 64
#: Words of candidates that one scan of the documents holds, about, and matches of words that a task counts at once (of one
#: document at least): what is broadcast, and what a task holds, are bounded.  Further candidates come in further scans.
BLOCK, COUNTED = 500_000, 2_000_000


@dataclass(frozen=True)
class EvidenceIndex:
    """postings: (video_id, token, modality, frame_id, document); present: (video_id, modality); documents, where the texts
    are at hand: (video_id, modality, frame_id, words)."""

    postings: DataFrame
    present: DataFrame
    documents: DataFrame | None = None

    def modalities(self) -> DataFrame:
        return self.present.select("modality").distinct()


def build(evidence: DataFrame) -> EvidenceIndex:
    """The index of texts (modality, video_id, frame_id, text); a frame_id that isn't a number is an unknown frame."""
    frame = F.expr("try_cast(frame_id AS BIGINT)")
    # of one frame's texts a hash tells apart which is which: only those of one (modality, video_id, frame_id) must differ
    rows = evidence.select("modality", "video_id", frame.alias("frame_id"), F.xxhash64("text").alias("document"), tokens(F.col("text")).alias("words"))
    postings = rows.select("video_id", F.explode("words").alias("token"), "modality", "frame_id", "document").distinct()
    return EvidenceIndex(postings, rows.select("video_id", "modality").distinct(), rows.drop("document"))


def write(index: EvidenceIndex, name: str, buckets: int = BUCKETS) -> None:
    """Keeps the index as the tables <name>_postings and <name>_present, bucketed by what candidates are joined on."""
    for part, keys in (("postings", ("video_id", "token")), ("present", ("video_id",))):
        getattr(index, part).repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(f"{name}_{part}")


def read(spark: SparkSession, name: str) -> EvidenceIndex:
    return EvidenceIndex(spark.table(f"{name}_postings"), spark.table(f"{name}_present"))


def scores(candidates: DataFrame, evidence: DataFrame | EvidenceIndex, query: str = "query_text", target: str = "best_frame_id", tolerance: int = 30) -> DataFrame:
    """(query_id, video_id, modality, score): of each store with a text about a candidate's video the largest share of the
    query's words that one document has; a frame further than tolerance from the candidate's counts half, an unknown frame
    in full, and a store without a common word 0.
    """
    index = evidence if isinstance(evidence, EvidenceIndex) else build(evidence)
    asked = candidates.select("query_id", "video_id", F.col(target).cast("bigint").alias("target"), tokens(F.col(query)).alias("words"))
    speaking = asked.where("video_id IS NOT NULL AND size(words) > 0")
    blocks = -(-(speaking.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK) or 1
    documents = _documents(index, speaking, blocks)
    best = None
    for i in range(blocks):
        taken = speaking.where(F.pmod(F.xxhash64("query_id", "video_id"), F.lit(blocks)) == i) if blocks > 1 else speaking
        made = _met(documents, taken, tolerance)
        best = made if best is None else best.unionByName(made)
    stores = asked.select("query_id", "video_id").distinct().join(index.present, "video_id")
    return stores.join(best, ["query_id", "video_id", "modality"], "left").select("query_id", "video_id", "modality", F.coalesce("score", F.lit(0.0)).alias("score"))


def _documents(index: EvidenceIndex, asked: DataFrame, blocks: int) -> DataFrame:
    """(video_id, modality, frame_id, words) of documents about candidates' videos; written where several scans read them.  Of
    a written index only the postings of candidates' words are read and put together again."""
    if index.documents is None:
        wanted = asked.select("video_id", F.explode("words").alias("token")).distinct()
        met = index.postings.join(wanted, ["video_id", "token"], "left_semi")
        made = met.groupBy("document", "frame_id", "modality", "video_id").agg(F.collect_list("token").alias("words")).drop("document")
    else:
        videos = asked.select("video_id").distinct()
        made = index.documents.join(F.broadcast(videos) if blocks == 1 else videos, "video_id", "left_semi")  # a block's videos are broadcast
    made = made.select("video_id", "modality", "frame_id", "words")
    return written(made) if blocks > 1 else made


class _Block:
    """Candidates by video, and the places among their video's of those that have a word, by (video, word)."""

    def __init__(self, asked: pa.Table):
        self.videos = asked.column("video_id").combine_chunks().unique()
        video = np.asarray(pc.index_in(asked.column("video_id"), value_set=self.videos)).astype(np.int64)
        order = np.argsort(video, kind="stable")
        asked, video = asked.take(pa.array(order)), video[order]
        self.query_id, words, target = asked.column("query_id").combine_chunks(), asked.column("words").combine_chunks(), asked.column("target")
        self.known, self.target = np.asarray(target.is_valid()), np.asarray(target.fill_null(0)).astype(np.int64)
        self.n = np.asarray(pc.list_value_length(words)).astype(np.int64)
        self.first = np.searchsorted(video, np.arange(len(self.videos) + 1))
        self.words = words.flatten().unique()
        word = np.asarray(pc.index_in(words.flatten(), value_set=self.words)).astype(np.int64)
        key = np.repeat(video, self.n) * len(self.words) + word
        by_key = np.argsort(key, kind="stable")
        self.members = np.repeat(np.arange(len(video)) - self.first[video], self.n)[by_key]
        self.keys, starts = np.unique(key[by_key], return_index=True)
        self.starts = np.append(starts, len(key))
        self.pairs = np.add.reduceat(self.n, self.first[:-1]) if len(video) else self.n

    def lists(self, video: np.ndarray, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of documents (their videos, and numbers of words) that a candidate of the video has: the document, and
        the place of the word's list."""
        word = pc.index_in(words, value_set=self.words)
        at = np.nonzero(np.asarray(word.is_valid()))[0]
        document = np.repeat(np.arange(len(sizes)), sizes)[at]
        key = video[document] * len(self.words) + np.asarray(word.fill_null(0)).astype(np.int64)[at]
        place = np.searchsorted(self.keys, key)
        fits = self.keys[np.minimum(place, len(self.keys) - 1)] == key
        return document[fits], place[fits]

    def best(self, v: int, documents: np.ndarray, places: np.ndarray, frames: np.ndarray, placed: np.ndarray, tolerance: int) -> np.ndarray:
        """The best score of each candidate of a video over some of its documents, numbered from 0: the word lists that each
        meets, its frame, and whether that is known."""
        here = slice(self.first[v], self.first[v + 1])
        target, many = self.target[here], here.stop - here.start
        sizes = self.starts[places + 1] - self.starts[places]
        ends = np.cumsum(sizes)
        member = self.members[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[places] - (ends - sizes), sizes)]
        common = np.bincount(np.repeat(documents, sizes) * many + member, minlength=len(frames) * many).reshape(-1, many)
        share = common / self.n[here]
        frames = frames[:, None]
        apart = np.where(frames >= target, frames - target, target - frames).view(np.uint64) > tolerance  # unsigned, no difference overflows
        return np.where(apart & placed[:, None] & self.known[here], share * 0.5, share).max(axis=0)


def _met(documents: DataFrame, asked: DataFrame, tolerance: int) -> DataFrame:
    """(query_id, video_id, modality, score) of a block's candidates (query_id, video_id, target, words) that share a word with a
    document, each with its best score."""
    schema = T.StructType([asked.schema["query_id"], asked.schema["video_id"], documents.schema["modality"], T.StructField("score", T.DoubleType())])
    block = documents.sparkSession.sparkContext.broadcast(_Block(asked.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, best = block.value, {}
        for batch in batches:
            batch = batch.append_column("v", pc.index_in(batch.column("video_id"), value_set=b.videos))
            batch = batch.filter(batch.column("v").is_valid())
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([*batch.columns, pc.dictionary_encode(batch.column("modality"), null_encoding="encode").indices], [*batch.schema.names, "m"])
            batch = batch.sort_by([("m", "ascending"), ("v", "ascending")])
            video, store = (np.asarray(batch.column(c)).astype(np.int64) for c in ("v", "m"))
            frame, words = batch.column("frame_id"), batch.column("words")
            frames, placed = np.asarray(frame.fill_null(0)).astype(np.int64), np.asarray(frame.is_valid())
            document, place = b.lists(video, words.flatten(), np.asarray(pc.list_value_length(words).fill_null(0)))
            begins = np.nonzero(np.append(True, (np.diff(video) != 0) | (np.diff(store) != 0)))[0]
            for start, stop in zip(begins, np.append(begins[1:], len(video)), strict=True):
                v = int(video[start])
                step = max(1, COUNTED // int(b.pairs[v]))
                key = (batch.column("modality")[int(start)].as_py(), v)
                for low in range(start, stop, step):
                    high = min(low + step, stop)
                    met = slice(*np.searchsorted(document, (low, high)))
                    made = b.best(v, document[met] - low, place[met], frames[low:high], placed[low:high], tolerance)
                    best[key] = np.maximum(best[key], made) if key in best else made
        for (modality, v), score in best.items():
            at = np.nonzero(score)[0]
            columns = [b.query_id.take(pa.array(at + b.first[v])), pa.repeat(b.videos[v], len(at)), pa.repeat(pa.scalar(modality, pa.string()), len(at)), pa.array(score[at])]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(run, schema).groupBy("query_id", "video_id", "modality").agg(F.max("score").alias("score"))
