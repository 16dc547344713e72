"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters, each of which fires or not on a whole text, which gives a bit mask:

* lexicons: four groups of seed words, and words, and word beginnings of 4, 5 and 6 bytes, that the toxic ones of the
  labelled rows hold far more often than the others, in whatever language; each kind is a voter of its own;
* patterns: a seed word in disguise (digits or signs for letters, letters repeated), a second person with its verb
  (five languages), shouting, runs of exclamation marks, a listed word or beginning said twice.

The label model P(y) * prod P(vote | its parent's vote, y) is fitted by expectation maximisation on the counts of the
masks over all documents; its accuracies are P(vote | y), and its correlations are the edges of the
tree of largest conditional mutual information between votes.  At most 2 ** VOTERS masks exist, so
the counts are bounded whatever the corpus.  Posteriors are the soft targets of a hashed linear model,
which alone gives the scores.  Bounds: at most Ftrl.max_rows labelled rows induce the lexicons, which have at most
2 ** BITS entries, and at most Ftrl.max_rows documents, chosen by a hash, fit the linear model; these need no label.

Defined results: null, empty and blank texts have no features and score the bias; equal texts score
alike; no documents give no rows; other columns are not read.  Without labelled rows only the seed
lexicon and the patterns vote.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, Tokens, bound_batches, bounded_sample, bounded_texts, fresh, gram_hashes, mix, span_hashes, text_chunks
from .linear import Ftrl, compact, fit, score

BITS = 20
#: Chosen on a fold of the rows that are learned from.
PARAMS = Ftrl(alpha=0.3, l1=3.0, l2=0.0, epochs=10)
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
#: Seed lexicon by group (fixed values).
SEEDS = (
    ("idiot", "moron", "imbecile", "fool", "clown"),
    ("stupid", "dumb", "pathetic", "worthless", "useless"),
    ("scum", "trash", "garbage", "vermin", "filth"),
    ("loser", "disgusting", "ugly", "hate", "kill"),
)
#: What the digits and signs of a disguised word stand for (fixed values).
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: A second person and its verb (fixed values).
ADDRESS = ("you are", "ur a", "du bist", "ihr seid", "tu es", "vous êtes", "tú eres", "eres un", "eres una")
#: Voters after the seed groups: an induced word, and a beginning of each length; then the patterns.
INDUCED = len(SEEDS)
DISGUISED = INDUCED + 1 + len(PREFIXES)
ADDRESSED, SHOUTED, MARKED, REPEATED = range(DISGUISED + 1, DISGUISED + 5)
VOTERS = REPEATED + 1
#: Words in capitals that make a text shouted, if they are most of its words; runs of marks that count.
LOUD, RUNS = 8, 3


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and word beginnings of 4, 5 and 6 bytes, A-Z lower-cased."""
    docs, hashes = zip(*_kinds(Tokens(lowered(buf), offsets, "alnum")), strict=True)
    doc = np.concatenate(docs)
    return doc, np.concatenate(hashes), np.ones(len(doc))


def lowered(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 0x41) & (buf <= 0x5A), buf + 0x20, buf).astype(np.uint8)


def _kinds(tokens: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and index of every word, and then of every word beginning, by length."""
    yield tokens.doc, (tokens.hashes() >> U(64 - BITS)).astype(np.int64)
    for k in PREFIXES:
        long = tokens.ends - tokens.starts > k
        at = mix(span_hashes(tokens.buf, tokens.starts[long], tokens.starts[long] + k) + U(k))
        yield tokens.doc[long], (at >> U(64 - BITS)).astype(np.int64)


def _fires(mask: np.ndarray, voter: int, docs: np.ndarray) -> None:
    mask[docs] |= 1 << voter


def patterns(buf: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> None:
    """Sets the bits of the pattern voters that need no lexicon but the seeds."""
    n = len(offsets) - 1
    tokens = Tokens(lowered(buf), offsets, "alnum")
    pairs = gram_hashes(tokens.hashes(), 2)
    inside = np.isin(pairs, _ADDRESS) & (tokens.doc[1:] == tokens.doc[:-1]) if len(pairs) else np.zeros(0, bool)
    _fires(mask, ADDRESSED, tokens.doc[:-1][inside] if len(pairs) else [])
    raw = Tokens(buf, offsets, "alnum")
    long = raw.ends - raw.starts >= 3
    capital = np.concatenate(([0], np.cumsum((buf >= 0x41) & (buf <= 0x5A))))
    loud = long & (capital[raw.ends] - capital[raw.starts] == raw.ends - raw.starts)
    of = lambda which: np.bincount(raw.doc[which], minlength=n)
    _fires(mask, SHOUTED, np.flatnonzero((of(loud) >= LOUD) & (2 * of(loud) > of(long))))
    run = (buf[1:] == 0x21) & (buf[:-1] == 0x21) if len(buf) else np.zeros(0, bool)
    first = np.flatnonzero(run & ~np.concatenate(([False], run[:-1])))
    where = np.searchsorted(offsets, first, side="right") - 1
    _fires(mask, MARKED, np.flatnonzero(np.bincount(where, minlength=n) >= RUNS))
    _fires(mask, DISGUISED, _disguised(buf, offsets))


def _disguised(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with a word that is a seed only when letters replace its digits and signs, or repeats go."""
    tokens = Tokens(buf, offsets, "words")
    shape = np.concatenate(([0], np.cumsum(_ODD[buf] | np.concatenate((buf[1:] == buf[:-1], [False])) if len(buf) else [])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[buf])))
    size = tokens.ends - tokens.starts
    maybe = np.flatnonzero((size >= 4) & (size <= 32) & (shape[tokens.ends] > shape[tokens.starts]) & (3 * (letters[tokens.ends] - letters[tokens.starts]) >= size))
    text = buf.tobytes()
    return np.array([tokens.doc[t] for t in maybe if undisguised(text[tokens.starts[t] : tokens.ends[t]].decode("latin-1"))], np.int64)


@lru_cache(maxsize=1 << 16)
def undisguised(word: str) -> bool:
    """Whether a word, of Latin-1 characters, is a seed in disguise, not as it stands."""
    low = word.lower().strip(".,;:?!\"'()*#%&")
    plain = "".join(LEET.get(c, c) for c in word.lower().rstrip(".,;:?!")).strip(".,;:?\"'()*#%&")
    once = "".join(c for c, _ in itertools.groupby(plain))
    return low not in _SEEDS and (plain in _SEEDS or once in _ONCE)


def _word_hashes(text: str) -> np.ndarray:
    data = text.encode()
    return Tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), "alnum").hashes()


_SEEDS = {w for group in SEEDS for w in group}
_ONCE = {"".join(c for c, _ in itertools.groupby(w)) for w in _SEEDS}
_ADDRESS = np.array([gram_hashes(_word_hashes(pair), 2)[0] for pair in ADDRESS], np.uint64)
_ODD, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_ODD[[ord(c) for c in LEET]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def induce(rows: DataFrame, min_support: int = 5, min_odds: float = 4.2) -> np.ndarray:
    """Features, of at most 2 ** BITS, that the toxic ones of the (bounded) labelled rows hold far more often than the
    others."""
    bound_batches(rows.sparkSession)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in text_chunks(batch):
                doc, index, _ = compact(*features(buf, offsets), True)
                toxic = np.asarray(part.column("target").to_numpy(zero_copy_only=False), float)[doc]
                found, where = np.unique(index, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(where, toxic)), pa.array(np.bincount(where, 1 - toxic))], ["index", "toxic", "clean"])

    sums = rows.agg(F.sum("target"), F.sum(1 - F.col("target"))).first()
    n_toxic, n_clean = (float(x or 0) for x in sums)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    kept = (
        rows.mapInArrow(entries, "index long, toxic double, clean double").groupBy("index").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= min_support) & (odds >= min_odds)).select("index").collect()
    )
    return np.array([r[0] for r in kept], np.int64)


def votes(docs: DataFrame, induced: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns and the mask of voters that fire on each whole text."""
    spark = docs.sparkSession
    bound_batches(spark)
    (body,) = fresh([*keep, "mask"], "__text")
    owner = np.full(1 << BITS, -1, np.int8)
    owner[induced] = INDUCED
    for k, group in enumerate(SEEDS):
        owner[(_word_hashes(" ".join(group)) >> U(64 - BITS)).astype(np.int64)] = k
    table = spark.sparkContext.broadcast(owner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            for part, buf, offsets in text_chunks(batch, body):
                mask = np.zeros(len(offsets) - 1, np.int64)
                patterns(buf, offsets, mask)
                for kind, (doc, index) in enumerate(_kinds(Tokens(lowered(buf), offsets, "alnum"))):
                    hit = (own[index] >= 0) & ((kind == 0) | (own[index] == INDUCED))
                    doc, index = doc[hit], index[hit]
                    voter = own[index].astype(np.int64)
                    np.bitwise_or.at(mask, doc, 1 << np.where(voter == INDUCED, INDUCED + kind, voter))
                    said, times = np.unique(doc << BITS | index, return_counts=True)
                    _fires(mask, REPEATED, said[times > 1] >> BITS)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(mask)], [*keep, "mask"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("mask", T.LongType())])
    return docs.select(*keep, F.col("text").alias(body)).mapInArrow(run, schema)


class LabelModel:
    """Tree-augmented generative model of the votes with a hidden class, fitted by EM on mask counts."""

    def __init__(self, masks: np.ndarray, known: np.ndarray, counts: np.ndarray, voters: int = VOTERS, rounds: int = 40):
        """known: 0 or 1 where the row's class was observed, -1 elsewhere."""
        self.voters = voters
        v = (masks[:, None] >> np.arange(voters)) & 1
        fixed = known >= 0
        p = np.where(fixed, known, np.where(v.sum(1) >= 2, 0.9, np.where(v.sum(1) == 1, 0.4, 0.02)))
        self.parent = np.full(voters, -1)
        for r in range(rounds):
            if r == rounds // 4:
                self.parent = self._tree(v, counts, p)
            self._maximise(v, counts, p)
            p = np.where(fixed, known, self.posterior(masks))
        self.prior_, self.accuracy_ = self.prior, np.stack([self._rate(v, counts * (1 - p)), self._rate(v, counts * p)])

    @staticmethod
    def _rate(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return (weight @ v + 0.5) / (weight.sum() + 1)

    def _tree(self, v: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Parents in the tree of largest conditional mutual information; self.correlation_ holds the latter."""
        k = self.voters
        info = np.zeros((k, k))
        total = counts.sum() + 1e-9
        for y in (1 - p, p):
            w = counts * y
            mass = w.sum() + 1
            for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):
                va, vb = (v == a).astype(float), (v == b).astype(float)
                joint = (va.T @ (w[:, None] * vb) + 0.25) / mass
                one, two = (w @ va + 0.5) / mass, (w @ vb + 0.5) / mass
                info += mass / total * joint * np.log(joint / (one[:, None] * two[None, :]))
        np.fill_diagonal(info, -1)
        self.correlation_ = info
        parent, inside, rest = np.full(k, -1), [0], set(range(1, k))
        while rest:
            gain, a, b = max((info[a, b], -a, -b) for a in inside for b in rest)
            parent[-b] = -a if gain > 1e-6 else -1
            inside.append(-b)
            rest.discard(-b)
        return parent

    def _maximise(self, v: np.ndarray, counts: np.ndarray, p: np.ndarray) -> None:
        self.prior = float((counts @ p + 0.5) / (counts.sum() + 1))
        self.table = np.zeros((2, self.voters, 2))  # class, voter, parent's vote -> P(fires)
        for y, w in enumerate((counts * (1 - p), counts * p)):
            for j in range(self.voters):
                up = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), int)
                for u in (0, 1):
                    at = w * (up == u)
                    self.table[y, j, u] = (at @ v[:, j] + 0.5) / (at.sum() + 1)

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        v = (masks[:, None] >> np.arange(self.voters)) & 1
        up = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        log = [np.log([1 - self.prior, self.prior][y]) + np.log(np.where(v == 1, self.table[y][np.arange(self.voters), up], 1 - self.table[y][np.arange(self.voters), up])).sum(1) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, params: Ftrl = PARAMS) -> tuple[np.ndarray, LabelModel]:
    """Classifier weights and the label model.

    Lexicons are induced from at most params.max_rows labelled rows (chosen by hash); mask counts cover
    all documents that learn_from admits; the classifier fits on at most params.max_rows of these with
    posterior targets, labelled or not.
    """
    admit = F.lit(True) if learn_from is None else learn_from
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & admit).select("doc_id", F.col("toxic").cast("double").alias("target"))
    known = F.broadcast(bounded_sample(known, ["doc_id"], params.max_rows, known.count()))
    texts = docs.select("doc_id", "text").where(admit)
    induced = induce(texts.join(known, "doc_id"))
    groups = votes(texts, induced, ["doc_id"]).join(known, "doc_id", "left").groupBy("mask", F.coalesce(F.col("target").cast("int"), F.lit(-1)).alias("known")).count().collect()
    masks, seen, counts = (np.array([r[i] for r in groups], np.int64) for i in range(3))
    model = LabelModel(masks, seen, counts.astype(float))
    every = np.unique(masks)
    posterior = dict(zip(every.tolist(), model.posterior(every).tolist(), strict=True))
    voted = votes(bounded_texts(texts, params.max_rows, int(counts.sum())), induced, ["text"])
    spark = docs.sparkSession
    targets = spark.createDataFrame(list(posterior.items()) or [(0, 0.0)], "mask long, target double")
    return fit(voted.join(F.broadcast(targets), "mask").select("text", "target"), features, BITS, params, presence=True), model


def classify(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """The kept columns, score (probability of toxicity) and predicted (score >= 0.3)."""
    return score(docs, features, weights, keep, presence=True).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
