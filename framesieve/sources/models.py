"""Adapters for what isn't in the image: decoders, encoders, scorers and answerers are injected.

Each takes a factory that makes the model once in a worker, so that no model is pickled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import prompt


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a text encoder: signed hashed words, unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for word in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        out[:, 0] += 1e-6
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return encode


def encode_text(df: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "vector", batch: int = 32) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for s in batches:
            parts = [encode(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            yield pd.Series([v.astype(np.float32) for p in parts for v in p], dtype=object)

    return df.withColumn(out, run(F.col(text)))


#: What a second encoder's model takes: ids of a text's begin, padding and end, how many ids, and the vectors' width (fixed values).
BEGIN, PAD, STOP, LIMIT, WIDTH = 0, 1, 2, 64, 1024


def padded(ids: list[list[int]], limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(texts, limit) ids with begin and end, longer texts cut so that both stay, and where they are padding."""
    out, padding = np.full((len(ids), limit), PAD, np.int64), np.ones((len(ids), limit), bool)
    for row, free, own in zip(out, padding, ids, strict=True):
        held = [BEGIN, *own[: limit - 2], STOP]
        row[: len(held)], free[: len(held)] = held, False
    return out, padding


def encode_ids(
    df: DataFrame, text: str, tokenizer: Callable[[], Callable[[str], list[int]]], model: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    out: str = "vector", limit: int = LIMIT, width: int = WIDTH, batch: int = 32,
) -> DataFrame:
    """df with the unit vectors of a model that takes token ids: tokenizer() gives ids(text) without begin and end, model()
    gives vectors(ids, padding), both made once in a task.  Vectors of another width, or of length zero, are errors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids, vectors = tokenizer(), model()
        for s in batches:
            texts, made = s.fillna("").tolist(), []
            for low in range(0, len(texts), batch):
                part = texts[low : low + batch]
                got = np.asarray(vectors(*padded([ids(t) for t in part], limit)), float)
                if got.shape != (len(part), width):
                    raise ValueError(f"expected {len(part)} vectors of width {width}, found {got.shape}")
                norms = np.linalg.norm(got, axis=1, keepdims=True)
                if not (norms > 0).all():
                    raise ValueError("zero-norm vector")
                made += list((got / norms).astype(np.float32))
            yield pd.Series(made, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def grounded_scorer(text_vector: list[float], image_scores: Callable[[np.ndarray, list], list[float]]) -> Callable[[], Callable[[list], list[float]]]:
    """A scorer factory around one text vector, normalised once."""
    vector = np.asarray(text_vector, np.float32).reshape(-1)
    if not np.linalg.norm(vector):
        raise ValueError("zero-norm vector")
    unit = vector / np.linalg.norm(vector)
    return lambda: lambda frames: image_scores(unit, frames)


def embedding_scorer(factory: Callable[[], Callable[[bytes], np.ndarray]], vector: str = "vector") -> Callable[[], Callable[[bytes, list[dict]], np.ndarray]]:
    """A scorer for operators.decoding: the cosines of a frame's embedding, made once, and the queries' vectors."""

    def made() -> Callable[[bytes, list[dict]], np.ndarray]:
        encode = factory()

        def score(content: bytes, asked: list[dict]) -> np.ndarray:
            rows = np.array([[*np.asarray(encode(content), float).reshape(-1)], *(a[vector] for a in asked)], float)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            if not (norms > 0).all():
                raise ValueError("zero-norm vector")
            rows = rows / norms
            return rows[1:] @ rows[0]

        return score

    return made


def probe_videos(paths: DataFrame, factory: Callable[[], Callable[[str], dict]]) -> DataFrame:
    """The video manifest of paths (video_id, video_path); failures are rows with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = factory()
        for pdf in batches:
            rows = []
            for v, path in zip(pdf["video_id"], pdf["video_path"], strict=True):
                try:
                    m = probe(path)
                    if m["fps"] <= 0:
                        raise ValueError("fps must be positive")
                    n = int(m["frame_count"])
                    rows.append((v, path, float(m["fps"]), n, n / m["fps"] if n > 0 else 0.0, int(m["width"]), int(m["height"]), None))
                except Exception as e:  # whatever an injected decoder raises belongs to its file
                    rows.append((v, path, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["video_id", "video_path", "fps", "frame_count", "duration_sec", "width", "height", "error"])

    return paths.select("video_id", "video_path").mapInPandas(run, "video_id string, video_path string, fps double, frame_count long, duration_sec double, width int, height int, error string")


def answer_questions(requests: DataFrame, factory: Callable[[], Callable[[str, list[bytes]], str]]) -> DataFrame:
    """requests (query_id, question, video_id, frame_ids, frames) with answer; at least one frame, counts equal."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = factory()
        for pdf in batches:
            for ids, frames in zip(pdf["frame_ids"], pdf["frames"], strict=True):
                if not len(frames) or len(ids) != len(frames):
                    raise ValueError("a request needs at least one frame, and one for each id")
            texts = [answer(prompt(q), list(f)).strip() for q, f in zip(pdf["question"], pdf["frames"], strict=True)]
            yield pdf[["query_id", "video_id"]].assign(answer=texts, confidence=None)

    kind = requests.schema["query_id"].dataType.simpleString()
    return requests.mapInPandas(run, f"query_id {kind}, video_id string, answer string, confidence double")
