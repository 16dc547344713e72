"""The second encoder's contract: 64 ids with begin and end, padding, width and unit length."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from framesieve import cli
from framesieve.sources import models

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def words():
    return lambda text: [10 + len(w) for w in text.split()]


def counting(width):
    """Vectors that say how many ids there are, what the last of them is, and how many are padding."""

    def made():
        def vectors(ids, padding):
            out = np.zeros((len(ids), width))
            out[:, 0], out[:, 1], out[:, 2] = ids.shape[1], ids[np.arange(len(ids)), (~padding).sum(1) - 1], padding.sum(1)
            return out

        return vectors

    return made


def test_padded():
    ids, padding = models.padded([[], [7, 8], list(range(100))], 6)
    assert ids.tolist() == [[0, 2, 1, 1, 1, 1], [0, 7, 8, 2, 1, 1], [0, 0, 1, 2, 3, 2]]
    assert padding.sum(axis=1).tolist() == [4, 2, 0]


def test_encode_ids(spark):
    texts = [None, "a", "ab cd", "x " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in models.encode_ids(df, "t", words, counting(1024), batch=2).collect():
        n = min(len((r.t or "").split()), 62) + 2
        wanted = np.array([64, 2, 64 - n], float)
        assert len(r.vector) == 1024 and np.allclose(r.vector[:3], wanted / np.linalg.norm(wanted), atol=1e-6)
    with pytest.raises(Exception, match="width 1024"):
        models.encode_ids(df, "t", words, counting(512)).collect()
    with pytest.raises(Exception, match="zero-norm"):
        models.encode_ids(df, "t", words, lambda: lambda ids, padding: np.zeros((len(ids), 1024))).collect()


def test_second_channel_by_its_own_encoder(spark, tmp_path):
    rows = [(0, "V1", 0, 0, 1.0, "a.jpg", [1.0, 0.0], [64.0, 2.0, 61.0]), (1, "V2", 0, 60, 2.0, "b.jpg", [1.0, 0.0], [0.0, 1.0, 0.0])]
    spark.createDataFrame(rows, "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, image_path string, embedding array<float>, embedding2 array<float>").write.parquet(str(tmp_path / "frames.parquet"))
    args = ["retrieve", "--manifest", str(tmp_path / "frames.parquet"), "--query", "car", "--second-channel", "--second-weight", "1.0", "--output", str(tmp_path / "r")]
    assert cli.main(args, spark, second_encoder=lambda df, text, out: models.encode_ids(df, text, words, counting(3), out, width=3)) == 0
    found = {r.video_id: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert found["V1"]["rank"] == 1 and round(found["V1"].channel2_best_score, 6) == 1
