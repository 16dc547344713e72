"""Parameters of the retrieval plan, folded into plans as literals.  Weights and limits are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FusionWeights:
    clip: float = 0.70
    objects: float = 0.10
    metadata: float = 0.05
    evidence: float = 0.15


@dataclass(frozen=True)
class RankingWeights:
    retrieval: float = 0.65
    temporal: float = 0.20
    multimodal: float = 0.15


#: What the whole pipeline ranks with, rather than the reranker's own defaults.
PIPELINE_WEIGHTS = RankingWeights(retrieval=0.55, temporal=0.15, multimodal=0.30)


@dataclass(frozen=True)
class TemporalScoreConfig:
    top_fraction: float = 0.20
    continuity: float = 0.05
    max_gap: int = 1


@dataclass(frozen=True)
class RetrieveConfig:
    top_k_frames: int = 200
    top_k_videos: int = 100
    per_video_k: int = 5
    channel2_k: int = 3
    channel2_weight: float = 0.35
    rrf_k: int = 60
    radius: int = 24
    max_decode: int = 96
    fusion: FusionWeights = field(default_factory=FusionWeights)
    ranking: RankingWeights = PIPELINE_WEIGHTS
    #: Shares of a query's own vector and its translation's.
    translated: tuple[float, float] = (0.20, 0.80)
    temporal: TemporalScoreConfig = field(default_factory=TemporalScoreConfig)

    def __post_init__(self) -> None:
        if not 0 <= self.channel2_weight <= 1:
            raise ValueError("channel2_weight must be in [0, 1]")


def frame_budget(k: int) -> tuple[int, int]:
    """Frames and videos that a run of k answers keeps before reranking."""
    return max(10 * k, 1000), min(max(k, 1), 100)
