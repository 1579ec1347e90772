"""All tunable values, in one frozen record."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    """Weights, margins and smoothing of the corrector, and the named modes that settle open questions of its specification."""

    w_unigram: float = 1.0
    w_left: float = 1.2
    w_right: float = 1.0
    w_distance: float = 2.2
    w_nonword_distance: float = 4.0
    w_zipf: float = 0.08
    w_length: float = 0.5
    delta: float = 0.0
    delta_rw: float = 5.0
    k_unigram: float = 1.0
    k_bigram: float = 0.01
    backoff: float = 0.4
    bigram_mode: str = "addk"
    min_zipf: float = 3.0
    min_unigram: int = 5
    min_count: int = 3
    max_candidates: int = 80
    max_index_length: int = 30
    trace_candidates: int = 20
    rules_before_gates: bool = False

    def __post_init__(self):
        if self.bigram_mode not in ("addk", "backoff"):
            raise ValueError(f"bigram_mode is addk or backoff, not {self.bigram_mode}")

    # names used in the scoring formula of the specification
    lambda_1 = property(lambda self: self.w_unigram)
    lambda_2 = property(lambda self: self.w_left)
    lambda_3 = property(lambda self: self.w_right)
    alpha = property(lambda self: self.w_distance)

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(sorted(asdict(self).items())).encode()).hexdigest()[:12]
