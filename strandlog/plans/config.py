"""Matcher options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

LONGEST, FIRST, STANDARD = "leftmost_longest", "leftmost_first", "standard"


@dataclass(frozen=True)
class MatcherConfig:
    """cache_regex is accepted and has no effect; the batch size is a hint for Arrow batches and micro-batches."""

    match_kind: str = LONGEST
    min_fragment_length: int = 1
    cache_regex: bool = True
    optimal_batch_size: int = 10_000
    fragment_match_threshold: float = 0.3

    @classmethod
    def streaming(cls) -> MatcherConfig:
        return cls(optimal_batch_size=1_000)

    @classmethod
    def batch_processing(cls) -> MatcherConfig:
        return cls(optimal_batch_size=10_000)

    @classmethod
    def bulk_processing(cls) -> MatcherConfig:
        return cls(optimal_batch_size=50_000)

    def with_match_kind(self, kind: str) -> MatcherConfig:
        if kind not in (LONGEST, FIRST, STANDARD):
            raise ValueError(f"unknown match kind {kind!r}")
        return replace(self, match_kind=kind)

    def with_min_fragment_length(self, length: int) -> MatcherConfig:
        return replace(self, min_fragment_length=max(1, length))

    def with_regex_caching(self, enabled: bool) -> MatcherConfig:
        return replace(self, cache_regex=enabled)

    def with_batch_size(self, size: int) -> MatcherConfig:
        return replace(self, optimal_batch_size=size)

    def with_fragment_threshold(self, threshold: float) -> MatcherConfig:
        return replace(self, fragment_match_threshold=min(1.0, max(0.0, threshold)))

    def apply_to(self, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(self.optimal_batch_size))
