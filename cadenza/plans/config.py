"""Settings of a transcription run and their checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowConfig:
    chunk_seconds: float = 30.0
    overlap_seconds: float = 2.0
    final_min_seconds: float = 0.0
    sample_rate: int = 16_000
    max_inflight: int = 1

    def __post_init__(self) -> None:
        checks = {
            "chunk_seconds must be positive": self.chunk_seconds > 0,
            "overlap_seconds must not be negative": self.overlap_seconds >= 0,
            "overlap_seconds must be less than chunk_seconds": self.overlap_seconds < self.chunk_seconds,
            "final_min_seconds must not be negative": self.final_min_seconds >= 0,
            "sample_rate must be positive": self.sample_rate > 0,
            "max_inflight must be positive": self.max_inflight > 0,
        }
        for message, ok in checks.items():
            if not ok:
                raise ValueError(message)

    @property
    def chunk_samples(self) -> int:
        return round(self.chunk_seconds * self.sample_rate)

    @property
    def stride_samples(self) -> int:
        return max(self.chunk_samples - round(self.overlap_seconds * self.sample_rate), 1)


#: Settings in the order in which they are checked, each with the condition that it must meet. Unset settings pass.
CHECKS = {
    "chunk_seconds": "chunk_seconds > 0",
    "overlap_seconds": "overlap_seconds >= 0 AND overlap_seconds < chunk_seconds",
    "final_min_seconds": "final_min_seconds >= 0",
    "utt_split_seconds": "utt_split_seconds >= 0",
    "num_streams": "num_streams > 0",
    "slot_size_kb": "slot_size_kb > 0",
    "slots_per_stream": "slots_per_stream > 0",
    "timeout_ms": "timeout_ms > 0",
    "max_inflight": "max_inflight > 0",
    "worker_id": "trim(worker_id) <> ''",
    "discovery_interval_ms": "discovery_interval_ms > 0",
    "heartbeat_interval_ms": "heartbeat_interval_ms > 0",
    "worker_ttl_ms": "worker_ttl_ms > 0",
    "sessions": "sessions > 0 OR role <> 'worker'",
    "max_new_tokens": "max_new_tokens > 0 OR role <> 'worker'",
    "ingress": "role NOT IN ('decoder', 'worker') OR trim(coalesce(ingress_urls, '')) <> '' OR trim(coalesce(discovery_dns, '')) <> ''",
}


def first_problem() -> Column:
    """The first setting of a row that fails its check, or null; columns are named like the settings."""
    return F.coalesce(*(F.when(~F.coalesce(F.expr(check), F.lit(True)), name) for name, check in CHECKS.items()))
