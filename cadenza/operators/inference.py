"""The seam for acoustic models: a function from samples to text and words, run once a window.

No model is part of the engine. A ``Backend`` is built once per Python worker and reused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Backend(Protocol):
    def transcribe(self, samples: np.ndarray) -> tuple[str, list[tuple[str, int, int]]]:
        """Text, and words with start and end in ms of the window."""


class LevelStub:
    """A deterministic stand-in: one word for each run of 16 samples, named by its level."""

    def transcribe(self, samples: np.ndarray) -> tuple[str, list[tuple[str, int, int]]]:
        words = [(f"l{int(round(float(np.abs(samples[k : k + 16]).mean()) * 10))}", k, k + 16) for k in range(0, len(samples) - 15, 16)]
        return " ".join(w for w, _, _ in words), words


class Pool:
    """At most ``size`` backends of a Python worker, lent one at a time.

    A backend comes back after its use. One whose use failed is given up, and its place is free for a new
    one, so an error neither blocks the pool nor leaves a broken backend in it.
    """

    def __init__(self, build: Callable[[], Backend], size: int = 1) -> None:
        self.build, self.size, self.free, self.lent = build, size, [], 0

    def available(self) -> int:
        return self.size - self.lent

    @contextmanager
    def lease(self) -> Iterator[Backend]:
        if self.lent >= self.size:
            raise RuntimeError("no backend is free")
        self.lent += 1
        try:
            backend = self.free.pop() if self.free else self.build()
            yield backend
            self.free.append(backend)
        finally:
            self.lent -= 1


@lru_cache(maxsize=4)
def _pool(build: Callable[[], Backend]) -> Pool:
    return Pool(build)


def transcribe(windows: DataFrame, build: Callable[[], Backend], samples: str = "window") -> DataFrame:
    """``windows`` with text and words; windows are independent, so any number run at once."""
    keep = [c for c in windows.columns if c != samples]
    kinds = dict(windows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            with _pool(build).lease() as backend:
                got = [backend.transcribe(np.asarray(x, np.float32)) for x in pdf[samples]]
            yield pdf[keep].assign(text=[t for t, _ in got], words=[[{"word": w, "start_ms": s, "end_ms": e} for w, s, e in ws] for _, ws in got])

    return windows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "words array<struct<word:string,start_ms:long,end_ms:long>>"]))
