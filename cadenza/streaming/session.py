"""Live transcription sessions: keyed state over ordered frames, as a batch and as a stream.

Input rows are frames of a stream in order of ``seq``: kind "window" (the words of one window, with
times relative to it), "preview" (words of audio that is not yet a window), "keepalive" (nothing),
"finalize" (flush without closing) and "end". Output rows are events. ``Session`` holds the rules; ``run_batch`` folds it over
bounded input and ``processor.run_stream`` over a streaming query with typed keyed state, with the same
results. There is no event time: a word waits until its window's stride covers it, and order is by ``seq``.
What a session holds for long (pending words, texts said) is only added to until it is wanted as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.stitch import LONGEST_OVERLAP, SHORTEST_OVERLAP

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
EPSILON_MS = 25
RATE = 16_000
MIN_PENDING_S, MIN_NEW_S = 0.6, 0.4  # before an interim result
SPEECH_RMS = 0.01
ATTACHED = set(".,!?;:%)]}'")
FRAME = "stream_id string, seq long, kind string, start_sample long, n_samples long, is_final boolean, rms double, words array<struct<word:string,start_ms:long,end_ms:long>>, text string"
EVENT = "stream_id string, event long, type string, is_final boolean, from_finalize boolean, transcript string, start_ms long, end_ms long, n_words long, speech_final boolean"


def attach(words: Iterable[str]) -> str:
    out = ""
    for w in words:
        out += w if not out or w in ATTACHED or w[:1] in ("'", "’") else " " + w
    return out


def _bare(word: str) -> str:
    """A word as fragments compare it: trimmed to letters and digits, ASCII letters in lower case."""
    kept = [k for k, c in enumerate(word) if c.isalnum()]
    return word[kept[0] : kept[-1] + 1].translate(_LOWER) if kept else ""


def merged(fragments: Iterable[str]) -> str:
    """Fragments joined by the longest overlap in words, as ``stitch.merge_fragments`` joins a table's."""
    said: list[str] = []
    for ws in (f.split() for f in fragments):
        a, b = [_bare(w) for w in said[-LONGEST_OVERLAP:]], [_bare(w) for w in ws[:LONGEST_OVERLAP]]
        sizes = range(min(len(a), len(b)), SHORTEST_OVERLAP - 1, -1)
        said += ws[next((k for k in sizes if a[-k:] == b[:k]), 0) :]
    return " ".join(said)


class Kept:
    """Items that a session adds one by one and then wants as a whole; here in memory."""

    def __init__(self) -> None:
        self.items: list[Any] = []

    def add(self, item: Any) -> None:
        self.items.append(item)

    def all(self) -> list[Any]:
        return list(self.items)

    def take(self) -> list[Any]:
        """All items, which are then no longer held."""
        got, self.items = self.items, []
        return got


@dataclass
class Session:
    """State and rules of one stream. Words are [word, start, end, stitch start, stitch end], in ms of the stream.

    ``last`` is the last of the ``pending`` words and ``fragment`` the last of the ``fragments``, None where there is none.
    """

    stride_ms: int = 5200
    gap_ms: int = 800
    interim: bool = False
    words: bool = False
    event: int = 0
    samples: int = 0
    spoken: bool = False
    stitch_end: int | None = None
    end: int | None = None
    last_interim: int = 0
    last: list[Any] | None = None
    fragment: str | None = None
    pending: Kept = field(default_factory=Kept)
    said: Kept = field(default_factory=Kept)
    fragments: Kept = field(default_factory=Kept)

    @property
    def completed(self) -> str:
        """All final texts so far."""
        return attach(self.said.all())

    def _emit(self, kind: str, words: list[list[Any]], final: bool = False, from_finalize: bool = False, text: str | None = None, speech_final: bool = False) -> dict:
        self.event += 1
        return {"event": self.event, "type": kind, "is_final": final, "from_finalize": from_finalize, "transcript": attach(w[0] for w in words) if text is None else text, "start_ms": words[0][1] if words and text is None else 0, "end_ms": words[-1][2] if words and text is None else self.samples * 1000 // RATE, "n_words": len(words), "speech_final": speech_final}

    @staticmethod
    def _clamped(w: list[Any], end: int | None) -> list[Any]:
        if end is None:
            return w
        start = max(w[1], end)
        return [w[0], start, max(w[2], start + 1), w[3], w[4]]

    def _commit(self, base_ms: int, words: list[dict], final: bool) -> list[list[Any]]:
        out = []
        for w in words:
            if not w["word"].strip() or (not final and w["end_ms"] > self.stride_ms):
                continue
            s, e = base_ms + w["start_ms"], base_ms + w["end_ms"]
            if self.stitch_end is not None and e <= self.stitch_end + EPSILON_MS:
                continue
            got = self._clamped([w["word"], s, e, s, e], self.end)
            self.stitch_end, self.end = e, got[2]
            out.append(got)
        return out

    def _remember(self, text: str) -> None:
        """What is final goes before interim results; where none are wanted it is not kept."""
        if self.interim and text:
            self.said.add(text)

    def _complete(self, words: list[list[Any]], from_finalize: bool, speech_final: bool = True) -> Iterator[dict]:
        """A final result and, where words are wanted, the end of its utterance."""
        out = self._emit("Results", words, True, from_finalize, speech_final=speech_final)
        self._remember(out["transcript"])
        yield out
        if self.words:
            yield self._emit("UtteranceEnd", words[-1:], text="") | {"start_ms": words[-1][2], "end_ms": words[-1][2], "n_words": 0}

    def _segments(self, fresh: list[list[Any]], from_finalize: bool) -> Iterator[dict]:
        """Every segment whose end ``fresh`` words make known: never the last pending word's."""
        for w in fresh:
            if self.last is not None and (max(0, w[3] - self.last[4]) >= self.gap_ms or self.last[0][-1:] in (".", "!", "?")):
                yield from self._complete(self.pending.take(), from_finalize)
            self.pending.add(w)
            self.last = w

    def _flush(self, close: bool) -> Iterator[dict]:
        """What is pending; where that is nothing, the text of windows without words."""
        if self.last is not None:
            self.last = None
            yield from self._complete(self.pending.take(), False, close)
        elif self.fragment is not None:
            self.fragment = None
            text = merged(self.fragments.take())
            self._remember(text)
            yield self._emit("Results", [], True, False, text, close)

    def feed(self, f: dict) -> Iterator[dict]:
        """Events that a frame gives rise to."""
        kind = f["kind"]
        if kind == "window":
            if not self.spoken and (f.get("rms") or 0) >= SPEECH_RMS:
                self.spoken = True
                yield self._emit("SpeechStarted", [])
            self.samples = max(self.samples, f["start_sample"] + f["n_samples"])
            fresh = self._commit(f["start_sample"] * 1000 // RATE, f["words"], bool(f["is_final"]))
            text = (f.get("text") or "").strip()
            if not f["words"] and text and self.fragment != text:
                self.fragments.add(text)
                self.fragment = text
            yield from self._segments(fresh, not f["is_final"])
        elif kind == "preview":
            total = f["start_sample"] + f["n_samples"]
            self.samples = max(self.samples, total)
            if not self.interim or f["n_samples"] < MIN_PENDING_S * RATE or total - self.last_interim < MIN_NEW_S * RATE:
                return
            words, cutoff, end = self.pending.all(), *((self.last[4], self.last[2]) if self.last else (None, None))
            for w in f["words"]:
                s, e = f["start_sample"] * 1000 // RATE + w["start_ms"], f["start_sample"] * 1000 // RATE + w["end_ms"]
                if w["word"].strip() and (cutoff is None or e > cutoff + EPSILON_MS):
                    words.append(self._clamped([w["word"], s, e, s, e], end))
                    end = words[-1][2]
            text = attach(filter(None, [self.completed, attach(w[0] for w in words) or (f.get("text") or "").strip()]))
            if text:
                self.last_interim = total
                yield self._emit("Results", words, text=text)
        elif kind == "finalize":
            yield from self._flush(False)
        elif kind == "end":
            yield from self._flush(True)
            yield self._emit("Results", [], True, True, speech_final=True)
        elif kind != "keepalive":
            raise ValueError(f"unknown frame {kind!r}")


def in_order(pdf: pd.DataFrame) -> Iterator[dict]:
    for row in pdf.sort_values("seq").to_dict("records"):
        yield row | {"words": [dict(w) for w in (row["words"] if row["words"] is not None else [])]}


def payload() -> Column:
    """An event as the JSON that a client gets."""
    seconds = lambda c: F.col(c) / 1000.0
    results = F.struct(F.col("type"), F.array(F.lit(0)).alias("channel_index"), seconds("end_ms").alias("duration"), seconds("start_ms").alias("start"), "is_final", "speech_final", "from_finalize", F.struct(F.array(F.struct("transcript", F.lit(0.0).alias("confidence"))).alias("alternatives")).alias("channel"))
    ended = F.struct(F.col("type"), F.array(F.lit(0)).alias("channel"), seconds("end_ms").alias("last_word_end"))
    started = F.struct(F.col("type"), F.array(F.lit(0)).alias("channel"), seconds("end_ms").alias("timestamp"))
    return F.when(F.col("type") == "Results", F.to_json(results)).when(F.col("type") == "UtteranceEnd", F.to_json(ended)).otherwise(F.to_json(started))


def run_batch(frames: DataFrame, **options: Any) -> DataFrame:
    """Events of bounded input."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session(**options)
        got = [e | {"stream_id": pdf["stream_id"].iloc[0]} for f in in_order(pdf) for e in session.feed(f)]
        return pd.DataFrame(got, columns=[c.split()[0] for c in EVENT.split(", ")])

    return frames.groupBy("stream_id").applyInPandas(run, EVENT)
