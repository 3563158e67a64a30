"""Live sessions as a streaming query with typed keyed state.

A stream's state is a value (its clock: counters, cursors, the last pending word) and three lists
(pending words, final texts, fragments). A batch reads the clock, adds to the lists and writes the
clock back; a list is read only where an event needs all of it, and goes when it is flushed. So what a
batch costs does not depend on what a stream holds. A timer closes streams that fall silent, and a map
with time to live remembers for a while which ones ended, so that late frames do not open them again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cadenza.streaming.session import EVENT, Session, in_order

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOCK = "event long, samples long, spoken boolean, stitch_end long, end long, last_interim long, seq long, fragment string, word string, word_start long, word_end long, word_stitch_start long, word_stitch_end long"
WORD = "word string, start long, end long, stitch_start long, stitch_end long"
_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class StateList:
    """Items in list state: those of this batch wait in memory until ``store``, earlier ones are read only when wanted."""

    def __init__(self, state: Any, single: bool = False) -> None:
        self.state, self.single = state, single
        self.fresh: list[Any] = []

    def add(self, item: Any) -> None:
        self.fresh.append(item)

    def all(self) -> list[Any]:
        held = [row[0] if self.single else list(row) for row in self.state.get()] if self.state.exists() else []
        return held + self.fresh

    def take(self) -> list[Any]:
        got, self.fresh = self.all(), []
        if self.state.exists():
            self.state.clear()
        return got

    def store(self) -> None:
        if self.fresh:
            self.state.appendList([(x,) if self.single else tuple(x) for x in self.fresh])


class SessionProcessor(StatefulProcessor):
    """``Session`` over frames of a stream; ``idle_ms`` closes silent streams, ``closed_ms`` is how long ended ones are remembered."""

    def __init__(self, options: dict[str, Any], idle_ms: int | None, closed_ms: int | None) -> None:
        self.options, self.idle_ms, self.closed_ms = options, idle_ms, closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.pending = handle.getListState("pending", WORD)
        self.said = handle.getListState("said", "text string")
        self.fragments = handle.getListState("fragments", "text string")
        self.closed = handle.getMapState("closed", "reason string", "seq long", self.closed_ms) if self.closed_ms else None

    def _session(self) -> tuple[Session, int]:
        session = Session(**self.options, pending=StateList(self.pending), said=StateList(self.said, True), fragments=StateList(self.fragments, True))
        seq = -1
        if self.clock.exists():
            session.event, session.samples, session.spoken, session.stitch_end, session.end, session.last_interim, seq, session.fragment, *last = self.clock.get()
            session.last = last if last[0] is not None else None
        return session, seq

    def _store(self, s: Session, seq: int) -> None:
        for kept in (s.pending, s.said, s.fragments):
            kept.store()
        self.clock.update((s.event, s.samples, s.spoken, s.stitch_end, s.end, s.last_interim, seq, s.fragment, *(s.last or [None] * 5)))

    def _forget(self, reason: str, seq: int) -> None:
        for state in (self.clock, self.pending, self.said, self.fragments):
            if state.exists():
                state.clear()
        if self.closed is not None:
            self.closed.updateValue((reason,), (seq,))

    def _late(self, seq: int) -> bool:
        """Whether a frame belongs to a stream that has ended: it is not beyond the frame that ended it."""
        return self.closed is not None and any(self.closed.containsKey((r,)) and seq <= self.closed.getValue((r,))[0] for r in ("end", "silence"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for timer in self.handle.listTimers() if self.idle_ms is not None else ():
            self.handle.deleteTimer(timer)
        session, last = self._session()
        out, ended = [], False
        for f in in_order(pd.concat(list(rows))):
            if f["seq"] <= last:
                raise ValueError(f"frame {f['seq']} came after {last}")
            if last < 0 and self._late(int(f["seq"])):
                continue
            last = int(f["seq"])
            out += session.feed(f)
            if f["kind"] == "end":
                ended = True
                break
        if ended:
            self._forget("end", last)
        elif last >= 0:
            self._store(session, last)
            if self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _events(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session, last = self._session()
        out = list(session.feed({"kind": "end"})) if last >= 0 else []
        self._forget("silence", last)
        yield _events(key, out)

    def close(self) -> None:
        pass


def _events(key: Any, events: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([e | {"stream_id": key[0]} for e in events], columns=_COLUMNS)


def run_stream(frames: DataFrame, idle_ms: int | None = 30_000, closed_ms: int | None = None, **options: Any) -> DataFrame:
    """Events of a streaming query; a frame that comes out of order is an error.

    A stream's state goes when it ends. A stream that gets no frame for ``idle_ms`` of processing time is
    closed as if it had ended: what is pending is flushed. None waits for ever, as a query over what is
    available now must, which timers would keep running. Frames that come with the end and after it are
    passed over. Later ones begin a new stream, but for ``closed_ms`` those up to the last frame heard are
    passed over too (a source may send them again).
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = idle_ms is not None or closed_ms is not None
    return frames.groupBy("stream_id").transformWithStateInPandas(SessionProcessor(options, idle_ms, closed_ms), EVENT, "Append", "ProcessingTime" if timed else "None")
