"""The same events from a streaming query as from a batch."""

import time

import pytest
from pyspark.sql import functions as F

from cadenza.operators import inference
from cadenza.streaming import controls, processor, session

OPTIONS = {"stride_ms": 5200, "gap_ms": 800, "interim": True}


def _frames(spark):
    word = lambda w, s: (w, s, s + 300)
    data = []
    for stream in ("a", "b"):
        for k in range(4):
            words = [word(f"{stream}{k}x", 100), word("end.", 900), word(f"y{k}", 4000), word("late", 5000)]
            data.append((stream, 2 * k, "window", k * 83_200, 96_000, False, 0.5, words, "text"))
            data.append((stream, 2 * k + 1, "preview", (k + 1) * 83_200, 16_000, False, 0.5, [word("soon", 100)], None))
        data.append((stream, 8, "finalize", 0, 0, False, 0.0, [], None))
        data.append((stream, 9, "end", 0, 0, True, 0.0, [], None))
    return spark.createDataFrame(data, session.FRAME)


def test_stream_equals_batch(spark, tmp_path):
    frames = _frames(spark)
    want = sorted(map(tuple, session.run_batch(frames, **OPTIONS).collect()), key=str)
    assert {r[2] for r in want} == {"Results", "SpeechStarted"} and sum(r[3] for r in want) > 6
    for k in range(5):  # two frames of each stream at a time
        frames.filter(F.expr(f"seq div 2 = {k}")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    live = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = processor.run_stream(live, idle_ms=None, **OPTIONS).writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("events").collect()), key=str) == want


def test_restart_after_a_kill_gives_the_same_events(spark, tmp_path):
    """A query that is stopped between batches goes on from its checkpoint, with what its state held."""
    frames = _frames(spark)
    want = sorted(map(tuple, session.run_batch(frames, **OPTIONS).collect()), key=str)
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def start(name):
        out = processor.run_stream(live, idle_ms=None, **OPTIONS)
        return out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).queryName(name).trigger(availableNow=True).start()

    for k in range(2):
        frames.filter(F.expr(f"seq div 2 = {k}")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    first = start("before")
    assert first.awaitTermination(120)
    for k in range(2, 5):
        frames.filter(F.expr(f"seq div 2 = {k}")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def fail(batch, number):
        raise RuntimeError("killed")

    broken = processor.run_stream(live, idle_ms=None, **OPTIONS).writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        broken.awaitTermination(120)
    assert start("after").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == want


def test_ended_streams_are_remembered_for_a_while(spark, tmp_path):
    word = lambda w, s: (w, s, s + 300)
    data = [("a", 3, "window", 0, 96_000, False, 0.0, [word("one", 100)], None), ("a", 4, "end", 0, 0, True, 0.0, [], None)]
    again = [("a", 4, "end", 0, 0, True, 0.0, [], None), ("a", 5, "window", 0, 96_000, False, 0.0, [word("new", 100)], None), ("a", 6, "end", 0, 0, True, 0.0, [], None)]
    (tmp_path / "in").mkdir()
    live = spark.readStream.schema(session.FRAME).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for k, rows in enumerate((data, again)):
        spark.createDataFrame(rows, session.FRAME).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        q = processor.run_stream(live, idle_ms=None, closed_ms=600_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(60)
        finally:
            q.stop()
    got = sorted((r.event, r.transcript) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "new"), (1, "one"), (2, ""), (2, "")]


class _Counted:
    """List state that counts its reads."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def clear(self):
        self.rows = []


def test_a_batch_does_not_read_what_is_held():
    state = _Counted()
    words, last = 0, None
    for k in range(50):  # one segment that never ends, a batch for each window
        s = session.Session(gap_ms=10**9, pending=processor.StateList(state), last=last, stitch_end=last and last[4], end=last and last[2])
        list(s.feed({"kind": "window", "start_sample": k * 16_000, "n_samples": 16_000, "is_final": True, "rms": 0.0, "words": [{"word": f"w{k}", "start_ms": 0, "end_ms": 900}]}))
        s.pending.store()
        words, last = words + 1, s.last
    assert state.reads == 0 and len(state.rows) == words == 50
    flushed = list(session.Session(pending=processor.StateList(state), last=last).feed({"kind": "end"}))
    assert flushed[0]["n_words"] == 50 and state.reads == 1 and not state.rows


def test_last_word_waits_for_a_flush():
    s = session.Session()
    got = list(s.feed({"kind": "window", "start_sample": 0, "n_samples": 96_000, "is_final": False, "rms": 0.0, "words": [{"word": "one.", "start_ms": 0, "end_ms": 100}, {"word": "two", "start_ms": 200, "end_ms": 300}]}))
    assert [e["transcript"] for e in got] == ["one."] and got[0]["from_finalize"]
    flushed = list(s.feed({"kind": "end"}))
    assert [e["transcript"] for e in flushed] == ["two", ""] and not flushed[0]["from_finalize"] and flushed[1]["from_finalize"]
    assert all(e["speech_final"] for e in got + flushed)


def _one(kind="window", words=(), **more):
    frame = {"kind": kind, "start_sample": 0, "n_samples": 96_000, "is_final": False, "rms": 0.0, "words": [{"word": w, "start_ms": a, "end_ms": b} for w, a, b in words]}
    return frame | more


def test_finalize_flushes_without_closing():
    s = session.Session(words=True)
    assert not list(s.feed(_one(words=[("two", 200, 300)]))) and not list(s.feed(_one("keepalive")))
    got = list(s.feed(_one("finalize")))
    assert [(e["type"], e["is_final"], e["speech_final"], e["end_ms"]) for e in got] == [("Results", True, False, 300), ("UtteranceEnd", False, False, 300)]
    end = list(s.feed(_one("end")))
    assert [(e["transcript"], e["speech_final"], e["from_finalize"], e["end_ms"]) for e in end] == [("", True, True, 6000)]


def test_text_without_words_is_flushed_only_when_nothing_is_pending():
    s = session.Session(interim=True)
    list(s.feed(_one(text="plain text")))
    list(s.feed(_one(words=[("two", 200, 300)], text="two")))
    assert [e["transcript"] for e in s.feed(_one("finalize"))] == ["two"]
    assert [e["transcript"] for e in s.feed(_one("finalize"))] == ["plain text"]
    got = list(s.feed(_one("preview", [("more", 0, 50)], start_sample=96_000, n_samples=16_000)))
    assert [(e["transcript"], e["is_final"], e["start_ms"], e["end_ms"]) for e in got] == [("two plain text more", False, 0, 7000)]


def test_a_final_window_gives_segments_that_are_not_from_finalize():
    got = list(session.Session().feed(_one(words=[("one.", 0, 100), ("two", 200, 300)], is_final=True)))
    assert [(e["transcript"], e["from_finalize"], e["speech_final"]) for e in got] == [("one.", False, True)]


def test_state_goes_at_the_end_and_after_a_timeout(spark, tmp_path):
    """One stream ends, one falls silent: its pending words are flushed, and no state is left."""
    word = lambda w, s: (w, s, s + 300)
    data = [("a", 0, "window", 0, 96_000, False, 0.5, [word("one.", 100), word("two", 900)], None), ("a", 1, "end", 0, 0, True, 0.0, [], None), ("b", 0, "window", 0, 96_000, False, 0.5, [word("left", 100)], None)]
    spark.createDataFrame(data, session.FRAME).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    live = spark.readStream.schema(session.FRAME).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = processor.run_stream(live, idle_ms=200).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(200):
            if spark.table("silent").filter("stream_id = 'b' AND from_finalize AND n_words = 0").count():
                break
            time.sleep(0.3)
        rows = sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"])
    finally:
        q.stop()
    got = {(r.stream_id, r.transcript) for r in spark.table("silent").filter("type = 'Results'").collect()}
    assert got == {("a", "one."), ("a", "two"), ("a", ""), ("b", "left"), ("b", "")} and rows == 0


def test_without_interim_results_no_transcript_is_kept():
    for interim in (True, False):
        s = session.Session(interim=interim)
        list(s.feed(_one(words=[("one.", 0, 100), ("two", 200, 300)])))
        assert s.completed == ("one." if interim else "")


def test_a_failed_backend_is_given_up_and_its_place_is_free():
    built = []

    def build():
        built.append(object())
        return built[-1]

    pool = inference.Pool(build, 1)
    with pool.lease() as first, pytest.raises(RuntimeError, match="no backend"), pool.lease():
        assert first is built[0] and pool.available() == 0
    with pytest.raises(KeyError), pool.lease() as again:
        assert again is first
        raise KeyError
    with pool.lease() as fresh:
        assert fresh is built[1]
    assert pool.available() == 1 and len(built) == 2


def test_a_ring_counts_waiting_writes(spark):
    ops = "wwwrrrrwrwwwwwr"
    df = spark.createDataFrame([(1, k, "write" if c == "w" else "read") for k, c in enumerate(ops)], "stream_id long, seq long, op string")
    held, want = 0, []
    for c in ops:
        want.append((held, c == "w" and held >= 2))
        held = held + 1 if c == "w" else max(held - 1, 0)
    assert [(r.held, r.waits) for r in controls.admitted(df, 2).orderBy("seq").collect()] == want
