"""Requests, client messages, sample files and features against small worked cases."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cadenza.functions import frontend
from cadenza.operators import stitch
from cadenza.sources import streams
from cadenza.streaming import controls, session

MESSAGE = "stream_id string, seq long, type string, payload string"


def test_messages_become_frames_up_to_the_close(spark):
    data = [("a", 1, "binary", "x"), ("a", 2, "text", '{"type":"KeepAlive"}'), ("a", 3, "ping", None), ("a", 4, "text", '{"type":"Odd"}'), ("a", 5, "text", "no json"),
            ("a", 6, "text", '{"type":"Finalize"}'), ("a", 7, "text", '{"type":"CloseStream"}'), ("a", 8, "binary", "late"), ("b", 1, "close", None), ("b", 2, "close", None), ("c", 1, "text", None)]
    rows = spark.createDataFrame(data, MESSAGE)
    got = sorted(tuple(r) for r in controls.frames(rows).collect())
    assert [g[:3] for g in got] == [("a", 1, "body"), ("a", 2, "keepalive"), ("a", 6, "finalize"), ("a", 7, "end"), ("b", 1, "end")]
    assert [g[3] for g in got] == ["x", None, None, None, None]
    with pytest.raises(PySparkException, match="unknown control message"):
        controls.frames(rows, lenient=False).collect()
    assert controls.frames(rows.filter("false")).count() == 0


def test_requests_round_trip(spark):
    data = [("a", "audio/wav", "x" * 130), ("b", "application/json", "{}"), ("c", None, "yz"), ("d", "audio/wav", ""), ("e", "audio/wav", None)]
    frames = streams.request_frames(spark.createDataFrame(data, "stream_id string, content_type string, body string"), 64)
    assert sorted((r.stream_id, r.seq) for r in frames.filter("kind = 'end'").collect()) == [("a", 3), ("c", 1), ("d", 0), ("e", 0)]
    assert sorted(tuple(r) for r in streams.bodies(frames).collect()) == [("a", "x" * 130, True), ("c", "yz", True)]
    assert [tuple(r) for r in streams.bodies(frames.filter("stream_id = 'a' AND seq <> 3")).collect()] == [("a", "x" * 130, False)]


def test_sample_files(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "one.f32").write_bytes(np.array([0.0, 1.25, -3.5], "<f4").tobytes())
    assert [list(r.samples) for r in streams.read_sample_files(spark, str(tmp_path / "ok")).collect()] == [[0.0, 1.25, -3.5]]
    (tmp_path / "ok" / "two.f32").write_bytes(b"12345")
    with pytest.raises(PySparkException, match="no whole number of samples"):
        streams.read_sample_files(spark, str(tmp_path / "ok")).collect()


def test_features_of_another_model(spark):
    x = np.sin(np.arange(64) * 0.7)
    rows = spark.createDataFrame([(1, x.tolist()), (2, []), (3, None)], "id long, x array<double>")
    raw = {r.id: np.array(r.features) for r in frontend.log_mel(rows, "x", mels=6, n_fft=32, hop=16, win=24, emphasis=0.0, guard=1e-5, per_band=False).collect()}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(24) / 23)
    padded = np.concatenate([np.zeros(16), x, np.zeros(16)])
    angle = np.exp(-2j * np.pi * np.outer(np.arange(17), np.arange(32)) / 32)
    power = [np.abs(angle @ (padded[k * 16 : k * 16 + 32] * np.pad(hann, 4))) ** 2 for k in range(4)]
    want = np.log(frontend.mel_filters(n_fft=32, mels=6) @ np.array(power).T + 1e-5)
    assert np.allclose(raw[1], want) and raw[2].shape == raw[3].shape == (6, 0)


def test_sessions_merge_fragments_as_tables_do(spark):
    cases = [["And so, my fellow Americans, ask not what your", "What your country can do for you"], ["The first sentence is here.", "A different sentence follows."], ["one two three", "TWO, three four", "three four"], ["-- !", "- ? x"]]
    rows = spark.createDataFrame([(k, i, t) for k, c in enumerate(cases) for i, t in enumerate(c)], "stream_id long, seq long, text string")
    got = dict(tuple(r) for r in stitch.merge_fragments(rows).collect())
    assert got == {k: session.merged(c) for k, c in enumerate(cases)} and got[0].endswith("ask not what your country can do for you")


def test_payloads(spark):
    s = session.Session(words=True)
    frame = {"kind": "window", "start_sample": 0, "n_samples": 16_000, "is_final": False, "rms": 0.5, "words": [{"word": "one.", "start_ms": 250, "end_ms": 500}, {"word": "b", "start_ms": 600, "end_ms": 700}]}
    events = [e | {"stream_id": "a"} for e in s.feed(frame)]
    df = spark.createDataFrame([tuple(e[c.split()[0]] for c in session.EVENT.split(", ")) for e in events], session.EVENT)
    got = [r.value for r in df.orderBy("event").select(session.payload().alias("value")).collect()]
    assert got[1] == '{"type":"Results","channel_index":[0],"duration":0.5,"start":0.25,"is_final":true,"speech_final":true,"from_finalize":true,"channel":{"alternatives":[{"transcript":"one.","confidence":0.0}]}}'
    assert got[2] == '{"type":"UtteranceEnd","channel":[0],"last_word_end":0.5}' and '"SpeechStarted"' in got[0]
    assert df.filter(F.col("type") == "UtteranceEnd").count() == 1
