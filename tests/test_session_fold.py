"""Sessions as array arithmetic give the events of ``Session``, frame by frame."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cadenza.functions import flat
from cadenza.plans.registry import QUERIES
from cadenza.streaming import fold, session

WORDS = ["a", "bee", "end.", ",", ".", "'s", "’t", "(", ")x", "Ü", "why?", "  ", "", " ", "go!", "'", "}"]


def _frames(rnd):
    """Frames of a few streams, odd ones among them, with seq ascending."""
    out = []
    for stream in range(rnd.randint(1, 5)):
        start = 0
        for _ in range(rnd.randint(0, 14)):
            kind = rnd.choice(["window"] * 5 + ["preview"] * 4 + ["keepalive", "finalize", "end"])
            words = []
            if kind in ("window", "preview"):
                at = rnd.randint(0, 300)
                for _ in range(rnd.randint(0, 6)):
                    at += rnd.randint(-30, 400)
                    words.append({"word": rnd.choice(WORDS), "start_ms": at, "end_ms": at + rnd.randint(-5, 400)})
            start += rnd.choice([0, 0, 1600, 8000, 8000, -3200])
            out.append({"stream_id": str(stream), "kind": kind, "start_sample": start, "n_samples": rnd.choice([0, 4800, 9600, 16000]), "is_final": rnd.random() < 0.3, "rms": rnd.choice([0.0, 0.009, 0.01, 0.5, None]), "words": words})
    return out


def _arrays(frames, streams):
    column = lambda k: np.array([f[k] for f in frames])
    said = [w for f in frames for w in f["words"]]
    times = [np.array([w[k] for w in said], np.int64) for k in ("start_ms", "end_ms")]
    return fold.Frames(
        np.array([streams.index(f["stream_id"]) for f in frames]), np.array([fold.KINDS.index(f["kind"]) for f in frames]), column("start_sample"), column("n_samples"), column("is_final"), np.array([f["rms"] or 0.0 for f in frames]),
        np.concatenate([[0], np.cumsum([len(f["words"]) for f in frames])]).astype(np.int64), pa.array([w["word"] for w in said], pa.string()), *times,
    )


def _shown(said, e):
    return said[e["shown_from"] : e["shown_to"]].decode() + (e["tail"] or "")


@pytest.mark.parametrize("options", [{}, {"words": True}, {"interim": True}, {"interim": True, "words": True, "gap_ms": 0}])
def test_fold_equals_session(options):
    rnd, options = random.Random(str(options)), {"stride_ms": 900, "gap_ms": 160} | options
    seen = set()
    for _ in range(400):
        frames = _frames(rnd)
        if not frames:
            continue
        streams = sorted({f["stream_id"] for f in frames})
        said, events = fold.events(_arrays(frames, streams), len(streams), **options)
        for stream, text, got in zip(streams, said.to_pylist(), events.to_pylist(), strict=True):
            one = session.Session(**options)
            want = [e for f in frames if f["stream_id"] == stream for e in one.feed(f)]
            found = [{k: e[k] for k in e if k not in ("shown_from", "shown_to", "tail")} | {"type": fold.TYPES[e["type"]], "transcript": _shown(text, e)} for e in got]
            assert found == want
            seen |= {(e["type"], e["is_final"], e["from_finalize"]) for e in want}
    assert len(seen) >= 3 + options.get("words", False) + options.get("interim", False)


def test_words_of_texts():
    texts = ["", "  one\ttwo\n", None, "three", " four five", " ", "six"]
    for part in (pa.array(texts), pa.array(["x y", *texts, "z"]).slice(1, len(texts))):
        of, first, end, _ = flat.split_words(part)
        data = flat.text_buffers(part)[1]
        assert list(zip(of.tolist(), flat.pieces(data, first, end).to_pylist(), strict=True)) == [(k, w) for k, t in enumerate(texts) for w in (t or "").replace(" ", "\0").split() for w in [w.replace("\0", " ")]]


@pytest.mark.parametrize("name", ["stm_autoseg", "stm_events", "stm_finalize", "stm_interim", "stm_process", "stm_session"])
def test_streams_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan
