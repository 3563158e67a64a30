"""Windows and features of streams cut into rows equal those of the same streams in one row each."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import frontend
from cadenza.operators import windows

SCHEMA = "stream_id long, seq long, samples array<float>, n long"


def cut(seed, sizes, lengths):
    """Streams of the ``lengths`` as rows of random ``sizes``, in mixed order, and whole."""
    rnd = random.Random(seed)
    whole = [(s, [round(rnd.uniform(-1, 1), 3) for _ in range(n)]) for s, n in enumerate(lengths)]
    rows = []
    for s, x in whole:
        at, seq = 0, 0
        while at < len(x):
            n = rnd.choice(sizes)
            rows.append((s, seq, x[at : at + n], 0))
            at, seq = at + n, seq + rnd.randint(1, 3)
    rnd.shuffle(rows)
    return rows, whole


CASES = [(1, [1, 2, 3]), (2, [7, 50, 400]), (3, [1000])]


@pytest.mark.parametrize("seed, sizes", CASES)
@pytest.mark.parametrize("chunk, overlap, least, per_block", [(10, 2, 1, 1), (16, 12, 5, 3), (5, 5, 1, 64)])
def test_windows(spark, seed, sizes, chunk, overlap, least, per_block):
    rows, whole = cut(seed, sizes, [1, 4, 9, 10, 18, 130, 257])
    got = windows.hop_windows_of_rows(spark.createDataFrame(rows, SCHEMA), chunk, overlap, least, windows_per_block=per_block)
    one = spark.createDataFrame([(s, 0, x, len(x)) for s, x in whole], SCHEMA)
    want = windows.window_samples(windows.hop_windows(one, "n", chunk, overlap, least), "samples").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed, sizes", CASES)
@pytest.mark.parametrize("per_band", [True, False])
@pytest.mark.parametrize("n_fft, hop, win, per_block", [(32, 8, 20, 1), (32, 10, 32, 4), (16, 20, 16, 3)])
def test_features(spark, seed, sizes, per_band, n_fft, hop, win, per_block):
    rows, whole = cut(seed, sizes, [1, 9, 12, 40, 130, 257])
    args = dict(mels=6, n_fft=n_fft, hop=hop, win=win, per_band=per_band)
    got = {(r["stream_id"], r["frame"]): r["bands"] for r in frontend.log_mel_frames(spark.createDataFrame(rows, SCHEMA), frames_per_block=per_block, **args).collect()}
    want = {}
    for r in frontend.log_mel(spark.createDataFrame([(s, 0, x, len(x)) for s, x in whole], SCHEMA), "samples", **args).collect():
        for f in range(len(r["features"][0])):
            want[r["stream_id"], f] = [band[f] for band in r["features"]]
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


def test_rows_without_samples_or_keys(spark):
    rows = [(1, 0, [1.0, 2.0], 0), (1, 1, None, 0), (1, 2, [], 0), (None, 3, [9.0], 0), (1, None, [9.0], 0), (1, 4, [3.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [(r["start_sample"], r["window"]) for r in windows.hop_windows_of_rows(df, 3, 0).collect()] == [(0, [1.0, 2.0, 3.0])]
    assert windows.hop_windows_of_rows(df.limit(0), 3, 0).collect() == []
    assert frontend.log_mel_frames(df.limit(0)).collect() == []


def test_a_long_stream_is_dealt_over_tasks(spark):
    """One stream of 300,000 samples in rows of 1,000: its blocks are no larger than a block and its surroundings."""
    rows = spark.range(300).select(F.lit(1).alias("stream_id"), F.col("id").alias("seq"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i.cast("float")).alias("samples"))
    blocks = windows.even_blocks(windows.with_places(rows), 8192, 100, 200).select("block", "first_sample", F.size("samples").alias("n")).collect()
    assert sorted(b["block"] for b in blocks) == list(range(37))
    assert max(b["n"] for b in blocks) == 8192 + 300 and all(b["first_sample"] == max(0, b["block"] * 8192 - 100) for b in blocks)
