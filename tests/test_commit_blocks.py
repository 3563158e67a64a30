"""Committed words against a plain fold: dense and sparse words, small blocks and slices, one long stream."""

import random

import pytest

from cadenza.operators import stitch

_SCHEMA = "stream_id long, window_seq long, pos long, word string, start_ms long, end_ms long, stitch_start_ms long, stitch_end_ms long, stable boolean"


def fold(data, epsilon=25):
    out, cursors = [], {}
    for stream, _, _, word, start, end, ss, se, stable in sorted(data, key=lambda r: r[:8]):
        n, last, clock = cursors.get(stream, (0, None, None))
        if not stable or not word.strip() or (last is not None and se <= last + epsilon):
            continue
        if clock is not None:
            start = max(start, clock)
            end = max(end, start + 1)
        out.append((stream, n, start, end, word, ss, se))
        cursors[stream] = (n + 1, se, end)
    return sorted(out)


def made(seed):
    rnd, data = random.Random(seed), []
    for stream in range(12):
        at, step = 0, [3, 10, 40, 300][(stream + seed) % 4]
        for window in range(rnd.choice([1, 3, 90])):
            for pos in range(rnd.choice([1, 5, 12])):
                at = max(at + rnd.randint(-step // 3, step), -50)
                start = at + rnd.randint(-30, 5)
                data.append((stream, window, pos, rnd.choice(["a", "b", " ", "c"]), start, start + rnd.randint(-3, 60), start, at, rnd.random() < 0.9))
    return data


@pytest.mark.parametrize("block_ms, windows_per_slice", [(26, 1), (64, 2), (stitch.BLOCK_MS, stitch.WINDOWS_PER_SLICE)])
def test_blocks_give_the_fold(spark, block_ms, windows_per_slice):
    data = made(block_ms)
    got = stitch.commit(spark.createDataFrame(data, _SCHEMA), block_ms=block_ms, windows_per_slice=windows_per_slice)
    assert got.columns == ["stream_id", "index", "start_ms", "end_ms", "word", "stitch_start_ms", "stitch_end_ms"]
    assert sorted(map(tuple, got.collect())) == fold(data)


def test_one_stream_without_a_pause(spark):
    """Words every 10 ms for 200 s: no word is emitted in any case but the first, so all blocks hang together."""
    data = [(7, i // 40, i % 40, "w", i * 10, i * 10 + 9, i * 10, i * 10 + 9, True) for i in range(20_000)]
    assert sorted(map(tuple, stitch.commit(spark.createDataFrame(data, _SCHEMA)).collect())) == fold(data)


def test_rows_without_keys_or_ends_are_left_out(spark):
    data = [(1, 0, 0, "a", 0, 10, 0, 10, True), (None, 0, 0, "b", 0, 90, 0, 90, True), (1, None, 1, "c", 0, 90, 0, 90, True), (1, 0, 2, "d", 0, 90, 0, None, True)]
    assert [r["word"] for r in stitch.commit(spark.createDataFrame(data, _SCHEMA)).collect()] == ["a"]
    assert stitch.commit(spark.createDataFrame([], _SCHEMA)).collect() == []


def test_blocks_longer_than_epsilon(spark):
    with pytest.raises(ValueError):
        stitch.commit(spark.createDataFrame([], _SCHEMA), block_ms=25)
