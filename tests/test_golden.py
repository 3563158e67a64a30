"""Golden vectors of the operators that are not plain SQL, and of the scalar rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import frontend
from cadenza.functions import scalars as S
from cadenza.operators import align, metrics, sessions, stitch, timing, windows
from cadenza.plans import config
from cadenza.plans.config import WindowConfig
from cadenza.sources import streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_windows_of_18_samples(spark):
    df = spark.createDataFrame([(1, 18), (2, 10), (3, 9)], "stream_id long, n long")
    got = rows(windows.hop_windows(df, "n", 10, 2, 1), "stream_id", "start_sample", "n_samples", "is_final")
    assert got == [(1, 0, 10, False), (1, 8, 10, False), (1, 16, 2, True), (2, 0, 10, False), (2, 8, 2, True), (3, 0, 9, True)]


def _window(seq, base, stable_ms, final, words, stitch_words=None):
    out = []
    for pos, (w, s, e) in enumerate(words):
        ss, se = (stitch_words or words)[pos][1:]
        out.append((1, seq, pos, w, base + s, base + e, base + ss, base + se, final or se <= stable_ms))
    return out


_COMMIT = "stream_id long, window_seq long, pos long, word string, start_ms long, end_ms long, stitch_start_ms long, stitch_end_ms long, stable boolean"


def test_commit_drops_unstable_and_repeated_words(spark):
    data = _window(0, 0, 8000, False, [("alpha", 200, 1000), ("beta", 7500, 8400)]) + _window(1, 8000, 8000, True, [("beta", 0, 400), ("gamma", 1000, 1800)])
    got = rows(stitch.commit(spark.createDataFrame(data, _COMMIT)), "index", "word")
    assert got == [(0, "alpha"), (1, "beta"), (2, "gamma")]


def test_commit_keeps_two_clocks(spark):
    first = _window(0, 0, 8000, False, [("alpha", 8200, 8800), ("beta", 8900, 9400)], [("alpha", 200, 1000), ("beta", 7500, 8400)])
    then = _window(1, 8000, 8000, True, [("gamma", 0, 100)], [("gamma", 200, 400)])
    got = rows(stitch.commit(spark.createDataFrame(first + then, _COMMIT)), "word", "start_ms", "end_ms", "stitch_start_ms")
    assert got == [("alpha", 8200, 8800, 200), ("gamma", 8800, 8801, 8200)]


def test_commit_is_a_fold_and_not_a_running_maximum(spark):
    data = [(1, 0, k, f"w{k}", e - 10, e, e - 10, e, True) for k, e in enumerate((100, 120, 130))]
    assert rows(stitch.commit(spark.createDataFrame(data, _COMMIT)), "end_ms") == [(100,), (130,)]


def test_clamp_closed_form_equals_recurrence(spark):
    rnd, data, want = random.Random(1), [], []
    for stream in range(40):
        end = None
        for pos in range(30):
            s = rnd.randint(0, 300)
            e = s + rnd.randint(-5, 40)
            data.append((stream, pos, s, e))
            start, stop = (s, e) if end is None else (max(s, end), max(e, max(s, end) + 1))
            end = stop
            want.append((stream, pos, start, stop))
    got = rows(stitch.clamp(spark.createDataFrame(data, "stream_id long, pos long, start_ms long, end_ms long")), "stream_id", "pos", "start_ms", "end_ms")
    assert got == sorted(want)


def test_estimate_from_spans(spark):
    words = spark.createDataFrame([(1, 0, "hello", 0, 5, 11, 3, 3000), (1, 1, "world", 6, 11, 11, 3, 3000)], "stream_id long, pos long, word string, start long, end long, length long, tokens long, duration_ms long")
    got = rows(timing.estimate(words), "word", "start_ms", "end_ms")
    assert got[0][1] == 0 and got[1][2] == 3000 and got[0][2] <= got[1][1] + 1000


def test_estimate_stays_monotone(spark):
    text = "ask not what your country can do for you"
    spans = timing.word_spans(spark.createDataFrame([(1, text)], "stream_id long, text string"))
    spans = spans.withColumn("length", F.lit(len(text)).cast("long")).withColumn("tokens", F.lit(12).cast("long")).withColumn("duration_ms", F.lit(4000).cast("long"))
    got = rows(timing.estimate(spans), "pos", "start_ms", "end_ms")
    assert len(got) == 9 and got[-1][2] == 4000 and all(s <= e for _, s, e in got) and all(a[2] <= b[2] for a, b in zip(got, got[1:], strict=False))


def test_fragments_merge_by_overlap(spark):
    data = [
        (1, 0, "And so, my fellow Americans, ask not what your"), (1, 1, "What your country can do for you, ask what you can do for your country."),
        (2, 0, "The first sentence is here."), (2, 1, "A different sentence follows."),
    ]
    got = dict(rows(stitch.merge_fragments(spark.createDataFrame(data, "stream_id long, seq long, text string")), "stream_id", "text"))
    assert got[1] == "And so, my fellow Americans, ask not what your country can do for you, ask what you can do for your country."
    assert got[2] == "The first sentence is here. A different sentence follows."


def test_scalars(spark):
    df = spark.createDataFrame([("Americans,",), ("don't",), ("Cohere’s",), ("CAFÉ",)], "w string")
    assert [r[0] for r in df.select(S.normalize_ctc(F.col("w"))).collect()] == ["americans", "don't", "cohere's", "café"]
    one = spark.range(1)
    assert one.select(S.join_words(F.array(*map(F.lit, ("hello", ",", "world"))))).first()[0] == "hello, world"
    assert one.select(S.samples_to_ms(F.lit(16000)), S.samples_to_ms(F.lit(8000))).first()[:] == (1000, 500)
    arrays = spark.createDataFrame([([],), ([0.0, 0.0, 0.0],), ([1.0, -1.0, 1.0, -1.0],)], "x array<float>")
    assert [r[0] for r in arrays.select(S.rms(F.col("x"))).collect()] == [0, 0, 1]
    odd = spark.createDataFrame([([float("nan"), 1.0, 2.0, 2.0],), ([float("-inf")],)], "x array<float>")
    assert [r[0] for r in odd.select(S.argmax_first(F.col("x"))).collect()] == [2, 0]


def test_collapse(spark):
    path = [3, 0, 0, 3, 0, 1, 3]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(path)], "stream_id long, frame long, token long")
    assert rows(metrics.collapse(df, 3), "run", "token", "first", "last") == [(1, 0, 1, 2), (2, 0, 4, 4), (3, 1, 5, 5)]


def test_forced_alignment():
    logits = np.zeros((5, 3))
    for t, k in enumerate((2, 0, 0, 1, 2)):
        logits[t, k] = 5
    assert align.forced_align(logits, [0, 1], 2) == [(1, 2), (3, 3)]
    with pytest.raises(ValueError):
        align.forced_align(logits[:1], [0, 1], 2)


def test_groups_and_anchors():
    permissive = align.AnchorConfig(0.5, 1, 8)
    got = align.anchor(["go", "now"], [(110, 180), (220, 280)], ["go", "go", "now"], [(0, 100), (100, 200), (200, 300)], 300, permissive)
    assert got[1:] == [(110, 180), (220, 280)]
    assert align.anchor(["newyork"], [(100, 800)], ["new", "york"], [(0, 500), (500, 1000)], 1000, permissive) == [(100, 400), (400, 800)]
    with pytest.raises(ValueError, match="few_matches"):
        align.anchor(["a"], [(0, 10)], ["a", "b", "c", "d"], [(k * 10, k * 10 + 10) for k in range(4)], 100)


def test_reconcile_and_fill():
    config = align.AnchorConfig(0.5, 1, 8, -69, 18)
    assert align.anchor(["one", "two"], [(100, 200), (200, 300)], ["one", "two"], [(100, 200), (200, 300)], 400, config) == [(31, 174), (174, 318)]
    with pytest.raises(ValueError, match="anchors_cross"):
        align.anchor(["one", "three"], [(0, 1), (1, 2)], ["one", "missing", "three"], [(0, 1), (1, 2), (1, 2)], 2, config)
    wide = align.AnchorConfig(0.5, 1, 8, -50, 50)
    got = align.anchor(["one", "three"], [(10, 100), (110, 200)], ["one", "missing", "three"], [(10, 100), (100, 110), (110, 200)], 300, wide)
    assert len(got) == 3 and all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False)) and all(s < e for s, e in got)


def test_edit_distance_and_lcs():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rnd = random.Random(2)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 8))] for _ in range(2))
        assert align.edit_distance(a, b) == slow(a, b)
        pairs = align.lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_side_times_only_where_words_agree(spark):
    own = spark.createDataFrame([(1, 0, "a", 0, 5), (2, 0, "b", 0, 5)], "stream_id long, pos long, word string, start_ms long, end_ms long")
    side = spark.createDataFrame([(1, 0, "a", 2, 7), (2, 0, "x", 2, 7)], "stream_id long, pos long, word string, start_ms long, end_ms long")
    assert rows(stitch.side_times(own, side), "stream_id", "start_ms", "stitch_start_ms", "applied") == [(1, 2, 0, True), (2, 0, 0, False)]


def test_sample_bytes_must_be_whole(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x00\xa0\x3f"),)], "b binary")
    assert streams.decode_samples(df, "b").first().samples == [1.25]
    with pytest.raises(Exception, match="whole number"):
        streams.decode_samples(spark.createDataFrame([(bytearray(b"abc"),)], "b binary"), "b").collect()


def test_frontend_shapes():
    x = np.sin(np.arange(3200) / 5)
    assert frontend.power_spectra(x).shape == (20, 257)
    assert frontend.mel_filters().shape == (128, 257)
    assert abs(frontend.normalize(np.random.rand(3, 50)).mean()) < 1e-9


def test_config_is_checked():
    assert WindowConfig(10, 2).stride_samples == 128_000
    for bad in (WindowConfig, ):
        with pytest.raises(ValueError):
            bad(2, 2)


def test_utterances_split_at_zero_gap(spark):
    df = spark.createDataFrame([(1, k, f"w{k}", k * 10, k * 10 + 5) for k in range(3)], "stream_id long, pos long, word string, start_ms long, end_ms long")
    assert sessions.utterances(df, 0).count() == 3 and sessions.utterances(df, 6).count() == 1


def test_calibration_gathers_no_table(spark):
    pairs = [(k * 7 % 23 - 5, k * 11 % 31 - 9) for k in range(200)]
    got = metrics.calibration(spark.createDataFrame([(s, e, 0, 0) for s, e in pairs], "start long, end long, ref_start long, ref_end long"))
    assert not [f for f in ("collect_list", "collect_set") if f in got._jdf.queryExecution().toString()]
    so, eo = (-sorted(x)[100] for x in zip(*pairs, strict=True))
    mid = sorted(abs(int((s + so + e + eo) / 2)) for s, e in pairs)
    want = (so, eo, sum(abs(s + so) for s, _ in pairs) / 200, sum(abs(e + eo) for _, e in pairs) / 200, sum(mid) / 200, mid[round(0.5 * 199 + 1e-9)], mid[round(0.95 * 199)])
    assert tuple(got.first()) == pytest.approx(want)
    assert metrics.calibration(spark.createDataFrame([], "start long, end long, ref_start long, ref_end long")).count() == 0


def test_settings_are_checked_in_order(spark):
    names = "chunk_seconds double, overlap_seconds double, final_min_seconds double, utt_split_seconds double, num_streams int, slot_size_kb int, slots_per_stream int, timeout_ms long, max_inflight int, worker_id string, discovery_interval_ms long, heartbeat_interval_ms long, worker_ttl_ms long, sessions int, max_new_tokens int, role string, ingress_urls string, discovery_dns string"
    good = [30.0, 2.0, 0.5, 0.8, 16, 32, 1024, 30_000, 2, "w", 2000, 1000, 5000, 2, 128, "worker", None, "dns"]
    bad = {0: 0.0, 1: 30.0, 2: -1.0, 3: -0.1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: " ", 10: 0, 11: 0, 12: 0, 13: 0, 14: 0, 17: " "}
    rows = [good] + [[v if i == k else x for i, x in enumerate(good)] for k, v in bad.items()]
    got = [r.p for r in spark.createDataFrame(rows, names).coalesce(1).select(config.first_problem().alias("p")).collect()]
    assert got == [None, *config.CHECKS]
    free = [0 if i in (13, 14) else "api" if i == 15 else x for i, x in enumerate(good)]
    assert spark.createDataFrame([free], names).select(config.first_problem().alias("p")).first().p is None


def test_repeated_streams_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "stream_id long, text string")
    assert rows(align.by_row(df, lambda r: [(r["stream_id"], w) for w in r["text"].split()], "stream_id long, w string"), "stream_id", "w") == [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "c")]


def test_word_groups_by_brute_force():
    rnd = random.Random(31)

    def best(hyp, hyp_ms, ref, ref_ms):
        found = {}

        def go(i, j):
            if (i, j) not in found:
                offers = [go(*x) for x in ((i - 1, j), (i, j - 1)) if min(x) >= 0]
                for h in range(max(i - 3, 0), i):
                    for r in range(max(j - 3, 0), j):
                        if all(hyp[h:i]) and all(ref[r:j]) and "".join(hyp[h:i]) == "".join(ref[r:j]):
                            a, b, c, d = go(h, r)
                            far = abs((hyp_ms[h][0] + hyp_ms[i - 1][1]) // 2 - (ref_ms[r][0] + ref_ms[j - 1][1]) // 2)
                            offers.append((a + j - r, b + len("".join(ref[r:j])), c + i - h, d - far))
                found[i, j] = max(offers, default=(0, 0, 0, 0))
            return found[i, j]

        return go(len(hyp), len(ref))

    for _ in range(300):
        hyp, ref = ([rnd.choice(["a", "b", "ab", "ba", ""]) for _ in range(rnd.randint(0, 7))] for _ in range(2))
        times = [[(t := rnd.randint(0, 900), t + rnd.randint(1, 90)) for _ in ws] for ws in (hyp, ref)]
        got = align.match_groups(hyp, times[0], ref, times[1])
        assert all("".join(hyp[a:b]) == "".join(ref[c:d]) != "" for a, b, c, d in got) and all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(got, got[1:], strict=False))
        far = sum(abs((times[0][a][0] + times[0][b - 1][1]) // 2 - (times[1][c][0] + times[1][d - 1][1]) // 2) for a, b, c, d in got)
        assert (sum(d - c for *_, c, d in got), sum(len("".join(ref[c:d])) for *_, c, d in got), sum(b - a for a, b, *_ in got), -far) == best(hyp, times[0], ref, times[1])


def test_common_subsequence_is_longest():
    rnd = random.Random(32)
    for _ in range(200):
        a, b = ([rnd.choice(["x", "y", "z", ""]) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q and p else max(table[i][j + 1], table[i + 1][j])
        assert len(align.lcs(a, b, blanks_count=False)) == table[-1][-1]
