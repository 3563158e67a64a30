"""Operators on rows that hold a stream: no shuffle of words, the rows of the operators that shuffle, and SQL's on odd tables."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cadenza.operators import stitch, timing
from cadenza.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TEXTS = [None, "", "  ", "One two. three ,", "'s it ’t a\tb\n c  d e f", " ünder. Straße!  x", "word " * 47, "a? b! c. d", "\n.", "same again", "x" * 70 + " y", "five5 " * 20]


@pytest.mark.parametrize("name", ["ses_resp", "stt_sidets", "stt_sidets_whole", "tim_overlap", "tim_wordframes"])
def test_words_are_not_shuffled(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def _same_as_sql(spark, folder, name, table):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    rows = want.fetchall()
    assert rows and sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


@pytest.mark.parametrize("name", ["ses_resp", "stt_sidets", "tim_overlap", "tim_wordframes"])
def test_odd_texts(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(3, 3 + len(TEXTS)), pa.int64()), "text": TEXTS, "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())}), tmp_path / "documents.parquet")
    _same_as_sql(spark, tmp_path, name, "documents")


@pytest.mark.parametrize("name", ["stt_sidets", "tim_overlap", "tim_wordframes"])
def test_streams_of_several_rows(spark, tmp_path, name):
    texts = ["one two. three", "four", "longer ones here, five", "six seven"]
    pq.write_table(pa.table({"doc_id": pa.array([6, 7, 6, 8], pa.int64()), "text": texts, "n_chars": pa.array(map(len, texts), pa.int64())}), tmp_path / "documents.parquet")
    _same_as_sql(spark, tmp_path, name, "documents")


def test_samples_are_summed_as_floats(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=1 << 20).astype(np.float32)
    odd = x[np.rint(x * np.float32(1000)) != np.rint(x.astype(float) * 1000)][:64]
    assert len(odd)
    rows = [np.resize(odd, 64), np.zeros(64, np.float32)]
    pq.write_table(pa.table({"vec_id": pa.array([1, 2], pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    _same_as_sql(spark, tmp_path, "win_samples", "embeddings")


def _rows(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def test_overlaps_by_row(spark):
    rnd = random.Random(3)
    data = []
    for k in range(60):
        text = "".join(rnd.choice("ab  é") for _ in range(rnd.randint(0, 30)))
        starts = [rnd.randint(0, 30) for _ in range(rnd.randint(0, 9))]
        starts, step = (starts, 4) if k % 3 == 0 else (sorted(starts), rnd.choice([0, 3]))  # in no order; gaps and empty ones
        data.append((k, text, [(n + 100, s, s + step) for n, s in enumerate(starts)]))
    docs = spark.createDataFrame(data, "stream_id long, text string, tokens array<struct<token:long,start:long,end:long>>")
    columns = ["stream_id", "pos", "first_token", "last_token"]
    assert _rows(timing.overlap_bounds_by_row(docs), *columns) == _rows(timing.overlap_bounds(timing.word_spans(docs.select("stream_id", "text")), docs.select("stream_id", F.inline("tokens"))), *columns)


def test_frames_by_row(spark):
    rnd = random.Random(4)
    data = []
    for k in range(60):
        n = rnd.randint(0, 8)
        ws = [(p, a := rnd.randint(0, 12), a + rnd.randint(0, 3)) for p in range(n)]
        data.append((k, ws, [(rnd.randint(0, 14), a := rnd.randint(0, 40), a + rnd.randint(0, 3)) for _ in range(rnd.randint(0, 12))], rnd.choice([0, 14]), rnd.choice([900, 10_000])))
    streams = spark.createDataFrame(data, "stream_id long, words array<struct<pos:long,token_start:long,token_end:long>>, frames array<struct<token:long,first:long,last:long>>, n_tokens long, duration long")
    columns = ["stream_id", "pos", "start_ms", "end_ms"]
    want = timing.words_from_frames(streams.select("stream_id", F.inline("words"), "n_tokens", "duration"), streams.select("stream_id", F.inline("frames")), 40, "n_tokens", "duration")
    assert _rows(timing.words_from_frames_by_row(streams, 40, "n_tokens", "duration"), *columns) == _rows(want, *columns)


def test_side_times_by_row(spark):
    own = [[(0, "a", 1, 2), (1, "b", 3, 4)]] * 5 + [[(0, None, 1, 2), (1, "b", 3, 4)], []]
    side = [own[0], [(0, "a", 5, 6), (1, "c", 7, 8)], [(0, "a", 5, 6)], [(0, "a", 5, 6), (2, "b", 7, 8)], [*own[0], (2, "c", 9, 9)], own[5], [(0, "a", 5, 6)]]

    def both(batch):
        def part(given):
            rows = [(k, *w) for k, i in enumerate(batch.column("stream_id").to_pylist()) for w in given[i]]
            of, pos, word, start, end = zip(*rows) if rows else ((),) * 5
            return np.array(of, int), np.array(pos, int), pa.array(word, pa.string()), np.array(start, int), np.array(end, int)

        return part(own), part(side)

    shaped = lambda given: spark.createDataFrame([(k, *w) for k, ws in enumerate(given) for w in ws], "stream_id long, pos long, word string, start_ms long, end_ms long")
    got = stitch.side_times_by_row(spark.createDataFrame([(k, "") for k in range(len(own))], "stream_id long, text string"), "text", both)
    want = stitch.side_times(shaped(own), shaped(side))
    assert _rows(got, *want.columns) == _rows(want, *want.columns) and {r.applied for r in got.collect()} == {True, False}
