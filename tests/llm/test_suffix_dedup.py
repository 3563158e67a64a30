"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import suffix_dedup

SCHEMA = "doc_id long, text string, block int, part string, held string"
LAST = 2**63 - 1


def brute(rows, length):
    rows = [(LAST if k is None else k, (t or "").encode()) for k, t in rows]
    low = {}
    for k, t in rows:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            low[s] = min(low.get(s, k), k)
    out = []
    for k, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if low[t[i : i + length]] < k:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_arrays_and_common_prefixes():
    rnd = random.Random(1)
    for trial in range(150):
        texts = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(40))) for _ in range(rnd.randrange(1, 6))]
        if trial % 3 == 0:
            texts = [b"a" * rnd.randrange(300) for _ in range(3)]
        raw = b"".join(texts)
        data, sizes = np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        order = suffix_dedup.suffix_array(data, ends)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : ends[i]], i))
        if len(raw):
            pairs = zip(order.tolist(), order.tolist()[1:], strict=False)
            common = [0] + [next((k for k, (x, y) in enumerate(zip(raw[a : ends[a]], raw[b : ends[b]], strict=False)) if x != y), min(ends[a] - a, ends[b] - b)) for a, b in pairs]
            assert suffix_dedup.common_prefixes(data, ends, order, 20, lanes=7).tolist() == [min(20, c) for c in common]


def test_anchors_agree_wherever_a_string_stands():
    rnd = random.Random(2)
    text = bytes(rnd.choice(b"abcdefgh") for _ in range(400))
    a = suffix_dedup.anchors(np.frombuffer(text, np.uint8), 50, 24)
    for i in (0, 17, 350):
        assert suffix_dedup.anchors(np.frombuffer(text[i : i + 50], np.uint8), 50, 24).tolist() == [a[i]]
    block = suffix_dedup.Block(pa.array(["x" * 49, None, "y" * 50, text.decode(), "y" * 60]), 50, 24)
    assert block.count.sum() == 1 + 351 + 11 and set(block.owner.tolist()) == {2, 3, 4}


def fixture():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé日") for _ in range(rnd.randint(2, 7)))
    passage = " ".join(word() for _ in range(40))
    rows = [(k, " ".join(word() for _ in range(rnd.randint(1, 60)))) for k in range(60)]
    rows += [(k, word() + passage[rnd.randrange(60) :] + word()) for k in range(60, 140)]  # one passage that most share
    rows += [(k, rows[k - 100][1]) for k in range(140, 160)]
    rows += [(200, "z" * 4000), (199, "z" * 70 + "\x00" * 60), (198, "\x00" * 61), (201, ""), (202, None), (203, "short"), (204, "ab" * 300)]
    rows += [(7, rows[61][1]), (7, rows[61][1]), (None, passage), (None, passage), (None, None), (90, rows[90][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot,shard_bytes", [(suffix_dedup.HOT, suffix_dedup.SHARD_BYTES), (3, 2000)])
def test_against_brute_force(spark, hot, shard_bytes):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)
    assert found(suffix_dedup.repeated_bytes(df, hot=hot, shard_bytes=shard_bytes, least_blocks=5)) == brute(rows, 50)
    short = [r for r in rows if r[0] is None or r[0] < 100]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in short], SCHEMA)
    assert found(suffix_dedup.repeated_bytes(df, length=16, gram=8, hot=hot, shard_bytes=shard_bytes, least_blocks=3)) == brute(short, 16)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_passages_of_a_block_in_any_order_of_its_rows(hot):
    """What a block sends and what it later makes of the answers are found in two passes, whose rows may come in different orders."""
    rows = [(LAST if k is None else k, t) for k, t in fixture()]

    def sent(order):
        block = suffix_dedup.Block(pa.array([rows[i][1] for i in order], pa.string()), 50, 24)
        keys, n = block.documents_of()
        held = n[np.searchsorted(keys, block.key)]
        return suffix_dedup.Passages(block, np.array([rows[i][0] for i in order]), held, hot, 6).rows

    first = sent(range(len(rows)))
    assert len(first) == 6
    for seed in range(3):
        assert sent(random.Random(seed).sample(range(len(rows)), len(rows))) == first


def test_query_on_the_table(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path + "/documents.parquet").collect()]
    assert found(suffix_dedup.op13_suffix_array_dedup(spark, path)) == brute(rows, 50)


def test_empty_table(spark):
    out = suffix_dedup.repeated_bytes(spark.createDataFrame([], SCHEMA), least_blocks=2)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
