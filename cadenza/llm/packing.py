"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised once; what is kept of them is a narrow table of pieces. The packing works
on the histogram of piece lengths, which has at most ``capacity`` entries whatever the input, and
yields a plan of bin patterns. Pieces then take their places in the plan by their rank among the
pieces of their length. Ranks come from counts per (length, bucket); a length has buckets in proportion
to its pieces, so one that many pieces share is dealt over as many tasks.

Defined results: null text counts as empty (one piece: the end id); null ``doc_id`` stays null;
repeated rows are packed as rows of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.llm.pieces import PieceTable
from cadenza.llm.session import cut, give_back, local_table, small_batches, table

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
ROWS_PER_BUCKET = 20_000
MOST_BUCKETS = 1 << 18  # of all lengths together, beside one for each
_CHUNK_CHARS = 1 << 18  # tokenising takes about 20 bytes a character, as NumPy counts them


@lru_cache(maxsize=2)
def _pieces(name: str) -> PieceTable:
    return PieceTable(name)


def text_chunks(texts: list[str], max_chars: int = _CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``max_chars`` together, with the index of their first."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield a, texts[a:i]
            a, size = i, 0
        size += len(t)
    if texts[a:]:
        yield a, texts[a:]


def tokenised_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only where longer than ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = _pieces(tokenizer)
        give_back()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, chunk in text_chunks(texts):
                rows: list[tuple] = []
                for k, tokens in enumerate(table_.encode(chunk)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(tokens), capacity)):
                        part = tokens[s : s + capacity]
                        rows.append((ids[a + k], p, s, len(part), zlib.crc32(part.tobytes())))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bin patterns (lengths in order, number of bins) that use up ``counts`` of pieces by length.

    Each bin is filled greedily with the largest piece that still fits. Where a gap stays, the
    bin's smallest piece makes room for two unpacked pieces that fill the widened gap more
    tightly. A pattern is repeated as often as the counts allow.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[list[int], int]] = []
    lengths = np.flatnonzero(left)
    while len(lengths):
        used: dict[int, int] = {}
        bin_, gap = [], capacity
        while gap > 0:
            k = int(np.searchsorted(lengths, gap, "right")) - 1
            while k >= 0 and used.get(int(lengths[k]), 0) >= left[lengths[k]]:
                k -= 1
            if k < 0:
                break
            x = int(lengths[k])
            n = int(min(gap // x, left[x] - used.get(x, 0)))
            bin_ += [x] * n
            used[x] = used.get(x, 0) + n
            gap -= n * x
        if gap > 0 and len(bin_) > 1:
            small = bin_[-1]
            used[small] -= 1
            free = np.zeros(capacity + 1, bool)
            for x in lengths.tolist():
                free[x] = left[x] > used.get(x, 0)
            pair = _tightest_pair(free, left, used, gap + small, small)
            if pair is None:
                used[small] += 1
            else:
                bin_ = [*bin_[:-1], *pair]
                for x in pair:
                    used[x] = used.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in used.items() if n)
        for x, n in used.items():
            left[x] -= times * n
        plan.append((bin_, times))
        lengths = np.flatnonzero(left)
    return plan


def _tightest_pair(free: np.ndarray, left: np.ndarray, used: dict[int, int], room: int, small: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum in (small, room]."""
    for total in range(room, small, -1):
        half = np.arange(1, total // 2 + 1)
        found = half[free[half] & free[np.minimum(total - half, len(free) - 1)] & (total - half < len(free))]
        for a in found[::-1].tolist():
            if a * 2 != total or left[a] - used.get(a, 0) >= 2:
                return total - a, a
    return None


def slots_of(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the plan as rank intervals: first ranks, pieces per bin, first bins, offsets in the bin, and where an interval's offsets begin."""
    taken: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}  # length -> (first rank, per bin, first bin, index in bin, offset)
    first_bin = 0
    for bin_, times in plan:
        offset, seen = 0, {}
        for x in bin_:
            slots.setdefault(x, []).append((taken.get(x, 0), bin_.count(x), first_bin, seen.get(x, 0), offset))
            seen[x] = seen.get(x, 0) + 1
            offset += x
        for x, n in seen.items():
            taken[x] = taken.get(x, 0) + n * times
        first_bin += times
    lookup = {}
    for x, got in slots.items():
        starts = sorted({g[0] for g in got})
        by = {s: sorted((g for g in got if g[0] == s), key=lambda g: g[3]) for s in starts}
        per = [by[s][0][1] for s in starts]
        flat = [g[4] for s in starts for g in by[s]]
        base = np.cumsum([0, *per[:-1]])
        lookup[x] = tuple(np.array(v, np.int64) for v in (starts, per, [by[s][0][2] for s in starts], flat, base))
    return lookup


def place(pieces: DataFrame, counts: dict[int, int], plan: list[tuple[list[int], int]], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``pieces`` (with a distinct ``row`` number each) with their ``sequence_id`` and ``offset`` under ``plan``.

    The plan has at most about ``capacity`` times a small factor entries and buckets number at most
    ``MOST_BUCKETS`` more than lengths, which bounds what the driver gets and broadcasts.
    """
    spark = pieces.sparkSession
    size = max(rows_per_bucket, sum(counts.values()) // MOST_BUCKETS)
    parts = local_table(spark, of=pa.array(list(counts), pa.int64()), buckets=pa.array([-(-n // size) for n in counts.values()], pa.int64()))
    dealt = pieces.join(F.broadcast(parts), F.col("length") == F.col("of")).withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets"))).drop("of", "buckets")
    found = sorted((r.length, r.bucket, r["count"]) for r in dealt.groupBy("length", "bucket").count().collect())
    lengths, buckets, sizes = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    upto = np.cumsum(sizes) - sizes
    first = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]])) if len(lengths) else lengths
    before = upto - np.repeat(upto[first], np.diff(np.concatenate([first, [len(lengths)]])))  # pieces of the length in earlier buckets
    shared = spark.sparkContext.broadcast((slots_of(plan), lengths * (MOST_BUCKETS * 2) + buckets, before))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, keys, earlier = shared.value
        for batch in batches:
            length, bucket_, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "bucket", "rank"))
            rank = rank + earlier[np.searchsorted(keys, length * (MOST_BUCKETS * 2) + bucket_)] if len(rank) else rank
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                starts, per, bins, flat, base = lookup[x]
                r = rank[at]
                k = np.searchsorted(starts, r, "right") - 1
                seq[at] = bins[k] + (r - starts[k]) // per[k]
                off[at] = flat[base[k] + (r - starts[k]) % per[k]]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "bucket", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per piece of every document, with its place in a sequence of at most ``capacity`` tokens."""
    small_batches(docs.sparkSession)
    pieces = cut(tokenised_pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    return place(pieces, counts, best_two_fit(counts, capacity), rows_per_bucket)


def op10_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
