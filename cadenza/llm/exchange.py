"""Counts of keys over a whole corpus, exchanged between blocks of rows and parts of the key space.

A block of rows sends each of its distinct 64-bit keys once, with its counts, to the part of the key
space that the key belongs to. A part adds up and returns the totals to each block in the order in
which its keys came. No key is hot, as a block sends it once; no task holds more than a block or a
part; and what is gathered grows with the input. Blocks grow with the root of the input once a message
from a block to a part would fall under about ``MESSAGE_BYTES`` of text, so messages do not get too many.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 12_000_000
LEAST_BLOCKS = 64
MESSAGE_BYTES = 600


def number_of_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, least: int = LEAST_BLOCKS) -> int:
    """Blocks of about ``block_bytes`` of text (more beyond 240 GB), at least ``least``."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return max(least, -(-size // max(block_bytes, math.isqrt(size * MESSAGE_BYTES))))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """``docs`` dealt into ``blocks`` by a hash of id and text, as column ``block``."""
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")


def packed(counts: np.ndarray) -> bytes:
    """Counts as bytes: one for each, 255 for those that follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, np.int64, offset=size)
    return out


def cuts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal parts of the key space begins in sorted keys, and the end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def sent(block: int, keys: np.ndarray, counts: dict[str, np.ndarray], parts: int, kind: type = np.uint64) -> pa.Table:
    """A block's sorted distinct keys and their counts, a row for each part of the key space.

    With ``kind`` uint32 a part tells keys apart by their lower half only: where half the bytes are
    worth it that a rare key gets the total of two.
    """
    cuts = cuts_of(keys, parts)
    held = np.flatnonzero(np.diff(cuts))
    spans = [slice(cuts[p], cuts[p + 1]) for p in held]
    columns = [pa.array([packed(c[x]) for x in spans], pa.binary()) for c in counts.values()]
    return pa.table([pa.array(held, pa.int32()), pa.array([block] * len(held), pa.int32()), pa.array([keys[x].astype(kind).tobytes() for x in spans], pa.binary()), *columns], ["part", "block", "keys", *counts])


def totals(sent_: DataFrame, names: list[str], parts: int, kind: type = np.uint64) -> DataFrame:
    """(block, part, counts): for each row of ``sent_`` the totals over all blocks of its keys, in their order."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, kind) for x in table.column("keys").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        out, (_, at) = [], np.unique(np.concatenate(keys), return_inverse=True)
        for c in names:
            sums = np.zeros(at.max() + 1, np.int64)
            np.add.at(sums, at, np.concatenate([unpacked(x, len(k)) for x, k in zip(table.column(c).to_pylist(), keys, strict=True)]))
            out.append(pa.array([packed(x) for x in np.split(sums[at], ends[:-1])], pa.binary()))
        return pa.table([table.column("block"), table.column("part"), *out], ["block", "part", *names])

    schema = ", ".join(["block int", "part int", *(f"{c} binary" for c in names)])
    return sent_.repartition(parts, "part").groupBy("part").applyInArrow(add, schema).repartition(parts, "block")


def received(totals_: pa.Table, keys: np.ndarray, names: list[str], parts: int) -> list[np.ndarray]:
    """The totals of a block's sorted distinct ``keys``, an array for each of ``names``."""
    cuts, out = cuts_of(keys, parts), [np.zeros(len(keys), np.int64) for _ in names]
    for part, *raws in zip(*(totals_.column(c).to_pylist() for c in ("part", *names)), strict=True):
        a, b = cuts[part], cuts[part + 1]
        for counts, raw in zip(out, raws, strict=True):
            counts[a:b] = unpacked(raw, b - a)
    return out
