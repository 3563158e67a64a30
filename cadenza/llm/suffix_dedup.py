"""Removing repeated byte strings: suffix arrays of shards, merged by binary search.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id.
Strings are dealt over the corpus by an anchor, the least hash among the ``GRAM``-byte strings within
each, so equal strings share their anchor wherever they stand, and a stretch of text whose strings
share one anchor travels as one passage.

1. Blocks of documents exchange their anchors (``exchange``): one that a single document holds, as most
   do, can repeat nothing in another, and its passages stay out of all that follows.
2. Blocks send each different passage once, with the smallest document that holds it, to the part
   (there are ``PARTS`` for each block) that its anchor falls in. An anchor that over ``HOT`` documents hold sends its strings one by one instead,
   each to the part of its own hash, so a line that a third of all documents share loads no single task.
3. A part joins its passages into shards of ``SHARD_BYTES``. Each shard gets its suffix array by
   Larsson-Sadakane refinement (groups not yet in order are sorted by the rank of what follows them, at
   doubling distance) and the common prefixes of neighbours by Kasai's sweep, here many sweeps side by
   side in NumPy. Neighbours with ``LENGTH`` bytes in common are one string, and take its smallest document.
   Shards of a part then look each other's strings up by binary search and take the smaller.
4. Blocks get the smallest document of each of their strings back and mark what goes.

Results are exact: hashes choose where strings meet, never whether they are equal.

Defined results: null text is empty; texts shorter than ``LENGTH`` keep all bytes; documents of one id
remove nothing from each other; rows without ``doc_id`` come after all others and remove nothing; repeated
rows each get a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.exchange import LEAST_BLOCKS, in_blocks, number_of_blocks, received, sent, totals
from cadenza.llm.session import small_batches, table
from cadenza.llm.textkit import U64, mix, spans_hash

LENGTH = 50
GRAM = 24
HOT = 1000
SHARD_BYTES = 1_000_000
BLOCK_BYTES = 8_000_000
PARTS = 3  # parts that passages are dealt into, for each block
LANES = 64  # positions of a sweep that Kasai's rule carries through
_LAST = 2**63 - 1
_SLICE = 1 << 20


# ---- suffix arrays ----


def _ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys``, and where in it a new value begins."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    return order, fresh


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; ``ends[i]`` is where the text that position i lies in ends, and its suffix with it.

    A suffix comes before those that it begins; equal ones are in the order of their positions. There are
    less than 2^31 bytes.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left = np.minimum(ends - place, 7).astype(U64)
    # seven bytes, those beyond the end blanked, and their number, which tells a zero byte from an end
    first = np.ndarray(n, ">u8", padded, strides=(1,)).astype(U64) >> U64(8) * (U64(8) - left) << U64(8) * (U64(8) - left)
    order, fresh = _ordered(first | left)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]  # a group bears the place of its first suffix
    todo, h = place, 7  # places whose groups are not in order yet
    while True:
        alone = fresh & np.append(fresh[1:], True)
        todo = todo[~alone]
        if not len(todo):
            return order
        at = order[todo]
        # a suffix that ends here comes first, by its position
        after = np.where(at + h < ends[at], n + rank[np.minimum(at + h, n - 1)], at)
        sort, fresh = _ordered(rank[at].astype(U64) << U64(32) | after.astype(U64))
        order[todo] = at = at[sort]  # places of a group follow each other, so its members keep to them
        rank[at] = todo[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        h *= 2


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int, lanes: int = LANES) -> np.ndarray:
    """For each place of ``order`` how many bytes its suffix has in common with the one before it, up to ``most``.

    By Kasai's rule a suffix has at least one byte less in common with its neighbour than the one that
    starts a byte earlier. Sweeps of ``lanes`` positions go on side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(n + 1, "<u8", padded, strides=(1,))
    common = np.zeros(n, np.int64)
    starts = np.arange(0, n, lanes)
    known = np.zeros(len(starts), np.int64)
    for step in range(min(lanes, n)):
        i = starts + step
        i = i[i < n]
        j = before[i]
        h = known[: len(i)]
        room = np.where(j < 0, 0, np.minimum(np.minimum(ends[i] - i, ends[j] - j), most))
        h = np.minimum(h, room)
        going = np.flatnonzero(h < room)
        while len(going):
            a, b = i[going] + h[going], j[going] + h[going]
            x = words[a] ^ words[b]
            low = x & (~x + U64(1))  # the lowest bit that differs tells the first byte that does
            same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, U64(1)).astype(np.float64))).astype(np.int64) >> 3)
            h[going] = np.minimum(h[going] + same, room[going])
            going = going[(same == 8) & (h[going] < room[going])]
        common[i] = h
        known = np.maximum(h - 1, 0)
    return common[order]


class Shard:
    """The different strings of ``length`` bytes within some passages, in order, with the smallest document of each."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> None:
        stops = np.cumsum(sizes)
        ends = np.repeat(stops, sizes)
        self.length, self.data = length, data
        order = suffix_array(data, ends)
        common = common_prefixes(data, ends, order, length)
        whole = ends[order] - order >= length
        order, common = order[whole], common[whole]  # shorter suffixes stand before those that they begin, so neighbours stay neighbours
        fresh = common < length
        fresh[:1] = True
        firsts = np.flatnonzero(fresh)
        self.starts = order[firsts].astype(np.int32)
        doc = np.repeat(docs, sizes)[order]
        self.least = np.minimum.reduceat(doc, firsts) if len(firsts) else np.zeros(0, np.int64)
        which = np.full(len(data), -1, np.int32)
        which[order] = np.cumsum(fresh, dtype=np.int32) - 1
        self._which = which[which >= 0]  # the number of each string, in the order of positions

    def strings(self, a: int, b: int) -> np.ndarray:
        """Strings ``a`` to ``b`` as fixed-length bytes, which NumPy orders like the suffixes."""
        if not len(self.data) or a >= b:
            return np.zeros(0, f"S{self.length}")
        windows = np.lib.stride_tricks.sliding_window_view(self.data, self.length)
        return np.ascontiguousarray(windows[self.starts[a:b]]).view(f"S{self.length}").ravel()

    def take_lower(self, other: Shard) -> None:
        """Looks up this shard's strings in ``other`` by binary search; both then hold the smaller document of what they share."""
        if not len(self.starts) or not len(other.starts):
            return
        theirs = other.strings(0, len(other.starts))
        for a in range(0, len(self.starts), _SLICE):
            mine = self.strings(a, a + _SLICE)
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            hit = np.flatnonzero(theirs[at] == mine)
            low = np.minimum(self.least[a + hit], other.least[at[hit]])
            self.least[a + hit] = low
            other.least[at[hit]] = low

    def of_passages(self) -> np.ndarray:
        """The smallest document of the string at each position that one starts at, in the order of positions."""
        return self.least[self._which]


# ---- anchors and passages ----


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from each position on; ``size`` is a multiple of eight."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    out = mix(words[:n] ^ U64(0x9E3779B97F4A7C15))
    for k in range(8, size, 8):
        out = mix(out * U64(0xD6E8FEB86659FD93) ^ words[k : k + n])
    return out


def anchors(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each string of ``length`` bytes the least hash of the strings of ``gram`` bytes in it."""
    low = gram_hashes(data, gram)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
        reach *= 2
    rest = width - reach
    return (np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]) if rest else low


class Block:
    """Texts end to end, and the runs of their strings that share an anchor: ``start`` and ``count`` strings in text ``owner``."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, length: int, gram: int) -> None:
        column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        column = column.cast(pa.large_binary()).fill_null(b"")
        self.length, n = length, len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.sizes = np.diff(self.offsets)
        strings = np.maximum(self.sizes - length + 1, 0)
        held = np.flatnonzero(strings)
        first = self.offsets[:-1][held]
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[first] += 1
        np.add.at(inside, first + strings[held], -1)
        inside = np.cumsum(inside, dtype=np.int8).astype(bool)
        change = np.zeros(len(self.data) + 1, bool)
        change[first] = True
        starts, keys, last = [np.zeros(0, np.int64)], [np.zeros(0, U64)], U64(0)
        for a in range(0, max(len(self.data) - length + 1, 0), _SLICE):
            key = anchors(self.data[a : a + _SLICE + length - 1], length, gram)
            fresh = change[a : a + len(key)]
            fresh |= np.concatenate([[last], key[:-1]]) != key
            fresh &= inside[a : a + len(key)]
            at = np.flatnonzero(fresh)
            starts.append(a + at)
            keys.append(mix(key[at]))  # least hashes are small: mixed again they fall evenly into parts
            last = key[-1]
        self.start, self.key = np.concatenate(starts), np.concatenate(keys)
        self.owner = np.searchsorted(self.offsets, self.start, "right") - 1
        stop = np.minimum(np.append(self.start[1:], len(self.data)), (self.offsets[:-1] + strings)[self.owner] if n else 0)
        self.count = stop - self.start

    def documents_of(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors and how many of the texts hold each."""
        pairs = np.lexsort((self.owner, self.key))
        key, owner = self.key[pairs], self.owner[pairs]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        return np.unique(key[fresh], return_counts=True)


class Passages:
    """The different passages that a block sends, by part and in an order that does not depend on that of its rows, and where each of its runs (or single strings) is among them."""

    def __init__(self, block: Block, ids: np.ndarray, held: np.ndarray, hot: int, parts: int) -> None:
        shared = held > 1
        start, count, key, owner, often = (x[shared] for x in (block.start, block.count, block.key, block.owner, held))
        single = often > hot
        if single.any():  # strings one by one
            k = np.where(single, count, 1)
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            start, owner, key = np.repeat(start, k) + within, np.repeat(owner, k), np.repeat(key, k)
            count, single = np.repeat(np.where(single, 1, count), k), np.repeat(single, k)
            key = np.where(single, spans_hash(block.data, start, start + block.length), key)
        self.start, self.count, self.owner = start, count, owner
        raw, found = block.data.tobytes(), {}
        size = count + block.length - 1
        doc, part_of = ids[owner], ((key >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        self.at = np.array([found.setdefault(raw[a:b], len(found)) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)], np.int64)
        m = len(found)
        least = np.full(m, _LAST)
        np.minimum.at(least, self.at, doc)
        part = np.zeros(m, np.int64)
        part[self.at] = part_of
        passages = list(found)
        # by part, then by bytes: rows of a block come in another order each time that executors read them
        order = np.array(sorted(range(m), key=passages.__getitem__), np.int64)
        order = order[np.argsort(part[order], kind="stable")]
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        self.rows = []
        self.strings = np.zeros(m, np.int64)  # how many strings each passage holds
        self.strings[self.at] = count
        self.order, self.cuts = order, cuts
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            mine = order[cuts[p] : cuts[p + 1]]
            texts = [passages[k] for k in mine.tolist()]
            self.rows.append((p, b"".join(texts), np.array([len(t) for t in texts], np.uint32).tobytes(), least[mine].tobytes()))

    def hits(self, found: pa.Table, ids: np.ndarray) -> np.ndarray:
        """Positions of the strings that a document of smaller id holds, from what the parts returned."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        per = self.strings[self.order]
        least = np.full(int(per.sum()), _LAST)
        edge = np.concatenate([[0], np.cumsum(per)])
        for part, runs, docs in zip(*(found.column(c).to_pylist() for c in ("part", "runs", "docs")), strict=True):
            a, b = edge[self.cuts[part]], edge[self.cuts[part + 1]]
            least[a:b] = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(runs, np.uint32))
        first = np.empty(len(per), np.int64)
        first[self.order] = edge[:-1]
        k = self.count
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        smaller = least[np.repeat(first[self.at], k) + within] < np.repeat(ids[self.owner], k)
        return (np.repeat(self.start, k) + within)[smaller]


def _runs(values: np.ndarray) -> tuple[bytes, bytes]:
    """Equal neighbours as their number and value."""
    cut_ = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return np.diff(np.concatenate([cut_, [len(values)]])).astype(np.uint32).tobytes(), values[cut_].astype(np.int64).tobytes()


def solve_part(messages: Iterable[tuple[bytes, np.ndarray, np.ndarray]], length: int, shard_bytes: int) -> list[np.ndarray]:
    """For each message (passages, sizes, documents) the smallest document of each of its strings."""
    known: dict[bytes, int] = {}
    places = []
    docs: list[int] = []
    for raw, sizes, least in messages:
        stops = np.cumsum(sizes).tolist()
        mine = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip([0, *stops[:-1]], stops, strict=True)], np.int64)
        docs.extend([_LAST] * (len(known) - len(docs)))
        for k, d in zip(mine.tolist(), least.tolist(), strict=True):
            docs[k] = min(docs[k], d)
        places.append(mine)
    sizes = np.array([len(x) for x in known], np.int64)
    data, low = np.frombuffer(b"".join(known), np.uint8), np.array(docs, np.int64)
    del known
    stops = np.cumsum(sizes)
    shards, a = [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(stops, stops[a] - sizes[a] + shard_bytes, "right")))
        shards.append(Shard(data[stops[a] - sizes[a] : stops[b - 1]], sizes[a:b], low[a:b], length))
        a = b
    for k, shard in enumerate(shards):
        for other in shards[:k]:
            shard.take_lower(other)
    least = np.concatenate([s.of_passages() for s in shards]) if shards else np.zeros(0, np.int64)
    per = sizes - length + 1
    first = np.cumsum(per) - per
    out = []
    for mine in places:
        k = per[mine]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out.append(least[np.repeat(first[mine], k) + within])
    return out


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``; ``length`` is ``gram`` or more, ``gram`` a multiple of eight."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = number_of_blocks(rows, block_bytes, least_blocks)
    parts = PARTS * blocks
    dealt = in_blocks(rows, blocks)

    def ids_of(table_: pa.Table) -> np.ndarray:
        return table_.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)

    def announce(table_: pa.Table) -> pa.Table:
        keys, n = Block(table_.column("text"), length, gram).documents_of()
        return sent(table_.column("block")[0].as_py(), keys, {"held": n}, blocks, np.uint32)

    def passages(block: Block, table_: pa.Table, found: pa.Table) -> Passages:
        keys, at = np.unique(block.key, return_inverse=True)
        return Passages(block, ids_of(table_), received(found, keys, ["held"], blocks)[0][at], hot, parts)

    def send(table_: pa.Table, found: pa.Table) -> pa.Table:
        columns = list(zip(*passages(Block(table_.column("text"), length, gram), table_, found).rows, strict=True)) or [[]] * 4
        block = table_.column("block")[0].as_py() if len(table_) else 0
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        part, *others = (pa.array(c, t) for c, t in zip(columns, types, strict=True))
        return pa.table([part, pa.array([block] * len(part), pa.int32()), *others], ["part", "block", "raw", "sizes", "docs"])

    def meet(table_: pa.Table) -> pa.Table:
        columns = (table_.column(c) for c in ("raw", "sizes", "docs"))
        messages_ = ((r.as_py(), np.frombuffer(s.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(d.as_buffer(), np.int64)) for r, s, d in zip(*columns, strict=True))
        found = solve_part(messages_, length, shard_bytes)
        runs, docs_ = zip(*map(_runs, found), strict=True)
        return pa.table([table_.column("block"), table_.column("part"), pa.array(runs, pa.binary()), pa.array(docs_, pa.binary())], ["block", "part", "runs", "docs"])

    def remove(table_: pa.Table, both: pa.Table) -> pa.Table:
        counts = both.filter(pa.compute.is_valid(both.column("held")))
        found = both.filter(pa.compute.is_valid(both.column("runs")))
        block, ids = Block(table_.column("text"), length, gram), ids_of(table_)
        hit = passages(block, table_, counts).hits(found, ids)
        edge = np.zeros(len(block.data) + 1, np.int32)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        cuts = block.offsets[:-1][block.sizes > 0]
        begins[cuts] = gone[cuts]
        removed, spans = (np.concatenate([[0], np.cumsum(x)])[block.offsets] for x in (gone, begins))
        kept = [hashlib.sha256(block.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
        return pa.table([table_.column("doc_id"), pa.array(block.sizes), pa.array(np.diff(removed).astype(np.int64)), pa.array(np.diff(spans).astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    counted = totals(dealt.groupBy("block").applyInArrow(announce, "part int, block int, keys binary, held binary"), ["held"], blocks, np.uint32)
    messages = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send, "part int, block int, raw binary, sizes binary, docs binary")
    solved = messages.repartition(parts, "part").groupBy("part").applyInArrow(meet, "block int, part int, runs binary, docs binary").repartition(blocks, "block")
    none = F.lit(None).cast("binary")
    both = counted.select("block", "part", "held", none.alias("runs"), none.alias("docs")).unionByName(solved.select("block", "part", none.alias("held"), "runs", "docs")).repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
