"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton holds every word sequence of every item. Document words are streamed through it and
the longest match ending at each word is tracked, up to the window length. A match of a whole
window marks its words as hit; so does a whole item that is shorter than a window. Only runs of
words that occur in some item reach the automaton at all; the rest is passed over with NumPy.

Items are taken in shards of bounded size. With more than one shard each passes over the documents for
its hits alone.

Defined results: null or blank text has no words and is not contaminated; an item without words
never occurs; an item without id is listed as the empty string; repeated items count once per id;
an empty benchmark hits nothing; repeated rows each get a row; extra columns pass through ``annotate``
unchanged unless named like its result, which replaces them, and through ``remove_hits`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.session import broadcast_up_to, cut, free_name, small_batches, table
from cadenza.llm.textkit import ALPHANUMERIC, Words, text_slices

WINDOW = 13
COVERAGE = 20  # a document is contaminated when COVERAGE * hit words >= words
SHARD_WORDS = 200_000
BROADCAST_ROWS = 250_000


class SuffixAutomaton:
    """Generalised suffix automaton over items given as lists of word numbers."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[str] = []
        self.windows: dict[int, list[int]] = {}  # state of a window -> items that hold it
        self.whole: dict[int, list[tuple[int, int]]] = {}  # state -> (length, item) of short items
        self.nearest: list[int] = []

    def _clone(self, p: int, q: int, w: int, length: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(length)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w, self.length[last] + 1)
        now = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w, self.length[p] + 1)
        return now

    def build(self, items: list[tuple[str, list[int]]]) -> SuffixAutomaton:
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for k, (name, words) in enumerate(items):
            self.items.append(name)
            state, n = 0, 0
            for w in words:
                state, n = self.step(state, n, w)
                if n == self.window:
                    held = self.windows.setdefault(state, [])
                    if not held or held[-1] != k:
                        held.append(k)
            if 0 < len(words) < self.window:
                self.whole.setdefault(state, []).append((n, k))
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.nearest = [-1] * len(self.link)
        for v in order:
            if v:
                self.nearest[v] = v if v in self.whole else self.nearest[self.link[v]]
        return self

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """State and length of the longest match (at most a window) after one more word."""
        nxt, link, length = self.next, self.link, self.length
        while state and w not in nxt[state]:
            state = link[state]
            n = length[state]
        if w not in nxt[state]:
            return 0, 0
        state, n = nxt[state][w], n + 1
        if n > self.window:
            n = self.window
        while n == self.window and length[link[state]] >= n:
            state = link[state]
        return state, n

    def hits(self, words: list[int], mark: np.ndarray, found: set[int], base: int) -> None:
        """Mark hit words of a run that begins at word ``base``; add the items to ``found``."""
        state = n = 0
        for i, w in enumerate(words):
            state, n = self.step(state, n, w)
            if n == self.window:
                mark[base + i - n + 1 : base + i + 1] = True
                found.update(self.windows[state])
            v, limit = self.nearest[state] if state else -1, n
            while v > 0:
                for k, item in self.whole[v]:
                    if v != state or k <= limit:
                        mark[base + i - k + 1 : base + i + 1] = True
                        found.add(item)
                v = self.nearest[self.link[v]]


def item_shards(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[tuple[np.ndarray, SuffixAutomaton, int]]:
    """(sorted word hashes, automaton over their numbers, shortest useful run) for shards of items, read one after the other."""

    def shard(rows: list[tuple[str, np.ndarray]]) -> tuple[np.ndarray, SuffixAutomaton, int]:
        vocabulary = np.unique(np.concatenate([h for _, h in rows]))
        numbered = [(name, np.searchsorted(vocabulary, h).tolist()) for name, h in rows]
        return vocabulary, SuffixAutomaton(window).build(numbered), min(window, *(len(h) for _, h in rows)) if len(rows) > 1 else min(window, len(rows[0][1]))

    held: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("string").alias("name"), "text").toLocalIterator():
        for _, _, data, offsets in text_slices(pa.array([row.text], pa.string()), 1 << 40):
            h = Words(data, offsets, ALPHANUMERIC).hashes()
            if len(h):
                held.append((row.name or "", h))
                size += len(h)
        if size >= shard_words:
            yield shard(held)
            held, size = [], 0
    if held:
        yield shard(held)


_RESULT = "struct<n_words:long,mark:binary,items:array<string>>"


class _Matcher:
    """Marks and items of the documents in an Arrow column, by one shard."""

    def __init__(self, shard: tuple[np.ndarray, SuffixAutomaton, int] | None) -> None:
        self.vocabulary, self.automaton, self.least = shard or (np.zeros(0, np.uint64), None, 1)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray | None, set[str]]]:
        """For each text its number of words, the hit words (None if there are none) and the items found."""
        vocabulary = self.vocabulary
        for a, b, data, offsets in text_slices(column):
            words = Words(data, offsets, ALPHANUMERIC)
            number = np.full(len(words.starts), -1, np.int64)
            if len(vocabulary):
                h = words.hashes()
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                number = np.where(vocabulary[at] == h, at, -1)
            first = words.first
            known = number >= 0
            begins, stops = known.copy(), known.copy()
            begins[1:] &= ~known[:-1]
            stops[:-1] &= ~known[1:]
            edge = first[1:-1]
            edge = edge[(edge > 0) & (edge < len(known))]
            begins[edge] = known[edge]
            stops[edge - 1] = known[edge - 1]
            s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
            far = e - s >= self.least
            s, e = s[far], e[far]
            owner = np.searchsorted(first, s, "right") - 1
            marks: dict[int, np.ndarray] = {}
            found: dict[int, set[int]] = {}
            for k, x, y in zip(owner.tolist(), s.tolist(), e.tolist(), strict=True):
                mark = marks.setdefault(k, np.zeros(first[k + 1] - first[k], bool))
                self.automaton.hits(number[x:y].tolist(), mark, found.setdefault(k, set()), x - int(first[k]))
            for k in range(b - a):
                names = {self.automaton.items[i] for i in found.get(k, ())}
                yield int(first[k + 1] - first[k]), marks[k] if names else None, names


def _found(match: _Matcher, batch: pa.RecordBatch, earlier: str | None) -> Iterator[tuple[int, np.ndarray | None, set[str]]]:
    """What ``match`` finds in each text of a batch, put together with the hits in ``earlier``."""
    before = batch.column(earlier).to_pylist() if earlier else None
    for k, (n, mark, names) in enumerate(match(batch.column("text"))):
        for old in (before[k] or ()) if before else ():
            names |= set(old["items"])
            was = np.unpackbits(np.frombuffer(old["mark"], np.uint8), count=n).astype(bool)
            mark = was if mark is None else mark | was
        yield n, mark, names


def _scan(docs: DataFrame, shard: tuple[np.ndarray, SuffixAutomaton, int] | None, keep: list[str], name: str, earlier: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, the hits of one shard put together with those in ``earlier``."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(shared.value)
        for batch in batches:
            out = [{"n_words": n, "mark": np.packbits(mark).tobytes() if mark is not None else None, "items": sorted(names)} for n, mark, names in _found(match, batch, earlier)]
            kind = pa.struct([("n_words", pa.int64()), ("mark", pa.binary()), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], [*keep, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` {_RESULT}"]))


def _hits(docs: DataFrame, shard: tuple[np.ndarray, SuffixAutomaton, int]) -> DataFrame:
    """(key, mark, items) of the documents that a shard hits; ``docs``: key, text."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(shared.value)
        for batch in batches:
            got = [(k, np.packbits(mark).tobytes(), sorted(names)) for k, (_, mark, names) in enumerate(match(batch.column("text"))) if names]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([k for k, _, _ in got], pa.int64())), pa.array([m for _, m, _ in got], pa.binary()), pa.array([x for _, _, x in got], pa.list_(pa.string()))], ["key", "mark", "items"])

    return docs.mapInArrow(run, "key string, mark binary, items array<string>")


def _but_last(docs: DataFrame, items: DataFrame, window: int, shard_words: int) -> tuple[DataFrame, tuple[np.ndarray, SuffixAutomaton, int] | None, str | None]:
    """``docs`` with the hits of all shards but the last, that shard, and the name of the column with the hits (None: no such shard).

    Each shard but the last passes over the texts for its hits alone, which are kept by the text's
    digest; the last pass puts them together. Texts are neither copied nor, while hits are few, shuffled.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    hits, waiting = [], None
    for shard in item_shards(items, window, shard_words):
        if waiting is not None:
            hits.append(cut(_hits(docs.select(digest.alias("key"), "text"), waiting)))
        waiting = shard
    if not hits:
        return docs, waiting, None
    found = reduce(DataFrame.unionByName, hits).dropDuplicates(["key", "mark", "items"])
    key, earlier = (free_name(docs.columns, c) for c in ("hit_key", "hit_earlier"))
    found = found.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("mark", "items")).alias(earlier))
    joined = docs.join(broadcast_up_to(cut(found), BROADCAST_ROWS), digest == F.col(key), "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), earlier), waiting, earlier


def annotate(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shard_words: int = SHARD_WORDS, name: str = "contamination") -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``name``: n_words, mark (a bit per word, null if none is hit), items found."""
    keep = [c for c in docs.columns if c.lower() != name.lower()] if keep is None else keep
    docs, shard, earlier = _but_last(docs, items, window, shard_words)
    return _scan(docs, shard, keep, name, earlier)


def digests(name: str = "contamination") -> dict[str, F.Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the column ``name`` of ``annotate``."""
    nibbles = {f"{k:X}": bin(k).count("1") for k in range(16)}
    digits = F.hex(F.col(f"{name}.mark"))
    hit = F.coalesce(sum((n * (F.length(digits) - F.length(F.replace(digits, F.lit(d), F.lit("")))) for d, n in nibbles.items() if n), F.lit(0)), F.lit(0)).cast("long")
    items = F.array_sort(F.array_distinct(F.col(f"{name}.items")))
    words = F.col(f"{name}.n_words")
    return {"n_words": words, "n_hit": hit, "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256), "contaminated": (hit > 0) & (COVERAGE * hit >= words)}


def hit_counts(annotated: DataFrame) -> DataFrame:
    """``annotated`` with n_words, n_hit, n_items, items_sha256 and contaminated, which replace columns so named."""
    new = digests()
    return annotated.select(*(F.col(f"`{c}`") for c in annotated.columns if c.lower() not in new), *(c.alias(n) for n, c in new.items()))


def _without(text: str, mark: np.ndarray) -> str:
    """``text`` without the words marked and what lies between those that follow one another."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), ALPHANUMERIC)
    drop = np.zeros(len(data) + 1, np.int32)
    starts = mark & ~np.concatenate([[False], mark[:-1]])
    stops = mark & ~np.concatenate([mark[1:], [False]])
    np.add.at(drop, words.starts[starts], 1)
    np.add.at(drop, words.ends[stops], -1)
    return data[np.cumsum(drop[:-1]) == 0].tobytes().decode()


def remove_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without contaminated documents, and the other documents without their hit spans.

    A hit span goes from the first byte of its first word to the last byte of its last word.
    ``n_chars``, where there is one, follows the text. Documents without a hit stay as they are, and so
    do all other columns, whatever their names. Both are done where hits are found, in one Python worker for each task.
    """
    columns = docs.columns
    kinds = dict(docs.dtypes)
    docs, shard, earlier = _but_last(docs, items, window, shard_words)
    shared = docs.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _Matcher(shared.value)
        for batch in batches:
            stay, clean = [], {}
            for k, (n, mark, _) in enumerate(_found(match, batch, earlier)):
                if mark is not None and COVERAGE * int(mark.sum()) >= n:
                    continue
                if mark is not None:
                    clean[len(stay)] = _without(batch.column("text")[k].as_py(), mark)
                stay.append(k)
            out = batch.select(columns)
            if len(stay) < batch.num_rows:
                out = out.take(pa.array(stay, pa.int64()))
            cols = {c: out.column(c) for c in columns}
            if clean:
                texts = out.column("text").to_pylist()
                for k, text in clean.items():
                    texts[k] = text
                cols["text"] = pa.array(texts, out.column("text").type)
                if "n_chars" in columns:
                    chars = out.column("n_chars").to_pylist()
                    for k, text in clean.items():
                        chars[k] = len(text)
                    cols["n_chars"] = pa.array(chars, out.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], columns)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = annotate(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hit_counts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
