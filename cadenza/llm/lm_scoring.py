"""Cross-entropy difference of matched n-gram models.

A target model is counted on the trusted documents (label quality 1), a background model on all
documents. Both share one vocabulary (every word of the corpus), one order (words and word pairs)
and one smoothing: half the weight on the pair's share of its context, half on the word's share of
all words with ``ADDED`` added to each count. After each word the probabilities of all words and of
the text's end sum to one. A document's score is the mean over its words of the target loss less the background loss, in nats:
low scores read like the target.

Every word and every pair is counted. Documents are dealt into blocks by a hash, and blocks exchange
the counts of their words and pairs with parts of the key space (``exchange``): what is gathered
grows with the input, no task holds more than a block or a part, and no key is hot. Words and pairs
are told apart by 64-bit hashes.

Defined results: null or blank text has no words, losses and difference null; repeated rows each get
a row and count as often as they occur; a null ``doc_id`` is never a target; without any target the
target model is uniform; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.exchange import BLOCK_BYTES, LEAST_BLOCKS, in_blocks, number_of_blocks, received, sent, totals
from cadenza.llm.session import broadcast_up_to, small_batches, table
from cadenza.llm.textkit import ALPHANUMERIC, Words, mix, text_slices

PAIR_WEIGHT = 0.5
ADDED = 0.5  # added to every word count
BROADCAST_ROWS = 1_000_000
_FLUSH = 4_000_000
_START = np.uint64(0x9E3779B97F4A7C15)  # stands before a text's first word
_WORD, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes of all words of all documents and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text")):
                held.append(Words(data, offsets, ALPHANUMERIC).hashes())
                if sum(map(len, held)) > _FLUSH:
                    yield from flush()
                    held = []
        yield from flush()

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def block_keys(text: pa.ChunkedArray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words and of the pairs that they end, whether each is of a target, the first word of each text, and the texts begun."""
    words, pairs, own, first, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(1, np.int64)], 0
    for a, b, data, offsets in text_slices(text):
        found = Words(data, offsets, ALPHANUMERIC)
        h = found.hashes()
        if len(h):
            before = np.concatenate([h[:1], h[:-1]])
            before[found.first[:-1][found.first[:-1] < len(h)]] = _START
            pairs.append(mix(mix(before ^ _PAIR) + h))
        words.append(mix(h ^ _WORD))
        own.append(np.repeat(target[a:b], np.diff(found.first)))
        first.append(found.first[1:] + at)
        at += len(h)
    first = np.concatenate(first)
    return np.concatenate(words), np.concatenate(pairs), np.concatenate(own), first, np.flatnonzero(np.diff(first))


def block_counts(text: pa.ChunkedArray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block, their counts in the targets and in all, the place of each word, pair and the start among them, and the first words."""
    words, pairs, own, first, begun = block_keys(text, target)
    start = mix(np.array([_START ^ _WORD]))
    keys, at = np.unique(np.concatenate([words, pairs, np.repeat(start, len(begun))]), return_inverse=True)
    n = np.bincount(at, minlength=len(keys))
    t = np.bincount(at[np.concatenate([own, own, target[begun]])], minlength=len(keys))
    return keys, t, n, at, first


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for every row of ``docs``, from the counts of all words and all pairs."""
    small_batches(docs.sparkSession)
    ids = broadcast_up_to(targets.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("target_id")).distinct(), BROADCAST_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", F.col("target_id").isNotNull().alias("target"), "text")
    blocks = number_of_blocks(rows, block_bytes, least_blocks)
    dealt = in_blocks(rows, blocks)

    def send(table_: pa.Table) -> pa.Table:
        keys, t, n, *_ = block_counts(table_.column("text"), table_.column("target").to_numpy())
        return sent(table_.column("block")[0].as_py(), keys, {"t": t, "n": n}, blocks)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of words in the targets and in all."""
        t = n = 0
        for batch in batches:
            target = batch.column("target").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_slices(batch.column("text")):
                own = np.diff(Words(data, offsets, ALPHANUMERIC).first)
                t, n = t + int(own[target[a:b]].sum()), n + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([n])], ["t", "n"])

    total = rows.select("target", "text").mapInArrow(words, "t long, n long").agg(F.sum("t"), F.sum("n")).first()
    total = [total[0] or 0, total[1] or 0]
    distinct = max(word_counts(rows).count(), 1)

    def score(table_: pa.Table, found: pa.Table) -> pa.Table:
        keys, _, _, at, first = block_counts(table_.column("text"), table_.column("target").to_numpy())
        t, n = received(found, keys, ["t", "n"], blocks)
        m = int(first[-1])
        word, pair = at[:m], at[m : 2 * m]
        before = np.concatenate([word[:1], word[:-1]])
        before[first[:-1][np.diff(first) > 0]] = at[-1] if m else 0
        length, losses = np.diff(first), []
        for counts, all_ in ((t, total[0]), (n, total[1])):
            alone = (counts[word] + ADDED) / (all_ + ADDED * distinct)
            context = counts[before]
            p = np.where(context > 0, PAIR_WEIGHT * counts[pair] / np.maximum(context, 1) + (1 - PAIR_WEIGHT) * alone, alone)
            sums = np.concatenate([[0.0], np.cumsum(-np.log(p))])
            losses.append((sums[first[1:]] - sums[first[:-1]]) / np.maximum(length, 1))
        none = length == 0
        return pa.table([table_.column("doc_id"), pa.array(length.astype(np.int64)), *(pa.array(x, mask=none) for x in (*losses, losses[0] - losses[1]))], ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    counted = totals(dealt.groupBy("block").applyInArrow(send, "part int, block int, keys binary, t binary, n binary"), ["t", "n"], blocks)
    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_entropy_difference(docs, table(spark, sf_dir, "labels").filter("quality = 1"))
