"""Token counts without token ids: pieces are counted once per distinct pre-token.

A first pass gathers the distinct pre-tokens of all documents with their frequencies; each is
given to the tokenizer once. A second pass forms per-document pre-token frequencies and joins them
to those counts. The most frequent pre-tokens, a bounded number of them, are joined within the
task; the others are joined by a shuffle on the pre-token, where by construction no key is hot.
Sums per document finish the count.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows each get a row with
the same counts; a null ``doc_id`` stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.packing import text_chunks
from cadenza.llm.pieces import PieceTable
from cadenza.llm.session import cut, small_batches, table, value_at_rank
from cadenza.llm.textkit import spans_hash

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
FREQUENT = 1 << 18
_FLUSH = 400_000


@lru_cache(maxsize=2)
def _pieces(name: str) -> PieceTable:
    return PieceTable(name)


def _simple_and_other(pieces: PieceTable, texts: list[str]) -> tuple[list[int], list[int]]:
    simple = [pieces.simple(t) for t in texts]
    return [i for i, s in enumerate(simple) if s], [i for i, s in enumerate(simple) if not s]


def distinct_pieces(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(piece, key, freq, n): every distinct pre-token, its hash (null if not simple), how often it occurs, and how many tokens it makes."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(tokenizer)
        held: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["piece", "freq"])

        for batch in batches:
            for _, texts in text_chunks([t or "" for t in batch.column("text").to_pylist()]):
                fast, slow = _simple_and_other(pieces, texts)
                units, starts, ends, _, joined = pieces.segment([texts[i] for i in fast])
                _, index, counts = np.unique(spans_hash(units, starts, ends), return_index=True, return_counts=True)
                for s, e, n in zip(starts[index].tolist(), ends[index].tolist(), counts.tolist(), strict=True):
                    piece = joined[s:e]
                    held[piece] = held.get(piece, 0) + n
                for i in slow:
                    for piece in pieces.split(texts[i]):
                        held[piece] = held.get(piece, 0) + 1
                if len(held) > _FLUSH:
                    yield from flush()
                    held = {}
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(tokenizer)
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                names = part.column("piece").to_pylist()
                n = list(map(len, pieces.ids_of(names)))
                plain = np.array([pieces.simple(x) for x in names])
                keys = np.where(plain, pieces.key([x if p else "" for x, p in zip(names, plain, strict=True)]).view(np.int64), 0)
                yield pa.RecordBatch.from_arrays([part.column("piece"), pa.array(keys, mask=~plain), part.column("freq"), pa.array(n, pa.int64())], ["piece", "key", "freq", "n"])

    found = docs.select("text").mapInArrow(gather, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(count, "piece string, key long, freq long, n long")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    counted = cut(distinct_pieces(docs, tokenizer))
    least = value_at_rank(counted.filter("key is not null"), "freq", frequent)
    common = counted.filter((F.col("freq") >= least) & F.col("key").isNotNull()).select("key", "n").toPandas()  # at most `frequent` rows
    keys, n = common["key"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int32)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], n[order]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row with the tokens of its frequent pre-tokens, and its other pre-tokens with their frequencies."""
        pieces = _pieces(tokenizer)
        known, tokens = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, texts in text_chunks([t or "" for t in batch.column("text").to_pylist()]):
                fast, slow = _simple_and_other(pieces, texts)
                base = np.zeros(len(texts), np.int64)
                rest: list[dict[str, int]] = [{} for _ in texts]
                if fast:
                    units, starts, ends, first, joined = pieces.segment([texts[i] for i in fast])
                    h = spans_hash(units, starts, ends)
                    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                    sums = np.concatenate([[0], np.cumsum(np.where(hit, tokens[at], 0), dtype=np.int64)]) if len(known) else np.zeros(len(h) + 1, np.int64)
                    base[fast] = sums[first[1:]] - sums[first[:-1]]
                    miss = np.flatnonzero(~hit)
                    owner = np.searchsorted(first, miss, "right") - 1
                    for k, s, e in zip(owner.tolist(), starts[miss].tolist(), ends[miss].tolist(), strict=True):
                        d = rest[fast[k]]
                        piece = joined[s:e]
                        d[piece] = d.get(piece, 0) + 1
                for i in slow:
                    own = pieces.split(texts[i])
                    plain = [p for p in own if pieces.simple(p)]
                    h = pieces.key(plain)
                    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                    base[i] = int(tokens[at][hit].sum()) if len(known) else 0
                    missed = [p for p, found in zip(plain, hit.tolist(), strict=True) if not found]
                    for piece in missed + [p for p in own if not pieces.simple(p)]:
                        rest[i][piece] = rest[i].get(piece, 0) + 1
                raw = [t.encode() for t in texts]
                identity = pa.array([xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + len(texts)], pa.int64()), identity, pa.array([len(r) for r in raw], pa.int64()), pa.array(base), pa.array([list(d.items()) for d in rest], pa.map_(pa.string(), pa.int64()))], ["doc_id", "identity", "n_bytes", "base", "rest"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(spread, "doc_id long, identity long, n_bytes long, base long, rest map<string,long>")
    # each row of docs also sends one row under a key that no pre-token has, spread over the tasks
    own = F.struct(F.concat(F.lit("\0\0"), F.col("identity").cast("string")).alias("key"), F.lit(None).cast("long").alias("value"))
    rows = found.select("doc_id", "identity", "n_bytes", "base", F.explode(F.concat(F.array(own), F.map_entries("rest"))).alias("e"))
    is_own = F.col("e.value").isNull()
    rows = rows.select("doc_id", "identity", F.when(is_own, F.col("n_bytes")).alias("n_bytes"), F.when(is_own, F.col("base")).alias("base"), F.col("e.key").alias("piece"), F.col("e.value").alias("times"))
    rare = counted.filter((F.col("freq") < least) | F.col("key").isNull()).select("piece", "n")
    joined = rows.join(rare, "piece", "left")
    # rows of one id and text are alike: their sum is shared among them
    per = joined.groupBy("doc_id", "identity").agg(F.max("n_bytes").alias("n_bytes"), F.max("base").alias("base"), F.count("n_bytes").alias("rows"), F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("rest"))
    return per.select("doc_id", "n_bytes", (F.col("base") + F.expr("rest div rows")).alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).drop("row")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
