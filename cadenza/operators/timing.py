"""Times of words from token places: spans, interval overlap, proportional bounds, monotone clamps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import flat
from cadenza.functions.scalars import frame_to_ms, token_to_ms


def word_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(stream_id, pos, word, start, end): words between white space with byte offsets."""
    gaps = F.split(F.col(text), r"\S+", -1)
    found = F.regexp_extract_all(F.col(text), F.lit(r"\S+"), F.lit(0))
    rows = docs.select("stream_id", F.posexplode(F.arrays_zip(found.alias("word"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))).alias("pos", "x"))
    rows = rows.select("stream_id", F.col("pos").cast("long").alias("pos"), "x.word", F.octet_length("x.gap").cast("long").alias("_gap"), F.octet_length("x.word").cast("long").alias("_n"))
    end = F.sum(F.col("_gap") + F.col("_n")).over(Window.partitionBy("stream_id").orderBy("pos"))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("_n")).select("stream_id", "pos", "word", "start", "end")


def overlap_bounds(words: DataFrame, tokens: DataFrame, band: int = 64) -> DataFrame:
    """``words`` with first and last token whose span overlaps theirs (null if none).

    words: stream_id, pos, start, end; tokens: stream_id, token, start, end. Both sides are dealt
    into bands of ``band`` bytes, so the interval condition meets an equality on (stream, band) and
    no nested loop arises.
    """
    w = words.withColumn("_band", F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(band)), F.call_function("div", F.greatest(F.col("end") - 1, F.col("start")), F.lit(band)))))
    t = tokens.select(F.col("stream_id").alias("_stream"), "token", F.col("start").alias("_ts"), F.col("end").alias("_te"), F.explode(F.sequence(F.call_function("div", F.col("start"), F.lit(band)), F.call_function("div", F.greatest(F.col("end") - 1, F.col("start")), F.lit(band)))).alias("_there"))
    meets = (w["stream_id"] == t["_stream"]) & (w["_band"] == t["_there"]) & (t["_te"] > w["start"]) & (t["_ts"] < w["end"])
    return w.join(t, meets, "left").groupBy(*(w[c] for c in words.columns)).agg(F.min("token").alias("first_token"), F.max("token").alias("last_token"))


def overlap_bounds_by_row(docs: DataFrame, text: str = "text") -> DataFrame:
    """(stream_id, pos, first_token, last_token): ``overlap_bounds`` of the words of texts whose row holds the tokens too, an array of (token, start, end). No shuffle.

    Where starts and ends of tokens do not fall, as in a text's tokens, those that a word overlaps stand together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, text):
                of, begin, end, offsets = flat.split_words(part.column(text))
                base = offsets[of]
                first, last, none = _overlaps(of, begin - base, end - base, *flat.items(part.column("tokens"), "token", "start", "end"))
                token = [pa.array(x, mask=none) for x in (first, last)]
                times = pa.StructArray.from_arrays([pa.array(flat.places(of)), *token], ["pos", "first_token", "last_token"])
                yield pa.RecordBatch.from_arrays([part.column("stream_id"), flat.lists(np.searchsorted(of, np.arange(part.num_rows + 1)), times)], ["stream_id", "found"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    kind = docs.schema["stream_id"].dataType.simpleString()
    found = docs.select("stream_id", text, "tokens").mapInArrow(run, f"stream_id {kind}, found array<struct<pos:long,first_token:long,last_token:long>>")
    return found.select("stream_id", F.inline("found"))


def _overlaps(of: np.ndarray, begin: np.ndarray, end: np.ndarray, held: np.ndarray, token: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest token of row ``of`` that each span overlaps, and whether there is none; ``held``: each token's row."""
    step = (np.diff(held) == 0) & ((np.diff(start) < 0) | (np.diff(stop) < 0) | (np.diff(token) < 0))
    mixed = np.unique(held[1:][step])
    span = int(max(map(np.max, (x for x in (start, stop, end, [0]) if len(x))))) + 2
    low = np.searchsorted(held * span + np.maximum(stop, 0), of * span + begin, "right")  # the first that ends beyond the begin
    high = np.searchsorted(held * span + np.maximum(start, 0), of * span + end, "left") - 1
    none = low > high
    first, last = (np.concatenate([token, [0]])[np.where(none, len(token), k)] for k in (low, high))
    for row in mixed.tolist():  # tokens in no order: each word against all of its text
        mine, theirs = np.flatnonzero(of == row), np.flatnonzero(held == row)
        for at in range(0, len(mine), 64):
            x = mine[at : at + 64]
            meets = (stop[theirs] > begin[x, None]) & (start[theirs] < end[x, None])
            none[x] = ~meets.any(1)
            first[x] = np.where(meets, token[theirs], np.iinfo(np.int64).max).min(1)
            last[x] = np.where(meets, token[theirs], np.iinfo(np.int64).min).max(1)
    return first, last, none


def proportional_bounds(start, end, length, tokens):  # noqa: ANN001, ANN201
    """Token bounds in proportion to a span's place in a text: at least one token, within the tokens there are."""
    first = F.least(F.call_function("div", start * tokens, length), tokens - 1)
    last = F.least(F.greatest(F.call_function("div", end * tokens + length - 1, length), first + 1), tokens)
    return first, last


def estimate(words: DataFrame) -> DataFrame:
    """``words`` with start_ms and end_ms from their place among ``tokens`` tokens over ``duration_ms``.

    words: stream_id, pos, start, end (bytes), length (of the text), tokens, duration_ms. Ends grow
    by at least one until the duration caps them; in closed form, so one window pass.
    """
    first, last = proportional_bounds(F.col("start"), F.col("end"), F.col("length"), F.col("tokens"))
    rows = words.withColumn("_s", token_to_ms(first, F.col("tokens"), F.col("duration_ms"))).withColumn("_e", token_to_ms(last, F.col("tokens"), F.col("duration_ms")))
    w = Window.partitionBy("stream_id").orderBy("pos")
    i = F.row_number().over(w).cast("long") - 1
    rows = rows.withColumn("_i", i).withColumn("_k", F.greatest(F.col("_e"), F.col("_s") + 1) - F.col("_i"))
    end = F.least(F.col("duration_ms"), F.col("_i") + F.max("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("end_ms", end)
    start = F.least(F.greatest(F.col("_s"), F.coalesce(F.lag("end_ms").over(w), F.lit(0).cast("long"))), F.col("end_ms"))
    return rows.withColumn("start_ms", start).drop("_s", "_e", "_i", "_k")


def token_spans(prefixes: DataFrame) -> DataFrame:
    """(stream_id, token, start, end): spans of tokens from lengths of decoded prefixes; only those that lengthen the text.

    prefixes: stream_id, token, length.
    """
    w = Window.partitionBy("stream_id").orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    rows = prefixes.withColumn("start", F.coalesce(F.max("length").over(w), F.lit(0).cast("long")))
    return rows.filter("length > start").select("stream_id", "token", "start", F.col("length").alias("end"))


def words_from_frames(words: DataFrame, frames: DataFrame, n_frames: int, n_tokens: str, duration: str, hop: int = 160, subsample: int = 8, rate: int = 16_000, offset: int = 0) -> DataFrame:
    """``words`` with times from the frames of their tokens.

    words: stream_id, pos, token_start, token_end and the columns ``n_tokens`` and ``duration``;
    frames: stream_id, token, first, last. A word without frames takes the frame in proportion to its
    middle token. It ends where the next word starts, if that is later, else after its last frame.
    """
    keys = words.columns
    spans = frames.select(F.col("stream_id").alias("_stream"), F.col("token").alias("_there"), "first", "last")
    held = F.when(F.col("token_end") > F.col("token_start"), F.sequence("token_start", F.col("token_end") - 1))
    each = words.withColumn("_token", F.explode_outer(held))
    found = each.join(spans, (each["stream_id"] == spans["_stream"]) & (each["_token"] == spans["_there"]), "left")
    grouped = found.groupBy(*keys).agg(F.min("first").alias("_f"), F.max("last").alias("_l"))
    middle = F.call_function("div", F.call_function("div", F.col("token_start") + F.col("token_end"), F.lit(2)) * n_frames, F.greatest(F.col(n_tokens), F.lit(1)))
    grouped = grouped.withColumn("_f", F.coalesce("_f", F.least(middle, F.lit(n_frames - 1)))).withColumn("_l", F.coalesce("_l", F.col("_f")))
    following = F.lead("_f").over(Window.partitionBy("stream_id").orderBy("pos"))
    end = F.when(following > F.col("_f"), following).otherwise(F.col("_l") + 1)
    at = lambda f: frame_to_ms(f, hop, subsample, rate, F.lit(offset), F.col(duration))
    return grouped.withColumn("_to", end).withColumn("start_ms", at(F.col("_f"))).withColumn("end_ms", at(F.col("_to"))).drop("_f", "_l", "_to")


def words_from_frames_by_row(streams: DataFrame, n_frames: int, n_tokens: str, duration: str, hop: int = 160, subsample: int = 8, rate: int = 16_000, offset: int = 0) -> DataFrame:
    """(stream_id, pos, start_ms, end_ms): ``words_from_frames`` of streams whose row holds both. No shuffle.

    streams: stream_id, ``words``, an array of (pos, token_start, token_end) in order of pos, ``frames``, one of (token, first, last), and
    the columns ``n_tokens`` and ``duration``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, pos, begin, end = flat.items(batch.column("words"), "pos", "token_start", "token_end")
            held, token, first, last = flat.items(batch.column("frames"), "token", "first", "last")
            total = np.maximum(batch.column("n_tokens").to_numpy(), 1)
            middle = np.minimum(_div(_div(begin + end, 2) * n_frames, total[of]), n_frames - 1)
            low, high, none = _extremes(of, begin, end, held, token, first, last)
            low = np.where(none, middle, low)
            high = np.where(none, low, high)
            following = np.concatenate([low[1:], [0]])[: len(low)]
            more = np.concatenate([of[1:] == of[:-1], [False]])[: len(of)] & (following > low)
            found = pa.StructArray.from_arrays([pa.array(x) for x in (pos, low, np.where(more, following, high + 1))], ["pos", "_f", "_to"])
            yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("duration"), flat.lists(np.searchsorted(of, np.arange(batch.num_rows + 1)), found)], ["stream_id", "duration", "found"])

    kind = streams.schema["stream_id"].dataType.simpleString()
    rows = streams.select("stream_id", "words", "frames", F.col(n_tokens).cast("long").alias("n_tokens"), F.col(duration).cast("long").alias("duration"))
    found = rows.mapInArrow(run, f"stream_id {kind}, duration long, found array<struct<pos:long,_f:long,_to:long>>").select("stream_id", "duration", F.inline("found"))
    at = lambda f: frame_to_ms(F.col(f), hop, subsample, rate, F.lit(offset), F.col("duration"))
    return found.select("stream_id", "pos", at("_f").alias("start_ms"), at("_to").alias("end_ms"))


def _div(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Whole division that cuts towards zero, as SQL's does."""
    return np.abs(a) // b * np.sign(a)


def _extremes(of: np.ndarray, begin: np.ndarray, end: np.ndarray, held: np.ndarray, token: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least ``first`` and largest ``last`` of row ``of``'s frames whose token is in [begin, end), and whether there is none."""
    order = np.lexsort((token, held))
    low = min((int(x.min()) for x in (token, begin) if len(x)), default=0)
    span = max((int(x.max()) for x in (token, end) if len(x)), default=0) - low + 2
    keys = (held * span + token - low)[order]
    a, b = (np.searchsorted(keys, of * span + x - low) for x in (begin, end))
    none = a >= b
    edges = np.stack([a[~none], b[~none]], 1).ravel()
    out = []
    for values, f, beyond in ((first, np.minimum, np.iinfo(np.int64).max), (last, np.maximum, np.iinfo(np.int64).min)):
        got = np.zeros(len(of), np.int64)
        got[~none] = f.reduceat(np.concatenate([values[order], [beyond]]), edges)[::2] if len(edges) else []
        out.append(got)
    return *out, none
