"""Ordered stitching of words from overlapping windows: commit, clamp, preview, fragments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import flat

EPSILON_MS = 25
LONGEST_OVERLAP, SHORTEST_OVERLAP = 24, 2
BLOCK_MS = 1 << 14
WINDOWS_PER_SLICE = 64


def clamp(rows: DataFrame, stream: str = "stream_id", order: str = "pos") -> DataFrame:
    """Monotone output clock: start' = max(start, previous end'), end' = max(end, start' + 1); the first word stays.

    In closed form end'_i = i + the running maximum of max(end, start + 1) - i, so one window pass does it.
    """
    w = Window.partitionBy(stream).orderBy(order)
    i = F.row_number().over(w).cast("long") - 1
    k = F.when(i == 0, F.col("end_ms")).otherwise(F.greatest("end_ms", F.col("start_ms") + 1) - i)
    rows = rows.withColumn("_k", k).withColumn("_i", i)
    rows = rows.withColumn("_end", F.col("_i") + F.max("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.greatest(F.col("start_ms"), F.coalesce(F.lag("_end").over(w), F.col("start_ms")))
    return rows.withColumn("start_ms", start).withColumn("end_ms", F.col("_end")).drop("_k", "_i", "_end")


def commit(rows: DataFrame, epsilon: int = EPSILON_MS, block_ms: int = BLOCK_MS, windows_per_slice: int = WINDOWS_PER_SLICE) -> DataFrame:
    """Committed words of each stream, as a fold over its windows in order: stream_id, index, start_ms, end_ms, word and both stitch times.

    ``rows``: stream_id, window_seq, pos, word, absolute start_ms, end_ms, stitch_start_ms,
    stitch_end_ms, and ``stable`` (final window, or the word ends within the stride). A word is
    skipped when its stitch end is at most ``epsilon`` past the last emitted one; skipped words
    leave the cursors alone. Blank words and those without stream, window or stitch end are left out.

    No stream is gathered, and one stream spreads over many tasks. An emitted word ends past all
    words before it, so only such words (``_records``) matter, and their ends grow. They meet in
    blocks of ``block_ms``, each of at most that many. What a block emits depends on the ones before
    by the last emitted end alone, of which ``epsilon`` + 1 cases differ, so a block is a table of that many
    exits. Tables are chained from one word that is emitted in any case (more than ``epsilon`` past
    all before it) to the next, which is all that one row ever holds. Places and clamped times are
    sums and maxima over blocks, then within them.
    """
    if block_ms <= epsilon:
        raise ValueError("a block must be longer than epsilon")
    none = -(epsilon + 1)  # a last end that far before a block skips nothing in it
    key = ["stream_id", "_block"]
    end = F.col("stitch_end_ms")
    at = F.pmod(end, F.lit(block_ms)).cast("int")
    free = F.coalesce(end > F.col("_last") + epsilon, F.lit(True))
    item = F.struct(at.alias("at"), free.alias("free"), F.col("_last").isNull().alias("first"), "start_ms", "end_ms", "word", "stitch_start_ms", "stitch_end_ms")
    usable = rows.filter(F.col("stable") & (F.trim("word") != "")).dropna(subset=["stream_id", "window_seq", "stitch_end_ms"])
    # keys that cannot be null: else joins add filters to one side, and the shuffle of blocks is not reused
    block = F.coalesce(F.call_function("div", end - at, F.lit(block_ms)), F.lit(0).cast("long"))
    blocks = _records(usable, windows_per_slice).withColumn("_block", block).groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    later = lambda last, x: F.when(x["at"] > last + epsilon, x["at"]).otherwise(last)
    leave = lambda s: F.aggregate("_items", s + none, later)
    cases = F.sequence(F.lit(0), F.when(F.get("_items", F.lit(0))["free"], 0).otherwise(epsilon))
    tables = blocks.select(*key, F.transform(cases, leave).alias("_exits"))
    chain = F.sum((F.size("_exits") == 1).cast("long")).over(Window.partitionBy("stream_id").orderBy("_block"))
    chains = tables.withColumn("_chain", chain).groupBy("stream_id", "_chain").agg(F.array_sort(F.collect_list(F.struct("_block", "_exits"))).alias("_tables"))

    def follow(acc: Column, t: Column) -> Column:
        case = F.greatest(acc["last"] - block_ms - none, F.lit(0))
        out = F.struct(t["_block"].alias("_block"), (case + none).alias("_enter"))
        return F.struct(F.concat(acc["outs"], F.array(out)).alias("outs"), F.get(t["_exits"], F.least(case, F.size(t["_exits"]) - 1)).alias("last"))

    start = F.struct(F.array().cast("array<struct<_block:bigint,_enter:int>>").alias("outs"), F.lit(0).alias("last"))
    enters = chains.select("stream_id", F.inline(F.aggregate("_tables", start, follow)["outs"]))

    def emit(acc: Column, x: Column) -> Column:
        said = F.struct(F.concat(acc["outs"], F.array(x)).alias("outs"), x["at"].alias("last"))
        return F.when(x["at"] > acc["last"] + epsilon, said).otherwise(acc)

    empty = F.struct(F.slice("_items", F.lit(1), F.lit(0)).alias("outs"), F.col("_enter").alias("last"))
    emitted = blocks.join(enters, key).select(*key, F.aggregate("_items", empty, emit)["outs"].alias("_out"))

    # the clock of `clamp`: end'_i = i + the running maximum of k_i - i
    k = lambda x: F.when(x["first"], x["end_ms"]).otherwise(F.greatest(x["end_ms"], x["start_ms"] + 1))
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = emitted.select(*key, F.size("_out").cast("long").alias("_n"), F.array_max(F.transform("_out", lambda x, i: k(x) - i)).alias("_k"))
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).withColumn("_top", F.max(F.col("_k") - F.col("_base")).over(earlier))
    rows = emitted.join(bases.select(*key, "_base", "_top"), key).select(*key, "_base", "_top", F.posexplode("_out").alias("_i", "_x"))
    rows = rows.withColumn("index", F.col("_base") + F.col("_i")).withColumn("_k", k(F.col("_x")) - F.col("index"))
    here = Window.partitionBy(*key).orderBy("_i")
    before = F.greatest("_top", F.max("_k").over(here.rowsBetween(Window.unboundedPreceding, -1)))
    begin = F.greatest(F.col("_x.start_ms"), F.col("index") - 1 + before)
    until = F.col("index") + F.greatest(before, F.col("_k"))
    return rows.select("stream_id", "index", begin.alias("start_ms"), until.alias("end_ms"), "_x.word", "_x.stitch_start_ms", "_x.stitch_end_ms")


def _records(rows: DataFrame, windows_per_slice: int) -> DataFrame:
    """Those of ``rows`` that end past all before them in their stream, with the latest end before as ``_last``: maxima of slices, then within."""
    key = ["stream_id", "_slice"]
    sliced = rows.withColumn("_slice", F.coalesce(F.call_function("div", F.col("window_seq"), F.lit(windows_per_slice)), F.lit(0).cast("long")))
    tops = sliced.groupBy(*key).agg(F.max("stitch_end_ms").alias("_top"))
    earlier = Window.partitionBy("stream_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*key, F.max("_top").over(earlier).alias("_before"))
    here = Window.partitionBy(*key).orderBy("window_seq", "pos", "word", "start_ms", "end_ms", "stitch_start_ms", "stitch_end_ms").rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest("_before", F.max("stitch_end_ms").over(here))
    return sliced.join(before, key).withColumn("_last", last).filter(F.col("_last").isNull() | (F.col("stitch_end_ms") > F.col("_last"))).drop("_before", "_slice")


def preview(pending: DataFrame, ahead: DataFrame, epsilon: int = EPSILON_MS) -> DataFrame:
    """Pending words, then preview words past the last pending one by more than ``epsilon`` (a cutoff fixed beforehand), clamped."""
    cutoff = pending.groupBy("stream_id").agg(F.max_by("stitch_end_ms", "pos").alias("_last"))
    fresh = ahead.join(cutoff, "stream_id", "left").filter(F.col("_last").isNull() | (F.col("stitch_end_ms") > F.col("_last") + epsilon))
    both = pending.withColumn("_part", F.lit(0)).unionByName(fresh.drop("_last").withColumn("_part", F.lit(1)))
    return clamp(both.withColumn("_order", F.struct("_part", "pos")), order="_order").drop("_part", "_order")


def drop_repeated_fragments(rows: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """Without blank fragments and without fragments equal to the last one kept."""
    kept = rows.filter(F.trim(text) != "")
    before = F.lag(text).over(Window.partitionBy("stream_id").orderBy(order))
    return kept.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(text) != F.col("_before"))).drop("_before")


def merge_fragments(rows: DataFrame, text: str = "text", order: str = "seq") -> DataFrame:
    """(stream_id, text): fragments joined by the longest overlap of 24 down to 2 words between end and beginning."""
    from cadenza.functions.scalars import normalize_edges

    parts = rows.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.filter(F.split(x[text], r"\s+"), lambda w: w != "")).alias("parts"))

    def step(acc: Column, ws: Column) -> Column:
        """Only the last words said can overlap, so those are kept beside the pieces."""
        low_a, low_b = F.transform(acc["tail"], normalize_edges), F.transform(F.slice(ws, F.lit(1), F.lit(LONGEST_OVERLAP)), normalize_edges)
        sizes = F.filter(F.sequence(F.lit(LONGEST_OVERLAP), F.lit(SHORTEST_OVERLAP), F.lit(-1)), lambda k: (k <= F.size(acc["tail"])) & (k <= F.size(ws)))

        def grown(q: Column) -> Column:
            meets = lambda k: F.slice(q["a"], F.size(q["a"]) - k + 1, k) == F.slice(q["b"], F.lit(1), k)
            k = F.coalesce(F.get(F.filter(sizes, meets), F.lit(0)), F.lit(0))
            new = F.slice(ws, k + 1, F.greatest(F.size(ws) - k, F.lit(0)))
            both = F.concat(acc["tail"], F.slice(new, F.greatest(F.size(new) - LONGEST_OVERLAP, F.lit(0)) + 1, F.lit(LONGEST_OVERLAP)))
            tail = F.slice(both, F.greatest(F.size(both) - LONGEST_OVERLAP, F.lit(0)) + 1, F.lit(LONGEST_OVERLAP))
            return F.struct(F.when(F.size(new) > 0, tail).otherwise(acc["tail"]).alias("tail"), F.concat(acc["outs"], F.array(new)).alias("outs"))

        return F.get(F.transform(F.array(F.struct(low_a.alias("a"), low_b.alias("b"))), grown), F.lit(0))

    zero = F.struct(F.array().cast("array<string>").alias("tail"), F.array().cast("array<array<string>>").alias("outs"))
    return parts.select("stream_id", F.array_join(F.flatten(F.aggregate("parts", zero, step)["outs"]), " ").alias("text"))


def side_times(words: DataFrame, side: DataFrame) -> DataFrame:
    """Times of a side model for streams where it has the same words in the same order; otherwise the words keep theirs.

    The own times stay as the stitch clock; ``applied`` says which it was.
    """
    both = words.join(side.select("stream_id", "pos", F.col("word").alias("_w"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")), ["stream_id", "pos"], "full")
    ok = F.min(F.coalesce(F.col("word") == F.col("_w"), F.lit(False)).cast("int")).over(Window.partitionBy("stream_id")) == 1
    rows = both.withColumn("applied", ok).filter("word is not null")
    return rows.select("stream_id", "pos", "word", F.when(F.col("applied"), F.col("_s")).otherwise(F.col("start_ms")).alias("start_ms"), F.when(F.col("applied"), F.col("_e")).otherwise(F.col("end_ms")).alias("end_ms"), F.col("start_ms").alias("stitch_start_ms"), F.col("end_ms").alias("stitch_end_ms"), "applied")


def side_times_by_row(rows: DataFrame, text: str, both: Callable[[pa.RecordBatch], tuple[flat.RowWords, flat.RowWords]]) -> DataFrame:
    """``side_times`` of streams whose row (stream_id, ``text``) gives their words and the side model's; equal stream ids keep their rows. No shuffle."""
    kind = rows.schema["stream_id"].dataType.simpleString()
    names = ["stream_id", "pos", "word", "start_ms", "end_ms", "stitch_start_ms", "stitch_end_ms", "applied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, text):
                own, side = both(part)
                applied = _same_words(part.num_rows, own, side)
                mine, theirs = applied[own[0]], applied[side[0]]
                times = []
                for k in (3, 4):
                    times.append(own[k].copy())
                    times[-1][mine] = side[k][theirs]
                columns = [pc.take(part.column("stream_id"), pa.array(own[0])), pa.array(own[1]), own[2].cast(pa.string()), *map(pa.array, (*times, own[3], own[4], mine))]
                found = pa.RecordBatch.from_arrays(columns, names)
                yield found.filter(pc.is_valid(own[2])) if own[2].null_count else found

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return rows.select("stream_id", text).mapInArrow(run, f"stream_id {kind}, pos long, word string, start_ms long, end_ms long, stitch_start_ms long, stitch_end_ms long, applied boolean")


def _same_words(n: int, own: flat.RowWords, side: flat.RowWords) -> np.ndarray:
    """Whether each row has the same words at the same places on both sides."""
    same = np.bincount(own[0], minlength=n) == np.bincount(side[0], minlength=n)
    mine, theirs = np.flatnonzero(same[own[0]]), np.flatnonzero(same[side[0]])
    equal = pc.equal(own[2].take(pa.array(mine)), side[2].take(pa.array(theirs))).fill_null(False).to_numpy(zero_copy_only=False) & (own[1][mine] == side[1][theirs])
    same[own[0][mine[~equal]]] = False
    return same
