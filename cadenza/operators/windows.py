"""Count-based overlapping windows over ordered samples, and fixed-size slices.

Windows are anchored at a stream's first sample: full windows every ``chunk - overlap`` samples and
one final window with what is left. All arithmetic is on counts, so no shuffle is needed where a row
holds a stream. Streams whose samples come in many rows are dealt into even blocks (``even_blocks``)
with the samples around them that their windows or frames need: one shuffle, by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def full_windows(n: Column, chunk: int, overlap: int) -> Column:
    stride = max(chunk - overlap, 1)
    return F.when(n < chunk, F.lit(0).cast("long")).otherwise(F.floor((n - chunk) / stride) + 1)


def hop_windows(streams: DataFrame, n: str, chunk: int, overlap: int, least_final: int = 1) -> DataFrame:
    """Rows of ``streams`` per window: window_seq, start_sample, n_samples, is_final. ``n`` names the sample count."""
    stride = max(chunk - overlap, 1)
    full = full_windows(F.col(n), chunk, overlap)
    left = F.col(n) - full * stride
    count = full + F.when(left >= least_final, 1).otherwise(0)
    rows = streams.withColumn("_full", full).withColumn("window_seq", F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))))
    final = F.col("window_seq") == F.col("_full")
    rows = rows.withColumn("start_sample", F.col("window_seq") * stride).withColumn("n_samples", F.when(final, F.col(n) - F.col("_full") * stride).otherwise(chunk).cast("long"))
    return rows.withColumn("is_final", final).drop("_full")


def window_samples(windows: DataFrame, samples: str) -> DataFrame:
    """``windows`` with the ``window`` of their array ``samples``."""
    return windows.withColumn("window", F.slice(F.col(samples), (F.col("start_sample") + 1).cast("int"), F.col("n_samples").cast("int")))


def slices(rows: DataFrame, body: str, size: int) -> DataFrame:
    """``body`` cut into parts of ``size`` characters (or bytes): slot, part."""
    n = F.length(body)
    last = F.greatest(F.ceil(n / size) - 1, F.lit(0))
    cut = rows.filter(n > 0).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return cut.withColumn("part", F.substring(F.col(body), (F.col("slot") * size + 1).cast("int"), F.lit(size)))


def frame_starts(n: Column, hop: int) -> Column:
    """First sample of each analysis frame: floor(n / hop) frames."""
    frames = F.floor(n / hop)
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0).cast("long"), frames - 1), lambda k: k * hop)).otherwise(F.array().cast("array<bigint>"))


def with_places(rows: DataFrame, samples: str = "samples", order: str = "seq") -> DataFrame:
    """``rows`` (stream_id, ``order``, ``samples``) with first_sample, the samples of the stream before, and stream_samples, all it has.

    (stream_id, order) names a row; rows without either, or without samples, are left out. Only sizes are summed by stream.
    """
    held = rows.dropna(subset=["stream_id", order, samples]).filter(F.size(samples) > 0)
    w = Window.partitionBy("stream_id")
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.select("stream_id", order, F.size(samples).cast("long").alias("_n"))
    places = sizes.select("stream_id", order, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("first_sample"), F.sum("_n").over(w).alias("stream_samples"))
    return held.join(places, ["stream_id", order])


def even_blocks(rows: DataFrame, size: int, before: int, after: int, samples: str = "samples") -> DataFrame:
    """(stream_id, block, first_sample, stream_samples, samples): each ``size`` samples of a stream, with up to ``before`` and ``after`` around.

    ``rows`` are as ``with_places`` gives them, of any sizes: a row sends each block what lies in it or around it,
    so a sample travels once and the share (before + after) / size of them again, and no task holds a stream.
    """
    first, n = F.col("first_sample"), F.size(samples)
    div = lambda a: F.call_function("div", a, F.lit(size))
    lowest = div(F.greatest(first - after, F.lit(0)))
    highest = F.least(div(first + n - 1 + before), div(F.col("stream_samples") - 1))
    sent = rows.withColumn("block", F.explode(F.sequence(lowest, highest)))
    begin = F.greatest(first, F.col("block") * size - before)
    end = F.least(first + n, (F.col("block") + 1) * size + after)
    part = F.slice(F.col(samples), (begin - first + 1).cast("int"), (end - begin).cast("int"))
    sent = sent.filter(end > begin).select("stream_id", "block", "stream_samples", F.struct(begin.alias("at"), part.alias("part")).alias("_part"))
    grouped = sent.groupBy("stream_id", "block").agg(F.max("stream_samples").alias("stream_samples"), F.array_sort(F.collect_list("_part")).alias("_parts"))
    return grouped.select("stream_id", "block", F.get("_parts", F.lit(0))["at"].alias("first_sample"), "stream_samples", F.flatten("_parts.part").alias("samples"))


def hop_windows_of_rows(rows: DataFrame, chunk: int, overlap: int, least_final: int = 1, samples: str = "samples", order: str = "seq", windows_per_block: int = 64) -> DataFrame:
    """``hop_windows`` with their samples as ``window``, of streams whose samples come in rows by ``order``.

    A block holds ``windows_per_block`` strides and what the last window in it takes beyond.
    """
    stride = max(chunk - overlap, 1)
    blocks = even_blocks(with_places(rows, samples, order), stride * windows_per_block, 0, max(chunk - stride, 0), samples)
    full = full_windows(F.col("stream_samples"), chunk, overlap)
    left = F.col("stream_samples") - full * stride
    k = F.col("window_seq")
    place = F.col("block") * windows_per_block
    cut = blocks.withColumn("window_seq", F.explode(F.sequence(place, place + windows_per_block - 1)))
    cut = cut.withColumn("is_final", k == full).filter((k < full) | (F.col("is_final") & (left >= least_final)))
    cut = cut.withColumn("start_sample", k * stride).withColumn("n_samples", F.when(F.col("is_final"), left).otherwise(chunk).cast("long"))
    window = F.slice("samples", (F.col("start_sample") - F.col("first_sample") + 1).cast("int"), F.col("n_samples").cast("int"))
    return cut.select("stream_id", "window_seq", "start_sample", "n_samples", "is_final", window.alias("window"))
