"""Utterances by gaps and sentence ends, paragraphs, and the nested result document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import flat
from cadenza.functions.scalars import ends_sentence, join_words, nonneg, utterance_id


def boundaries(words: DataFrame, gap_ms: int, order: str = "pos") -> DataFrame:
    """``words`` with ``utterance`` (from 1): a new one after a gap of ``gap_ms`` or more, or after a sentence end.

    ``words``: stream_id, start_ms, end_ms, word and the order column. One shuffle by stream.
    """
    w = Window.partitionBy("stream_id").orderBy(order)
    last = F.lag("end_ms").over(w)
    opens = last.isNull() | (nonneg(F.col("start_ms") - last) >= gap_ms) | ends_sentence(F.lag("word").over(w))
    return words.withColumn("_opens", opens.cast("int")).withColumn("utterance", F.sum("_opens").over(w)).drop("_opens")


def utterances(words: DataFrame, gap_ms: int, order: str = "pos") -> DataFrame:
    """(stream_id, utterance, id, start_ms, end_ms, n_words, transcript)."""
    marked = boundaries(words, gap_ms, order)
    grouped = marked.groupBy("stream_id", "utterance").agg(F.array_sort(F.collect_list(F.struct(order, "word", "start_ms", "end_ms"))).alias("ws"))
    return grouped.select("stream_id", "utterance", utterance_id(F.col("utterance")).alias("id"), F.col("ws")[0]["start_ms"].alias("start_ms"), F.element_at("ws", -1)["end_ms"].alias("end_ms"), F.size("ws").cast("long").alias("n_words"), join_words(F.transform("ws", lambda x: x["word"])).alias("transcript"))


def with_silent_streams(found: DataFrame, streams: DataFrame) -> DataFrame:
    """``found`` and, for streams without words but with a transcript, one utterance over the whole duration.

    ``streams``: stream_id, transcript, duration_ms.
    """
    silent = streams.join(found.select("stream_id").distinct(), "stream_id", "left_anti").filter(F.trim("transcript") != "")
    n = F.size(F.filter(F.split("transcript", r"\s+"), lambda w: w != "")).cast("long")
    return found.unionByName(silent.select("stream_id", F.lit(1).cast("long").alias("utterance"), F.lit("utt-0001").alias("id"), F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").cast("long").alias("end_ms"), n.alias("n_words"), "transcript"))


def auto_segments(words: DataFrame, gap_ms: int, order: str = "pos") -> DataFrame:
    """Segments that are complete on the stitch clock: every one but the last, which only a flush releases."""
    clock = words.withColumn("start_ms", F.col("stitch_start_ms")).withColumn("end_ms", F.col("stitch_end_ms"))
    found = utterances(clock, gap_ms, order)
    return found.withColumn("_last", F.max("utterance").over(Window.partitionBy("stream_id"))).filter("utterance < _last").drop("_last")


def paragraphs(found: DataFrame) -> DataFrame:
    """(stream_id, num_words, start_ms, end_ms, n_sentences, transcript): one paragraph a stream, a sentence for each utterance."""
    grouped = found.groupBy("stream_id").agg(F.sum("n_words").alias("num_words"), F.array_sort(F.collect_list(F.struct("utterance", "start_ms", "end_ms", "transcript"))).alias("s"))
    return grouped.select("stream_id", "num_words", F.col("s")[0]["start_ms"].alias("start_ms"), F.element_at("s", -1)["end_ms"].alias("end_ms"), F.size("s").cast("long").alias("n_sentences"), F.array_join(F.transform("s", lambda x: x["transcript"]), " ").alias("transcript"))


def response(words: DataFrame, gap_ms: int, order: str = "pos") -> DataFrame:
    """(stream_id, response): the nested result of each stream as JSON, null fields left out."""
    ws = words.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct(order, "word", "start_ms", "end_ms"))).alias("ws"))
    us = utterances(words, gap_ms, order).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("utterance", "id", "start_ms", "end_ms", "transcript"))).alias("us"))
    said = F.transform("ws", lambda x: F.struct(x["word"].alias("word"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms")))
    parts = F.transform("us", lambda u: F.struct(u["id"].alias("id"), u["start_ms"].alias("start_ms"), u["end_ms"].alias("end_ms"), u["transcript"].alias("transcript")))
    return ws.join(us, "stream_id").select("stream_id", _document(join_words(F.transform("ws", lambda x: x["word"])), said, parts).alias("response"))


def _document(transcript: Column, words: Column, found: Column) -> Column:
    doc = F.struct(
        F.struct(F.col("stream_id").cast("string").alias("request_id"), F.lit(1).alias("channels")).alias("metadata"),
        F.struct(F.array(F.struct(F.array(F.struct(transcript.alias("transcript"), words.alias("words"))).alias("alternatives"))).alias("channels"), found.alias("utterances")).alias("results"),
    )
    return F.to_json(doc)


def response_by_row(rows: DataFrame, text: str, words: Callable[[pa.RecordBatch], flat.RowWords], gap_ms: int) -> DataFrame:
    """``response`` of streams whose row (stream_id, ``text``) gives their words; equal stream ids keep their rows. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.chunks(batch, text):
                of, _, word, start, end = words(part)
                marks = flat.Marks.of(word)
                leads = flat.places(of) == 0
                opens = leads.copy()
                opens[1:] |= (np.maximum(start[1:] - end[:-1], 0) >= gap_ms) | marks.closes[:-1]
                first = np.flatnonzero(opens)
                last = np.concatenate([first[1:], [len(of)]])[: len(first)] - 1
                held, rows = np.searchsorted(of, np.arange(part.num_rows + 1)), np.searchsorted(of[first], np.arange(part.num_rows + 1))
                joined = lambda begins, edges: pc.binary_join(flat.lists(edges, pc.binary_join_element_wise(flat.spaces(~(begins | marks.bare | marks.quote)), word.cast(pa.string()), "")), "")  # noqa: B023, E731
                ids = pc.binary_join_element_wise("utt-", pc.utf8_lpad(pa.array(flat.places(of[first]) + 1).cast(pa.string()), 4, "0"), "")
                ws = pa.StructArray.from_arrays([word.cast(pa.string()), pa.array(start), pa.array(end)], ["word", "start_ms", "end_ms"])
                us = pa.StructArray.from_arrays([ids, pa.array(start[first]), pa.array(end[last]), joined(opens, np.append(first, len(of)))], ["id", "start_ms", "end_ms", "transcript"])
                found = pa.RecordBatch.from_arrays([part.column("stream_id"), joined(leads, held), flat.lists(held, ws), flat.lists(rows, us)], ["stream_id", "transcript", "ws", "us"])
                yield found.filter(pa.array(np.diff(held) > 0))

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    kind = rows.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, transcript string, ws array<struct<word:string,start_ms:long,end_ms:long>>, us array<struct<id:string,start_ms:long,end_ms:long,transcript:string>>"
    found = rows.select("stream_id", text).mapInArrow(run, schema)
    return found.select("stream_id", _document(F.col("transcript"), F.col("ws"), F.col("us")).alias("response"))
