"""Sources: stage heads, sample bytes, alignment JSON, request options, vocabularies, binary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.scalars import is_json_request, parse_bool
from cadenza.operators.windows import slices

ENCODING, RATE, CHANNELS = "f32le", 16_000, 1
ALIGNMENTS = "map<string,struct<word_segments:array<struct<word:string,start:double,end:double>>>>"


def valid_head(encoding: Column, rate: Column, channels: Column) -> Column:
    """Whether a stage head is what recognition takes: f32le, 16 kHz, mono."""
    return (encoding == ENCODING) & (rate == RATE) & (channels == CHANNELS)


def decode_samples(rows: DataFrame, body: str, out: str = "samples", encoding: str = "f32le") -> DataFrame:
    """``rows`` with the samples of a binary column: little-endian floats, or 16-bit integers scaled to [-1, 1).

    A length that is no multiple of a sample's size is an error; empty bytes give no samples.
    """
    kinds = dict(rows.dtypes)
    unit = {"f32le": np.dtype("<f4"), "linear16": np.dtype("<i2")}[encoding]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for raw in batch.column(body).to_pylist():
                if raw is not None and len(raw) % unit.itemsize:
                    raise ValueError(f"{len(raw)} bytes are no whole number of samples")
                x = None if raw is None else np.frombuffer(raw, unit).astype(np.float32)
                got.append(x / np.float32(32768) if x is not None and encoding == "linear16" else x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), f"`{out}` array<float>"]))


def read_sample_files(spark: SparkSession, path: str, encoding: str = "f32le") -> DataFrame:
    """(path, samples) of raw sample files."""
    return decode_samples(spark.read.format("binaryFile").load(path).select("path", "content"), "content", encoding=encoding).drop("content")


def read_frames(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Tagged frames (stream_id, seq, kind, payload) from Parquet files, as a batch or as a stream."""
    schema = "stream_id string, seq long, kind string, payload binary"
    return (spark.readStream.schema(schema) if streaming else spark.read.schema(schema)).parquet(path)


def request_frames(requests: DataFrame, size: int) -> DataFrame:
    """(stream_id, seq, kind, part) of requests (stream_id, content_type, body): slots of ``size``, then an end.

    Requests whose content type is JSON are rejected and give no frames; an empty body gives only its end.
    """
    taken = requests.filter(~F.coalesce(is_json_request(F.col("content_type")), F.lit(False)))
    parts = slices(taken, "body", size).select("stream_id", F.col("slot").alias("seq"), F.lit("body").alias("kind"), "part")
    n = F.ceil(F.coalesce(F.length("body"), F.lit(0)) / size).cast("long")
    return parts.unionByName(taken.select("stream_id", n.alias("seq"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("part")))


def bodies(frames: DataFrame) -> DataFrame:
    """(stream_id, body, ended): the body frames of each stream put together, up to its end; streams without any are left out."""
    item = F.when(F.col("kind") == "body", F.struct("seq", "part"))
    whole = frames.groupBy("stream_id").agg(F.array_sort(F.collect_list(item)).alias("parts"), F.max(F.col("kind") == "end").alias("ended"), F.min(F.when(F.col("kind") == "end", F.col("seq"))).alias("stop"))
    parts = F.filter("parts", lambda p: F.col("stop").isNull() | (p["seq"] < F.col("stop")))
    return whole.filter(F.size(parts) > 0).select("stream_id", F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("body"), "ended")


def alignments(rows: DataFrame, text: str) -> DataFrame:
    """(key, pos, word, start, end) of reference alignments kept as a JSON map."""
    entries = rows.select(F.explode(F.from_json(text, ALIGNMENTS)).alias("key", "value"))
    found = entries.select("key", F.posexplode("value.word_segments").alias("pos", "s"))
    return found.select("key", "pos", "s.word", "s.start", "s.end")


def lookup(json: Column, key: Column | str) -> Column:
    """Value of a key in a JSON map of strings; a missing key is an error."""
    value = F.try_element_at(F.from_json(json, "map<string,string>"), F.lit(key) if isinstance(key, str) else key)
    return F.coalesce(value, F.raise_error(F.lit(f"no entry for {key}")).cast("string"))


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """(id, piece) of a vocabulary kept as a JSON map from id to piece."""
    return rows.select(F.explode(F.from_json(text, "map<string,string>")).alias("id", "piece")).select(F.col("id").cast("int").alias("id"), "piece")


def request_id(first: Column, second: Column) -> Column:
    """The first positive number of two headers; null where one is to be generated."""
    number = lambda h: F.when(h.try_cast("long") > 0, h.try_cast("long"))
    return F.coalesce(number(F.trim(first)), number(F.trim(second)))


def query_values(uri: Column) -> Column:
    """Key-value pairs of a query string in order, as array<struct<k,v>>."""
    q = F.regexp_replace(F.when(F.contains(uri, F.lit("?")), F.regexp_replace(uri, r"^[^?]*\?", "")).otherwise(""), "#.*$", "")
    parts = F.filter(F.split(q, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")).alias("v")))


#: The boolean request options.
FLAGS = ("utterances", "paragraphs", "interim_results", "punctuate", "smart_format", "diarize", "numerals")


def listen_options(uri: Column, headers: Column) -> Column:
    """Request options from headers and query; a present header blocks the query value, even if it is invalid.

    Of repeated query keys the last valid one counts. ``timestamps`` turns ``words`` on, and where any
    ``timestamps`` value is given a ``words`` header is ignored though it still blocks the query.
    """
    pairs = query_values(uri)

    def given(key: str) -> Column:
        return F.try_element_at(headers, F.lit(key))

    def last(key: str) -> Column:
        return F.try_element_at(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"]), F.lit(-1))

    def valid(key: str, read, default) -> Column:  # noqa: ANN001
        from_query = F.try_element_at(F.filter(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: read(p["v"])), lambda v: v.isNotNull()), F.lit(-1))
        return F.coalesce(F.when(given(key).isNotNull(), read(given(key))).otherwise(from_query), F.lit(default))

    flags = {k: valid(k, parse_bool, False) for k in FLAGS}
    timestamps = valid("timestamps", parse_bool, False)
    any_timestamps = given("timestamps").isNotNull() | last("timestamps").isNotNull()
    header_words = F.when(~any_timestamps, F.coalesce(parse_bool(given("words")), F.lit(False))).otherwise(False)
    words = F.when(given("words").isNotNull(), header_words).otherwise(valid("words", parse_bool, False)) | timestamps
    number = lambda key, ok: (lambda v: F.when(ok(v), v))(F.coalesce(given(key), last(key)).try_cast("long"))
    encoding = F.lower(F.trim(F.coalesce(given("encoding"), last("encoding"))))
    return F.struct(
        *(v.alias(k) for k, v in flags.items()),
        timestamps.alias("timestamps"),
        words.alias("words"),
        F.greatest(valid("channels", lambda v: v.try_cast("int"), 1), F.lit(1)).alias("channels"),
        valid("utt_split", lambda v: F.when(v.try_cast("double") >= 0, v.try_cast("double")), 0.8).alias("utt_split"),
        number("endpointing", lambda v: v >= 0).alias("endpointing"),
        number("sample_rate", lambda v: v > 0).alias("sample_rate"),
        F.when(encoding.isin("linear16", "s16le"), "linear16").alias("encoding"),
        F.coalesce(given("language"), last("language")).alias("language"),
        F.coalesce(given("model"), last("model")).alias("model"),
    )
