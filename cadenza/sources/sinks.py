"""Sinks: sample bytes, staged frames, NDJSON lines, re-framed lines, manifests, metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.windows import slices


def encode_samples(rows: DataFrame, samples: str, out: str = "body") -> DataFrame:
    """``rows`` with an array of floats as little-endian bytes."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if x is None else np.asarray(x, "<f4").tobytes() for x in batch.column(samples).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), f"`{out}` binary"]))


def staged(rows: DataFrame, body: str, size: int) -> DataFrame:
    """Frames of a stage: a head, the body in slots of ``size``, an end, numbered in order."""
    parts = slices(rows, body, size).select("stream_id", (F.col("slot") + 1).alias("seq"), F.lit("body").alias("kind"), "part")
    n = F.ceil(F.length(body) / size)
    head = rows.select("stream_id", F.lit(0).cast("long").alias("seq"), F.lit("head").alias("kind"), F.lit(None).cast("string").alias("part"))
    end = rows.select("stream_id", (n + 1).cast("long").alias("seq"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("part"))
    return head.unionByName(parts).unionByName(end)


def ndjson(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON line for each row; null fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def lines(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, line_no, line): a stream's chunks put together and cut at newlines, without \\r and without empty lines."""
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("_all"))
    found = F.filter(F.transform(F.split("_all", "\n", -1), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    return whole.select(key, F.posexplode(found).alias("line_no", "line"))


def manifest_changes(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Entries of one manifest that the other lacks: ``change`` is "upload" or "delete"."""
    return local.exceptAll(remote).withColumn("change", F.lit("upload")).unionByName(remote.exceptAll(local).withColumn("change", F.lit("delete")))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
