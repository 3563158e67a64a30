"""Registration of queries, and the fixtures that bind operators to the supplied tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import flat

FEW = 100_000  # ids that may be broadcast
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query under ``name``, with DuckDB SQL for the same rows where there is some."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where no folder is named and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.removeprefix('file:').rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="cadenza-")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, pos, word, start_ms, end_ms): the words of ``documents`` with invented, partly overlapping times."""
    return words_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), "text"))


def words_of(docs: DataFrame) -> DataFrame:
    rows = docs.select("stream_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "word"))
    start = F.expr("pos * 300L + (stream_id * 7 + pos * 13) % 50")
    return rows.select("stream_id", F.col("pos").cast("long").alias("pos"), "word", start.alias("start_ms"), (start + F.expr("200 + (pos * 31L) % 150")).alias("end_ms"))


def word_arrays(batch: pa.RecordBatch) -> flat.RowWords:
    """``words`` of a batch's rows (stream_id, text) as arrays: row, pos, word, start_ms, end_ms."""
    of, first, end, _ = flat.split_words(batch.column("text"))
    pos = flat.places(of)
    start = pos * 300 + np.fmod(batch.column("stream_id").to_numpy(zero_copy_only=False).astype(np.int64)[of] * 7 + pos * 13, 50)
    return of, pos, flat.pieces(flat.text_buffers(batch.column("text"))[1], first, end), start, start + 200 + pos * 31 % 150


def by_stream(docs: DataFrame, whole: Callable[[DataFrame], DataFrame], dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the rows that hold a stream alone, and ``dealt`` of those whose stream_id other rows have too.

    Ids alone are shuffled to tell, in a job of its own, as ``dealt`` is in the plan only where it has rows.
    """
    several = docs.groupBy("stream_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("stream_id").alias("_id"))
    n = several.limit(FEW + 1).count()
    if not n:
        return whole(docs)
    ids = F.broadcast(several) if n <= FEW else several
    meets = docs["stream_id"].eqNullSafe(ids["_id"])
    return whole(docs.join(ids, meets, "left_anti")).unionByName(dealt(docs.join(ids, meets, "left_semi")))


#: The same in DuckDB, as a WITH item named w.
WORDS = r"""w AS (SELECT stream_id, pos, word, pos * 300 + (stream_id * 7 + pos * 13) % 50 AS start_ms,
  pos * 300 + (stream_id * 7 + pos * 13) % 50 + 200 + (pos * 31) % 150 AS end_ms
  FROM (SELECT doc_id AS stream_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos
    FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)))"""


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
