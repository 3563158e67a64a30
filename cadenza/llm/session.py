"""Small helpers around the Spark session that several operators share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local folder only where none is set (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cadenza-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Send rows to Python workers in small Arrow batches, as whole texts make wide rows: this bounds what a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return to the system what this process has freed: driver and Python workers live on from stage to stage, and glibc keeps their pages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def local_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of values that the driver holds. They go through Arrow: rows would pass Python workers of a kind of their own, which live on beside those of the operators."""
    return spark.createDataFrame(pa.table(columns))


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; otherwise unchanged, so Spark shuffles.

    Counting stops after ``rows + 1`` rows; ``df`` should be narrow and cheap to recompute.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column bears it (Spark does not tell capitals apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def value_at_rank(df: DataFrame, column: str, rows: int) -> int:
    """The smallest value v of the positive count ``column`` such that at most ``rows`` rows have v or more.

    Reads a histogram whose bins are exact to 4096 and then 64 to each doubling, so the driver gets
    a bounded table; past 4096 v is the lower end of a bin.
    """
    wide = (F.lit(4096) + F.floor((F.log2(column) - 12) * 64)).cast("long")
    bins = df.groupBy(F.when(F.col(column) <= 4096, F.col(column)).otherwise(wide).alias("bin")).count().collect()
    seen, least = 0, None
    for r in sorted(bins, key=lambda r: -r.bin):
        if seen + r["count"] > rows:
            break
        seen += r["count"]
        least = r.bin
    if least is None:
        return 1 << 62
    return least if least <= 4096 else int(2 ** (12 + (least - 4096) / 64)) + 1
