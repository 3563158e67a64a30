"""Raw sample files by byte ranges: a file of any size is read by many tasks, as a Python data source.

``format("samples")`` gives (path, first_sample, samples): rows of ``rowSamples`` samples. Files are cut
into ranges of about ``rangeBytes``, whose bounds fall between samples, and a range is read in pieces, so
neither a task nor a row holds a file. Options: ``path`` (a file, or a folder and all below it),
``encoding`` (f32le, or linear16, scaled to [-1, 1)), ``rangeBytes``, ``rowSamples``. Bytes at the end of a
file that are no whole sample are an error, found before anything is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

UNITS = {"f32le": np.dtype("<f4"), "linear16": np.dtype("<i2")}
RANGE_BYTES = 64 << 20
ROW_SAMPLES = 16_000
_BATCH_ROWS = 64


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


def sample_files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    found = (os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if not n.startswith((".", "_")))
    return sorted(f for f in found if "/_" not in f[len(path) :])


class SamplesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.encoding = options["path"], options.get("encoding", "f32le")
        self.unit = UNITS[self.encoding]
        self.row = int(options.get("rowSamples", ROW_SAMPLES)) * self.unit.itemsize
        # whole rows in a range, so that rows do not depend on where ranges are cut
        self.range = max(1, int(options.get("rangeBytes", RANGE_BYTES)) // self.row) * self.row

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in sample_files(self.path):
            size = os.path.getsize(file)
            if size % self.unit.itemsize:
                raise ValueError(f"{file}: {size} bytes are no whole number of samples")
            out += [Range(file, a, min(a + self.range, size)) for a in range(0, size, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            for at in range(partition.begin, partition.end, _BATCH_ROWS * self.row):
                f.seek(at)
                x = np.frombuffer(f.read(min(_BATCH_ROWS * self.row, partition.end - at)), self.unit).astype(np.float32)
                if self.encoding == "linear16":
                    x /= np.float32(32768)
                width = self.row // self.unit.itemsize
                edges = np.append(np.arange(0, len(x), width), len(x)).astype(np.int32)
                rows = len(edges) - 1
                first = at // self.unit.itemsize + edges[:-1].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * rows), pa.array(first), pa.ListArray.from_arrays(pa.array(edges), pa.array(x))], ["path", "first_sample", "samples"])


class Samples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "path string, first_sample long, samples array<float>"

    def reader(self, schema: StructType) -> SamplesReader:
        return SamplesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Samples)


def read_samples(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """(path, first_sample, samples) of the sample files under ``path``."""
    register(spark)
    return spark.read.format("samples").options(path=path, **options).load()
