"""A live source that can be restarted: messages spooled by front ends, as a Python data source.

A front end (a process that holds sockets) appends what its clients send as Parquet segments to a folder
of its own, ``<path>/<front>/<name>.parquet``; a stream stays with one front end, and names sort in the
order of writing. Segments are written under another suffix and renamed, so each is seen whole or not at
all. ``format("spool")`` reads them:

* as a batch over a folder of front ends, a folder of files or one file: a task for each row group;
* as a stream: the offset is the last segment of each front end, a micro-batch takes what came since (at
  most ``segmentsPerBatch`` of each, but all of them in the first batch after a start, as Spark asks for
  its end before it tells where the query was), a task for each front end keeps its order, and a range that was
  planned before a failure is read again after it. With ``purge`` a commit removes the segments before it.

Options: ``path``, ``segmentsPerBatch`` (all), ``purge`` (false). The schema is given, or that of the first segment.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

SUFFIX = ".parquet"
_FIRST = ""  # before every name


def fronts(path: str) -> dict[str, list[str]]:
    """Segment names by front end, in order; files directly in ``path``, or ``path`` itself, are a front end without a name."""
    if os.path.isfile(path):
        return {"": [""]}
    found: dict[str, list[str]] = {}
    for entry in sorted(os.scandir(path), key=lambda e: e.name):
        if entry.is_dir() and not entry.name.startswith(("_", ".")):
            found[entry.name] = sorted(n for n in os.listdir(entry.path) if n.endswith(SUFFIX))
        elif entry.name.endswith(SUFFIX):
            found.setdefault("", []).append(entry.name)
    return found


def append(path: str, front: str, name: str, rows: pa.Table) -> None:
    """A front end's next segment, which readers see whole or not at all."""
    folder = os.path.join(path, front)
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, name + SUFFIX)
    pq.write_table(rows, target + ".tmp")
    os.replace(target + ".tmp", target)


@dataclass
class Segments(InputPartition):
    """Files to read one after the other; ``groups`` are the row groups wanted (all if None)."""

    files: list[str]
    groups: list[int] | None = None

    def rows(self, schema: StructType) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(schema)
        for file in self.files:
            with pq.ParquetFile(file, pre_buffer=False) as f:  # no threads, as workers fork
                for batch in f.iter_batches(8192, row_groups=self.groups, columns=schema.names, use_threads=False):
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(wanted.field(n).type) for n in schema.names], schema=wanted)


class SpoolReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self.schema, self.path = schema, path

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for front, names in fronts(self.path).items():
            for name in names:
                file = os.path.join(self.path, front, name) if name else self.path
                with pq.ParquetFile(file) as f:
                    out += [Segments([file], [k]) for k in range(f.num_row_groups)]
        return out or [Segments([])]

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return partition.rows(self.schema)


class SpoolStreamReader(DataSourceStreamReader):
    """Offsets are {front end: last segment taken}."""

    def __init__(self, schema: StructType, path: str, most: int, purge: bool) -> None:
        self.schema, self.path, self.most, self.purge = schema, path, most, purge
        self.reached: dict[str, str] | None = None  # not known yet

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """At most ``most`` segments of each front end beyond what was planned last."""
        out = dict(self.reached or {})
        for front, names in fronts(self.path).items():
            fresh = [n for n in names if n > out.get(front, _FIRST)]
            taken = fresh[: self.most] if self.most and self.reached is not None else fresh
            if taken:
                out[front] = taken[-1]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = dict(end)
        out: list[InputPartition] = []
        for front, names in fronts(self.path).items():
            files = [os.path.join(self.path, front, n) for n in names if start.get(front, _FIRST) < n <= end.get(front, _FIRST)]
            if files:
                out.append(Segments(files))
        return out or [Segments([])]

    def read(self, partition: Segments) -> Iterator[pa.RecordBatch]:
        return partition.rows(self.schema)

    def commit(self, end: dict) -> None:
        """Everything up to ``end`` has been written by the query and is never asked for again."""
        if self.purge:
            for front, names in fronts(self.path).items():
                for name in names:
                    if name <= end.get(front, _FIRST):
                        os.remove(os.path.join(self.path, front, name))


class Spool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> StructType:
        for front, names in fronts(self.options["path"]).items():
            for name in names:
                return from_arrow_schema(pq.read_schema(os.path.join(self.options["path"], front, name) if name else self.options["path"]))
        raise ValueError("give a schema: there is no segment yet")

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(schema, self.options["path"])

    def streamReader(self, schema: StructType) -> SpoolStreamReader:  # noqa: N802
        purge = json.loads(self.options.get("purge", "false").lower())
        return SpoolStreamReader(schema, self.options["path"], int(self.options.get("segmentsPerBatch", "0")), purge)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Spool)
