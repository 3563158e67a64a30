"""Sinks with commit: staged parts, an atomic manifest, finishing again without harm, as a Python data source.

``format("committed")`` writes JSON lines (``encoding`` ndjson, the default) or raw samples (``encoding``
f32le, of the one column of floats, or arrays of them) under ``path``. A task attempt writes a file of its own under
``_staging``; the driver's commit renames the files of the attempts that counted to their final names and
replaces ``_manifest.json``, which lists each file with its rows, size and SHA-256, in one step. What no
manifest lists is no part of the table: other attempts' files are removed at the commit, and all at an
abort. A batch of a stream is committed under its number; if the manifest has it already, as after a
failure between commit and checkpoint, committing it again changes nothing. ``mode("overwrite")`` starts a
new list and removes what the old one held after the swap.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
STAGING = "_staging"
SUFFIX = {"ndjson": ".ndjson", "f32le": ".f32"}


@dataclass
class Part(WriterCommitMessage):
    file: str
    rows: int
    size: int
    sha256: str


def manifest(path: str) -> list[dict[str, Any]]:
    """The files of the table, in order; none where nothing has been committed."""
    try:
        with open(os.path.join(path, MANIFEST), encoding="utf-8") as f:
            return json.load(f)["files"]
    except FileNotFoundError:
        return []


def swap_manifest(path: str, files: list[dict[str, Any]]) -> None:
    """Replaces the manifest in one step: readers see the old list or the new one."""
    fresh = os.path.join(path, f"{MANIFEST}.{uuid.uuid4().hex}")
    with open(fresh, "w", encoding="utf-8") as f:
        json.dump({"files": files}, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(fresh, os.path.join(path, MANIFEST))


def encoded(batch: pa.RecordBatch, encoding: str) -> bytes:
    if encoding == "ndjson":
        rows = ({k: v for k, v in row.items() if v is not None} for row in batch.to_pylist())
        return "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":"), default=str) + "\n" for r in rows).encode()
    column = batch.column(0)
    flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).astype("<f4").tobytes()


class Parts:
    """Writing, committing and aborting parts under ``path``; ``job`` names what is staged."""

    def __init__(self, path: str, encoding: str, job: str, overwrite: bool = False) -> None:
        self.path, self.encoding, self.job, self.overwrite = path, encoding, job, overwrite

    @property
    def staging(self) -> str:
        return os.path.join(self.path, STAGING, self.job)

    def stage(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """One attempt's file; a failure leaves nothing of it."""
        os.makedirs(self.staging, exist_ok=True)
        file = os.path.join(self.staging, uuid.uuid4().hex)
        rows = size = 0
        digest = hashlib.sha256()
        try:
            with open(file, "wb") as f:
                for batch in batches:
                    raw = encoded(batch, self.encoding)
                    f.write(raw)
                    digest.update(raw)
                    rows, size = rows + batch.num_rows, size + len(raw)
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            os.remove(file)
            raise
        return Part(file, rows, size, digest.hexdigest())

    def finish(self, parts: list[Part | None], batch: str) -> None:
        """Makes ``parts`` files of the table under the name ``batch``, once."""
        held = manifest(self.path)
        if not any(f["batch"] == batch for f in held):
            fresh = []
            for k, part in enumerate(p for p in parts if p is not None and p.rows):
                name = f"part-{batch}-{k:05d}{SUFFIX[self.encoding]}"
                if os.path.exists(part.file):  # else an earlier finish was cut off after renaming it
                    os.replace(part.file, os.path.join(self.path, name))
                fresh.append({"batch": batch, "file": name, "rows": part.rows, "size": part.size, "sha256": part.sha256})
            fresh = fresh or [{"batch": batch, "file": None, "rows": 0, "size": 0, "sha256": hashlib.sha256().hexdigest()}]
            swap_manifest(self.path, fresh if self.overwrite else held + fresh)
            for old in held if self.overwrite else []:
                if old["file"]:
                    os.remove(os.path.join(self.path, old["file"]))
        self.drop()

    def drop(self) -> None:
        """Removes whatever attempts of this job have staged."""
        for folder, names in [(self.staging, os.listdir(self.staging))] if os.path.isdir(self.staging) else []:
            for n in names:
                os.remove(os.path.join(folder, n))
            os.rmdir(folder)
            try:
                os.rmdir(os.path.dirname(folder))
            except OSError:
                pass  # other jobs stage there


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, parts: Parts) -> None:
        self.parts = parts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.parts.stage(iterator)

    def commit(self, messages: list[Part | None]) -> None:
        self.parts.finish(messages, self.parts.job)

    def abort(self, messages: list[Part | None]) -> None:
        self.parts.drop()


class CommittedStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, parts: Parts) -> None:
        self.parts = parts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.parts.stage(iterator)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self.parts.finish(messages, f"batch{batchId:09d}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self.parts.drop()


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def _parts(self, overwrite: bool = False) -> Parts:
        return Parts(self.options["path"], self.options.get("encoding", "ndjson"), uuid.uuid4().hex, overwrite)

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        os.makedirs(self.options["path"], exist_ok=True)
        return CommittedWriter(self._parts(overwrite))

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedStreamWriter:  # noqa: N802
        os.makedirs(self.options["path"], exist_ok=True)
        return CommittedStreamWriter(self._parts())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)


def committed_lines(spark: SparkSession, path: str):  # noqa: ANN201
    """(value): the lines of a committed table: of the files that its manifest lists, and no others."""
    files = [os.path.join(path, f["file"]) for f in manifest(path) if f["file"]]
    return spark.read.text(files) if files else spark.createDataFrame([], "value string")
