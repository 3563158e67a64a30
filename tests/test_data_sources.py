"""Sources and sinks as data sources: restarts, ranges, commits, aborts."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.sources import committed, sample_files, spool

MESSAGE = "stream_id string, seq long, type string, payload string"


def messages(*rows):
    return pa.table({c.split()[0]: [r[k] for r in rows] for k, c in enumerate(MESSAGE.split(", "))}, pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("type", pa.string()), ("payload", pa.string())]))


def test_spool_as_a_batch(spark, tmp_path):
    spool.register(spark)
    path = str(tmp_path / "in")
    for front in ("f1", "f2"):
        for k in range(3):
            spool.append(path, front, f"{k:05d}", messages((front, 2 * k, "binary", "x"), (front, 2 * k + 1, "text", None)))
    got = spark.read.format("spool").option("path", path).load()
    assert got.schema.simpleString() == "struct<stream_id:string,seq:bigint,type:string,payload:string>" and got.rdd.getNumPartitions() == 6
    assert sorted((r.stream_id, r.seq) for r in got.collect()) == [(f, k) for f in ("f1", "f2") for k in range(6)]
    two = spark.read.format("spool").schema("seq long, type string").option("path", path).load()
    assert two.columns == ["seq", "type"] and two.count() == 12
    (tmp_path / "none").mkdir()
    assert spark.read.format("spool").schema(MESSAGE).option("path", str(tmp_path / "none")).load().count() == 0


def test_spool_stream_restarts_and_replays(spark, tmp_path):
    spool.register(spark)
    path = str(tmp_path / "in")
    live = spark.readStream.format("spool").schema(MESSAGE).option("path", path).option("segmentsPerBatch", 1).load()
    batches = []

    def start(write):
        return live.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    def keep(batch, number):
        batches.append((number, sorted((r.stream_id, r.seq) for r in batch.collect())))

    def fail(batch, number):
        raise RuntimeError(f"killed at {number} with {batch.count()}")

    for front in ("a", "b"):
        spool.append(path, front, "00000", messages((front, 0, "binary", "x"), (front, 1, "binary", "y")))
    assert start(keep).awaitTermination(60)
    for front in ("a", "b"):
        spool.append(path, front, "00001", messages((front, 2, "binary", "z")))
    with pytest.raises(Exception, match="killed at 1 with 2"):
        start(fail).awaitTermination(60)
    spool.append(path, "a", "00002", messages(("a", 3, "binary", "late")))
    for _ in range(2):  # the first may end with the batch that had failed
        assert start(keep).awaitTermination(60)
    got = [x for _, rows in batches for x in rows]
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)] and len(got) == len(set(got))
    assert batches[1] == (1, [("a", 2), ("b", 2)])  # the batch that was planned before the failure, unchanged


def test_spool_plans_each_front_end_in_order_and_purges(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(4):
        spool.append(path, "a", f"{k:05d}", messages(("a", k, "binary", "x")))
    r = spool.SpoolStreamReader(None, path, 2, True)
    assert r.initialOffset() == {} and r.latestOffset() == {"a": "00003.parquet"}  # where the query was is not known yet
    first = {"a": "00001.parquet"}
    assert [len(p.files) for p in r.partitions({}, first)] == [2]
    second = r.latestOffset()
    assert second == {"a": "00003.parquet"}
    again = spool.SpoolStreamReader(None, path, 2, True).partitions(first, second)  # after a restart
    assert [os.path.basename(f) for f in again[0].files] == ["00002.parquet", "00003.parquet"]
    r.commit(first)
    assert sorted(os.listdir(os.path.join(path, "a"))) == ["00002.parquet", "00003.parquet"]


def test_one_sample_file_by_several_tasks(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal(10_007).astype("<f4")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.f32").write_bytes(x.tobytes())
    (tmp_path / "s/none.f32").write_bytes(b"")
    whole = {}
    for size in (4, 1000, 4_000_000):
        df = sample_files.read_samples(spark, str(tmp_path / "s"), rangeBytes=size * 4, rowSamples=100)
        rows = df.orderBy("first_sample").collect()
        assert df.rdd.getNumPartitions() == {4: 101, 1000: 11, 4_000_000: 1}[size]
        assert [r.first_sample for r in rows] == list(range(0, 10_007, 100))
        whole[size] = np.concatenate([r.samples for r in rows]).astype("<f4")
        assert whole[size].tobytes() == x.tobytes()
    (tmp_path / "i.raw").write_bytes(np.array([0, -32768, 16384], "<i2").tobytes())
    assert [r.samples for r in sample_files.read_samples(spark, str(tmp_path / "i.raw"), encoding="linear16").collect()] == [[0.0, -1.0, 0.5]]
    (tmp_path / "bad.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        sample_files.read_samples(spark, str(tmp_path / "bad.f32")).count()


def lines(path):
    return sorted(json.loads(line)["id"] for f in committed.manifest(path) if f["file"] for line in open(os.path.join(path, f["file"]), encoding="utf-8"))


def files(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, ns in os.walk(path) for n in ns)


def test_committed_lines(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "t")
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "é").alias("name")).repartition(3)
    df.write.format("committed").option("path", path).mode("append").save()
    assert lines(path) == list(range(100)) and sorted(r.value for r in committed.committed_lines(spark, path).collect())[0] == '{"id":0,"name":"é"}'
    df.filter("id < 10").write.format("committed").option("path", path).mode("append").save()
    assert lines(path) == sorted([*range(100), *range(10)])
    df.filter("id < 5").write.format("committed").option("path", path).mode("overwrite").save()
    assert lines(path) == list(range(5)) and len(files(path)) == len(committed.manifest(path)) + 1
    listed = committed.manifest(path)
    assert sum(f["rows"] for f in listed) == 5 and all(os.path.getsize(os.path.join(path, f["file"])) == f["size"] for f in listed)


def test_failed_tasks_leave_nothing(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "t")
    bad = spark.range(60, numPartitions=3).select(F.when(F.col("id") == 59, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("committed").option("path", path).mode("append").save()
    assert committed.manifest(path) == [] and files(path) == []
    spark.range(60, numPartitions=3).write.format("committed").option("path", path).mode("append").save()
    assert lines(path) == list(range(60))


def test_a_retried_task_counts_once_and_finishing_again_changes_nothing(tmp_path):
    path = str(tmp_path)
    parts = committed.Parts(path, "ndjson", "j")
    batch = lambda *ids: iter([pa.record_batch([pa.array(ids)], ["id"])])

    def broken():
        yield next(batch(7))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        parts.stage(broken())
    parts.stage(batch(1, 2))  # an attempt whose result never arrived
    counted = [parts.stage(batch(1, 2)), parts.stage(batch(3)), parts.stage(batch()), None]
    parts.finish(counted, "b1")
    assert lines(path) == [1, 2, 3] and len(files(path)) == 3
    before = committed.manifest(path)
    committed.Parts(path, "ndjson", "k").finish(counted, "b1")
    assert committed.manifest(path) == before and lines(path) == [1, 2, 3]
    # a driver that was lost between renaming and the manifest: the batch is finished by the next
    late = committed.Parts(path, "ndjson", "l")
    part = late.stage(batch(4))
    os.replace(part.file, os.path.join(path, "part-b2-00000.ndjson"))
    late.finish([part], "b2")
    assert lines(path) == [1, 2, 3, 4]


def test_stream_into_a_committed_table(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "t")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    live = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second finds nothing new
        q = live.writeStream.format("committed").option("path", path).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert lines(path) == list(range(30)) and sorted({f["batch"] for f in committed.manifest(path)}) == [f"batch{k:09d}" for k in range(3)]


def test_samples_through_sink_and_source(spark, tmp_path):
    committed.register(spark)
    path = str(tmp_path / "s")
    spark.createDataFrame([([1.0, 2.0],), ([],), ([0.5],)], "x array<float>").coalesce(1).write.format("committed").option("path", path).option("encoding", "f32le").mode("append").save()
    got = sample_files.read_samples(spark, path, rowSamples=2).orderBy("first_sample").collect()
    assert [r.samples for r in got] == [[1.0, 2.0], [0.5]]
