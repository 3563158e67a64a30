"""How many Python workers a task of the pipeline holds, and what the driver keeps after it has learned."""

import re
from pathlib import Path

import pyarrow as pa

from cadenza.llm import components, decontaminate, quality, session

SMALL, TRAINED = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def _held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_decontamination_takes_one_python_worker_for_a_task(spark):
    docs, bench = (session.table(spark, SMALL, n) for n in ("documents", "benchmark"))
    for shard in (200_000, 2_000):
        clean = decontaminate.remove_hits(docs, bench, shard_words=shard)
        assert str(clean._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_hits_of_earlier_shards_are_taken_out_in_the_one_pass(spark):
    bench = spark.createDataFrame([("a", " ".join(f"ka{i}" for i in range(20))), ("b", " ".join(f"kb{i}" for i in range(20)))], "item_id string, text string")
    a, b = (r.text for r in bench.orderBy("item_id").collect())
    prose = " ".join(f"w{i}" for i in range(900))
    docs = spark.createDataFrame([(1, f"{prose} {a}, {prose}! {b}. end", 0, "x"), (2, a, len(a), "y"), (3, prose, 7, "z"), (4, None, None, None)], "doc_id long, text string, n_chars int, hit_earlier string")
    clean = f"{prose} , {prose}! . end"
    for shard in (200_000, 10):
        got = decontaminate.remove_hits(docs, bench, shard_words=shard)
        assert got.schema == docs.schema and sorted(tuple(r) for r in got.collect()) == [(1, clean, len(clean), "x"), (3, prose, 7, "z"), (4, None, None, None)]


def test_local_tables_start_no_python_worker(spark):
    df = session.local_table(spark, a=pa.array([3, 1, None], pa.int64()), b=pa.array([True, False, True], pa.bool_()))
    assert df.dtypes == [("a", "bigint"), ("b", "boolean")] and [tuple(r) for r in df.collect()] == [(3, True), (1, False), (None, True)]
    assert "Python" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_the_driver_gives_back_what_learning_took(spark):
    docs, labels = (session.table(spark, TRAINED, n) for n in ("documents", "labels"))
    assert quality.train(docs, labels) is not None
    held = _held_mb()
    session.give_back()
    assert held - _held_mb() < 16


def test_a_round_of_component_search_is_planned_in_two_small_queries(spark, monkeypatch):
    sizes = []

    def counted(df):
        sizes.append(len(str(df._jdf.queryExecution().executedPlan())))
        return session.cut(df)

    monkeypatch.setattr(components, "cut", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert max(sizes) < 25_000, sizes
