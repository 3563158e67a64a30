"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.session import cut

FEW = 256  # a node of no more edges than this is never hot
HUBS = 500_000  # most nodes that are broadcast
CHUNK = 500_000  # edges that one task contracts at a time


def local_roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``m`` nodes the smallest that it is connected with by edges (i, j)."""
    root = np.arange(m)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): ``edges`` with those of each chunk of a task replaced by stars around the smallest node of each of the chunk's components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
            if sum(len(a) for a, _ in held) >= chunk:
                yield from flush()
                held = []
        yield from flush()

    return edges.mapInArrow(run, "a long, b long")


def with_lowest(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the smallest v of each u.

    A u of more than ``most`` rows is a hub. There are at most rows / most hubs, so they are
    broadcast and their rows stay where they are; all others are joined by a shuffle.
    """
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hubs = F.broadcast(low.filter(F.col("degree") > most).select("u", "m"))
    others = rows.join(hubs, "u", "left_anti").join(low.filter(F.col("degree") <= most).select("u", "m"), "u")
    return rows.join(hubs, "u").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def connected_components(edges: DataFrame, contract: bool = False) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node reachable.

    Every step is a join or an aggregate over edges; nothing is gathered on the driver but two
    sums. Loops and repeated edges are allowed; an empty table gives no rows. A node with very many
    edges is never the key of one task (``with_lowest``). With ``contract`` tasks first contract what
    they hold, in chunks of bounded size and with NumPy; the steps then join what lies in different chunks.
    """
    if contract:
        edges = cut(edges)
        edges = cut(contracted(edges.coalesce(max(1, edges.count() // CHUNK))))
    pairs = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    n, before = pairs.count(), None
    while n:
        most = max(FEW, 2 * n // HUBS)  # 2n rows have at most HUBS nodes beyond it
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # cut here as well: with_lowest reads its rows three times, so the driver would plan this part three times in one query
        large = cut(with_lowest(both, most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct())
        small = with_lowest(large, most).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = cut(small.filter("u <> v").distinct())
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before, n = (state.n, state.h), state.n
    return loops.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
