"""Exact n-gram Jaccard self-join of documents, with its connected components.

A document is the set of its distinct five-word shingles. Equal sets are merged first, so copies
cost nothing afterwards. Candidate pairs come from an inverted index over the part of each set
that any partner must share in (its prefix, whose length the threshold and the set's size fix).
Shingles are ordered by the number of sets that hold them, counted over the whole corpus
(``exchange``), so a prefix holds a set's rarest shingles, and shingles of one set only are left
out. Lists of up to ``LIST`` sets give their pairs, and those whose possible overlap stays below the
size-derived bound are discarded at once: what two sets share in short lists is counted, and each
shingle of a prefix that may lie in a long list counts as shared. Longer lists give a star instead of
pairs, from those of their sets whose size and place still allow a link. The sets of each candidate group then meet in
blocks: a blocked sparse product of the set-by-shingle incidence accumulates overlap counts, and
pairs below the bound 7 * overlap >= 3 * (size + size) are dropped. Large groups are dealt over
pairs of blocks.

The order of the shingles never changes the result. Sets are told apart by a 64-bit hash.

Defined results: null or blank text has no shingles, ``n_shingles`` 0 and its own id as component;
repeated rows each get a row; rows without ``doc_id`` take part and carry null; a component's id is
its smallest ``doc_id``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.components import connected_components, local_roots
from cadenza.llm.exchange import LEAST_BLOCKS, in_blocks, number_of_blocks, received, sent, totals
from cadenza.llm.session import broadcast_up_to, cut, small_batches, table
from cadenza.llm.textkit import BLANK_SEPARATED, Words, set_id, shingle_sets, text_slices

SHINGLE = 5
LIST = 32
BLOCK_SHINGLES = 3_000_000
BLOCK_SETS = 2048
ALONE = 128  # a candidate group of no more sets meets in one cell
BROADCAST_ROWS = 1_000_000
_OUT = 1 << 16


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, shingle sets) of slices of a batch."""
    for a, b, data, offsets in text_slices(batch.column("text")):
        yield np.arange(a, b), list(shingle_sets(Words(data, offsets, BLANK_SEPARATED), b - a, SHINGLE))


def shingle_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node): the size of each document's set and the set's identity (null if it has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _columns(batch):
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(n, pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "node"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, node long")


def prefix_length(n: int) -> int:
    """How many of a set's shingles, in any common order, must meet those of each partner at Jaccard 3/4."""
    return n - (3 * n + 3) // 4 + 1


def block_sets(text: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """The distinct shingle sets of some texts and their identities."""
    found: dict[int, np.ndarray] = {}
    for a, b, data, offsets in text_slices(text):
        for s in shingle_sets(Words(data, offsets, BLANK_SEPARATED), b - a, SHINGLE):
            if len(s):
                found.setdefault(set_id(s), s)
    return list(found), list(found.values())


def postings(docs: DataFrame, blocks: int, longest: int = LIST) -> DataFrame:
    """(gram, node, n, pos, far, most) of each set's prefix, its shingles in the common order: rare before frequent, ties by hash.

    ``far`` is how many shingles of the prefix up to this one, and ``most`` how many of all of it, are held
    by more than ``longest`` sets, so that their lists may be long.

    How many sets hold a shingle is counted over the whole corpus; copies in different blocks count each,
    and a count may rarely be that of two shingles. It is never too low: a shingle that only one set holds
    meets nothing and is left out.
    """
    dealt = in_blocks(docs.select("doc_id", "text"), blocks)

    def send(table_: pa.Table) -> pa.Table:
        sets = block_sets(table_.column("text"))[1]
        keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return sent(table_.column("block")[0].as_py(), keys, {"held": n}, blocks, np.uint32)

    def prefixes(table_: pa.Table, found: pa.Table) -> pa.Table:
        nodes, sets = block_sets(table_.column("text"))
        out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], *([np.zeros(0, np.int32)] for _ in range(4))]
        if sets:
            keys, at = np.unique(np.concatenate(sets), return_inverse=True)
            held = received(found, keys, ["held"], blocks)[0][at]
            start = 0
            for k, s in zip(nodes, sets, strict=True):
                n = len(s)
                own = held[start : start + n]
                start += n
                p = prefix_length(n)
                order = np.lexsort((s, own))[:p]
                shared = np.flatnonzero(own[order] > 1)
                grams, far = s[order[shared]], np.cumsum(own[order] > longest).astype(np.int32)
                same = lambda x: np.full(len(shared), x, np.int32)  # noqa: B023, E731
                for column, values in zip(out, (grams, np.full(len(grams), k, np.int64), same(n), (shared + 1).astype(np.int32), far[shared], same(far[-1])), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(out[0]).view(np.int64)), *(pa.array(np.concatenate(x)) for x in out[1:])], ["gram", "node", "n", "pos", "far", "most"])

    counted = totals(dealt.groupBy("block").applyInArrow(send, "part int, block int, keys binary, held binary"), ["held"], blocks, np.uint32)
    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(prefixes, "gram long, node long, n int, pos int, far int, most int")


def candidate_edges(index: DataFrame, longest: int = LIST) -> DataFrame:
    """(a, b) such that any two sets at Jaccard 3/4 or more are connected by these edges."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shingle and size; a list may go on in the next batch."""

        def out(a, b, na, nb, pa_, pb, far, most, star):  # noqa: ANN001
            ok = (a != b) & (4 * np.minimum(na, nb).astype(np.int64) >= 3 * np.maximum(na, nb).astype(np.int64)) if not star else a != b
            a, b, na, nb, pa_, pb, far, most = (x[ok] for x in (a, b, na, nb, pa_, pb, far, most))
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            na, nb, pa_, pb = np.where(swap, nb, na), np.where(swap, na, nb), np.where(swap, pb, pa_), np.where(swap, pa_, pb)
            for i in range(0, len(a), _OUT):
                small = (pa.array(x[i : i + _OUT].astype(np.int32)) for x in (na, nb, pa_, pb, far, most))
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + _OUT]), pa.array(b[i : i + _OUT]), *small, pa.array(np.full(len(a[i : i + _OUT]), star))], ["a", "b", "na", "nb", "pa", "pb", "far", "most", "star"])

        def lists(gram, node, n, pos, far, most):  # noqa: ANN001  complete lists of at most `longest`
            cut_ = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            size = np.diff(np.concatenate([cut_, [len(gram)]]))
            for k in np.unique(size[size > 1]).tolist():
                base = cut_[size == k]
                i, j = np.triu_indices(k, 1)
                step = max(1, (1 << 18) // len(i))
                for x in range(0, len(base), step):
                    p, q = ((base[x : x + step, None] + m).ravel() for m in (i, j))
                    yield from out(node[p], node[q], n[p], n[q], pos[p], pos[q], np.minimum(far[p], far[q]), np.minimum(most[p], most[q]), False)

        hub, open_ = None, None  # (gram, centre, n of the last) of a long list under way; the last batch's last long gram
        rest = [np.zeros(0, np.int64)] * 6
        for batch in batches:
            cols = [np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, ("gram", "node", "n", "pos", "far", "most"), strict=True)]
            gram = cols[0]
            if not len(gram):
                continue
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(gram)]]))
            long_ = sizes > longest
            if open_ is not None and gram[0] == open_:
                long_[0] = True
            open_ = int(gram[-1]) if long_[-1] else None
            done = np.repeat(~long_, sizes)
            tail = sizes[-1] if not long_[-1] else 0  # an open short list waits
            done[len(gram) - tail :] = False
            yield from lists(*(c[done] for c in cols))
            for s, k in zip(starts[long_].tolist(), sizes[long_].tolist(), strict=True):
                g, node, n, pos = int(gram[s]), cols[1][s : s + k], cols[2][s : s + k].astype(np.int64), cols[3][s : s + k].astype(np.int64)
                went_on = hub is not None and hub[0] == g
                # the smallest size in the list that a member can link with, and what its place leaves to share
                least = n[np.searchsorted(n, -(-3 * n // 4))]
                if went_on:
                    least = np.where(4 * hub[2] >= 3 * n, -(-3 * n // 4), least)
                able = 7 * (n - pos + 1) >= 3 * (n + least)
                node, n = node[able], n[able]
                if not len(n):
                    continue
                prev = np.concatenate([[hub[2] if went_on else n[0]], n[:-1]])
                fresh = 4 * prev < 3 * n  # sizes too far apart for any link across
                at = np.maximum.accumulate(np.where(fresh, np.arange(len(n)), -1))
                centre = np.where(at < 0, hub[1] if went_on else node[0], node[np.maximum(at, 0)])
                z = np.zeros(len(n), np.int32)
                yield from out(centre, node, z, z, z, z, z, z, True)
                hub = (g, int(centre[-1]), int(n[-1]))
            rest = [c[len(gram) - tail :] for c in cols]
        if len(rest[0]):
            yield from lists(*rest)

    found = index.repartition("gram").sortWithinPartitions("gram", "n").mapInArrow(pairs, "a long, b long, na int, nb int, pa int, pb int, far int, most int, star boolean")
    met = found.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("far").alias("far"), F.max("most").alias("most"), F.max("star").alias("star"))
    # beyond the last shared place, or beyond the prefix that ends first, nothing is known to differ; nor is it in long lists
    beyond = F.greatest(*(F.expr(f"(3 * {n} + 3) div 4 - 1") for n in ("na", "nb")))
    possible = F.col("met") + F.least(F.col("far") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")), F.col("most") + beyond)
    return met.filter(F.col("star") | (7 * possible >= 3 * (F.col("na") + F.col("nb")))).select("a", "b")


def overlap_links(sets: list[np.ndarray], rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, with 100 * overlap >= 75 * union, by a blocked sparse product of the incidence."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    count = np.diff(np.concatenate([starts, [len(grams)]]))
    shared = count > 1
    starts, count = starts[shared], count[shared]
    dense = count >= max(24, m // 24)
    by_size = [(int(k), starts[~dense & (count == k)]) for k in np.unique(count[~dense]).tolist()]
    heavy = list(zip(starts[dense].tolist(), count[dense].tolist(), strict=True))
    for a in range(0, m, rows):
        b = min(m, a + rows)
        overlap = np.zeros((b - a, m), np.float32)
        flat = overlap.reshape(-1)
        for k, at in by_size:
            step = max(1, (1 << 19) // (k * k))
            for x in range(0, len(at), step):
                docs = owner[at[x : x + step, None] + np.arange(k)]
                left = np.repeat(docs, k, axis=1).ravel().astype(np.int64)
                right = np.tile(docs, (1, k)).ravel()
                ok = (left >= a) & (left < b) & (right > left)
                if ok.any():
                    flat += np.bincount((left[ok] - a) * m + right[ok], minlength=len(flat)).astype(np.float32) if ok.sum() * 8 > len(flat) else 0
                    if ok.sum() * 8 <= len(flat):
                        np.add.at(flat, (left[ok] - a) * m + right[ok], 1)
        for x in range(0, len(heavy), 1024):
            part = heavy[x : x + 1024]
            columns = np.zeros((m, len(part)), np.float32)
            for c, (s, k) in enumerate(part):
                columns[owner[s : s + k], c] = 1
            overlap += columns[a:b] @ columns.T
        i, j = np.nonzero(7 * overlap >= 3 * (sizes[a:b, None] + sizes[None, :]))
        ok = j > i + a
        yield i[ok] + a, j[ok]


def links(docs: DataFrame, ids: DataFrame, edges: DataFrame, block: int = BLOCK_SHINGLES, alone: int = ALONE) -> tuple[DataFrame, DataFrame]:
    """Exact links within candidate groups: ((node, root) stars of linked sets, (node, n_links)).

    A group of at most ``alone`` sets and ``block`` shingles meets in one cell. A larger one is dealt into
    blocks, each pair of which is a cell of the product; there are about an eighth as many cells as sets,
    so a cell stays small, and none holds more than two blocks.
    """
    group = connected_components(edges, contract=True)
    members = ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    # the smallest id may be null only if all are; such a set keeps its text by the node itself
    chosen = cut(group.join(members, "node").select("node", F.col("root").alias("grp"), "doc_id", "n", "copies"))
    sizes = chosen.groupBy("grp").agg(F.sum("n").alias("shingles"), F.count("*").alias("m"))
    many = F.when(F.col("m") > alone, F.greatest(F.ceil(F.sqrt(F.col("m") / 4)), F.ceil(F.col("m") / BLOCK_SETS))).otherwise(1)
    # only large groups are listed, so this is short, and a group's rows do not meet
    large = cut(sizes.select("grp", F.greatest(many, F.ceil(F.col("shingles") / block)).cast("int").alias("blocks")).filter("blocks > 1"))
    dealt = chosen.join(broadcast_up_to(large, BROADCAST_ROWS), "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("node", "doc_id", "copies", "grp", "blocks", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    placed = spread.groupBy("node", "doc_id").agg(F.collect_list(F.struct("grp", "lo", "hi", "own", "copies")).alias("places")).withColumnRenamed("doc_id", "rep_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for rows, got in _columns(batch):
                keep = [(int(r), s) for r, s in zip(rows, got, strict=True) if len(s) and set_id(s) == nodes[r]]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[r] for r, _ in keep], pa.int64()), batch.column("places").take(pa.array([r for r, _ in keep])), pa.array([s.tobytes() for _, s in keep], pa.binary())], ["node", "places", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = broadcast_up_to(placed, BROADCAST_ROWS // 4)
    wanted = texts.join(small, texts.doc_id.eqNullSafe(small.rep_id)).select("node", "places", "text")
    rows = wanted.mapInArrow(sets, "node long, places array<struct<grp:long,lo:int,hi:int,own:int,copies:long>>, shingles binary")
    rows = rows.select("node", "shingles", F.explode("places").alias("p")).select("node", "shingles", "p.*")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One block (or pair of blocks) after the other; rows arrive sorted by block."""

        def solve(own_pair: bool, node: list[int], sets_: list[np.ndarray], own_: list[int], copies: list[int]) -> pa.RecordBatch | None:
            last = {}
            for k, x in enumerate(node):
                last[x] = k
            at = sorted(last.values(), key=lambda k: node[k])  # repeated rows of an id count once
            ids_, part, weight_ = np.array([node[k] for k in at]), np.array([own_[k] for k in at]), np.array([copies[k] for k in at], np.int64)
            if len(at) < 2:
                return None
            ii, jj = [], []
            for i, j in overlap_links([sets_[k] for k in at]):
                if not own_pair:
                    across = part[i] != part[j]
                    i, j = i[across], j[across]
                ii.append(i)
                jj.append(j)
            i, j = np.concatenate(ii), np.concatenate(jj)
            if not len(i):
                return None
            root = local_roots(len(at), i, j)
            n = np.bincount(i, weight_[j], len(at)) + np.bincount(j, weight_[i], len(at))
            hit = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(ids_[hit]), pa.array(ids_[root[hit]]), pa.array(n[hit].astype(np.int64))], ["node", "root", "n"])

        key, node, sets_, own_, copies = None, [], [], [], []
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("grp", "lo", "hi", "node", "own", "copies")}
            raw = batch.column("shingles")
            for k in range(batch.num_rows):
                now = (cols["grp"][k], cols["lo"][k], cols["hi"][k])
                if now != key:
                    if key is not None and (out := solve(key[1] == key[2], node, sets_, own_, copies)) is not None:
                        yield out
                    key, node, sets_, own_, copies = now, [], [], [], []
                node.append(cols["node"][k])
                sets_.append(np.frombuffer(raw[k].as_buffer(), np.uint64))
                own_.append(cols["own"][k])
                copies.append(cols["copies"][k])
        if key is not None and (out := solve(key[1] == key[2], node, sets_, own_, copies)) is not None:
            yield out

    found = cut(rows.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi").mapInArrow(meet, "node long, root long, n long"))
    return found.select(F.col("node").alias("a"), F.col("root").alias("b")), found.groupBy("node").agg(F.sum("n").alias("others"))


def jaccard_components(docs: DataFrame, longest: int = LIST, block: int = BLOCK_SHINGLES, alone: int = ALONE, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs``.

    ``n_links`` counts the other rows that the document links with, copies included.
    """
    small_batches(docs.sparkSession)
    ids = cut(shingle_ids(docs))
    edges = candidate_edges(postings(docs, number_of_blocks(docs, least=least_blocks), longest), longest)
    stars, others = links(docs, ids, edges, block, alone)
    root = connected_components(stars, contract=True)
    nodes = ids.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    nodes = nodes.join(root, "node", "left").join(others, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(lowest, "root").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return ids.join(nodes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that link, directly or through others, with a document of smaller id.

    Of repeated rows of one id the first stays. Rows without an id stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"))
    gone = broadcast_up_to(cut(found.filter("doc_id <> component_id").select("doc_id").distinct()), BROADCAST_ROWS)
    twice = cut(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
