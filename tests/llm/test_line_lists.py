"""Lines that share segments with very many others: what meets there, and by which bounds."""

import random

import pytest

import corpus_pipeline
from cadenza.llm import line_dedup
from tests.llm.test_operators import line_classes


@pytest.mark.parametrize("most", range(20))
def test_two_places_differ_by_each_shift(most):
    few = line_dedup.shifts(most)
    assert few[0] == 0 and {b - a for a in few for b in few} >= set(range(-most, most + 1)) and (most < 2 or len(few) < 2 * most + 1)


def near_copies():
    """Copies of one line that differ in other places, most too far apart to be alike."""
    rnd = random.Random(3)
    base = " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(70))
    rows = []
    for i in range(160):
        k = rnd.randrange(0, len(base))
        rows.append((i, base[:k] + "".join(rnd.choice("bcfgjkmpqvwxyz") for _ in range(4)) + base[k:]))
    rows += [(160 + i, rows[i][1][:-9] + "é" + rows[i][1][-9:]) for i in range(0, 160, 4)]
    return rows


def counted(monkeypatch):
    """Numbers of the pairs whose distances are computed from now on."""
    counts, verified = [], line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *more: (counts.append(pairs.count()), verified(pairs, *more))[1])
    return counts


def test_near_copies_do_not_meet_in_pairs(spark, monkeypatch):
    """Few pairs of near copies are compared, and links are those of brute force."""
    rows, counts = near_copies(), counted(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.pos) for r in line_dedup.removed_lines(df).collect()}
    assert got == line_classes(rows) and len(got) >= 40
    assert sum(counts) < len(rows) ** 2 / 6  # of half the square, most before


def test_near_copies_in_the_pipelines_stage(spark, monkeypatch):
    rows, counts = near_copies(), counted(monkeypatch)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    left = {r.doc_id for r in corpus_pipeline.line_deduplication(spark, docs, "").collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in line_classes(rows)}
    assert sum(counts) < len(rows) ** 2 / 6


def test_signatures_take_no_row_for_each_character(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, "")], "id long, line string")
    assert "Generate" not in line_dedup.signatures(texts)._jdf.queryExecution().toString()


def test_part_signatures_change_by_bounds(spark):
    """Of what lines begin and end with, apart from each other, at most two parities differ for each edit."""
    rnd, rows, edits = random.Random(4), [], []
    for k in range(150):
        a = [rnd.choice("abcdefé ") for _ in range(rnd.choice([20, 33, 61, 84, 99, 300]))]
        b, e = a[:], k % 5
        for _ in range(e):
            i = rnd.randint(0, len(b))
            b[i : i + rnd.randint(0, 1)] = [rnd.choice("xyé")] * rnd.randint(0, 1)
        edits.append((e, max(1, min(len(a), len(b)) // 20)))
        rows += [(2 * k, edits[-1][1], "".join(a)), (2 * k + 1, edits[-1][1], "".join(b))]
    found = {r.id: r for r in line_dedup.part_signatures(spark.createDataFrame(rows, "id long, c int, line string")).collect()}
    flips = lambda p, q: bin((p ^ q) & (2**64 - 1)).count("1")
    seen = 0
    for k, (e, _) in enumerate(edits):
        x, y = found[2 * k], found[2 * k + 1]
        n = min(len(x.heads), len(y.heads))
        for j in range(n + 1):
            changed = (flips(x.heads[j - 1], y.heads[j - 1]) if j else 0) + (flips(x.tails[n - j - 1], y.tails[n - j - 1]) if j < n else 0)
            assert changed <= 2 * e
            seen = max(seen, changed)
    assert seen >= 5
    assert all(x.heads and x.tails for x in found.values())
