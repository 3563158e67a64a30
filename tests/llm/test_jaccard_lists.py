"""Links of sets whose shared shingles lie in lists of very different lengths, against brute force."""

import random

import pytest

from cadenza.llm import jaccard_join


def sets_of(rows):
    out = {}
    for k, text in rows:
        w = text.split()
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(rows):
    """{id: (size, component, links)}."""
    sets = sets_of(rows)
    ids = sorted(sets)
    root, links = {k: k for k in ids}, dict.fromkeys(ids, 0)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: (len(sets[k]), find(k), links[k]) for k in ids}


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(df, least_blocks=3, **options).collect()}


def mixed_lists():
    """Two documents that link by one rare shingle, one that 40 short documents hold and 22 that 60 long documents hold."""
    rnd = random.Random(1)
    word = iter(f"w{k}" for k in range(10**6))
    own = [next(word) for _ in range(6)]  # two shingles: one of the two documents alone, one that short documents hold too
    tail = [next(word) for _ in range(26)]
    rows = [(1, " ".join(tail + own)), (2, " ".join(own + tail))]  # 24 shingles in common, four each where the parts meet
    rows += [(10 + k, " ".join(own[1:] + [next(word) for _ in range(3)])) for k in range(40)]
    rows += [(100 + k, " ".join([next(word) for _ in range(30)] + tail + [next(word) for _ in range(30)])) for k in range(60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest", [2, jaccard_join.LIST])
def test_shingles_in_long_lists_before_rare_ones(spark, longest):
    rows = mixed_lists()
    want = brute(rows)
    assert want[2][1] == 1 and want[1][2] == 1
    assert found(spark, rows, longest=longest) == want


@pytest.mark.parametrize("seed,longest", [(1, 2), (4, jaccard_join.LIST)])
def test_skewed_shingles(spark, seed, longest):
    """Documents of boilerplate phrases drawn with falling frequency and of words of their own, edited here and there."""
    rnd = random.Random(seed)
    phrases = [[f"p{k}x{j}" for j in range(rnd.randint(4, 16))] for k in range(12)]
    bases = [sum((phrases[min(int(rnd.expovariate(0.5)), 11)] for _ in range(rnd.randint(1, 4))), [f"b{k}w{j}" for j in range(rnd.randint(0, 12))]) for k in range(60)]
    rows = []
    for k in range(220):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(4)}"
        rows.append((k, " ".join(words)))
    assert found(spark, rows, longest=longest) == brute(rows)
