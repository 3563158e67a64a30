"""The classifier's risk, class prior and query against independent computations."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import quality
from cadenza.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def draws(seed, n_positive=400, n_web=1200, share=0.4):
    rnd = np.random.default_rng(seed)
    good = lambda n: rnd.normal([1.0, 0.5], 1.0, (n, 2))
    bad = lambda n: rnd.normal([-1.0, -0.5], 1.0, (n, 2))
    k = int(n_web * share)
    return good(n_positive), np.concatenate([good(k), bad(n_web - k)]), bad(1000), good(1000)


def risk(theta, p, u, prior, ridge):
    """Written out from its definition, by log(1 + exp): positives at the loss of label 1, the rest by difference, not below zero."""
    loss = lambda z, y: np.logaddexp(0, -z if y else z).mean()
    zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
    rest = loss(zu, 0) - prior * loss(zp, 0)
    return prior * loss(zp, 1) + max(rest, 0.0) + ridge / 2 * (theta[:-1] ** 2).sum(), rest


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_is_a_minimum_of_the_risk(seed):
    positive, web, _, _ = draws(seed)
    model = quality.fit_pu(positive, web, 0.4, steps=4000, ridge=1e-2)
    p, u = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, web))
    theta = np.append(model.weight, model.bias)
    least, rest = risk(theta, p, u, 0.4, 1e-2)
    assert rest > 0  # the plain branch, where the risk is smooth
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-4
        slope = (risk(theta + step, p, u, 0.4, 1e-2)[0] - risk(theta - step, p, u, 0.4, 1e-2)[0]) / 2e-4
        assert abs(slope) < 5e-3
    rnd = np.random.default_rng(seed)
    assert all(risk(theta + rnd.normal(0, 0.3, len(theta)), p, u, 0.4, 1e-2)[0] >= least for _ in range(200))


def test_risk_of_the_rest_does_not_stay_below_zero():
    """Few positives in many dimensions: an unbiased risk without the step back runs far below zero."""
    rnd = np.random.default_rng(4)
    positive, web = rnd.normal(0, 1, (20, 60)), rnd.normal(0, 1, (60, 60))
    model = quality.fit_pu(positive, web, 0.8, steps=1500, ridge=0.0)
    p, u = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (positive, web))
    assert risk(np.append(model.weight, model.bias), p, u, 0.8, 0.0)[1] > -0.1


@pytest.mark.parametrize("share", [0.2, 0.4, 0.7])
def test_prior_of_a_planted_mixture(share):
    positive, web, _, held = draws(7, 2000, 8000, share)
    rough = quality.fit_rough(positive, web)
    found = quality.estimate_prior(quality.bins(rough.score(held)), quality.bins(rough.score(web)))
    s_p, s_u = rough.score(held), rough.score(web)
    plain = min(np.mean(s_u >= t) / np.mean(s_p >= t) for t in np.arange(quality.BINS) / quality.BINS if np.mean(s_p >= t) >= 0.5)
    assert abs(found - plain) < 1e-9 and abs(found - share) < 0.12


def test_trained_without_negatives_it_tells_them_apart():
    positive, web, bad, good = draws(5)
    model = quality.fit_pu(positive, web, 0.4)
    assert ((model.score(bad) < 0.5).mean() + (model.score(good) >= 0.5).mean()) / 2 > 0.8


def test_query_scores_each_text_by_itself(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    name = next(n for n in QUERIES if n.startswith("op6_"))
    got = QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        alone = float(model.score(quality.features(pa.array([text[r.doc_id]], pa.string())))[0])
        assert abs(r.score - alone) < 1e-9 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
