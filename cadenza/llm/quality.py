"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; unlabelled are all documents of the learning
folds. A logistic model over shape and byte-pair features is fitted by minimising the non-negative
unbiased risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

with the class prior ``pi`` estimated beforehand, from a first scorer's scores of all documents of the
learning folds. The fit runs on a bounded sample, chosen by a hash of the document id (``positives``
and ``unlabelled`` bound it); scoring reads every whole text.

Labels, language, source and id are never inputs of a score. Rows whose crc32(doc_id as text)
mod 4 is 2 are held out: neither their labels nor their texts are learned from.

Defined results: null text is scored as empty; a null ``doc_id`` is not held out; repeated rows
each get a row; without any positive label every score is the prior 0.5; an empty table gives no
rows; extra columns are ignored by ``score`` and passed on by ``reject_low_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.session import free_name, give_back, local_table, small_batches, table
from cadenza.llm.textkit import BLANK_SEPARATED, Words, text_slices

THRESHOLD = 0.7
POSITIVES = 4000
UNLABELLED = 8000
PAIRS = 256
BINS = 4096
FOLDS, HELD_OUT = 4, 2

_KINDS = np.zeros(256, np.intp)  # byte classes: 0 other
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))), 1):
    for _b in _bytes:
        _KINDS[_b] = _k
N_KINDS = 10
N_SHAPE = N_KINDS + 10


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text: byte classes, word and line shape, and hashed byte pairs."""
    out = np.zeros((len(column), N_SHAPE + PAIRS))
    for a, b, data, offsets in text_slices(column):
        words = Words(data, offsets, BLANK_SEPARATED)
        hashes = words.hashes()
        lengths = (words.ends - words.starts).astype(np.float64)
        kinds = _KINDS[data]
        pair = ((data[:-1].astype(np.int64) * 31 + data[1:]) * 0x9E3779B1 >> 12) % PAIRS
        newline = np.flatnonzero(data == 10)
        for k in range(b - a):
            s, e, p, q = int(offsets[k]), int(offsets[k + 1]), int(words.first[k]), int(words.first[k + 1])
            n, m = e - s, q - p
            x = out[a + k]
            if not n:
                continue
            x[:N_KINDS] = np.sqrt(np.bincount(kinds[s:e], minlength=N_KINDS) / n)
            x[N_KINDS] = np.log1p(n) / 10
            x[N_KINDS + 1] = np.log1p(m) / 10
            if m:
                values, counts = np.unique(hashes[p:q], return_counts=True)
                x[N_KINDS + 2] = len(values) / m
                x[N_KINDS + 3] = counts.max() / m
                x[N_KINDS + 4] = lengths[p:q].mean() / 10
                x[N_KINDS + 5] = lengths[p:q].std() / 10
                x[N_KINDS + 6] = (len(values) / m) * np.log1p(m) / 10
                if m >= 4:
                    steps = np.unique(hashes[p : q - 1] * np.uint64(3) + hashes[p + 1 : q])
                    x[N_KINDS + 7] = len(steps) / (m - 1)
            lines = newline[np.searchsorted(newline, s) : np.searchsorted(newline, e)]
            x[N_KINDS + 8] = np.log1p(n / (len(lines) + 1)) / 10
            x[N_KINDS + 9] = np.log1p(len(lines)) / 10
            if n > 1:
                x[N_SHAPE:] = np.sqrt(np.bincount(pair[s : e - 1], minlength=PAIRS) / (n - 1))
    return out


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


class Model:
    """A logistic model on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float, prior: float) -> None:
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from counts of both by score (in ``BINS`` equal bins) of a scorer not fitted on the positives counted.

    For any threshold, P_u(score >= t) >= prior * P_p(score >= t); the tightest such bound over
    thresholds that at least half of the positives pass is the estimate. Lower shares would make
    the ratio too noisy.
    """
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (positive, unlabelled))
    half = above_p >= 0.5
    return float(np.clip((above_u[half] / above_p[half]).min(), 0.05, 0.99)) if half.any() else 0.5


def bins(scores: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum((scores * BINS).astype(np.int64), BINS - 1), minlength=BINS)


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, ridge: float) -> Model:
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w, c = np.zeros(p.shape[1]), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        sp, su = sigmoid(p @ w + c), sigmoid(u @ w + c)
        negative_risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
        gu, gp = np.concatenate([u.T @ su, [su.sum()]]) / len(u), np.concatenate([p.T @ sp, [sp.sum()]]) / len(p)
        gpos = np.concatenate([p.T @ (sp - 1), [(sp - 1).sum()]]) / len(p)
        if negative_risk >= 0:
            g = prior * gpos + gu - prior * gp
        else:  # the estimated risk on negatives went below zero: step back
            g = -(gu - prior * gp)
        g[:-1] += ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        d = 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, c = w - d[:-1], c - d[-1]
    return Model(mean, scale, w, float(c), prior)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 500, ridge: float = 1e-3) -> Model:
    """Fit by the non-negative unbiased risk."""
    return _fit(positive, unlabelled, prior, steps, ridge)


def fit_rough(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 160, ridge: float = 1e-2) -> Model:
    """A first scorer, fitted on one half of the positives; the prior is estimated with the other half."""
    return _fit(positive[::2], unlabelled[::2], 0.7, steps, ridge)


def counts_by_score(docs: DataFrame, model: Model) -> np.ndarray:
    """How many documents of the learning folds score in each of ``BINS`` bins: all of them are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BINS, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                n += bins(shared.value.score(features(batch.slice(a, 512).column("text"))))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bin", "n"])

    learn = docs.filter(F.coalesce(fold() != HELD_OUT, F.lit(False))).select("text")
    out = np.zeros(BINS, np.int64)
    for r in learn.mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most BINS rows
        out[r.bin] = r.n
    return out


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model from a bounded sample of the learning folds; None without a positive label."""
    model = _trained(docs, labels, positives, unlabelled)
    give_back()  # the sample came as one object for each row
    return model


def _trained(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> Model | None:
    spark = docs.sparkSession
    small_batches(spark)
    ids = F.col("doc_id").cast("long").alias("doc_id")
    learn = F.coalesce(fold() != HELD_OUT, F.lit(False))
    spread = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = {r.doc_id for r in labels.filter("quality = 1").select(ids).distinct().filter(learn).orderBy(*spread).limit(positives).collect()}
    web = {r.doc_id for r in docs.select(ids).filter(learn).orderBy(*spread).limit(unlabelled).collect()}
    if not good or not web:
        return None
    either = sorted(good | web)
    chosen = local_table(spark, doc_id=pa.array(either, pa.int64()), good=pa.array([i in good for i in either], pa.bool_()), web=pa.array([i in web for i in either], pa.bool_()))
    rows = docs.select(ids, "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "good", "web")), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "good", "web", "x"])

    got = rows.mapInArrow(run, "doc_id long, good boolean, web boolean, x binary").toPandas().sort_values(["doc_id", "x"])
    if not got["good"].any() or not got["web"].any():
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64)
    positive, web_ = x[got["good"].to_numpy()], x[got["web"].to_numpy()]
    del got, x
    if len(positive) < 2:
        return fit_pu(positive, web_, 0.5)
    rough = fit_rough(positive, web_)
    return fit_pu(positive, web_, estimate_prior(bins(rough.score(positive[1::2])), counts_by_score(docs, rough)))


def score(docs: DataFrame, model: Model | None, keep: list[str], name: str = "quality_score") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and its score as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                s = fitted.score(features(part.column("text"))) if fitted is not None else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], [*keep, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"]))


def reject_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored under ``threshold``; all of them if nothing can be learned."""
    model = train(docs, labels)
    if model is None:
        return docs
    columns = docs.columns
    name = free_name(columns, "quality_score")
    return score(docs, model, columns, name).filter(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in columns))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
