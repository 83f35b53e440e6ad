"""Mixing to target weights by soft membership.

A softmax classifier, learned from the table of labels on hashed words and a few
figures of form, gives every document posteriors over domains.  Rates, one a
document and not negative, are then fitted by projected gradient steps so that
the expected tokens of each domain, ``sum(rate * tokens * posterior)``, match
the targets in least squares.

A step needs the domains' totals and their Gram matrix, which Spark sums; what
comes back to the tasks is one vector of as many numbers as there are domains.
A document's rate is a fold of its own posteriors over the steps so far, so no
state is kept between steps and a lost executor costs nothing.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, durable, pack, ship, unpack
from .words import U, Words, pieces

#: Hashed words, figures of form, labelled rows that learning takes at most (those of smallest hash).
BUCKETS, FORM, SAMPLE = 512, 6, 6000
#: Evaluations of the fit at most; the relative miss at which a target counts as met, and the relative gain below which the fit has settled.
STEPS, CLOSE, SETTLED = 100, 1e-6, 1e-4


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of each text, features of each text) for runs of texts; whole texts."""
    for a, b, w in pieces(texts):
        n, size = b - a, np.diff(w.first)
        text = np.repeat(np.arange(n), size)
        cell = (w.hash >> U(64 - 9)).astype(np.int64)
        x = np.zeros((n, BUCKETS + FORM), np.float32)
        counts = np.bincount(text * BUCKETS + cell, minlength=n * BUCKETS).reshape(n, BUCKETS)
        x[:, :BUCKETS] = np.log1p(counts)
        x[:, :BUCKETS] /= np.maximum(1e-6, np.linalg.norm(x[:, :BUCKETS], axis=1, keepdims=True))
        x[:, BUCKETS:] = _form(w, text, n, size)
        yield size, x


def _form(w: Words, text: np.ndarray, n: int, size: np.ndarray) -> np.ndarray:
    """Share of upper-case letters, of other signs and of digits, mean word length, log of words, distinct words' share."""
    data = w.data
    at = np.repeat(text, w.end - w.start)
    held = np.zeros(len(data) + 1, np.int64)
    np.add.at(held, w.start, 1)
    np.add.at(held, w.end, -1)
    data = data[np.cumsum(held[:-1]) > 0]
    chars = np.maximum(1, np.bincount(at, minlength=n))
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    other = (data < 128) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    first = np.unique(np.stack([text.astype(U), w.hash]), axis=1)[0].astype(np.int64) if len(text) else np.zeros(0, np.int64)
    share = lambda m: np.bincount(at[m], minlength=n) / chars
    some = np.maximum(1, size)
    return np.stack([share(upper), share(other), share(digit), chars / some / 10, np.log1p(size) / 5, np.bincount(first, minlength=n) / some], 1)


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """Softmax weights (features and one x domains) from labelled (id, domain), of which ``sample`` rows at most are taken."""
    few = labelled.where(F.col("domain").isin(domains)).select(F.col("id"), "domain").distinct().orderBy(F.xxhash64("id"), "id", "domain").limit(sample)
    rows = columns(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(few), "id")  # bounded by sample
    # of rows that repeat an id one text is learned from, so that what comes back is bounded by sample, too
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")
    rows = rows.groupBy("id", "domain").agg(one).select("id", "domain", "m.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for _, x in features(b.column(2)):
                k = len(x)
                yield pa.RecordBatch.from_pydict({"id": b.column(0).slice(at, k), "domain": b.column(1).slice(at, k), "x": pa.array([pack(v) for v in x], pa.binary())})
                at += k

    got = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, domain string, x binary").collect()
    got.sort(key=lambda r: (r["id"], r["domain"]))
    w = np.zeros((BUCKETS + FORM + 1, len(domains)))
    if not got:
        return w
    x = np.stack([unpack(r["x"], np.float32)[0] for r in got])
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    y = np.zeros((len(x), len(domains)), np.float32)
    y[np.arange(len(x)), [domains.index(r["domain"]) for r in got]] = 1
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 301):
        g = x.T @ (_softmax(x @ w) - y) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def posteriors(docs: DataFrame, w: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (a hash of the text), tokens (words of the whole text) and p (a probability a domain) for every row."""
    told = docs.sparkSession.sparkContext.broadcast(w)
    rows = columns(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64("text").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for size, x in features(b.column(2)):
                p, k = _softmax(np.concatenate([x, np.ones((len(x), 1), np.float32)], 1) @ told.value), len(x)
                offsets = pa.array(np.arange(k + 1) * p.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k), b.column(1).slice(at, k), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], ["id", "key", "tokens", "p"])
                at += k

    shape = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {shape}, key long, tokens long, p array<double>")


def _rate(steps: list[np.ndarray]) -> Column:
    """A document's rate after these steps, from 1 on."""
    if not steps:
        return F.lit(1.0)
    all_ = F.array(*(F.array(*map(F.lit, map(float, s))) for s in steps))
    move = lambda s: F.aggregate(F.zip_with("p", s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(all_, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


class Fit(NamedTuple):
    """Steps taken, totals of the domains reached and wished for, whether they are met, and whether the least squares have settled."""

    taken: list[np.ndarray]
    reached: np.ndarray
    goal: np.ndarray
    met: bool
    settled: bool


def fit_rates(soft: DataFrame, weights: list[float], total: float | None = None, steps: int = STEPS) -> Fit:
    """Steps that lead to rates whose totals are nearest to the targets.

    ``soft`` has tokens and p; ``weights`` are the domains' shares of ``total``
    (all tokens if not given).  Steps are in the metric of the documents that
    still have a rate above 0, and along the plain gradient once these bring the
    totals no nearer; a step that doesn't is not taken and made shorter.  So
    targets that cannot be met end as near to them as rates can bring them.
    """
    d = len(weights)
    size = float(soft.agg(F.sum("tokens")).first()[0] or 0)
    goal = np.array(weights, float) / sum(weights) * (size if total is None else total)
    if not size:
        return Fit([], np.zeros(d), goal, not goal.any(), True)
    p = [F.get("p", F.lit(i)) for i in range(d)]

    def look(taken: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Totals, and the Gram matrix of the documents that have a rate."""
        x = soft.withColumn("r", _rate(taken))
        pairs = [(i, j) for i in range(d) for j in range(d)]
        sums = x.agg(*(F.sum(F.col("r") * F.col("tokens") * q) for q in p), *(F.sum(F.when(F.col("r") > 0, F.col("tokens") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs)).first()
        v = np.array(sums, float)
        return v[:d], v[d:].reshape(d, d) / size

    taken: list[np.ndarray] = []
    reached, gram = look(taken)
    bold, length, slow, seen = True, 1.0, 0, 1
    while True:
        miss = (reached - goal) / size
        if np.abs(miss).max() < CLOSE:
            return Fit(taken, reached, goal, True, True)
        if slow >= 4 or length < 1e-3 or seen >= steps:
            return Fit(taken, reached, goal, False, slow >= 4 or length < 1e-3)
        step = length * (np.linalg.solve(gram + 1e-9 * np.eye(d), miss) if bold else miss / np.linalg.eigvalsh(gram)[-1])
        got, seen = look([*taken, step]), seen + 1
        now, then = (((got[0] - goal) / size) ** 2).sum(), (miss**2).sum()
        if now >= then:
            length /= 4
            if bold and length < 0.2:
                bold, length = False, 1.0
            continue
        slow = slow + 1 if now > (1 - SETTLED) * then else 0
        taken, (reached, gram) = [*taken, step], got
        length = min(2 * length, 1.0) if bold else 2 * length


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """id_col, text_key, n_tokens, posteriors (array, domains by name), rate and copies for every row.

    ``labelled`` has (id, domain); ``weights`` gives each domain's share.  copies
    rounds the rate up or down by a hash of id and text, so that its expectation
    is the rate; rows that repeat id and text get the same.  A null text has no
    tokens, and the rate of its posteriors.  Without labels all posteriors are
    equal; an empty table gives an empty result.  Ids may be of any type and
    null (such rows cannot be labelled); of an id that repeats, one text is
    learned from.  Targets that cannot be met are warned of, with the totals
    reached.  Other columns are not read, so their names cannot clash.
    """
    ship(docs.sparkSession)
    domains = sorted(weights)
    w = learn(docs, labelled, domains, id_col, text_col)
    soft = durable(posteriors(docs, w, id_col, text_col))
    fit = fit_rates(soft, [weights[d] for d in domains], total)
    if not fit.met:
        how = "the nearest that rates reach" if fit.settled else f"not settled after {STEPS} evaluations"
        warnings.warn(f"targets {dict(zip(domains, fit.goal.tolist()))} are missed: {fit.reached.tolist()} tokens, {how}", stacklevel=2)
    out = soft.withColumn("rate", _rate(fit.taken))
    chance = (F.xxhash64("id", "key", F.lit("mix")) / F.lit(2.0**64)) + 0.5
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.col("tokens").alias("n_tokens"), F.col("p").alias("posteriors"), "rate", copies.alias("copies"))


#: Shares of tokens that the registered query and the pipeline aim at.
WEIGHTS = {"clean": 0.82, "low": 0.12, "toxic": 0.06}


def domains_of(labels: DataFrame) -> DataFrame:
    """(id, domain) of the table of labels: toxic, else clean or low by quality; rows without a label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where("domain IS NOT NULL AND id IS NOT NULL")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = mix(docs, domains_of(labels), WEIGHTS)
    p = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(sorted(WEIGHTS))]
    return out.select("doc_id", "n_tokens", *p, "rate", "copies")
