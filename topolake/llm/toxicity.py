"""Toxicity by cumulative-link ordinal regression over sparse text features.

A text's features are its words and its words' first 4 and 5 letters (which catch inflected forms), each with value
ln(1 + occurrences), so one insult counts as much in a long text as in a short one. With thresholds t0 < t1 < ... and one
weight vector w for all of them, P(grade <= k) = sigmoid(t_k - w.x); expected severity is the sum of P(grade > k).

The model is fitted on at most `max_docs` labelled documents, picked by a hash of doc_id. Of their features all those count
whose share among graded and clean documents differs by `least_z` standard errors or more. Labels that only say toxic or
not are graded first, by evidence from other documents: the sample is dealt into two folds, the features that mark toxic
documents in one fold grade the toxic documents of the other by their occurrences, cut at their terciles into grades 1, 2
and 3; clean is 0. No document's own words choose the marks that grade it.

Defined results: a null or empty text has no features and gets the base rate's severity; null labels are left out; repeated
rows each get a row, and in the sample each count; without labels of both kinds every severity is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .util import own, shared_dir, slices, stored

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Occurrences of words ("word") and of their beginnings ("wor*")."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[w] += n
        for k in (4, 5):
            if len(w) >= k:
                out[w[:k] + "*"] += n
    return out


@dataclass(frozen=True)
class Model:
    """weights by feature, one vector for all thresholds."""

    weights: dict[str, float]
    thresholds: np.ndarray

    @cached_property
    def beginnings(self) -> tuple[frozenset, frozenset]:
        """The features that are words' first 4 and 5 letters."""
        return tuple(frozenset(f[:-1] for f in self.weights if f[-1] == "*" and len(f) == k + 1) for k in (4, 5))

    def grades(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) by text and k."""
        known, (b4, b5) = self.weights, self.beginnings
        s = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not t:
                continue
            hit: dict[str, int] = {}
            for w, n in Counter(_WORD.findall(t.lower())).items():
                if w in known:
                    hit[w] = hit.get(w, 0) + n
                if w[:4] in b4 and len(w) >= 4:
                    hit[w[:4] + "*"] = hit.get(w[:4] + "*", 0) + n
                if w[:5] in b5 and len(w) >= 5:
                    hit[w[:5] + "*"] = hit.get(w[:5] + "*", 0) + n
            s[i] = sum(self.weights[f] * np.log1p(n) for f, n in sorted(hit.items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_features: int, l2: float = 0.05, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the cumulative-link likelihood of grades y; X in coordinates; full-batch Adam."""
    k = int(y.max())
    w = np.zeros(n_features)
    share = np.array([(y <= j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(start), 0.05))
    p = np.r_[w, start[0], gap]
    m, v = np.zeros_like(p), np.zeros_like(p)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n = len(y)
    for step in range(1, steps + 1):
        t = np.r_[p[n_features], p[n_features] + np.cumsum(np.exp(p[n_features + 1 :]))]
        s = np.bincount(rows, vals * p[cols], n)
        up = np.where(y < k, sigmoid(t[np.minimum(y, k - 1)] - s), 1.0)
        low = np.where(y > 0, sigmoid(t[np.maximum(y - 1, 0)] - s), 0.0)
        prob = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / prob, low * (1 - low) / prob
        ds = dl - du  # of the log-likelihood, by the score
        dt = np.bincount(np.minimum(y, k - 1), np.where(y < k, du, 0), k) - np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dl, 0), k)
        g = np.zeros_like(p)
        g[:n_features] = -np.bincount(cols, vals * ds[rows], n_features) / n + l2 * p[:n_features] / n
        g[n_features] = -dt.sum() / n
        g[n_features + 1 :] = -(np.cumsum(dt[::-1])[::-1][1:] * np.exp(p[n_features + 1 :])) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], np.r_[p[n_features], p[n_features] + np.cumsum(np.exp(p[n_features + 1 :]))]


def grades_of(y: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Grades 0, 1, 2... of labels 0 and 1: evidence of the toxic ones cut at its terciles, grades without a document closed up."""
    cuts = np.quantile(evidence[y > 0], [1 / 3, 2 / 3])
    grade = np.where(y > 0, 1 + (evidence[:, None] > cuts[None, :]).sum(axis=1), 0)
    return np.searchsorted(np.unique(grade), grade)


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", graded: bool = False, max_docs: int = 20_000, least_z: float = 4.0) -> Model:
    """Fit on documents with a label; `graded` says that `grade` already holds severities 0, 1, 2...

    The sample of at most max_docs (doc_id, label) rows is broadcast; all else stays distributed until it is reduced to the
    chosen features of the sample. Where documents repeat an id, the rows taken are again at most max_docs in expectation.
    """
    shared_dir(docs.sparkSession)
    known = own(labels, "doc_id", grade).where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(grade).cast("int").alias("y"))
    picked = known.orderBy(F.xxhash64(F.lit("toxicity"), "_id"), "_id", "y").limit(max_docs)
    met = own(docs, "doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
    if (rows := met.count()) > max_docs:
        met = met.where(F.pmod(F.xxhash64(F.lit("rows"), "doc_id", "text", "y"), F.lit(1 << 30)) < int((1 << 30) * max_docs / rows))
    sample = stored(met.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int")), "labelled")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            seen: dict[tuple[int, bool], Counter] = {(fold, bad): Counter() for fold in (0, 1) for bad in (False, True)}
            for t, y, fold in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                seen[fold, bool(y)].update(features(t).keys())
            names = list(set().union(*seen.values()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in seen)], ["f", "good0", "bad0", "good1", "bad1"])

    parts = ["good0", "bad0", "good1", "bad1"]
    n = sample.agg(*(F.count(F.when((F.col("fold") == int(p[-1])) & ((F.col("y") > 0) == (p[:-1] == "bad")), 1)).alias(p) for p in parts)).first()
    if not n["bad0"] + n["bad1"] or not n["good0"] + n["good1"]:
        return Model({}, np.full(1, 40.0))

    def z(folds: tuple[int, ...]) -> Column:
        bad, good = (sum(n[f"{kind}{k}"] for k in folds) for kind in ("bad", "good"))
        if not bad or not good:
            return F.lit(0.0)
        some, others = (sum(F.col(f"{kind}{k}") for k in folds) for kind in ("bad", "good"))
        pool = (some + others) / float(bad + good)
        return (some / bad - others / good) / F.sqrt(pool * (1 - pool) * (1 / bad + 1 / good) + 1e-12)

    seen = sample.mapInArrow(count, "f string, " + ", ".join(f"{p} long" for p in parts)).groupBy("f").agg(*(F.sum(p).alias(p) for p in parts))
    # mark k grades the documents of fold k by what the other fold shows
    scored = seen.select("f", z((0, 1)).alias("z"), (z((1,)) >= least_z).alias("mark0"), (z((0,)) >= least_z).alias("mark1"))
    chosen = scored.where((F.abs("z") >= least_z) | F.col("mark0") | F.col("mark1")).orderBy(F.desc(F.abs("z")), "f").collect()  # of the bounded sample
    index = {r["f"]: i for i, r in enumerate(r for r in chosen if abs(r["z"]) >= least_z)}
    if not index:
        return Model({}, np.full(1, 40.0))
    marks = {k: frozenset(r["f"] for r in chosen if r[f"mark{k}"]) for k in (0, 1)}

    def rows_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            cols, counts, evidence = [], [], []
            for t, fold in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = features(t)
                hit = sorted((index[f], k) for f, k in found.items() if f in index)
                cols.append([i for i, _ in hit])
                counts.append([k for _, k in hit])
                evidence.append(sum(k for f, k in found.items() if f in marks[fold]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cols, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(evidence, pa.int64())], ["doc_id", "y", "cols", "n", "evidence"])

    got = sample.select("doc_id", "text", "y", "fold").mapInArrow(rows_of, "doc_id long, y int, cols array<int>, n array<int>, evidence long").orderBy("doc_id", "y", "cols", "n").collect()  # at most max_docs rows
    y = np.array([r["y"] for r in got])
    at = np.repeat(np.arange(len(got)), [len(r["cols"]) for r in got])
    cols = np.array([c for r in got for c in r["cols"]], np.int64)
    values = np.log1p(np.array([c for r in got for c in r["n"]], float))
    if not graded:
        y = grades_of((y > 0).astype(int), np.array([r["evidence"] for r in got], float))
    w, t = fit_ordinal(at, cols, values, y, len(index))
    return Model({f: float(w[i]) for f, i in index.items()}, t)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each chosen feature of the bounded sample

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            above = shared.value.grades(b.column(1).to_pylist())
            at_least = np.c_[np.ones(len(above)), above, np.zeros(len(above))]
            grade = (at_least[:, :-1] - at_least[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    shared_dir(docs.sparkSession)
    return own(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")
