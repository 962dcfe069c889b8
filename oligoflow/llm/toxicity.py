"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, their prefixes of PREFIXES letters (insults share stems), and a second term for
a prefix that several distinct words share; each counts once, as a hash. The machine adds a weight for every term and, for
every pair of terms, the product of their latent vectors, so it can learn that an insult beside a group's name counts
more than either. Training takes at most PER_CLASS labelled rows of each class and weighs them back to their share. Of
the terms that at least MIN_DOCS of them hold it keeps those whose share differs between the classes by MIN_Z standard
errors, and those that tell something beside another term only: the PAIR_TERMS commonest and the strongest of the kept
ones are tried in pairs, and both terms of a pair stay whose product goes with the label by PAIR_Z standard errors more
than the two terms alone explain. All others have no effect on a score.

Cases: null and empty texts have no terms and score the intercept; a text of any length is read whole; repeated words
count once; with a single class among the labels the score is that class's share; other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, learn

PER_CLASS, MIN_DOCS, MIN_Z, BUCKETS, FACTORS = 4000, 4, 3.5, 1 << 22, 8
PAIR_TERMS, PAIR_Z = 512, 8.0
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A text with this score or more is rejected.
REJECT = 0.3


def terms(text: str | None) -> set[int]:
    """Hashes of the distinct terms of the whole text."""
    words = set(WORD.findall((text or "").lower()))
    once, twice = set(), set()
    for size in PREFIXES:
        for word in words:
            if len(word) > size:
                prefix = word[:size]
                (twice if prefix in once else once).add(prefix)
    crc = zlib.crc32
    found = {crc(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in words}
    found |= {crc(p.encode("utf-8", "surrogatepass"), 1) & (BUCKETS - 1) for p in once}
    return found | {crc(p.encode("utf-8", "surrogatepass"), 2) & (BUCKETS - 1) for p in twice}


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row sums of values between starts (the last start is the end); empty rows give zero."""
    total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def raw(model: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The machine's output before the sigmoid, for rows of term positions."""
    v = model["v"][ids]
    linear = _sums(model["w"][ids][:, None], starts)[:, 0]
    pairs = 0.5 * (_sums(v, starts) ** 2 - _sums(v * v, starts)).sum(axis=1)
    return model["w0"] + linear + pairs


def in_pairs(rows: list[np.ndarray], y: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Those of the tried terms that stand in a pair whose product goes with y, beyond what both terms give alone."""
    x = np.zeros((len(rows), len(tried)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(tried, r)
        at = at[at < len(tried)]
        x[i, at[np.isin(tried[at], r)]] = 1
    x -= x.mean(axis=0)
    spread = np.sqrt(np.maximum((x * x).sum(axis=0), 1e-9))
    left = (y - y.mean()).astype(np.float32)
    slope = x.T @ left / spread**2
    # y against the product of two centred terms; what each term alone explains of y is taken out to first order
    both = x.T @ (x * left[:, None])
    square = (x * x).T @ (x * x)
    alone = (x * x).T @ x * slope
    both -= alone + alone.T
    z = np.abs(both) / np.sqrt(np.maximum(square, 1e-9)) / max(float(left.std()), 1e-9)
    z[np.eye(len(tried), dtype=bool) | (square < MIN_DOCS)] = 0
    return tried[(z >= PAIR_Z).any(axis=1)]


def hashed(text: str | None) -> np.ndarray:
    """terms in order."""
    found = terms(text)
    return np.sort(np.fromiter(found, np.int32, len(found)))


def train(sample: pd.DataFrame, share: float, epochs: int = 12, seed: int = 7) -> dict:
    """A model from rows (terms, y); share is the share of y = 1 among all rows that may be learned from.

    terms are hashed() of a text, so a task that learns holds no texts; counts are kept for each possible term.
    """
    y = sample["y"].to_numpy(np.float64)
    empty = {"terms": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros((0, FACTORS)), "w0": float(np.log((share + 1e-3) / (1 - share + 1e-3)))}
    if len(set(y)) < 2:
        return empty
    rows = [np.asarray(t, np.int32) for t in sample["terms"]]
    counts, there = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for r, k in zip(rows, y):  # a row holds a term once
        counts[r] += 1
        if k:
            there[r] += 1
    held = np.flatnonzero(counts)
    counts, there = counts[held].astype(np.int64), there[held].astype(np.int64)
    n, n1 = len(y), y.sum()
    spread = np.sqrt(counts / n * (1 - counts / n) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    z = np.abs(there / n1 - (counts - there) / (n - n1)) / spread
    alone = held[(counts >= MIN_DOCS) & (z >= MIN_Z)]
    some = np.lexsort((held, -counts))[:PAIR_TERMS]
    strong = np.lexsort((held, -z * (counts >= MIN_DOCS)))[:PAIR_TERMS]
    held = np.union1d(alone, in_pairs(rows, y, np.unique(held[np.concatenate([some, strong])])))
    place = np.full(BUCKETS, -1, np.int32)
    place[held] = np.arange(len(held))
    rows = [p[p >= 0].astype(np.int64) for p in (place[r] for r in rows)]
    del counts, there, place
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    p = {"w0": np.array([empty["w0"]]), "w": np.zeros(len(held)), "v": rng.normal(0, 0.01, (len(held), FACTORS))}
    moment = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            ids = np.concatenate([rows[i] for i in pick])
            sizes = np.array([len(rows[i]) for i in pick])
            starts = np.r_[0, np.cumsum(sizes)]
            z = raw({"w0": p["w0"][0], "w": p["w"], "v": p["v"]}, ids, starts)
            slope = weight[pick] * (learn.sigmoid(z) - y[pick]) / len(pick)
            each = np.repeat(slope, sizes)
            total = np.repeat(_sums(p["v"][ids], starts), sizes, axis=0)
            grads = {"w0": np.array([slope.sum()]), "w": np.bincount(ids, each, len(held)) + 2e-5 * np.sign(p["w"]), "v": np.zeros_like(p["v"])}
            push = each[:, None] * (total - p["v"][ids])
            for f in range(FACTORS):
                grads["v"][:, f] = np.bincount(ids, push[:, f], len(held))
            grads["v"] += 1e-4 * p["v"]
            t += 1
            for k, a in p.items():
                m, s = moment[k]
                m += 0.1 * (grads[k] - m)
                s += 0.001 * (grads[k] ** 2 - s)
                a -= (0.02 if k != "v" else 0.005) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return {"terms": held, "w": p["w"], "v": p["v"], "w0": float(p["w0"][0])}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> dict:
    """A model from labels(doc_id, toxic) that meet may_learn."""
    count = labels.where(may_learn & F.col("toxic").isin(0, 1)).agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    share = count["k"] / count["n"] if count["n"] else 0.0

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([hashed(t) for t in texts], dtype=object)

    rows = learn.training_rows(docs, labels, "toxic", may_learn, PER_CLASS, [0, 1])
    rows = rows.select("doc_id", features("text").alias("terms"), "y", F.xxhash64("text").alias("tie"))
    return learn.fit_in_task(rows, lambda sample: train(sample, share), ["terms", "tie"])


#: Words whose model terms a worker remembers; others are worked out anew.
REMEMBERED = 100_000


class Scorer:
    """Scores texts; equal to raw() over terms(), but works out a word's part of them once."""

    def __init__(self, model: dict):
        self.model = model
        self.place = {int(t): i for i, t in enumerate(model["terms"])}
        self.known: dict[str, tuple | None] = {}

    def _part(self, word: str) -> tuple | None:
        """(places of the word's own terms, places of the terms its prefixes give when shared), None if none."""
        place, crc = self.place, zlib.crc32
        hashes = [crc(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)]
        prefixes = [word[:k].encode("utf-8", "surrogatepass") for k in PREFIXES if len(word) > k]
        hashes += [crc(p, 1) & (BUCKETS - 1) for p in prefixes]
        own = [place[h] for h in hashes if h in place]
        shared = [(p, place[h]) for p in prefixes if (h := crc(p, 2) & (BUCKETS - 1)) in place]
        found = (own, shared) if own or shared else None
        if len(self.known) < REMEMBERED:
            self.known[word] = found
        return found

    def places(self, text: str | None) -> list[int]:
        known, found, seen = self.known, set(), set()
        for word in set(WORD.findall((text or "").lower())):
            part = known[word] if word in known else self._part(word)
            if part:
                found.update(part[0])
                for prefix, term in part[1]:
                    if prefix in seen:
                        found.add(term)
                    seen.add(prefix)
        return sorted(found)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = [self.places(t) for t in texts]
        ids = np.array([i for r in rows for i in r], np.int64)
        return learn.sigmoid(raw(self.model, ids, np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int64)))


def score(docs: DataFrame, model: dict) -> Column:
    """The score (0 to 1) of docs.text, as a column."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pd.Series(scorer.scores(list(texts)))
        del scorer
        common.release()

    return run(docs["text"].cast("string"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below REJECT, all columns kept; learned from every labelled row of docs."""
    model = fit(docs, labels, F.lit(True))
    name = common.free_name(docs, "toxic_score")
    return docs.withColumn(name, score(docs, model)).where(F.col(name) < REJECT).drop(name)
