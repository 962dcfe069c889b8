"""Language ID in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are hashed character trigrams of the lower-cased whole text (bytes of UTF-8, words set apart by a single
space), as square roots of frequencies scaled to length one. Families are told apart by one-versus-rest machines of
the same kind, languages within a family by one machine for each pair and their votes, margins settling ties.
Machines are trained by dual coordinate descent on at most PER_LANGUAGE rows of each language, or on fewer of each
where there are so many languages that all together would exceed SAMPLE rows; every language is learned.

Cases: null texts and texts without a letter are `und` with score 0; a language that FAMILIES lacks is a family of its
own; with a single language learned every text with a letter gets it; rows without lang or text are not learned from; with
none to learn from every text is `und`; ties go to the name that sorts first; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, learn

PER_LANGUAGE, SAMPLE, DIMENSIONS = 1000, 32_000, 1 << 13
#: Language families by ISO 639-1 code, fixed values.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "is": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "gl": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "be": "slavic", "bg": "slavic", "cs": "slavic", "hr": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "sl": "slavic", "sr": "slavic", "uk": "slavic",
    "et": "finnic", "fi": "finnic",
    "bn": "indic", "gu": "indic", "hi": "indic", "mr": "indic", "pa": "indic", "ur": "indic",
    "az": "turkic", "kk": "turkic", "tr": "turkic", "uz": "turkic",
}
LETTER = re.compile(r"[^\W\d_]")
GAPS = re.compile(r"[\W\d_]+")


def features(text: str) -> np.ndarray:
    data = np.frombuffer(f" {GAPS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(DIMENSIONS, np.float32)
    hashed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    hashed ^= hashed >> np.uint32(15)
    counts = np.sqrt(np.bincount(hashed & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS).astype(np.float32))
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 10, seed: int = 3) -> np.ndarray:
    """Weights, bias last, of a linear support vector machine (squared hinge) for labels -1 and 1."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    square = (x * x).sum(axis=1) + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def train(sample: pd.DataFrame) -> dict:
    langs = sorted(set(sample["y"]))
    x = np.array([features(t) for t in sample["text"]], np.float32).reshape(-1, DIMENSIONS)
    y = sample["y"].to_numpy()
    family = {lang: FAMILIES.get(lang, lang) for lang in langs}
    families = sorted(set(family.values()))
    of = np.array([family[v] for v in y])
    model = {"families": families, "members": {f: [v for v in langs if family[v] == f] for f in families}, "rest": {}, "pairs": {}}
    if len(families) > 1:
        model["rest"] = {f: machine(x, np.where(of == f, 1, -1)) for f in families}
    for f in families:
        for a, b in combinations(model["members"][f], 2):
            mine = (y == a) | (y == b)
            model["pairs"][a, b] = machine(x[mine], np.where(y[mine] == a, 1, -1))
    return model


def fit(docs: DataFrame, may_learn) -> dict:
    labels = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    langs = sorted(r["lang"] for r in labels.select("lang").distinct().collect())  # one row for each language
    if not langs:
        return {"families": []}
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(langs)))
    return learn.fit_in_task(learn.training_rows(docs.where(F.col("text").isNotNull()), labels, "lang", F.lit(True), each, langs), train)


def predict(model: dict, text: str | None) -> tuple[str, float]:
    if not text or not model["families"] or not LETTER.search(text):
        return "und", 0.0
    x = np.append(features(text), np.float32(1))
    family, sure = model["families"][0], 1.0
    if model["rest"]:
        margins = {f: float(w @ x) for f, w in model["rest"].items()}
        family = max(model["families"], key=lambda f: margins[f])
        others = max(v for f, v in margins.items() if f != family)
        sure = float(learn.sigmoid(2 * (margins[family] - others)))
    votes = {v: [0, 0.0] for v in model["members"][family]}
    for a, b in combinations(votes, 2):
        margin = float(model["pairs"][a, b] @ x)
        votes[a if margin >= 0 else b][0] += 1
        votes[a][1] += margin
        votes[b][1] -= margin
    best = max(votes, key=lambda v: tuple(votes[v]))
    if len(votes) > 1:
        sure *= float(learn.sigmoid(4 * votes[best][1] / (len(votes) - 1)))
    return best, sure


def identify(docs: DataFrame, model: dict):
    """struct<lang string, score double> of docs.text, as a column."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([predict(sent.value, t) for t in texts], columns=["lang", "score"])

    return run(docs["text"].cast("string"))
