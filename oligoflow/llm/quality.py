"""Quality by compression with two zstandard dictionaries, one from good and one from bad labelled text.

A text is cut into blocks of BLOCK bytes, all of it, so short that the dictionary counts for more than the block's own
past; each block is compressed with either dictionary. The difference of the two totals, divided by the text's bytes,
says which dictionary the text resembles, and a logistic curve fitted on labelled rows that no dictionary saw turns it
into the score.

Cases: null and empty texts compress to nothing under both, a difference of zero; a short text is one short block;
with a single class among the labels, or too few rows for a dictionary, the score is the share of label 1; other
columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, learn

PER_CLASS, BLOCK, DICTIONARY, LEVEL = 3000, 256, 64 << 10, 3


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def difference(self, text: str | None) -> float:
        """Positive if the good dictionary makes the text smaller."""
        parts = blocks(text)
        good, bad = sum(len(self.good.compress(p)) for p in parts), sum(len(self.bad.compress(p)) for p in parts)
        return (bad - good) / sum(map(len, parts)) if parts else 0.0


def _dictionary(texts: list[str]) -> bytes:
    parts = [b for t in texts for b in blocks(t)]
    return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()


def train(sample: pd.DataFrame, share: float) -> dict:
    """Dictionaries from the rows with an even number, the curve from the others."""
    y, model = sample["y"].to_numpy(np.float64), {"share": share}
    even = np.arange(len(sample)) % 2 == 0
    if min((y[even] == k).sum() for k in (0, 1)) < 4 or min((y[~even] == k).sum() for k in (0, 1)) < 4:
        return model
    try:
        good, bad = (_dictionary(sample["text"][even & (y == k)].tolist()) for k in (1, 0))
    except zstandard.ZstdError:  # too little text for a dictionary
        return model
    compressors = Compressors(good, bad)
    x = np.array([compressors.difference(t) for t in sample["text"][~even]])
    y = y[~even]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return model | {"good": good, "bad": bad, "curve": learn.logistic(x[:, None], y, weight, ridge=1e-4)}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> dict:
    count = labels.where(may_learn & F.col("quality").isin(0, 1)).agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("k")).first()
    share = count["k"] / count["n"] if count["n"] else 0.5
    rows = learn.training_rows(docs, labels, "quality", may_learn, PER_CLASS, [0, 1])
    return learn.fit_in_task(rows, lambda sample: train(sample, share))


def score_texts(model: dict, compressors: Compressors | None, texts: list[str | None]) -> np.ndarray:
    if compressors is None:
        return np.full(len(texts), float(model["share"]))
    slope, base = model["curve"]
    return learn.sigmoid(slope * np.array([compressors.difference(t) for t in texts]) + base)


def score(docs: DataFrame, model: dict) -> Column:
    """The score (0 to 1, higher: better) of docs.text, as a column."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = sent.value
        compressors = Compressors(found["good"], found["bad"]) if "good" in found else None
        for texts in batches:
            yield pd.Series(score_texts(found, compressors, list(texts)))

    return run(docs["text"].cast("string"))
