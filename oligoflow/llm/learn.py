"""Bounded labelled samples, calibration and model delivery, shared by the three classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fit: Column, per_class: int, classes: list) -> DataFrame:
    """(doc_id, text, y) of at most per_class rows of each class among labels rows that meet fit."""
    ids = labels.where(fit & F.col(label).isin(classes)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
    chosen = common.sample_ids(ids, "y", per_class, classes)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def fit_in_task(rows: DataFrame, trainer: Callable[[pd.DataFrame], dict], columns: list[str] | None = None) -> dict:
    """Train on a bounded sample in one executor task and bring back the model.

    rows has doc_id, y and columns (text, if none are given); of several rows of one id the last column tells the order.
    Null ids don't occur; without rows the trainer gets an empty sample.
    """
    columns = columns or ["text"]
    common.small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = pd.concat([pd.DataFrame({"doc_id": [], "y": [], **{c: [] for c in columns}}), *batches], ignore_index=True)
        sample = sample.sort_values(["doc_id", columns[-1]]).reset_index(drop=True)
        yield pd.DataFrame({"model": [pickle.dumps(trainer(sample))]})
        del sample
        common.release()

    found = rows.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(bytes(found["model"])) if found else trainer(pd.DataFrame({"doc_id": [], "y": [], **{c: [] for c in columns}}))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients, intercept last, of a ridge logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(y)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    pull = np.eye(x.shape[1]) * ridge
    pull[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull @ beta
        beta -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, gradient)
    return beta


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
