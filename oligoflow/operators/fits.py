"""Maximum likelihood fits by Newton steps on sums: no values and no histogram come to the driver.

A gamma fit needs three sums over the data, and its steps are one expression on them. Weibull and negative binomial fits
need new sums for each step: one aggregate over the data each, and what comes to the driver is one row. Digamma and
trigamma are series, as columns and as SQL, so that the same steps can be taken elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import written

#: Places that the series shift their argument by, and the steps taken.
SHIFT, STEPS = 8, 40


def digamma(x, log: Callable = F.log):
    """The derivative of the logarithm of the gamma function: a recurrence up to x + SHIFT, then the asymptotic series."""
    y = x + SHIFT
    v = 1 / (y * y)
    out = log(y) - 1 / (2 * y) - v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v / 240)))
    for i in range(SHIFT):
        out = out - 1 / (x + i)
    return out


def trigamma(x):
    """The derivative of digamma."""
    y = x + SHIFT
    v = 1 / (y * y)
    out = 1 / y + v / 2 + v / y * (1 / 6 - v * (1 / 30 - v * (1 / 42 - v / 30)))
    for i in range(SHIFT):
        out = out + 1 / ((x + i) * (x + i))
    return out


def digamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    v = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 1 / (2 * {y}) - {v} * (1.0 / 12 - {v} * (1.0 / 120 - {v} * (1.0 / 252 - {v} / 240))) - " + " - ".join(f"1 / ({x} + {i})" for i in range(SHIFT)) + ")"


def trigamma_sql(x: str) -> str:
    y = f"({x} + {SHIFT})"
    v = f"(1 / ({y} * {y}))"
    return f"(1 / {y} + {v} / 2 + {v} / {y} * (1.0 / 6 - {v} * (1.0 / 30 - {v} * (1.0 / 42 - {v} / 30))) + " + " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(SHIFT)) + ")"


def _values(depth: DataFrame) -> DataFrame:
    """(x, w): the positive depths and how often they occur, as a written table that may be of any size."""
    rows = depth.where("n_reads > 0").groupBy(F.col("n_reads").cast("double").alias("x")).agg(F.count("*").cast("double").alias("w"))
    return written(rows, "depths")


def gamma_shape(mean: Column, mean_log: Column) -> Column:
    """The shape of the best gamma distribution, by Newton steps on log(k) - digamma(k) = log(mean) - mean of logs."""
    s = F.log(mean) - mean_log
    first = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, lambda k, _: k - (F.log(k) - digamma(k) - s) / (1 / k - trigamma(k)))


def fit_gamma(depth: DataFrame) -> DataFrame:
    """(n, k, theta) of depth(n_reads): one pass, and no driver. Equal depths alone have no spread, so k is null."""
    x = F.when(F.col("n_reads") > 0, F.col("n_reads").cast("double"))
    sums = depth.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.log(x)).alias("mean_log"))
    spread = F.log("mean") - F.col("mean_log") > 1e-9
    rows = sums.withColumn("k", F.when(spread, gamma_shape(F.col("mean"), F.col("mean_log"))))
    return rows.select("n", "k", (F.col("mean") / F.col("k")).alias("theta"))


def fit_weibull(depth: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(n, k, lambda) of depth(n_reads): one aggregate a step; equal depths alone give nulls."""
    rows = _values(depth)
    spark, log = depth.sparkSession, F.log("x")
    one = rows.agg(F.sum("w").alias("n"), (F.sum(F.col("w") * log) / F.sum("w")).alias("l"), F.max("x").alias("top"), F.min("x").alias("low")).first()
    if not one["n"] or one["top"] == one["low"]:
        return spark.createDataFrame([(int(one["n"] or 0), None, None)], "n long, k double, lambda double")
    k, top = 1.0, one["top"]
    for _ in range(STEPS):
        power = F.col("w") * F.pow(F.col("x") / top, F.lit(k))  # scaled, so that no power overflows
        a, b, c = rows.agg(F.sum(power), F.sum(power * log), F.sum(power * log * log)).first()
        g, slope = b / a - 1 / k - one["l"], c / a - (b / a) ** 2 + 1 / k**2
        step = g / slope
        k = k - step if k > step else k / 2
        if abs(step) < tolerance * k:
            break
    a = rows.agg(F.sum(F.col("w") * F.pow(F.col("x") / top, F.lit(k)))).first()[0]
    return spark.createDataFrame([(int(one["n"]), k, top * (a / one["n"]) ** (1 / k))], "n long, k double, lambda double")


def fit_nbinom(depth: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """(n, r, p) of depth(n_reads) for depths above zero: one aggregate a step; nulls unless the variance passes the mean."""
    rows = _values(depth)
    spark = depth.sparkSession
    n, mean, square = rows.agg(F.sum("w"), F.sum(F.col("w") * F.col("x")) / F.sum("w"), F.sum(F.col("w") * F.col("x") * F.col("x")) / F.sum("w")).first()
    if not n or square - mean**2 <= mean:
        return spark.createDataFrame([(int(n or 0), None, None)], "n long, r double, p double")
    r = mean**2 / (square - mean**2 - mean)
    for _ in range(STEPS):
        x = F.col("x") + r
        a, b = rows.agg(F.sum(F.col("w") * digamma(x)), F.sum(F.col("w") * trigamma(x))).first()
        g = a / n - digamma(r, math.log) + math.log(r / (r + mean))
        slope = b / n - trigamma(r) + 1 / r - 1 / (r + mean)
        step = g / slope
        r = r - step if r > step else r / 2
        if abs(step) < tolerance * r:
            break
    return spark.createDataFrame([(int(n), r, r / (r + mean))], "n long, r double, p double")
