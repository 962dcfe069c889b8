"""Fits by Newton steps against the derivative of the likelihood and a search for its largest value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow.operators import fits, profile
from oligoflow.plans.queries import prepare


def test_series_of_the_gamma_function(spark):
    for x in (0.01, 0.3, 1.0, 2.5, 40.0, 1e5):
        h = 1e-5 * x
        assert abs(fits.digamma(x, math.log) - (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)) < 1e-4 * (1 + 1 / x)
        assert abs(fits.trigamma(x) - (fits.digamma(x + h, math.log) - fits.digamma(x - h, math.log)) / (2 * h)) < 1e-4 * (1 + 1 / x**2)
    assert abs(fits.digamma(1.0, math.log) + 0.5772156649015329) < 1e-9 and abs(fits.trigamma(1.0) - math.pi**2 / 6) < 1e-9
    row = spark.range(1).select(fits.digamma(F.lit(2.5)).alias("a"), fits.trigamma(F.lit(2.5)).alias("b")).first()
    assert abs(row.a - fits.digamma(2.5, math.log)) < 1e-12 and abs(row.b - fits.trigamma(2.5)) < 1e-12


@pytest.mark.parametrize(("family", "fit", "names"), [("gamma", fits.fit_gamma, ("k", "theta")), ("weibull", fits.fit_weibull, ("k", "lambda")), ("nbinom", fits.fit_nbinom, ("r", "p"))])
def test_fits_are_the_most_likely(spark, family, fit, names):
    prepare(spark)
    rng = np.random.default_rng(3)
    values = np.maximum(rng.negative_binomial(4, 0.2, 3000), 0)
    depth = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "ref_idx long, n_reads long")
    got = fit(depth).first()
    x, w = np.unique(values[values > 0].astype(float), return_counts=True)
    want, _ = profile.fit_family(family, x, w.astype(float))
    assert got.n == int((values > 0).sum())
    for name in names:
        assert abs(got[name] - want[name]) < 1e-5 * abs(want[name])
    same = spark.createDataFrame([(i, 7) for i in range(20)] + [(30, 0)], "ref_idx long, n_reads long")
    assert fit(same).first()[names[0]] is None and fit(same).first().n == 20
    assert fit(same.limit(0)).first()[names[0]] is None
