"""The six-letter alphabet against whole numbers, and shares of depth families against densities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow.functions import depth, dna


def test_six_letters_by_division(spark):
    rng = random.Random(1)
    blocks = [b"\0" * 5, b"\xff" * 5, *(bytes(rng.randrange(256) for _ in range(5)) for _ in range(300))]
    df = spark.createDataFrame([(b.hex(),) for b in blocks], "h string").withColumn("s", dna.six_encode(F.col("h")))
    for r in df.select("h", "s", dna.six_decode(F.col("s")).alias("again"), dna.six_screen(F.col("s")).alias("ok")).collect():
        n, want = int(r.h, 16), ""
        for _ in range(16):
            n, digit = divmod(n, 6)
            want = "ACGTPZ"[digit] + want
        assert (r.s, r.again, r.ok) == (want, r.h, not any(c * 4 in want for c in "ACGTPZ"))


@pytest.mark.parametrize(("family", "mean", "cv"), [("exponential", 3.0, None), ("uniform", 5.0, 0.3), ("weibull", 4.0, 0.55), ("normal", 5.0, 0.35), ("lognormal", 3.0, 0.6)])
def test_shares_below_are_integrals_of_the_density(family, mean, cv):
    p = depth.depth_params(family, mean, cv)
    x = np.linspace(0.5, 30.5, 300_001)
    mass = np.concatenate([[0], np.cumsum(np.exp(depth.log_density(family, p, (x[1:] + x[:-1]) / 2))) * (x[1] - x[0])])
    got = depth.below(family, p, x[::10_000])
    assert np.abs(got - got[0] - mass[::10_000]).max() < 1e-4
    bounds = np.array(depth.depth_cdf(family, p))
    assert (np.diff(bounds) >= 0).all() and bounds[-1] == 2**31
    assert np.abs(bounds[:8] / 2**31 - depth.below(family, p, np.arange(8) + 0.5)[: len(bounds[:8])]).max() < 1e-8


def test_families_that_reach_too_far_raise():
    with pytest.raises(ValueError, match="may be drawn"):
        depth.depth_cdf("gamma", depth.depth_params("gamma", 50_000.0, 2.0))
