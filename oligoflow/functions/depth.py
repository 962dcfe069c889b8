"""Read-depth distributions: parameters from mean and spread, and the discrete table that draws are looked up in."""

from __future__ import annotations

import math

import numpy as np

from .dna import M31

FAMILIES = ("lognormal", "gamma", "normal", "weibull", "exponential", "poisson", "uniform", "nbinom", "beta")


def _weibull_shape(cv: float) -> float:
    """Shape whose coefficient of variation is cv, by bisection (it falls as the shape grows)."""
    low, high = 0.1, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        ratio = math.exp(math.lgamma(1 + 2 / mid) - 2 * math.lgamma(1 + 1 / mid)) - 1
        low, high = (mid, high) if ratio > cv * cv else (low, mid)
    return (low + high) / 2


def depth_params(family: str, mean: float, cv: float | None = None, low: float | None = None, high: float | None = None) -> dict[str, float]:
    """Parameters of a family with this mean and coefficient of variation; ValueError where there are none."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    if mean <= 0:
        raise ValueError("the mean depth must be positive")
    if family in ("poisson", "exponential"):
        return {"lambda": mean} if family == "poisson" else {"scale": mean}
    if cv is None or cv <= 0:
        raise ValueError(f"{family} needs a positive cv")
    if family == "lognormal":
        spread = math.log1p(cv * cv)
        return {"mu": math.log(mean) - spread / 2, "sigma": math.sqrt(spread)}
    if family == "gamma":
        return {"k": cv**-2, "theta": mean * cv * cv}
    if family == "normal":
        return {"mu": mean, "sigma": mean * cv}
    if family == "weibull":
        shape = _weibull_shape(cv)
        return {"k": shape, "lambda": mean / math.gamma(1 + 1 / shape)}
    if family == "uniform":
        half = math.sqrt(3) * mean * cv
        return {"a": mean - half, "b": mean + half}
    if family == "nbinom":
        over = cv * cv - 1 / mean
        if over <= 0:
            raise ValueError("nbinom needs cv**2 above 1 / mean")
        return {"r": 1 / over, "p": 1 / (1 + over * mean)}
    low, high = (0.0, 4 * mean) if low is None or high is None else (low, high)
    at, spread = (mean - low) / (high - low), (cv * mean / (high - low)) ** 2
    weight = at * (1 - at) / spread - 1
    if not 0 < at < 1 or weight <= 0:
        raise ValueError("beta has no such mean and cv on this range")
    return {"alpha": at * weight, "beta": (1 - at) * weight, "low": low, "scale": high - low}


def theoretical(family: str, p: dict[str, float]) -> tuple[float, float]:
    """(mean, cv) that the parameters give."""
    if family == "lognormal":
        return math.exp(p["mu"] + p["sigma"] ** 2 / 2), math.sqrt(math.expm1(p["sigma"] ** 2))
    if family == "gamma":
        return p["k"] * p["theta"], p["k"] ** -0.5
    if family == "normal":
        return p["mu"], p["sigma"] / p["mu"]
    if family == "weibull":
        one, two = math.gamma(1 + 1 / p["k"]), math.gamma(1 + 2 / p["k"])
        return p["lambda"] * one, math.sqrt(two / one**2 - 1)
    if family == "exponential":
        return p["scale"], 1.0
    if family == "poisson":
        return p["lambda"], p["lambda"] ** -0.5
    if family == "uniform":
        return (p["a"] + p["b"]) / 2, (p["b"] - p["a"]) / math.sqrt(3) / (p["a"] + p["b"])
    if family == "nbinom":
        mean = p["r"] * (1 - p["p"]) / p["p"]
        return mean, math.sqrt(mean / p["p"]) / mean
    a, b = p["alpha"], p["beta"]
    mean = p["low"] + p["scale"] * a / (a + b)
    return mean, p["scale"] * math.sqrt(a * b / (a + b + 1)) / (a + b) / mean


def log_density(family: str, p: dict[str, float], x: np.ndarray) -> np.ndarray:
    """Log density (log probability for poisson and nbinom) at x, -inf where there is none."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.log(np.where(x > 0, x, np.nan))
        if family == "lognormal":
            out = -((log - p["mu"]) ** 2) / (2 * p["sigma"] ** 2) - log - math.log(p["sigma"] * math.sqrt(2 * math.pi))
        elif family == "gamma":
            out = (p["k"] - 1) * log - x / p["theta"] - math.lgamma(p["k"]) - p["k"] * math.log(p["theta"])
        elif family == "normal":
            return -((x - p["mu"]) ** 2) / (2 * p["sigma"] ** 2) - math.log(p["sigma"] * math.sqrt(2 * math.pi))
        elif family == "weibull":
            z = np.where(x > 0, x, np.nan) / p["lambda"]
            out = math.log(p["k"] / p["lambda"]) + (p["k"] - 1) * np.log(z) - z ** p["k"]
        elif family == "exponential":
            out = np.where(x >= 0, -x / p["scale"] - math.log(p["scale"]), np.nan)
        elif family == "poisson":
            out = x * math.log(p["lambda"]) - p["lambda"] - lgamma(x + 1)
        elif family == "uniform":
            out = np.where((x >= p["a"]) & (x <= p["b"]), -math.log(p["b"] - p["a"]), np.nan)
        elif family == "nbinom":
            out = lgamma(x + p["r"]) - math.lgamma(p["r"]) - lgamma(x + 1) + p["r"] * math.log(p["p"]) + x * math.log1p(-p["p"])
        else:
            z = (x - p["low"]) / p["scale"]
            z = np.where((z > 0) & (z < 1), z, np.nan)
            log_beta = math.lgamma(p["alpha"]) + math.lgamma(p["beta"]) - math.lgamma(p["alpha"] + p["beta"])
            out = (p["alpha"] - 1) * np.log(z) + (p["beta"] - 1) * np.log1p(-z) - log_beta - math.log(p["scale"])
    return np.nan_to_num(out, nan=-np.inf, neginf=-np.inf)


def below(family: str, p: dict[str, float], x: np.ndarray) -> np.ndarray | None:
    """The share of a family below x, for those that have a closed form; None for the others."""
    erf = np.vectorize(math.erf, otypes=[float])
    with np.errstate(divide="ignore"):
        if family == "exponential":
            return -np.expm1(-np.maximum(x, 0) / p["scale"])
        if family == "uniform":
            return np.clip((x - p["a"]) / (p["b"] - p["a"]), 0, 1)
        if family == "weibull":
            return -np.expm1(-((np.maximum(x, 0) / p["lambda"]) ** p["k"]))
        if family == "normal":
            return (1 + erf((x - p["mu"]) / p["sigma"] / math.sqrt(2))) / 2
        if family == "lognormal":
            return (1 + erf((np.log(np.maximum(x, 0)) - p["mu"]) / p["sigma"] / math.sqrt(2))) / 2
    return None


def depth_cdf(family: str, params: dict[str, float], most: int = 100_000) -> list[int]:
    """Bounds on [0, 2**31): depth k is drawn where the draw is below bound k and not below bound k - 1.

    A continuous draw is rounded to the nearest whole number and clipped at 0, so depth k >= 1 has the mass between
    k - 1/2 and k + 1/2 and depth 0 what is left. The table ends where a draw of 31 bits can't reach further; a family
    that reaches beyond `most` raises ValueError.
    """
    mean, cv = theoretical(family, params)
    top = int(mean * (1 + 60 * cv)) + 20
    if top > most:
        raise ValueError(f"depths beyond {most} may be drawn; the mean or its spread is too large")
    closed = below(family, params, np.arange(0, top + 1) + 0.5)
    if closed is not None:
        return _ended(np.floor(closed * (M31 + 1)).astype(np.int64))
    if family in ("poisson", "nbinom"):
        mass = np.exp(log_density(family, params, np.arange(1, top + 1).astype(float)))
    else:
        steps = 65
        weights = np.ones(steps)
        weights[1:-1:2], weights[2:-1:2] = 4, 2
        weights /= 3 * (steps - 1)
        grid = np.arange(1, top + 1)[:, None] + np.linspace(-0.5, 0.5, steps)[None, :]
        mass = np.exp(log_density(family, params, grid)) @ weights
        if family == "beta":  # a density with ends is no polynomial there
            fine = np.arange(1, top + 1)[:, None] + (np.arange(2000)[None, :] + 0.5) / 2000 - 0.5
            mass = np.exp(log_density(family, params, fine)).mean(axis=1)
    zero = max(0.0, 1 - mass.sum())
    return _ended(np.floor(np.cumsum(np.r_[zero, mass]) * (M31 + 1)).astype(np.int64))


def _ended(bounds: np.ndarray) -> list[int]:
    end = int(np.searchsorted(bounds, M31 - 1)) + 1
    bounds = bounds[: min(end, len(bounds))]
    bounds[-1] = M31 + 1
    return bounds.tolist()
