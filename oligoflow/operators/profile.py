"""Noise profiles from alignments(read_id, ref_idx, cigar, md, read [, ref_start, seq]), and the choice of a depth distribution.

CIGAR and MD are parsed by whole Arrow batches; an alignment may start anywhere in its reference.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import batch as kernel
from ..functions import dna
from ..functions.depth import FAMILIES, log_density


def _columns(alignments: DataFrame, *more: str) -> DataFrame:
    return alignments.select("read_id", "ref_idx", "cigar", "md", "read", *[c for c in ("ref_start", *more) if c in alignments.columns])


def _context(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(k3, b4) of each event by the strand: the three bases before a substitution and its own, the four before others."""
    letters, offsets = kernel.text_bytes(part.column("seq"))
    low, size = offsets[found["row"]], np.diff(offsets)[found["row"]]
    shift = (found["kind"] != kernel.S).astype(np.int64)
    inside = (found["pos"] >= 3 + shift) & (found["pos"] < size - 1)
    at = np.where(inside, low + found["pos"] - shift, 3)
    c = [kernel.CODE[letters[at - k]] if len(letters) > 3 else at * 0 - 1 for k in (3, 2, 1, 0)]
    return np.where(inside, 16 * c[0] + 4 * c[1] + c[2], -1), np.where(inside, c[3], -1)


def alignment_events(alignments: DataFrame) -> DataFrame:
    """(read_id, ref_idx, kind, pos, ref_base, read_base, k3, b4): one row for each substituted, inserted or deleted base.

    Insertions carry the reference position that follows them. k3 and b4, the context of four bases, need the strands
    as seq and are null without them or too near to an end.
    """
    has_seq = "seq" in alignments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = kernel.alignment_events(part)
            row = pa.array(found["row"])
            k3, b4 = _context(part, found) if has_seq else (found["pos"] * 0 - 1,) * 2
            yield pa.record_batch(
                [part.column("read_id").take(row), part.column("ref_idx").take(row), kernel.single_letters(found["kind"]), pa.array(found["pos"], pa.int32()),
                 kernel.single_letters(found["ref"]), kernel.single_letters(found["read"]), pa.array(k3, pa.int32(), mask=k3 < 0), pa.array(b4, pa.int32(), mask=b4 < 0)],
                names=["read_id", "ref_idx", "kind", "pos", "ref_base", "read_base", "k3", "b4"],
            )

    rows = _columns(alignments, "seq")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"read_id {kinds['read_id']}, ref_idx {kinds['ref_idx']}, kind string, pos int, ref_base string, read_base string, k3 int, b4 int")


#: What one task counts.
TALLY = "kind string, pos int, ref_base string, read_base string, k3 int, b4 int, n long"


def tallied(has_seq: bool) -> Callable:
    """What tally counts of a task's batches(cigar, md, read [, ref_start, seq]), as TALLY."""
    names = ["kind", "pos", "ref_base", "read_base", "k3", "b4", "n"]

    def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, at, np.concatenate(counts))
        return code, total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros(0, np.int64)
        cells, places = (empty, empty), (empty, empty)
        for part in batches:
            found = kernel.alignment_events(part)
            k3, b4 = _context(part, found) if has_seq else (found["pos"] * 0 - 1,) * 2
            kind, pos = found["kind"].astype(np.int64), found["pos"].astype(np.int64)
            code = (((kind << 8 | found["ref"]) << 8 | found["read"]) << 7 | (k3 + 1)) << 3 | (b4 + 1)
            code, n = np.unique(code, return_counts=True)
            cells = merged([cells[0], code], [cells[1], n])
            start, end = found["run_ref"].astype(np.int64), (found["run_ref"] + found["run_n"]).astype(np.int64)
            at = np.concatenate([pos << 8 | kind, start << 8 | ord("M"), end << 8 | ord("M")])
            step = np.concatenate([np.ones(len(pos) + len(start), np.int64), np.full(len(end), -1)])
            places = merged([places[0], at], [places[1], step])
        code, n = cells
        k3, b4 = (code >> 3 & 127) - 1, (code & 7) - 1
        letters = lambda low: kernel.single_letters((code >> low & 255).astype(np.uint8))
        yield pa.record_batch([letters(26), pa.nulls(len(code), pa.int32()), letters(18), letters(10), pa.array(k3, pa.int32(), mask=k3 < 0), pa.array(b4, pa.int32(), mask=b4 < 0), pa.array(n)], names=names)
        code, n = places
        blank = [pa.nulls(len(code), t) for t in (pa.string(), pa.string(), pa.int32(), pa.int32())]
        yield pa.record_batch([kernel.single_letters((code & 255).astype(np.uint8)), pa.array(code >> 8, pa.int32()), *blank, pa.array(n)], names=names)

    return run


def tally(alignments: DataFrame) -> DataFrame:
    """(kind, pos, ref_base, read_base, k3, b4, n): alignments counted in one pass, a few thousand rows a task.

    Rows without pos count the events of alignment_events by bases and context; rows with pos count them by place, and,
    as kind M, how many more reads begin (or, below zero, end) to cover a place.
    """
    return tally_sum(_columns(alignments, "seq").mapInArrow(tallied("seq" in alignments.columns), TALLY))


def tally_sum(counts: DataFrame) -> DataFrame:
    """A tally from what tasks counted."""
    return counts.groupBy("kind", "pos", "ref_base", "read_base", "k3", "b4").agg(F.sum("n").alias("n"))


def tallied_positions(counts: DataFrame) -> DataFrame:
    """position_counts from a tally."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    places = counts.where("pos is not null").groupBy("pos").agg(of("M").alias("step"), *[of(k).alias(n) for k, n in (("S", "n_sub"), ("I", "n_ins"), ("D", "n_del"))])
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # one row for each place of a reference
    every = places.withColumn("coverage", F.sum("step").over(upto)).withColumn("_next", F.lead("pos").over(Window.orderBy("pos")))
    # Places between two where something begins or ends are covered like the first of them.
    filled = every.withColumn("_at", F.explode(F.sequence("pos", F.coalesce(F.col("_next") - 1, F.col("pos")))))
    own = lambda n: F.when(F.col("_at") == F.col("pos"), F.col(n)).otherwise(F.lit(0).cast("long")).alias(n)
    rows = filled.select(F.col("_at").alias("pos"), "coverage", own("n_sub"), own("n_ins"), own("n_del"))
    last = rows.agg(F.max(F.when(F.col("coverage") + F.col("n_sub") + F.col("n_ins") + F.col("n_del") > 0, F.col("pos"))).alias("_last"))
    return rows.join(F.broadcast(last), F.col("pos") <= F.col("_last")).drop("_last")


def _count(events: DataFrame) -> Column:
    """Events of a group: of rows that are one event each, or of a tally's."""
    return (F.sum("n") if "n" in events.columns else F.count("*")).alias("n")


_KINDS = (("n_sub", kernel.S), ("n_ins", kernel.I), ("n_del", kernel.D))
#: What position_counts sums up of one batch.
POSITIONS = ", ".join(["pos int", *(f"{n} long" for n in ("coverage", *(n for n, _ in _KINDS)))])


def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What position_counts sums up of a task's batches(cigar, md, read [, ref_start]), as POSITIONS."""
    for part in batches:
        found = kernel.alignment_events(part)
        start, end = found["run_ref"], found["run_ref"] + found["run_n"]
        size = int(max([0, *(x.max() for x in (end, found["pos"] + 1) if len(x))]))
        cover = np.cumsum(np.bincount(start, minlength=size + 1) - np.bincount(end, minlength=size + 1))[:size]
        counts = [np.bincount(found["pos"][found["kind"] == k], minlength=size) for _, k in _KINDS]
        yield pa.record_batch([pa.array(np.arange(size), pa.int32()), *(pa.array(c, pa.int64()) for c in (cover, *counts))], names=["pos", "coverage", *(n for n, _ in _KINDS)])


def position_counts(alignments: DataFrame) -> DataFrame:
    """(pos, coverage, n_sub, n_ins, n_del), one row for each position that any read touches.

    One pass over the alignments: every batch sums up its own positions before anything is shuffled.
    """
    return position_sum(_columns(alignments).mapInArrow(positions, POSITIONS))


def position_sum(counts: DataFrame) -> DataFrame:
    """position_counts from what batches summed up."""
    return counts.groupBy("pos").agg(*[F.sum(n).alias(n) for n in ("coverage", *(n for n, _ in _KINDS))])


def position_rates(counts: DataFrame, length: int) -> DataFrame:
    """Counts and rates of each position from position_counts; what lies behind the last base counts for none."""
    every = counts.sparkSession.range(length).select(F.col("id").cast("int").alias("pos"))
    rows = every.join(F.broadcast(counts.where(F.col("pos") < length)), "pos", "left").na.fill(0)  # a row for each position
    base = F.greatest("coverage", F.lit(1))
    rates = [F.round(F.col(f"n_{k}") / base, 10).alias(f"{k}_rate") for k in ("sub", "ins", "del")]
    whole = F.round((F.col("n_sub") + F.col("n_ins") + F.col("n_del")) / base, 10).alias("total_rate")
    return rows.select("pos", "coverage", "n_sub", "n_ins", "n_del", *rates, whole)


def overall(counts: DataFrame, bases: DataFrame, n_reads: Column, n_mapped: Column) -> DataFrame:
    """One row: reads, mapped reads and their share, covered bases, events of each kind and their rates a covered base."""
    a = counts.agg(F.sum("coverage").alias("covered"))
    b = bases.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(n) for k, n in (("S", "n_sub"), ("I", "n_ins"), ("D", "n_del"))])
    rows = a.join(b, F.lit(True)).select(n_reads.alias("n_reads"), n_mapped.alias("n_mapped"), "covered", "n_sub", "n_ins", "n_del")  # one row each
    base = F.greatest("covered", F.lit(1))
    return rows.select("*", F.round(F.col("n_mapped") / F.greatest("n_reads", F.lit(1)), 8).alias("mapping_rate"), *[F.round(F.col(f"n_{k}") / base, 10).alias(f"{k}_rate") for k in ("sub", "ins", "del")])


def base_counts(events: DataFrame) -> DataFrame:
    """(kind, ref_base, read_base, n): the substitution matrix and the inserted and deleted bases."""
    return events.groupBy("kind", F.coalesce("ref_base", F.lit("-")).alias("ref_base"), F.coalesce("read_base", F.lit("-")).alias("read_base")).agg(_count(events))


def base_matrix(bases: DataFrame) -> DataFrame:
    """(kind, ref_base, A, T, C, G): base_counts as a matrix with a column for each base of the read."""
    return bases.groupBy("kind", "ref_base").pivot("read_base", [*dna.CHANNEL]).agg(F.sum("n")).na.fill(0, [*dna.CHANNEL])


def kmer_counts(events: DataFrame, kind: str) -> DataFrame:
    """(k3, b4, out, n): context of three bases and the one at the place.

    Substitutions: the three before and the base itself. Deletions and insertions: the four before the place.
    """
    rows = events.where((F.col("kind") == kind) & F.col("k3").isNotNull())
    out = dna.base_index(F.col("read_base") if kind != "D" else F.col("ref_base"))
    return rows.groupBy("k3", "b4", out.alias("out")).agg(_count(events))


def kmer_probabilities(counts: DataFrame, over: str = "out") -> DataFrame:
    """counts plus p: the share within (k3, b4), or within (k3, out) for deletions."""
    keys = ["k3", "b4"] if over == "out" else ["k3", "out"]
    return counts.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*keys)), 10))


def kmer_full(counts: DataFrame) -> DataFrame:
    """(k3, b4, out, p) of all 1024 places: the share within (k3, b4), a quarter each in contexts never seen."""
    every = counts.sparkSession.range(1024).select((F.col("id") / 16).cast("int").alias("k3"), (F.col("id") / 4 % 4).cast("int").alias("b4"), (F.col("id") % 4).cast("int").alias("out"))
    rows = every.join(F.broadcast(counts), ["k3", "b4", "out"], "left").na.fill(0, ["n"])  # at most 1024 rows
    total = F.sum("n").over(Window.partitionBy("k3", "b4"))
    return rows.select("k3", "b4", "out", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.25), 10).alias("p"))


def inserted_shares(counts: DataFrame) -> DataFrame:
    """(base, p, cum) of the inserted bases in channel order, from counts(base, n); a quarter each if there are none."""
    spark = counts.sparkSession
    every = spark.range(4).select(F.col("id").alias("place"), F.substring(F.lit(dna.CHANNEL), (F.col("id") + 1).cast("int"), F.lit(1)).alias("base"))
    rows = every.join(F.broadcast(counts), "base", "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy())  # four rows
    rows = rows.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(0.25))
    return rows.select("base", F.round("p", 10).alias("p"), F.round(F.sum("p").over(Window.orderBy("place")), 10).alias("cum"))


def rate_consistency(rates: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: the largest gap between a position's total rate and the sum of its three rates, and whether it's small."""
    gap = F.max(F.abs(F.col("total") - F.col("sub") - F.col("ins") - F.col("del")))
    return rates.agg(gap.alias("gap")).select("gap", (F.col("gap") <= tolerance).alias("consistent"))


def base_lut(counts: DataFrame) -> DataFrame:
    """(ref_base, base, p, cum) of the three substitutes of each base in channel order, from counts(ref_base, base, n).

    A base that was never substituted gets a third for each.
    """
    spark = counts.sparkSession
    every = spark.createDataFrame([(a, b, i) for a in dna.CHANNEL for i, b in enumerate(dna.CHANNEL) if a != b], "ref_base string, base string, place int")
    rows = every.join(counts, ["ref_base", "base"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("ref_base"))
    rows = rows.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1 / 3)))
    cum = F.sum("p").over(Window.partitionBy("ref_base").orderBy("place"))
    return rows.select("ref_base", "base", F.round("p", 10).alias("p"), F.round(cum, 10).alias("cum"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, ref_name, ref_start, cigar, md, read) of tab-separated lines, ref_start from 0; * stands for no reference."""
    return spark.read.csv(path, sep="\t", schema="read_id string, ref_name string, ref_start int, cigar string, md string, read string")


def mapped(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """alignments(ref_name, ...) with ref_idx and seq of refs(ref_idx, name, seq); reads of no known reference are left out."""
    return alignments.join(refs.select("ref_idx", "seq", F.col("name").alias("ref_name")), "ref_name").drop("ref_name")


def depth_stats(depth: DataFrame, total_refs: Column | None = None) -> DataFrame:
    """One row over depth(n_reads): references with reads, their mean, cv, least and most, and the share without."""
    n = F.when(F.col("n_reads") > 0, F.col("n_reads"))
    return depth.agg(
        F.count("*").alias("n_refs"), F.count(n).alias("n_covered"), F.round(F.avg(n), 8).alias("mean_depth"), F.round(F.stddev_pop(n) / F.avg(n), 8).alias("cv"),
        F.min(n).alias("min_depth"), F.max(n).alias("max_depth"), F.round(1 - F.count(n) / F.count("*"), 8).alias("dropout"),
    )


def sufficient(depth: DataFrame) -> DataFrame:
    """One row: n, sum, sum of squares, sum of logarithms, least and most of the positive depths."""
    x = F.when(F.col("n_reads") > 0, F.col("n_reads"))
    return depth.agg(F.count(x).alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_xx"), F.round(F.sum(F.log(x.cast("double"))), 6).alias("sum_log"), F.min(x).alias("min_x"), F.max(x).alias("max_x"))


def _search(f, low: float, high: float) -> float:
    """Where a function of one parameter is largest, by golden section on its logarithm."""
    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    for _ in range(120):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if f(math.exp(c)) > f(math.exp(d)) else (c, b)
    return math.exp((a + b) / 2)


def fit_family(family: str, x: np.ndarray, w: np.ndarray) -> tuple[dict[str, float], float]:
    """(parameters, log likelihood) of the best fit to values x that occur w times."""
    n, mean = w.sum(), (w * x).sum() / w.sum()
    spread = max((w * (x - mean) ** 2).sum() / n, 1e-12)
    log = np.log(x)
    at = lambda p: float((w * log_density(family, p, x)).sum())
    if family == "lognormal":
        mu = (w * log).sum() / n
        p = {"mu": mu, "sigma": math.sqrt(max((w * (log - mu) ** 2).sum() / n, 1e-12))}
    elif family == "normal":
        p = {"mu": mean, "sigma": math.sqrt(spread)}
    elif family == "exponential":
        p = {"scale": mean}
    elif family == "poisson":
        p = {"lambda": mean}
    elif family == "uniform":
        p = {"a": x.min(), "b": max(x.max(), x.min() + 1e-9)}
    elif family == "gamma":
        k = _search(lambda k: at({"k": k, "theta": mean / k}), 1e-3, 1e6)
        p = {"k": k, "theta": mean / k}
    elif family == "weibull":
        scale = lambda k: ((w * x**k).sum() / n) ** (1 / k)
        k = _search(lambda k: at({"k": k, "lambda": scale(k)}), 0.05, 60.0)
        p = {"k": k, "lambda": scale(k)}
    elif family == "nbinom":
        r = _search(lambda r: at({"r": r, "p": r / (r + mean)}), 1e-3, 1e6)
        p = {"r": r, "p": r / (r + mean)}
    else:
        top = x.max() * (1 + 1 / max(n, 2))
        m, s = mean / top, spread / top**2
        weight = m * (1 - m) / s - 1
        if weight <= 0:
            return {}, -math.inf
        p = {"alpha": m * weight, "beta": (1 - m) * weight, "low": 0.0, "scale": top}
    return p, at(p)


#: Distinct depths that are fitted at most; their histogram is all that comes to the driver.
MOST_DEPTHS = 1_000_000


def fit_depth(depth: DataFrame) -> DataFrame:
    """(family, n_params, loglik, aic, rank) of every family; the histogram of depths, one row per depth, is fitted."""
    hist = depth.where("n_reads > 0").groupBy("n_reads").count().limit(MOST_DEPTHS + 1).collect()
    if len(hist) > MOST_DEPTHS:
        raise ValueError(f"more than {MOST_DEPTHS} distinct depths")
    spark, x = depth.sparkSession, np.array([r["n_reads"] for r in hist], float)
    w, rows = np.array([r["count"] for r in hist], float), []
    for family in FAMILIES if w.sum() >= 10 else ():
        _, loglik = fit_family(family, x, w)
        k = 1 if family in ("exponential", "poisson") else 2
        if math.isfinite(loglik):
            rows.append((family, k, round(loglik, 4), round(2 * k - 2 * loglik, 4)))
    ranked = [(*r, i + 1) for i, r in enumerate(sorted(rows, key=lambda r: (r[3], r[0])))] or [("normal", 2, None, None, 1)]
    return spark.createDataFrame(ranked, "family string, n_params int, loglik double, aic double, rank int")


def spline_weights(n: int, length: int) -> np.ndarray:
    """(length, n) weights that take n rates to length rates: a natural cubic spline over the index, ends pinned.

    They depend on the two lengths alone. Column j is the spline through a one at place j and zeros elsewhere.
    """
    x = np.linspace(0, n - 1, length)
    ones = np.eye(n)
    i = np.clip(x.astype(int), 0, max(n - 2, 0))
    t = (x - i)[:, None]
    if n == length or n < 3:
        out = (1 - t) * ones[i] + t * ones[np.minimum(i + 1, n - 1)]
    else:
        inner = n - 2
        system = 4 * np.eye(inner) + np.eye(inner, k=1) + np.eye(inner, k=-1)
        bend = np.zeros((n, n))
        bend[1:-1] = np.linalg.solve(system, 6 * np.diff(ones, 2, axis=0))
        out = (1 - t) * ones[i] + t * ones[i + 1] + ((1 - t) ** 3 - (1 - t)) * bend[i] / 6 + (t**3 - t) * bend[i + 1] / 6
    out[0], out[-1] = ones[0], ones[-1]
    return out


def resize(rates: DataFrame, names: tuple[str, ...], n: int, length: int) -> DataFrame:
    """(pos, *names) of length positions from rates(pos, *names) of n; nothing falls below zero."""
    w = spline_weights(n, length)
    table = rates.sparkSession.createDataFrame(pd.DataFrame({"to": np.repeat(np.arange(length), n).astype("int32"), "pos": np.tile(np.arange(n), length).astype("int32"), "w": w.ravel()}))
    rows = rates.join(F.broadcast(table), "pos").groupBy(F.col("to").alias("pos"))
    return rows.agg(*[F.greatest(F.sum(F.col(k) * F.col("w")), F.lit(0.0)).alias(k) for k in names])
