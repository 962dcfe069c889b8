"""Command line: simulate a run from a FASTA file, in normal or simple mode."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.depth import FAMILIES
from .plans import runs
from .sources import strands


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="oligoflow", description=__doc__)
    p.add_argument("--input", required=True, help="FASTA file of strands")
    p.add_argument("--output", required=True, help="folder to write, replaced if present")
    p.add_argument("--depth", type=float, default=10.0, help="mean reads of a strand")
    p.add_argument("--distribution", choices=FAMILIES, default="lognormal")
    p.add_argument("--cv", type=float, help="coefficient of variation; needed but for poisson and exponential")
    p.add_argument("--low", type=float, help="least depth of the beta family")
    p.add_argument("--high", type=float, help="largest depth of the beta family")
    p.add_argument("--dropout", type=float, help="share of strands without reads, kept exactly")
    p.add_argument("--rates", type=float, nargs="+", default=[], help="one total or three rates (substitution, insertion, deletion) per 1000 bases")
    p.add_argument("--profile", help="folder of a profile that an extraction wrote: rates, bases, contexts and dropout")
    p.add_argument("--use-kmer", action="store_true", help="choose bases by their context of four bases; needs a profile")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--chunk-size", type=int, help="reads in a chunk; by default all that are expected, 100,000 at most")
    p.add_argument("--bernoulli", action="store_true", help="independent errors instead of exact counts for each position")
    p.add_argument("--shuffle", action="store_true")
    p.add_argument("--merge", action="store_true")
    p.add_argument("--copies", help="simple mode: text file of `index count` lines")
    p.add_argument("--errors", help="simple mode: text file of `read pos type base` lines")
    return p


def options(argv: list[str] | None = None) -> tuple[argparse.Namespace, runs.Options]:
    p = parser()
    a = p.parse_args(argv)
    if a.depth <= 0 or (a.chunk_size is not None and a.chunk_size < 1):
        p.error("depth and chunk size must be positive")
    if a.cv is None and a.distribution not in ("poisson", "exponential") and not a.copies:
        p.error(f"{a.distribution} needs --cv")
    if (a.low is None) != (a.high is None) or (a.low is not None and (a.distribution != "beta" or a.low >= a.high)):
        p.error("--low and --high come together, for beta alone, the lower first")
    if a.use_kmer and not a.profile:
        p.error("--use-kmer needs --profile")
    if a.dropout is not None and not 0 <= a.dropout < 1:
        p.error("dropout lies between 0 and 1")
    if len(a.rates) not in (0, 1, 3) or any(not 0 <= r <= 1000 for r in a.rates) or sum(a.rates) > 1000:
        p.error("rates are one or three numbers from 0 to 1000 with a sum of 1000 at most")
    return a, runs.Options(a.distribution, a.depth, a.cv, a.dropout, tuple(a.rates), a.seed, not a.bernoulli, a.shuffle, a.merge, a.chunk_size, a.profile, a.use_kmer, a.low, a.high)


def main(argv: list[str] | None = None) -> None:
    a, o = options(argv)
    spark = SparkSession.builder.appName("oligoflow").getOrCreate()
    refs = runs.references(spark, a.input)
    if a.copies:
        copies = strands.parse_copy_plan(spark.read.text(a.copies), refs.count())
        lines = spark.read.text(a.errors) if a.errors else spark.createDataFrame([], "value string")
        found = runs.simple(refs, copies, lines.withColumn("line_no", F.monotonically_increasing_id()))
        strands.write_fasta(found, a.output, F.concat(F.lit("seq_"), (F.col("read_id") + 1).cast("string")), F.col("read"), ["read_id"])
        return
    run = runs.normal(refs, o)
    runs.write_run(run, a.output, o)
    runs.write_command(spark, a.output, argv if argv is not None else sys.argv[1:])
    run["summary"].show(truncate=False)


if __name__ == "__main__":
    main()
