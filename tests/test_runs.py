"""Whole runs from FASTA to files and back to a profile."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow import cli
from oligoflow.operators import channel
from oligoflow.operators import profile as profile_ops
from oligoflow.plans import runs
from oligoflow.sources import strands


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    rng = random.Random(1)
    path = tmp_path_factory.mktemp("in") / "refs.fasta"
    refs = ["".join(rng.choices("ACGT", k=60)) for _ in range(50)]
    path.write_text("".join(f">seq_{i}\n{s}\n" for i, s in enumerate(refs)))
    return str(path), refs


def test_normal_run_and_its_profile(spark, fasta, tmp_path):
    path, refs = fasta
    a, o = cli.options(["--input", path, "--output", str(tmp_path / "out"), "--depth", "6", "--distribution", "gamma", "--cv", "0.3", "--dropout", "0.1", "--rates", "30", "--shuffle", "--chunk-size", "40"])
    found = runs.references(spark, path)
    assert [r.seq for r in found.orderBy("ref_idx").collect()] == refs
    run = runs.normal(found, o)
    s = run["summary"].first()
    assert s.n_refs == 50 and s.n_dropped == 5 and s.n_reads > 150
    rows = run["aligned"].withColumn("again", channel.rebuild(F.col("read"), F.col("cigar"), F.col("md"))).collect()
    assert len(rows) == s.n_reads and all(r.again == r.seq == refs[r.ref_idx] for r in rows)
    runs.write_run(run, a.output, o)
    back = strands.read_fasta(spark, f"{a.output}/reads/*").collect()
    assert sorted(r.seq for r in back) == sorted(r.read for r in rows)
    assert {r.name for r in back} == {f"read_{i + 1}" for i in range(s.n_reads)}
    truth = {r._c0: r for r in spark.read.csv(f"{a.output}/read_to_ref_shuffled", sep="\t").collect()}
    named = {r.name: r.seq for r in back}
    want = {(f"ref_{r.ref_idx + 1}", r.cigar, r.md, r.read) for r in rows}
    assert {(t._c1, t._c2, t._c3, named[k]) for k, t in truth.items()} == want
    assert spark.read.csv(f"{a.output}/ref_count", sep="\t").count() == 50
    profile = runs.extract(run["aligned"], found, str(tmp_path / "profile"))
    p = profile["positions"].agg(F.sum("n_sub"), F.sum("n_ins"), F.sum("n_del")).first()
    assert tuple(p) == (s.n_sub, s.n_ins, s.n_del)
    assert profile["depth"].first().dropout == 0.1
    assert spark.read.parquet(str(tmp_path / "profile/kmer_sub")).columns == ["k3", "b4", "out", "n", "p"]


def test_simple_run(spark, fasta):
    path, refs = fasta
    found = runs.references(spark, path)
    copies = spark.createDataFrame([(0, 2), (7, 1)], "ref_idx long, n long")
    errors = spark.createDataFrame([("1 1 D 255", 1), ("3 60 I T", 2), ("9 1 S A", 3)], "value string, line_no long")
    got = {r.read_id: r.read for r in runs.simple(found, copies, errors).collect()}
    assert got == {0: refs[0][1:], 1: refs[0], 2: refs[7][:59] + "T" + refs[7][59:]}


def test_bad_inputs(spark, tmp_path):
    (tmp_path / "bad.fasta").write_text(">a\nACGT\n>b\nACG\n")
    with pytest.raises(ValueError):
        runs.references(spark, str(tmp_path / "bad.fasta"))
    for args in ([], ["--cv", "0.3", "--use-kmer"], ["--cv", "0.3", "--low", "1"], ["--depth", "0"], ["--rates", "1", "2"], ["--dropout", "2"], ["--rates", "1001"]):
        with pytest.raises(SystemExit):
            cli.options(["--input", "x", "--output", "y", *args])


def test_a_profile_can_be_simulated_again(spark, fasta, tmp_path):
    """Rates, bases, contexts and dropout of a run's profile come back in a run by that profile."""
    path, refs = fasta
    found = runs.references(spark, path)
    _, o = cli.options(["--input", path, "--output", "x", "--depth", "60", "--distribution", "poisson", "--dropout", "0.1", "--rates", "40", "20", "30"])
    first = runs.normal(found, o)
    s = first["summary"].first()
    for got, want in zip((s.n_sub, s.n_ins, s.n_del), (40, 20, 30)):
        assert abs(got / (s.n_reads * 60) * 1000 / want - 1) < 0.1
    named = first["aligned"].select(F.col("read_id").cast("string").alias("read_id"), F.concat(F.lit("seq_"), "ref_idx").alias("ref_name"), "cigar", "md", "read")
    stray = spark.createDataFrame([("x", "nowhere", "4M", "4", "ACGT")], named.schema)
    out = str(tmp_path / "profile")
    profile = runs.extract(named.unionByName(stray), found, out)
    total = profile["summary"].first()
    assert (total.n_mapped, total.n_reads) == (s.n_reads, s.n_reads + 1)
    assert (total.n_sub, total.n_ins, total.n_del) == (s.n_sub, s.n_ins, s.n_del)
    line = runs.summary_line(profile)
    assert len(line.columns) == 14 and line.count() == 1
    for extra in ([], ["--use-kmer"]):
        _, o = cli.options(["--input", path, "--output", "x", "--depth", "60", "--distribution", "poisson", "--profile", out, "--seed", "5", *extra])
        again = runs.normal(found, o)
        t = again["summary"].first()
        assert t.n_dropped == 5
        for a, b in zip((s.n_sub, s.n_ins, s.n_del), (t.n_sub, t.n_ins, t.n_del)):
            assert abs(a / s.n_reads / (b / t.n_reads) - 1) < 0.1
    # other lengths take the rates by spline, and rates asked for replace the profile's
    noise, _ = runs.load_profile(spark, out, runs.Options(rates=(50.0,)), 90)
    assert noise.length == 90 and abs(noise.rates.sum(axis=1).mean() - 0.05) < 1e-6
    assert (np.diff(noise.subs, axis=1) >= 0).all() and noise.subs.max() <= 10**6


def test_splines_match_a_plain_solution():
    y = np.array([1.0, 3.0, 2.0, 5.0, 4.0])
    w = profile_ops.spline_weights(5, 9)
    got = w @ y
    assert np.allclose(got[::2], y)
    # second derivatives by the tridiagonal equations, solved as a full system
    full = np.zeros((5, 5))
    full[0, 0] = full[4, 4] = 1
    for i in (1, 2, 3):
        full[i, i - 1 : i + 2] = 1, 4, 1
    m = np.linalg.solve(full, np.r_[0, 6 * np.diff(y, 2), 0])
    middle = [(y[i] + y[i + 1]) / 2 - (m[i] + m[i + 1]) / 16 for i in range(4)]
    assert np.allclose(got[1::2], middle)
    assert np.allclose(profile_ops.spline_weights(2, 5) @ np.array([1.0, 2.0]), np.linspace(1, 2, 5))


def test_small_rules(spark):
    assert (runs.chunk_size(50, 2.5), runs.chunk_size(10**6, 9.0), runs.chunk_size(10, 1.0, 7)) == (125, 100_000, 7)
    assert runs.extractor_params("exponential", 4.0, 1.0) == {"rate": 0.25} and runs.extractor_params("nbinom", 4.0, 0.1)["r"] > 0
    row = spark.range(1).select(runs.merged_name("a", True).alias("m"), runs.merged_name("a", False, F.lit("2020-01-02 03:04:05").cast("timestamp")).alias("n"), runs.rate_text(F.lit(0.0123)).alias("r")).first()
    assert (row.m, row.n, row.r) == ("a_shuffled_merged", "a_merged_20200102_030405", "1.23%")
    reads = spark.range(10).select(F.col("id").alias("read_id"), F.col("id").alias("place"), F.lit("x").alias("name"), F.lit("A").alias("seq"))
    assert [tuple(r) for r in runs.simple_chunks(reads, 4).orderBy("chunk_idx").collect()] == [(0, 0, 3, 4), (1, 4, 7, 4), (2, 8, 9, 2)]
    shown = [r.place for r in runs.preview(reads, 1).collect()]
    assert shown[:2] == [0, 1] and len(set(shown)) == 3
    chunks = spark.createDataFrame([(0, 5), (1, 5)], "chunk_idx long, n_reads long")
    dealt = spark.createDataFrame([(0, 0, 5), (1, 0, 4)], "chunk_idx long, target long, n long")
    assert [tuple(r) for r in runs.mapping_faults(dealt, chunks).collect()] == [(1, 4, 5)]
