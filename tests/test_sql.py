"""Registered SQL functions against the column functions that they stand for."""

from collections import Counter

from pyspark.sql import functions as F

from oligoflow.functions import dna, sql
from oligoflow.operators import profile
from oligoflow.sources import sam


def test_scalar_functions(spark):
    names = sql.register(spark)
    assert names == sql.register(spark) and "dna_gc" in names and "alignment_events" in names
    rows = [("ACGTTTTTGGG",), ("ATGAAATAGCC",), ("",), (None,), ("CCCCC",)]
    df = spark.createDataFrame(rows, "seq string")
    got = spark.sql("SELECT seq, dna_gc(seq) g, dna_longest_run(seq) r, dna_longest_frame(seq) f, dna_other_strand(seq) o, dna_gc_share(seq) s FROM {df}", df=df).collect()
    want = df.select("seq", dna.gc_count(F.col("seq")).alias("g"), dna.longest_run(F.col("seq")).alias("r"), dna.longest_frame(F.col("seq")).alias("f"), sam.turned(F.col("seq")).alias("o")).collect()
    assert sorted(tuple(r)[:5] for r in got if r.seq is not None) == sorted(tuple(r) for r in want if r.seq is not None)
    assert {r.seq: r.s for r in got}[""] is None
    blocks = spark.createDataFrame([("0001ff80aa",)], "b string")
    one = spark.sql("SELECT dna_six_encode(b) s, dna_six_decode(dna_six_encode(b)) again FROM {blocks}", blocks=blocks).first()
    assert one.s == blocks.select(dna.six_encode(F.col("b"))).first()[0] and one.again == "0001ff80aa"


def test_events_of_a_table(spark):
    sql.register(spark)
    rows = [("5M1I3M1D4M", "5T2^T4", "GTTGCTACGAACC", 2), ("4M", "4", "ACGT", 0), ("4M", "0A0C2", "TTGT", 7)] * 300
    df = spark.createDataFrame(rows, "cigar string, md string, read string, ref_start int").repartition(4)
    found = spark.sql("SELECT kind, pos, ref_base, read_base FROM alignment_events(TABLE(SELECT cigar, md, read, ref_start FROM {df}))", df=df)
    named = df.withColumn("read_id", F.lit(0).cast("long")).withColumn("ref_idx", F.lit(0).cast("long"))
    want = profile.alignment_events(named).select("kind", "pos", "ref_base", "read_base")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect())) and found.count() == 300 * 5
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
