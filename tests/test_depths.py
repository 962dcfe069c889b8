"""Depths of strands counted text by text against numbering all strands at once, and bounded tasks."""

import os

import pytest
from pyspark.sql import functions as F

from oligoflow.functions import dna
from oligoflow.operators import channel, profile
from oligoflow.plans import queries
from oligoflow.plans.queries import prepare
from oligoflow.sources import strands as source

SMALL = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    prepare(spark)
    rows = [(5, "ab" * 400), (2, None), (9, ""), (3, "x"), (-4, "é" * 3001), (7, "y" * 64)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_depths_of_texts_are_those_of_all_strands(spark, docs, monkeypatch):
    monkeypatch.setattr(source, "STRANDS_AT_ONCE", 7)
    whole = source.strands_of(docs, "doc_id", "text")
    want = channel.number_reads(channel.sample_depth(whole, "gamma", 2.0, 0.5, 42)).select("ref_idx", "doc_id", "seg", "seq", "n_reads", "first_read")
    got = channel.strand_depths(docs, "doc_id", "text", "gamma", 2.0, 0.5, 42)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ids = channel.strand_depths(docs, "doc_id", "text", "gamma", 2.0, 0.5, 42, bases=False)
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, want.select(*ids.columns).collect()))
    assert sorted(r.ref_idx for r in source.strand_ids(source.places_of(docs, "doc_id", "text")).collect()) == list(range(whole.count()))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for d, data in texts.items():
        seqs = [r.seq for r in whole.where(F.col("doc_id") == d).orderBy("seg").collect()]
        assert "".join(seqs) == "".join(dna.CODING[b >> k & 3] for b in data.ljust(-(-len(data) // 32) * 32, b"\0") for k in (6, 4, 2, 0))


def test_no_strand_is_sorted_or_dealt_and_tasks_are_bounded(spark, docs, monkeypatch):
    monkeypatch.setattr(source, "STRANDS_IN_TASK", 10)
    found = channel.strand_depths(docs, "doc_id", "text", "gamma", 2.0, 0.5, 42)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()
    assert found.rdd.getNumPartitions() >= source.strands_of(docs, "doc_id", "text").count() // 10


def test_queries_of_depth_alone_run_no_python_on_strands(spark):
    plan = queries.QUERIES["depth_sample_poisson"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_tally_is_what_the_events_count(spark):
    prepare(spark)
    aligned = queries.alignments(spark, SMALL, "seq", "read", "cigar", "md").limit(3000).localCheckpoint()
    aligned = aligned.withColumn("ref_start", (F.col("ref_idx") % 5 * 40).cast("int"))
    counts, events = profile.tally(aligned).cache(), profile.alignment_events(aligned).cache()
    some = counts.where("pos is null")
    for a, b in [(profile.base_counts(some), profile.base_counts(events)), *((profile.kmer_counts(some, k), profile.kmer_counts(events, k)) for k in "SID")]:
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, profile.tallied_positions(counts).collect())) == sorted(map(tuple, profile.position_counts(aligned).collect()))
    assert counts.count() < 6000 and events.count() > 3000


def test_blocks_of_a_document_are_put_together_where_they_are_made(spark):
    plan = queries.QUERIES["base6_roundtrip"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")


def test_sam_text_is_packed_and_stored_once(spark):
    path, records = queries._records(spark, SMALL)
    assert all(f.endswith(".gz") for f in os.listdir(path) if f.startswith("part-"))
    assert sorted(records.inputFiles()) == sorted(f for f in spark.read.text(path).inputFiles())
