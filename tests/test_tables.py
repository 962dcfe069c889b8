"""Allocation across chunks and substitution tables."""

import gzip
from pathlib import Path
from urllib.parse import unquote, urlparse

from oligoflow.operators import order, profile
from oligoflow.plans import queries
from oligoflow.sources import strands as source


def test_allocation_deals_out_every_read_within_its_window(spark):
    sizes = [5, 100, 0, 7, 33, 12, 50]
    df = spark.createDataFrame(list(enumerate(sizes)), "chunk_idx long, n_reads long")
    rows = order.allocate(df, 2).collect()
    for i, n in enumerate(sizes):
        mine = [r for r in rows if r.chunk_idx == i]
        assert sum(r.n for r in mine) == n and len(mine) == 5
        assert all(min((r.target - i) % 7, (i - r.target) % 7) <= 2 for r in mine)
    one = order.allocate(df.limit(1), 2).collect()
    assert [(r.chunk_idx, r.target, r.n) for r in one] == [(0, 0, 5)]


def test_substitution_table(spark):
    counts = spark.createDataFrame([("A", "T", 1), ("A", "G", 3), ("C", "A", 5)], "ref_base string, base string, n long")
    got = {(r.ref_base, r.base): (r.p, r.cum) for r in profile.base_lut(counts).collect()}
    assert len(got) == 12
    assert got["A", "T"] == (0.25, 0.25) and got["A", "C"] == (0.0, 0.25) and got["A", "G"] == (0.75, 1.0)
    assert got["G", "A"] == (0.3333333333, 0.3333333333) and got["C", "A"] == (1.0, 1.0)


def test_alignment_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("r1\tref_1\t0\t4M\t4\tACGT\nr2\t*\t0\t*\t\tACGT\n")
    refs = spark.createDataFrame([(7, "ref_1", "ACGT")], "ref_idx long, name string, seq string")
    found = profile.read_alignments(spark, str(tmp_path / "a.tsv"))
    assert found.count() == 2
    assert [(r.read_id, r.ref_idx, r.ref_start) for r in profile.mapped(found, refs).collect()] == [("r1", 7, 0)]


def test_strands_in_order_move_texts_alone(spark):
    rows = [(k * 7919 % 500, "é" * (k % 9) + "x" * (k * 31 % 400) if k % 11 else (None, "")[k % 2]) for k in range(500)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    for some, kind in ((rows, "long"), ([(f"k{k:04}", t) for k, t in rows], "string"), (rows[:1], "long"), ([], "long")):
        docs = spark.createDataFrame(some, f"doc_id {kind}, text string").repartition(3)
        plain = source.strands_of(docs, "doc_id", "text")
        spark.conf.set(size, "3")
        found = source.strands_of(docs, "doc_id", "text", ordered=True)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        got = [tuple(r) for r in found.collect()]
        spark.conf.set(size, before)
        assert got == sorted(map(tuple, plain.collect())) and [r[0] for r in got] == list(range(len(got)))
        assert plan.count("RepartitionByExpression") == 1 and plan.index("MapInArrow") < plan.index("RepartitionByExpression")


def test_fasta_is_packed_and_in_order(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(queries, "_new_path", lambda s, label, new=queries._new_path: paths.append(new(s, label)) or paths[-1])
    found = queries.fasta_roundtrip(spark, "/root/testdata/sf0.001")
    files = sorted(Path(unquote(urlparse(paths[0]).path)).glob("part-*"))
    lines = [line for f in files for line in gzip.open(f, "rt").read().splitlines()]
    names = lines[::2]
    assert names == [f">seq_{k + 1}" for k in range(len(names))] and found.count() == len(names)
    assert sum(f.stat().st_size for f in files) < sum(map(len, lines)) / 4
