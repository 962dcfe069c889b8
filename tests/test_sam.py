"""SAM text: columns, flags and tags, and events of alignments with every kind of CIGAR run against a walk base by base."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oligoflow.operators import profile
from oligoflow.plans import runs
from oligoflow.plans.queries import prepare
from oligoflow.sources import sam


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_columns_flags_and_tags(spark):
    rows = ["@HD\tVN:1.6", "@SQ\tSN:ref_1\tLN:9", "", "r1\t0\tref_1\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tMD:Z:1A2\tXX:B:c,1,2", "r2\t20\t*\t0\t0\t*\t=\t7\t-5\tAACG\t*", "r3\t2064\tref_1\t1\t255\t2H2M\t*\t0\t0\tGT\t*\tMD:Z:2\tbroken", "r4\t99\tref_1\t1\t9\t*\t*\t0\t0\t*\t*"]
    got = {r.read_id: r for r in sam.parse(lines(spark, rows)).collect()}
    assert set(got) == {"r1", "r2", "r3", "r4"}
    assert (got["r1"].ref_start, got["r1"].md, got["r1"].tags, got["r1"].mapq, got["r1"].quality) == (2, "1A2", {"NM": "1", "MD": "1A2", "XX": "c,1,2"}, 60, "IIII")
    assert got["r2"].unmapped and got["r2"].reverse and got["r2"].sequenced == "CGTT" and got["r2"].ref_name is None and got["r2"].ref_start is None and (got["r2"].mate_ref, got["r2"].mate_pos, got["r2"].template) == ("=", 7, -5)
    assert got["r3"].supplementary and got["r3"].reverse and got["r3"].sequenced == "AC" and got["r3"].tags == {"MD": "2"}
    assert got["r4"].paired and got["r4"].proper and got["r4"].mate_reverse and got["r4"].first and not got["r4"].unmapped and got["r4"].read is None
    records = sam.parse(lines(spark, rows))
    assert {r.read_id for r in sam.aligned(records).collect()} == {"r1", "r3"} and {r.read_id for r in sam.aligned(records, primary=True).collect()} == {"r1"}
    one = sam.mapping(records).first()
    assert (one.n_reads, one.n_mapped, one.n_reverse, one.n_bases, one.mapped_bases, one.mapping_rate) == (4, 3, 1, 10, 6, 0.75)
    assert sam.mapping(sam.parse(lines(spark, []))).first().mapping_rate == 0.0
    for bad in ("r\t0\tx", "r\tzero\tref\t1\t0\t*\t*\t0\t0\t*\t*", "r\t0\tref\tp\t0\t*\t*\t0\t0\t*\t*"):
        with pytest.raises(Exception, match="bad alignment line"):
            sam.parse(lines(spark, [bad])).collect()


def by_walk(start, ops, md, read):
    """Events (kind, pos, ref, read) and covered places of one alignment, one base at a time."""
    ref, at, places, events = start, 0, [], []
    for n, op in ops:
        for _ in range(n):
            if op in "M=X":
                places.append((ref, at))
            if op == "I":
                events.append(("I", ref, None, read[at]))
            ref += op in "M=XDN"
            at += op in "M=XIS"
    deleted, here = [], start
    for n, op in ops:
        for k in range(n):
            if op == "D":
                deleted.append(here)
            here += op in "M=XDN"
    order = sorted(places + [(r, None) for r in deleted])
    i = 0
    for kind, value in md:
        if kind == "n":
            i += value
        else:
            r, a = order[i]
            events.append(("S", r, value, read[a]) if kind == "S" else ("D", r, value, None))
            i += 1
    return events, [r for r, _ in places]


def case(rng):
    start, ops, ref, read, md, run, last = rng.randint(0, 9), [], [], "", [], 0, ""
    if rng.random() < 0.3:
        ops.append((rng.randint(1, 3), "H"))
    if rng.random() < 0.4:
        ops.append((rng.randint(1, 3), "S"))
        read += "".join(rng.choices("ACGT", k=ops[-1][0]))
    for op in rng.choices("MM=XIDNP", k=rng.randint(1, 9)):
        if op == last or (op in "DN" and last in "DN"):
            continue
        last, n = op, rng.randint(1, 4)
        ops.append((n, op))
        for _ in range(n):
            if op in "M=X":
                wrong = op == "X" or (op == "M" and rng.random() < 0.3)
                base = rng.choice("ACGT")
                read += base
                if wrong:
                    md += [("n", run), ("S", rng.choice("ACGT".replace(base, "")))]
                    run = 0
                else:
                    run += 1
            elif op == "D":
                md += [("n", run), ("D", rng.choice("ACGT"))]
                run = 0
            elif op == "I":
                read += rng.choice("ACGT")
    md.append(("n", run))
    text, i = "", 0
    while i < len(md):
        kind, value = md[i]
        if kind == "n":
            text += str(value)
        elif kind == "S":
            text += value
        else:
            text += "^" + value
            while i + 2 < len(md) and md[i + 1] == ("n", 0) and md[i + 2][0] == "D" and md[i + 2][0] == kind:
                text, i = text + md[i + 2][1], i + 2
        i += 1
    return start, ops, md, text, read


def test_every_kind_of_run(spark):
    rng = random.Random(12)
    cases = [c for c in (case(rng) for _ in range(600)) if c[4] and any(op in "M=X" for _, op in c[1])]
    rows = [f"r{i}\t0\tref\t{s + 1}\t60\t{''.join(f'{n}{o}' for n, o in ops)}\t*\t0\t0\t{read}\t*\tMD:Z:{md}" for i, (s, ops, _, md, read) in enumerate(cases)]
    records = sam.aligned(sam.parse(lines(spark, rows))).withColumn("ref_idx", F.lit(0).cast("long"))
    want, cover = Counter(), Counter()
    for i, (s, ops, md, _, read) in enumerate(cases):
        events, places = by_walk(s, ops, md, read)
        want.update((f"r{i}", *e) for e in events)
        cover.update(places)
    got = Counter((r.read_id, r.kind, r.pos, r.ref_base, r.read_base) for r in profile.alignment_events(records).collect())
    assert got == want
    counts = {r.pos: r.coverage for r in profile.position_counts(records).collect()}
    assert {p: n for p, n in counts.items() if n} == dict(cover)


def test_files_and_profile(spark, tmp_path):
    prepare(spark)
    strand = "ACGTTGCAAGGCTTAACCGGTTAA"
    rows = spark.createDataFrame(
        [("a", "s1", 0, "24M", "24", strand, False, False), ("b", "s1", 2, "5M1I3M1D4M", "5T2^T4", "GTTGCTACGAACC", False, True), ("c", "s2", 0, "24M", "24", strand, True, True), ("d", None, None, None, None, "", True, False), ("e", "s3", 0, "24M", None, strand, False, False)],
        "read_id string, ref_name string, ref_start int, cigar string, md string, read string, unmapped boolean, reverse boolean",
    )
    path = str(tmp_path / "out.sam")
    sam.write(rows, path, spark.createDataFrame([("s1", 24), ("s2", 24)], "ref_name string, length long"))
    got = {r.read_id: r for r in sam.scan(spark, path).collect()}
    assert {r.ref_name: r.length for r in sam.references(spark, path).collect()} == {"s1": 24, "s2": 24}
    assert (got["a"].md, got["b"].ref_start, got["b"].reverse, got["b"].sequenced) == ("24", 2, True, "GGTTCGTAGCAAC") and got["c"].read == "TTAACCGGTTAAGCCTTGCAACGT" and got["c"].unmapped and got["d"].read is None and got["e"].md is None
    refs = spark.createDataFrame([(0, "s1", strand), (1, "s2", strand)], "ref_idx long, name string, seq string")
    found = runs.extract_sam(spark, path, refs)
    depth = found["depth"].first()
    assert (depth.n_refs, depth.n_covered) == (2, 1)
    one = found["summary"].first()
    assert (one.n_reads, one.n_mapped, one.mapping_rate) == (5, 2, 0.4)
