"""Channel operators: hand-worked CIGAR and MD cases, explicit plans, quotas, numbering."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oligoflow.functions import batch
from oligoflow.functions import depth as depth_tables
from oligoflow.functions import dna
from oligoflow.operators import channel, order
from oligoflow.plans.queries import prepare

STRAND = "ACGTACGTAC"
#: Events, CIGAR and MD of a strand of ten bases, worked by hand from the rules for SAM records.
CASES = [
    ("", "10M", "10"), ("S0", "10M", "0A9"), ("S9", "10M", "9C0"), ("S4 S5", "10M", "4A0C4"), ("D0", "1D9M", "0^A9"), ("D4", "4M1D5M", "4^A5"),
    ("D4 D5", "4M2D4M", "4^AC4"), ("D4 S5", "4M1D5M", "4^A0C4"), ("S4 D5", "5M1D4M", "4A0^C4"), ("D9", "9M1D", "9^C0"), ("I0", "1I10M", "10"), ("I4", "4M1I6M", "10"),
]


def events_of(text):
    out = []
    for e in text.split():
        pos = int(e[1:])
        out.append((pos, e[0], {"S": "T" if STRAND[pos] != "T" else "G", "I": "G", "D": None}[e[0]], STRAND[pos]))
    return out


@pytest.fixture(scope="module")
def aligned(spark):
    prepare(spark)
    flat = [(i, *e) for i, (text, *_) in enumerate(CASES) for e in events_of(text)]
    row, pos = (np.array([e[k] for e in flat]) for k in (0, 1))
    kind, base, ref = (np.array([ord(e[k] or "\0") for e in flat], np.uint8) for k in (2, 3, 4))
    letters, n = batch.matrix(pa.array([STRAND] * len(CASES)), len(STRAND)), len(CASES)
    reads = batch.mutated(letters, row, pos, kind, base).to_pylist()
    cigars, mds = batch.cigar(n, 10, row, pos, kind).to_pylist(), batch.md(n, 10, row, pos, kind, ref).to_pylist()
    return spark.createDataFrame(list(zip(range(n), [0] * n, [STRAND] * n, reads, cigars, mds)), "read_id long, ref_idx long, seq string, read string, cigar string, md string")


def test_cigar_and_md(aligned):
    got = {r.read_id: (r.cigar, r.md) for r in aligned.collect()}
    assert [got[i] for i in range(len(CASES))] == [(c, m) for _, c, m in CASES]


def test_draws_are_those_of_the_column(spark):
    keys = [0, 1, 127, 2**31 + 5, 2**41 + 77, 2**62 + 3]
    frame = spark.createDataFrame([(k, i * 37) for i, k in enumerate(keys)], "k long, p int")
    rows = frame.select("k", dna.mix(F.col("k"), 3, 42).alias("u"), dna.mix_at(F.col("k"), F.col("p"), 3, 42).alias("v")).collect()
    assert {r.k: r.u for r in rows} == dict(zip(keys, batch.draws(np.array(keys), 3, 42).tolist()))
    assert {r.k: r.v for r in rows} == dict(zip(keys, batch.draws_at(np.array(keys), np.arange(6) * 37, 3, 42).tolist()))


def test_draws_have_no_short_period():
    numbers, places = np.arange(2000), np.arange(128)
    drawn = batch.draws_at(numbers[:, None], places, 2, 42)
    for step in (2**24, 2**31, 2**32, 2**48):
        assert (batch.draws_at(numbers[:, None] + step, places, 2, 42) == drawn).mean() < 1e-3
        assert (batch.draws(numbers + step, 0, 42) == batch.draws(numbers, 0, 42)).mean() < 1e-2
    assert len(np.unique(batch.states(np.arange(200_000) * 2**24, 0, 42))) == 200_000


def test_seeds_and_streams_are_unrelated():
    numbers, places = np.arange(3000), np.arange(64)
    one = batch.draws_at(numbers[:, None], places, 2, 42).astype(float)
    others = [batch.draws_at(numbers[:, None] + more, places + at, stream, seed).astype(float) for more, at, stream, seed in ((0, 0, 3, 42), (0, 0, 2, 43), (1, 0, 2, 42), (0, 1, 2, 42), (1, 0, 2, 42 + 1000003), (0, 0, 2, 42 + 7919))]
    for other in others:
        assert abs(np.corrcoef(one.ravel(), other.ravel())[0, 1]) < 0.01
    # Even over the range, in each bit, and between neighbouring reads and positions.
    share = np.bincount((one.ravel() / 2**31 * 64).astype(int), minlength=64) / one.size * 64
    assert abs(share - 1).max() < 0.1
    assert all(abs((one.astype(int) >> bit & 1).mean() - 0.5) < 0.01 for bit in range(31))
    assert abs(np.corrcoef(one[1:].ravel(), one[:-1].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(one[:, 1:].ravel(), one[:, :-1].ravel())[0, 1]) < 0.01
    # Errors of one read are as spread out as independent ones: their number's variance is binomial.
    hits = (one < 0.1 * 2**31).sum(axis=1)
    assert abs(hits.mean() - 6.4) < 0.2 and abs(hits.var() - 64 * 0.09) < 0.6


def test_reads_and_their_strand_again(aligned):
    rows = aligned.select("read_id", "read", channel.rebuild(F.col("read"), F.col("cigar"), F.col("md")).alias("again")).collect()
    for r in rows:
        want = list(STRAND)
        for pos, kind, base, _ in reversed(events_of(CASES[r.read_id][0])):
            want[pos : pos + (kind != "I")] = [] if kind == "D" else [base]
        assert r.read == "".join(want) and r.again == STRAND


def test_alignment_events_are_the_planted_ones(aligned):
    from oligoflow.operators import profile

    got = sorted((r.read_id, r.kind, r.pos, r.ref_base, r.read_base) for r in profile.alignment_events(aligned).collect() if r.kind != "I")
    want = sorted((i, k, p, ref, b if k == "S" else None) for i, (t, *_) in enumerate(CASES) for p, k, b, ref in events_of(t) if k != "I")
    assert got == want
    rows = {r.pos: r for r in profile.position_counts(aligned).collect()}
    for p in range(10):
        count = {k: sum(f"{k}{p}" in t.split() for t, *_ in CASES) for k in "SID"}
        assert (rows[p].coverage, rows[p].n_sub, rows[p].n_ins, rows[p].n_del) == (len(CASES) - count["D"], count["S"], count["I"], count["D"])


def test_alignments_may_start_anywhere(spark):
    from oligoflow.operators import profile

    rows = [("a", 0, 3, "2S2M1I3M1D2M", "1A3^G0C1", "TTACGTTTCA", "ACGTCGATTTGGTA"), ("b", 0, 0, "4M", "4", "ACGT", "ACGTCGATTTGGTA"), ("c", 1, None, "2M", "0G1", "AC", "GC")]
    df = spark.createDataFrame(rows, "read_id string, ref_idx long, ref_start int, cigar string, md string, read string, seq string")
    got = sorted((r.read_id, r.pos, r.kind, r.ref_base, r.read_base) for r in profile.alignment_events(df).collect())
    assert got == [("a", 4, "S", "A", "C"), ("a", 5, "I", None, "G"), ("a", 8, "D", "G", None), ("a", 9, "S", "C", "C"), ("c", 0, "S", "G", "A")]
    cover = {r.pos: r.coverage for r in profile.position_counts(df.where("ref_idx = 0")).collect() if r.coverage}
    assert cover == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, 10: 1}


def test_explicit_places(spark):
    reads = spark.createDataFrame([(0, STRAND), (1, STRAND), (2, STRAND)], "read_id long, seq string")
    plan = [(0, 2, "S", "A", 1), (0, 2, "S", "T", 2), (0, 4, "I", "G", 3), (0, 4, "I", "T", 4), (1, 0, "D", None, 5), (1, 9, "S", "C", 6), (1, 40, "S", "A", 7), (1, 3, "D", None, 8), (1, 3, "I", "C", 9)]
    errs = spark.createDataFrame(plan, "read_idx long, pos int, etype string, base string, line_no long")
    placed = channel.explicit_events(reads, errs)
    got = {r.read_id: r.x for r in reads.join(placed, "read_id").select("read_id", channel.apply_places(F.col("seq"), F.col("places")).alias("x")).collect()}
    assert got == {0: "ACTTGTACGTAC", 1: "CGCACGTAC"}


def test_quota_is_exact_and_smallest(spark):
    prepare(spark)
    reads = spark.range(3000).select(F.col("id").alias("read_id"), F.lit(0).cast("long").alias("ref_idx"), F.lit("A" * 16).alias("seq"))
    noise, n = channel.standard_noise(16, (30.0, 10.0, 15.0)), 3000
    found = []
    for sigmas in (8.0, 0.01):  # the second window is too narrow and must be widened
        cuts = channel.error_cuts(reads.select("read_id"), noise, 5, sigmas)
        found.append(sorted((r.pos, r.read_id, r.etype) for r in channel.errors(reads, noise, 5, cuts).collect()))
    assert found[0] == found[1]
    u = batch.draws_at(np.arange(n)[:, None], np.arange(16), 2, 5)
    for pos in range(16):
        quota = int(np.rint(n * noise.rates[pos].sum()))
        assert sorted(r for p, r, _ in found[0] if p == pos) == sorted(np.lexsort((np.arange(n), u[:, pos]))[:quota].tolist())
    none = channel.error_cuts(reads.select("read_id"), channel.standard_noise(16, (0.0, 0.0, 0.0)), 5)
    assert channel.errors(reads, noise, 5, none).count() == 0 and (none.draw == -1).all()


def test_batches_agree_with_a_plain_loop(spark):
    """Placement, bases by context, reads and truth of random strands, one base at a time."""
    rng = random.Random(5)
    kmer = np.sort(np.random.default_rng(2).integers(0, batch.BASE_DRAWS, (2, 256, 3)), axis=2)
    noise = channel.standard_noise(30, (60.0, 40.0, 50.0), kmer)
    strands = ["".join(rng.choices("ACGT", k=30)) for _ in range(200)]
    df = spark.createDataFrame([(i * 7, i, s) for i, s in enumerate(strands)], "read_id long, ref_idx long, seq string")
    got = {r.ref_idx: r for r in channel.simulate(df, noise, 9).collect()}
    bounds, code = noise.bounds(), "ATCG".index
    draw = lambda read, pos, stream: int(batch.draws_at(np.array([read]), np.array([pos]), stream, 9)[0])
    for i, strand in enumerate(strands):
        out, n = "", {"S": 0, "I": 0, "D": 0}
        for p, ref in enumerate(strand):
            u, v = draw(i * 7, p, 2), draw(i * 7, p, 4) % batch.BASE_DRAWS
            kind = next((k for k, b in zip("SID", bounds[p]) if u < b), None)
            if kind:
                n[kind] += 1
            if kind in ("S", "I"):
                if 3 <= p < 28:
                    index = 64 * code(strand[p - 3]) + 16 * code(strand[p - 2]) + 4 * code(strand[p - 1]) + code(ref)
                    base = "ATCG"[sum(v >= b for b in kmer["SI".index(kind), index])]
                elif kind == "S":
                    base = "ATCG".replace(ref, "")[sum(v >= b for b in noise.subs[code(ref)])]
                else:
                    base = "ATCG"[sum(v >= b for b in noise.ins)]
                out += base if kind == "S" else base + ref
            elif kind is None:
                out += ref
        assert (got[i].read, got[i].n_sub, got[i].n_ins, got[i].n_del) == (out, n["S"], n["I"], n["D"])
    again = channel.simulate(df, noise, 9).select("ref_idx", channel.rebuild(F.col("read"), F.col("cigar"), F.col("md")).alias("s")).collect()
    assert all(r.s == strands[r.ref_idx] for r in again)


def test_hot_references_are_cut_into_spans(spark, monkeypatch):
    monkeypatch.setattr(channel, "SPAN", 7)
    df = spark.createDataFrame([(0, 20, 0), (1, 0, 20), (2, 1, 20), (3, 7, 21)], "ref_idx long, n_reads long, first_read long")
    got = sorted((r.read_id, r.ref_idx, r.copy_idx) for r in channel.expand(df).collect())
    assert got == [(i, 0, i) for i in range(20)] + [(20, 2, 0)] + [(21 + i, 3, i) for i in range(7)]


def test_deep_references_are_looked_up_in_batches(spark):
    df = spark.range(2000).select(F.col("id").alias("ref_idx"))
    found = channel.sample_depth(df, "gamma", 900.0, 1.3, 3)
    bounds = depth_tables.depth_cdf("gamma", depth_tables.depth_params("gamma", 900.0, 1.3))
    assert len(bounds) > channel.TREE
    u = batch.draws(np.arange(2000), 0, 3)
    assert [r.n_reads for r in found.orderBy("ref_idx").collect()] == np.searchsorted(np.array(bounds), u, side="right").tolist()


def test_numbering_spans_partitions(spark):
    prepare(spark)
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5)) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(7)
    got = sorted((r.k, r.ordinal, r.before) for r in order.running(df, ["k"], F.col("n")).collect())
    total, want = 0, []
    for i, (k, n) in enumerate(sorted(rows)):
        want.append((k, i, total))
        total += n
    assert got == want
    assert order.running(df.limit(0), ["k"], F.col("n")).count() == 0


def test_apportionment_ties(spark):
    df = spark.createDataFrame([("g", 0, 2.5, 10), ("g", 1, 2.5, 10), ("g", 2, 5.0, 10)], "g string, j int, share double, total long")
    assert {r.j: r.n for r in order.largest_remainder(df, ["g"], "share", "total", "j").collect()} == {0: 2, 1: 3, 2: 5}


def test_chunks_split_references_on_borders(spark):
    prepare(spark)
    df = spark.createDataFrame([(0, 3), (1, 0), (2, 8), (3, 7)], "ref_idx long, n_reads long")
    got = sorted(tuple(r) for r in channel.pack_chunks(channel.number_reads(df), 5).collect())
    assert got == [(0, 0, 3), (0, 2, 2), (1, 2, 5), (2, 2, 1), (2, 3, 4), (3, 3, 3)]


@pytest.mark.parametrize("rate", [0.0, 0.3, 0.9])
def test_dropout_is_exact(spark, rate):
    prepare(spark)
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "ref_idx long, n_reads long")
    got = {r.ref_idx: r.n_reads for r in channel.calibrate_dropout(df, rate, 3).collect()}
    assert len(got) == 500 and sum(n == 0 for n in got.values()) == int(500 * rate)
    assert all(got[i] in (i % 3, 0, 1) for i in got)


@pytest.mark.parametrize("family", depth_tables.FAMILIES)
def test_depth_tables_have_the_asked_mean_and_spread(family):
    mean, cv = 30.0, 0.4
    params = depth_tables.depth_params(family, mean, cv)
    bounds = depth_tables.depth_cdf(family, params)
    mass = [(b - a) / 2**31 for a, b in zip([0, *bounds], bounds)]
    found = sum(k * p for k, p in enumerate(mass))
    want_mean, want_cv = depth_tables.theoretical(family, params)
    assert abs(found / mean - 1) < 0.02 and abs(want_mean / mean - 1) < 1e-6
    spread = (sum((k - found) ** 2 * p for k, p in enumerate(mass))) ** 0.5 / found
    assert abs(spread - want_cv) < 0.02
    if family not in ("poisson", "exponential"):
        assert abs(want_cv - cv) < 1e-6


def test_depth_parameters_that_cannot_be():
    for bad in (("nbinom", 4.0, 0.1), ("beta", 4.0, 5.0), ("gamma", -1.0, 0.5), ("gamma", 4.0, None), ("cauchy", 1.0, 1.0)):
        with pytest.raises(ValueError):
            depth_tables.depth_params(*bad)


def test_rates_are_scaled(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 3.0), (1, 3.0, 0.0, 1.0)], "pos int, sub double, ins double, del double")
    got = channel.override_rates(df, [400.0]).agg(F.avg(F.col("sub") + F.col("ins") + F.col("del"))).first()[0]
    assert abs(got - 0.4) < 1e-9
    three = channel.override_rates(df, [100.0, 50.0, 20.0]).agg(F.avg("sub"), F.avg("ins"), F.avg("del")).first()
    assert [round(x, 9) for x in three] == [0.1, 0.0, 0.02]
    with pytest.raises(ValueError):
        channel.override_rates(df, [600.0, 500.0, 0.0])


def test_codes(spark):
    data = [(b"",), (bytes(range(256)),), (b"hello",)]
    rows = spark.createDataFrame(data, "b binary").select("b", dna.dna_encode(F.col("b")).alias("s")).select("b", "s", dna.dna_decode(F.col("s")).alias("again")).collect()
    for r in rows:
        assert r.s == "".join("ACGT"[x >> s & 3] for x in bytes(r.b) for s in (6, 4, 2, 0)) and bytes(r.again) == bytes(r.b)
    runs = spark.createDataFrame([("AAAATTTTTG",), ("ACGT",), ("",)], "s string").select(dna.longest_run(F.col("s")).alias("n"), dna.gc_count(F.col("s")).alias("gc")).collect()
    assert [tuple(r) for r in runs] == [(5, 1), (1, 2), (0, 0)]
