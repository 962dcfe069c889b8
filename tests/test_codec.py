"""Fountain code, Reed-Solomon, consensus, fits, text formats and the stream."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoflow.functions import dna
from oligoflow.operators import consensus, fountain, profile
from oligoflow.plans.queries import prepare
from oligoflow.sources import strands


def test_reed_solomon_corrects_half_the_parity():
    rng = random.Random(1)
    for wrong in range(6):
        for _ in range(20):
            data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 40)))
            block = bytearray(fountain.rs_encode(data))
            for i in rng.sample(range(len(block)), wrong):
                block[i] ^= rng.randrange(1, 256)
            assert fountain.rs_decode(bytes(block)) == data
    assert fountain.rs_decode(bytes(rng.randrange(256) for _ in range(46))) is None


def test_soliton_and_register():
    p = fountain.robust_soliton(500, 0.05, 0.1)
    assert abs(p.sum() - 1) < 1e-12 and p.argmax() == 1 and (p >= 0).all()
    states = list(fountain.lfsr(10_000))
    assert len(set(states)) == 10_000 and max(states) < 2**32 and states[:2] == [170, 340]


def test_peeling_gives_the_segments_back(spark):
    prepare(spark)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("0123456789abcdef", k=64))) for i in range(40)]
    segments = spark.createDataFrame(rows, "seg_idx int, payload string")
    drops = fountain.droplets(fountain.droplet_plan(spark, 150, 40, 3), segments).checkpoint()
    want = dict(rows)
    for r in drops.collect():
        x = 0
        for s in r.seg_ids:
            x ^= int(want[s], 16)
        assert int(r.payload, 16) == x and len(set(r.seg_ids)) == r.degree
    assert {r.seg_idx: r.payload for r in fountain.peel(drops).collect()} == want
    assert fountain.peel(drops.limit(0)).count() == 0


def test_file_through_oligos(spark):
    prepare(spark)
    rng = random.Random(4)
    segments = spark.createDataFrame([(i, "".join(rng.choices("0123456789abcdef", k=64))) for i in range(12)], "seg_idx int, payload string")
    coded = fountain.encode_file(segments, 12, 9, alpha=2.0, homopolymer=6, gc_slack=0.2).checkpoint()
    assert coded.count() == 37 and coded.where(F.rlike("dna", F.lit("A{7}|C{7}|G{7}|T{7}"))).isEmpty()
    got = fountain.parse_oligos(coded.select(F.col("droplet").alias("line"), "dna").unionByName(coded.select(F.lit(10**6).cast("long").alias("line"), "dna")))
    assert {r.droplet: r.payload for r in got.collect()} == {r.droplet: r.payload for r in coded.collect()}


def test_vote_ties_and_missing(spark):
    rows = [("c", "AAAA"), ("c", "TAAT"), ("c", "TTA"), ("d", "ACGT"), ("e", "AT")]
    got = {r.cluster_id: r.seq for r in consensus.majority_vote(spark.createDataFrame(rows, "cluster_id string, read string"), 4).collect()}
    assert got == {"c": "AAAA", "d": "ACGT"}
    four = spark.createDataFrame([("c", b * 2) for b in "ATGC"], "cluster_id string, read string")
    assert consensus.majority_vote(four, 2, z=5).first().seq == "ZZ"


def distance(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = list(accumulate_row(row, i, x, b))
    return row[-1]


def accumulate_row(row, i, x, b):
    left = i + 1
    yield left
    for j, y in enumerate(b):
        left = min(row[j] + (x != y), row[j + 1] + 1, left + 1)
        yield left


def test_alignment_is_the_best_within_its_band():
    """Edits by the full table wherever the band is wide enough, and letters that cost as many edits as they say."""
    rng = random.Random(3)
    models, reads = [], []
    for _ in range(300):
        model = "".join(rng.choices("ACGT", k=40))
        read = list(model)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(read))
            read[at : at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "G", "T"])
        models.append(model)
        reads.append("".join(read))
    letters, edits = consensus.align(reads, models, 4)
    for model, read, row, n in zip(models, reads, letters, edits):
        assert n == distance(read, model)
        line = bytes(row).decode()
        lost, wrong = line.count("Z"), sum(a not in (b, "Z") for a, b in zip(line, model))
        assert lost + wrong + (len(read) - (len(model) - lost)) == n
    far, edits = consensus.align(["A" * 30, ""], ["C" * 40] * 2, 2)
    assert bytes(far[0]) == b"Z" * 40 == bytes(far[1]) and (edits > 40).all()


def test_correction_follows_its_rules_read_by_read(spark):
    rng = random.Random(8)
    rows = []
    for c in range(12):
        ref = "".join(rng.choices("ACGT", k=30))
        for _ in range(7):
            t = list(ref)
            for _ in range(rng.choice([0, 1, 1, 7])):
                t[rng.randrange(len(t))] = rng.choice("ACGT")
            if rng.random() < 0.4:
                at = rng.randrange(30)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "A"])
            rows.append((c, "".join(t)))
    rows += [(50, "ACG"), (51, None), (None, "A" * 30)]

    def vote(reads, z):
        out = ""
        for p in range(30):
            n = {b: sum(r[p] == b for r in reads) for b in "ATGC"}
            out += "Z" if z and max(n.values()) < z and len(set(n.values())) == 1 else max("ATGC", key=lambda b: n[b])
        return out

    want = {}
    for c in range(12):
        mine = [r for k, r in rows if k == c]
        model = vote([r for r in mine if len(r) == 30], 5)
        kept = []
        for r in mine:
            if len(r) == 30 and sum(a != b for a, b in zip(r, model)) < 5:
                kept.append(r)
                continue
            line = bytes(consensus.align([r], [model], 2)[0][0]).decode()
            if line.count("Z") < 5 and sum(a != b for a, b in zip(line, model)) < 5:
                kept.append(line)
            elif len(r) == 30:
                kept.append(r)
        want[c] = vote(kept, 0)
    df = spark.createDataFrame(rows, "cluster_id long, read string")
    assert {r.cluster_id: r.seq for r in consensus.correct_clusters(df, 30).collect()} == want


def test_votes_of_a_hot_cluster_are_added_up(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, "".join(rng.choices("ACGT", weights=(5, 2, 2, 1), k=12))) for c in (1, 1, 1, 1, 2, 3) for _ in range(90 if c == 1 else 3)]
    df = spark.createDataFrame(rows, "cluster_id long, read string")
    plain = sorted(tuple(r) for r in consensus.majority_vote(df, 12).collect())
    monkeypatch.setattr(consensus, "HOT", 7)
    assert sorted(tuple(r) for r in consensus.majority_vote(df, 12).collect()) == plain and len(plain) == 3


def test_common_pieces_and_names(spark):
    rows = [("abcdxyz", "zzabcdyz", 99), ("abcdxyz", "zzabcdyz", 2), ("abc", "", 5), (None, "a", 5)]
    got = [r.p for r in spark.createDataFrame(rows, "a string, b string, n int").select(consensus.common_piece("a", "b", "n").alias("p")).collect()]
    assert got == ["abcd", "ab", "", ""]
    members = spark.createDataFrame([("r1", 0), ("r2/1", 1), ("q", 2)], "read_id string, ord int")
    reads = spark.createDataFrame([("r2/1", "C"), ("r11", "A"), ("r10", "G")], "name string, read string")
    assert {r.read_id: (r.name, r.read) for r in consensus.match_ids(members, reads).collect()} == {"r1": ("r10", "G"), "r2/1": ("r2/1", "C"), "q": (None, None)}


def test_correction_restores_strands(spark):
    rng = random.Random(5)
    refs = {i: "".join(rng.choices("ACGT", k=80)) for i in range(6)}
    rows = []
    for i, s in refs.items():
        for _ in range(9):
            t = list(s)
            t[rng.randrange(80)] = rng.choice("ACGT")
            if rng.random() < 0.4:
                del t[rng.randrange(20, 60)]
            rows.append((i, "".join(t)))
    df = spark.createDataFrame(rows, "cluster_id long, read string")
    got = {r.cluster_id: r.seq for r in consensus.correct_clusters(df, 80).collect()}
    assert set(got) == set(refs) and sum(a != b for i in refs for a, b in zip(got[i], refs[i])) <= 2
    prepare(spark)
    named = spark.createDataFrame([(k, r) for k, (_, r) in enumerate(rows)], "read_id long, read string")
    found = {r.read_id: r.cluster_id for r in consensus.cluster_reads(named).collect()}
    pure = {c: {rows[k][0] for k in found if found[k] == c} for c in set(found.values())}
    assert all(len(v) == 1 for v in pure.values()) and len(pure) < len(rows) * 0.6


def test_fit_prefers_the_true_family(spark):
    rng = np.random.default_rng(1)
    for family, x in (("poisson", rng.poisson(20, 3000)), ("exponential", np.ceil(rng.exponential(400, 3000))), ("lognormal", np.rint(rng.lognormal(4, 0.8, 3000)))):
        df = spark.createDataFrame([(int(v),) for v in x], "n_reads long")
        ranks = {r.family: r.rank for r in profile.fit_depth(df).collect()}
        assert ranks[family] <= 2
    assert profile.fit_depth(spark.createDataFrame([(1,)], "n_reads long")).first().family == "normal"


def test_register_jumps_to_its_states(spark):
    states = list(fountain.lfsr(5000))
    assert [fountain.lfsr_state(n) for n in (1, 2, 77, 4999, 5000)] == [states[n - 1] for n in (1, 2, 77, 4999, 5000)]
    assert [r.seed for r in fountain.lfsr_states(spark, 5000).orderBy("i").collect()] == states


def test_decoding_reports(spark):
    prepare(spark)
    truth = spark.createDataFrame([(0, "aa"), (1, "bb"), (2, "cc")], "seg_idx long, payload string")
    got = spark.createDataFrame([(0, "aa"), (1, "bc")], "seg_idx long, payload string")
    assert tuple(fountain.completion(got, truth).first()) == (3, 2, 1, 1, False)
    layout = spark.createDataFrame([(0, "x", 0, 3), (1, "x", 1, 3), (2, "y", 0, 2)], "seg_idx long, item_id string, seg int, n_bytes long")
    solved = spark.createDataFrame([(0, "6162"), (1, "6300")], "seg_idx long, payload string")
    assert [(r.item_id, bytes(r.content)) for r in fountain.files(solved, layout).collect()] == [("x", b"abc")]
    seen = spark.createDataFrame([(1,), (1,), (2,)], "droplet long")
    assert {(r.n, r.droplets) for r in fountain.seed_histogram(seen).collect()} == {(2, 1), (1, 1)}


def test_majority_of_several_peelings(spark):
    prepare(spark)
    words = [f"{i:02x}" * 32 for i in range(6)]
    rows = [(k, [k % 6], words[k % 6]) for k in range(60)] + [(60, [0], "ff" * 32)]
    df = spark.createDataFrame(rows, "droplet long, seg_ids array<long>, payload string")
    got = {r.seg_idx: r.payload for r in fountain.aggressive_decode(df, 3, 0.5, 1).collect()}
    assert got == dict(enumerate(words))


def test_reading_frames(spark):
    rows = [("CCATGAAATAGCC", 9), ("ATGTGGTGA", 9), ("ATGAAA", 0), ("", 0), ("ATGATGTAA", 9), ("ATGTAATTATGCCCTTTTGACC", 12)]
    got = spark.createDataFrame(rows, "s string, n int").select("n", dna.longest_frame(F.col("s")).alias("g")).collect()
    assert all(r.n == r.g for r in got)


def test_plans_are_checked(spark):
    lines = lambda rows: spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, line_no long")
    assert sorted(tuple(r) for r in strands.parse_copy_plan(lines(["1 3", "", " 2\t0 ", "3 1"]), 3).collect()) == [(0, 3), (2, 1)]
    for bad in (["1 2", "1 3"], ["4 1"], ["0 1"], ["x 1"], ["1 y"]):
        with pytest.raises(Exception, match="bad copy plan"):
            strands.parse_copy_plan(lines(bad), 3).collect()
    good = strands.parse_error_plan(lines(["1 2 S a", "2 1 D 255", "9 1 I G"]), 2).collect()
    assert sorted((r.read_idx, r.pos, r.etype, r.base) for r in good) == [(0, 1, "S", "A"), (1, 0, "D", None)]
    for bad in (["1 2 X A"], ["1 2 D A"], ["1 2 S 255"], ["1 z S A"]):
        with pytest.raises(Exception, match="bad error plan"):
            strands.parse_error_plan(lines(bad), 2).collect()


def test_text_formats(spark, tmp_path):
    clusters = [("0", 0, "seq_1"), ("0", 1, "seq_9"), ("7", 0, "seq_4")]
    strands.write_clusters(spark.createDataFrame(clusters, "cluster_id string, ord int, read_id string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in strands.read_clusters(spark, str(tmp_path / "c")).collect()) == clusters
    lines = spark.createDataFrame([(x,) for x in ("3\tACGT", "ACGG", ">head", "ACNT", "")], "value string")
    assert sorted(tuple(r) for r in strands.decoder_lines(lines).collect()) == [(1, "ACGG"), (3, "ACGT")]
    refs = spark.createDataFrame([("ACGT",), ("ACG",), ("ACX",)], "seq string")
    assert tuple(strands.validate(refs).first()) == (3, 3, 4, 1, False)
    names = spark.createDataFrame([(i, f"seq_{v}") for i, v in enumerate([1, 2, 10, 3, 4])], "place long, name string")
    assert tuple(consensus.natural_violations(names).first()) == (5, 1)


def test_stream_keeps_one_read_of_each_droplet(spark, tmp_path):
    from oligoflow.streaming import decode

    prepare(spark)
    rng = random.Random(6)
    segments = spark.createDataFrame([(i, "".join(rng.choices("0123456789abcdef", k=64))) for i in range(5)], "droplet long, payload string")
    rows = [r.dna for r in fountain.oligos(segments).collect()]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(rows + rows[:2] + ["ACNT"]) + "\n")
    (source / "b.txt").write_text("\n".join(rows[1:]) + "\n")
    decode.decode_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.droplet, r.payload) for r in got) == sorted((r.droplet, r.payload) for r in segments.collect())


def test_cluster_reads_with_many_strands_under_a_key(spark):
    """Strands that share a run of 12 bases or a long head, three reads each: every read finds its own strand's."""
    import random

    from oligoflow.operators import consensus
    from oligoflow.plans.queries import prepare

    prepare(spark)
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("ACGT", k=n))
    common, head, rows, truth = draw(30), draw(70), [], []
    for s in range(120):
        strand = draw(49) + common + draw(49) if s < 90 else head + draw(58)
        for _ in range(3):
            bases = list(strand)
            for p in rng.sample(range(128), 2):
                bases[p] = rng.choice("ACGT")
            truth.append(s)
            rows.append((len(rows), "".join(bases)))
    df = spark.createDataFrame([*rows, (9000, None), (9001, "ACGT"), (9002, "")], "read_id long, read string")
    for tile in (512, 16):
        got = {r.read_id: r.cluster_id for r in consensus.cluster_reads(df, tile=tile).collect()}
        assert [got.pop(i) for i in (9000, 9001, 9002)] == [9000, 9001, 9002]
        assert len(got) == len(rows) and all(truth[i] == truth[c] for i, c in got.items())
        assert sum(got[i] == 3 * s for i, s in enumerate(truth)) >= 0.95 * len(rows)
    # every pair of the same reads that the edit distance allows is joined
    small = [r for i, r in rows if truth[i] < 12]
    want = {(i, j) for i in range(len(small)) for j in range(i) if distance(small[i], small[j]) <= 12}
    assert want and all(got[i] == got[j] for i, j in want)


def test_read_components_follow_a_long_chain(spark):
    from oligoflow.operators import consensus
    from oligoflow.plans.queries import prepare

    prepare(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long")
    assert {r.node: r.component for r in consensus.components(chain).collect()} == dict.fromkeys(range(2001), 0)
