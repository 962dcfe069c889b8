"""Peeling by state: the same as all at once, with late droplets, repeats and files that stay incomplete."""

import random

from pyspark.sql import functions as F

from oligoflow.functions import dna
from oligoflow.operators import fountain
from oligoflow.plans.queries import _new_path, prepare
from oligoflow.streaming import decode


def test_state_solves_what_elimination_by_degree_one_solves():
    rng = random.Random(1)
    for _ in range(60):
        k = rng.randint(1, 12)
        truth = [rng.getrandbits(64) for _ in range(k)]
        drops = []
        for n in range(rng.randint(1, 3 * k)):
            some = rng.sample(range(k), rng.randint(1, min(k, 4)))
            value = 0
            for s in some:
                value ^= truth[s]
            drops.append((n, some, value))
        held, left, solved = decode.Peeling(k), [(set(s), v) for _, s, v in drops], {}
        while any(len(s) == 1 for s, _ in left):
            s, v = next(x for x in left if len(x[0]) == 1)
            name = next(iter(s))
            solved[name] = v
            left = [(t - {name}, w ^ v if name in t else w) for t, w in left]
        for n, some, value in rng.sample(drops, len(drops)):
            held.add(n, some, value, 2)
            held.add(n, some, value, 1)  # a repeat counts and tells nothing new
        assert held.solved == solved and all(truth[s] == v for s, v in solved.items())
        assert held.complete == (len(solved) == k) and held.counts == {n: 3 for n, _, _ in drops}
        if held.complete:
            held.add(999, [0], 12345, 1)  # late: counted, and nothing changes
            assert held.solved == solved and held.counts[999] == 1 and not held.open


def test_pool_in_two_runs_of_a_stream(spark, tmp_path):
    prepare(spark)
    rng = random.Random(2)
    files = {1: 6, 2: 3, 3: 5}
    segments = {(f, s): "".join(rng.choices("0123456789abcdef", k=64)) for f, k in files.items() for s in range(k)}
    known = spark.createDataFrame(list(files.items()), "file_id long, k long")
    plan = decode.file_plan(known, 7, 4.0, 30).collect()
    lines = []
    for r in plan:
        value = 0
        for s in r.seg_ids:
            value ^= int(segments[r.file_id, s], 16)
        lines.append((r.file_id, r.droplet, f"{value:064x}"))
    coded = fountain.oligos(spark.createDataFrame(lines, "file_id long, droplet long, payload string")).collect()
    texts = {(r.file_id, r.droplet): f"{r.file_id}|{r.droplet % 3 + 1}\t{r.dna}" for r in coded}
    folder, out, state = tmp_path / "in", _new_path(spark, "decoded"), _new_path(spark, "state")
    folder.mkdir()
    first = [t for (f, d), t in texts.items() if f == 1 or (f == 2 and d < 2)] + ["1|>a name", "9|" + coded[0].dna, "1|1\t" + "ACGT" * 46, "1|ACGN", "2|0\t" + coded[0].dna]
    (folder / "a.txt").write_text("\n".join(first) + "\n")

    def run():
        rows = spark.readStream.schema("value string").text(str(folder))
        cut = F.split("value", "[|]")
        stream = rows.select(cut[0].cast("long").alias("file_id"), cut[1].alias("value"))
        decode.run_pool(stream, known, 7, out, state).awaitTermination()
        return spark.read.schema(decode.SOLVED).parquet(out).collect()

    once = run()
    assert {r.file_id for r in once} == {1} and {(r.file_id, r.seg): r.payload for r in once} == {x: p for x, p in segments.items() if x[0] == 1}
    assert once[0].reads == sum(d % 3 + 1 for f, d in texts if f == 1)
    later = [t for (f, d), t in texts.items() if f == 2] + first[:20]  # repeats of a file that is complete
    (folder / "b.txt").write_text("\n".join(later) + "\n")
    again = run()
    assert {(r.file_id, r.seg): r.payload for r in again} == {x: p for x, p in segments.items() if x[0] != 3} and len(again) == 9
