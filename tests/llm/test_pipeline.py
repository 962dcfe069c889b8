"""Near copies and the pipeline's stages against brute force on small tables."""

import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from oligoflow.llm import decontaminate, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = "".join(rng.choices("qwxz", k=6))
    return out


def copies(seed=1):
    """Originals of 150 words, copies with few or many words changed, and texts of their own."""
    rng = random.Random(seed)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(3000)]
    rows, at = [], 0
    for _ in range(25):
        base = rng.choices(stock, k=150)
        for n in (0, 1, 1, 2, 25):
            rows.append((at, " ".join(edited(rng, base, n))))
            at += 1
    base = rng.choices(stock, k=200)
    rows += [(at + i, " ".join(edited(rng, base, 1 if i else 0))) for i in range(60)]
    at += 60
    return rows + [(at + i, " ".join(rng.choices(stock, k=rng.randint(1, 80)))) for i in range(60)] + [(at + 100, None), (at + 101, "")]


@pytest.mark.parametrize("crowd", [32, 8, 1])
def test_near_copies_join_what_resembles(spark, crowd):
    rows = copies()
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), crowd=crowd).collect()}
    assert set(got) == {i for i, _ in rows}
    assert got == groups_by_brute_force(rows)
    text = dict(rows)
    groups = defaultdict(list)
    for i, c in got.items():
        groups[c].append(i)
    for c, members in groups.items():
        assert c == min(members)
        for i in members if len(members) > 1 else ():
            assert max(jaccard(text[i], text[j]) for j in members if j != i) >= 0.8


@pytest.mark.parametrize("made_up", [False, True])
def test_order_of_shingles_changes_no_result(spark, monkeypatch, made_up):
    """Without the sample, and with counts made up for half of all shingles, the same texts are joined."""
    rows = copies(2)
    grams = np.unique(np.concatenate([simhash.shingle_hashes(t) for _, t in rows]))[::2] if made_up else np.zeros(0, np.uint64)
    counts = np.random.default_rng(5).integers(3, 1000, len(grams))
    monkeypatch.setattr(simhash, "_common_shingles", lambda texts: (grams, counts))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == groups_by_brute_force(rows)


def test_fingerprints_alone_link_nothing(spark):
    """Texts less alike than 0.8 whose fingerprints differ in two bits at most stay apart."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 40:
        base = rng.choices([f"w{i}" for i in range(500)], k=rng.randint(6, 9))
        some = [" ".join(base), " ".join(edited(rng, base, 1))]
        prints = [simhash.fingerprint(t, 5) for t in some]
        if (prints[0] ^ prints[1]).bit_count() <= 2 or len(rows) < 20:
            rows += [(len(rows) + k, t) for k, t in enumerate(some)]
        if rng.random() < 1e-4:
            break
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == groups_by_brute_force(rows)


def test_sketches_let_similar_pairs_through():
    """No pair of 0.8 or more is put aside by its sketch, whatever the texts' lengths, and few unlike pairs pass."""
    rng = random.Random(21)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(20_000)]
    passed = 0
    for k in range(1200):
        base = rng.choices(stock, k=rng.choice([6, 12, 30, 80, 200, 600, 2000]))
        n = int(len(base) * rng.uniform(0, 0.03)) if len(base) > 30 else rng.randint(0, 1)
        texts = [" ".join(base), " ".join(edited(rng, base, n) if k % 2 else base + rng.choices(stock, k=len(base) // 5))]
        hashes = [simhash.shingle_hashes(t) for t in texts]
        rows = [np.frombuffer(simhash.sketch(h), np.uint8)[None] for h in hashes]
        if simhash.resemblance(*[h.tobytes() for h in hashes]) >= 0.8:
            passed += 1
            assert simhash.may_resemble(*rows, 0.8)[0]
    assert passed > 500
    far = [np.frombuffer(simhash.sketch(simhash.shingle_hashes(" ".join(rng.choices(stock, k=300)))), np.uint8) for _ in range(200)]
    assert not simhash.may_resemble(np.array(far[:100]), np.array(far[100:]), 0.8).any()
    empty = np.frombuffer(simhash.sketch(np.zeros(0, np.uint64)), np.uint8)[None]
    assert simhash.may_resemble(empty, empty, 0.8)[0]


def test_resemblance_is_that_of_whole_shingle_sets():
    rng = random.Random(2)
    words = [str(i) for i in range(40)]
    for _ in range(50):
        a, b = (" ".join(rng.choices(words[:6], k=rng.randint(1, 60))) for _ in range(2))
        assert abs(simhash.resemblance(simhash.signature(a)[1], simhash.signature(b)[1]) - jaccard(a, b)) < 1e-9
    assert simhash.resemblance(b"", b"") == 1.0


def test_one_of_each_keeps_columns_and_nulls(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None), (7, "other words stand here now")]
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 7, 9]
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(8)
    rows = copies(4)
    top = 1000
    rows += [(top + i, rows[i][1].upper()) for i in range(10) if rows[i][1]]
    bench = [(k, " ".join(rng.choices([f"q{i}" for i in range(300)], k=40))) for k in range(5)]
    rows += [(2000 + k, f"some talk before {t} and some behind") for k, t in bench]
    toxic = [(3000 + i, " ".join([*rng.choices(["plain", "calm", "words"], k=20), "scumbag", str(i)])) for i in range(60)]
    rows += toxic
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, t) for k, t in bench], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 3000)) for i, t in rows if t], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontaminate", "packing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / f"before-{name}"))
        docs = stage(spark, spark.read.parquet(str(tmp_path / f"before-{name}")), str(tmp_path))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = dict(rows)
    assert kept["toxicity"] == {i for i, _ in rows if i < 3000}
    best = {}
    for i in kept["toxicity"]:
        key = (texts[i] or "").lower()
        best[key] = max(best.get(key, -1), i)
    assert kept["exact_dedup"] == set(best.values())
    components = groups_by_brute_force([(i, texts[i]) for i in sorted(kept["exact_dedup"])])
    assert kept["simhash"] == set(components.values()) < kept["exact_dedup"]
    assert kept["decontaminate"] == {i for i in kept["simhash"] if all(decontaminate.compare(texts[i], t)[0] < decontaminate.COVERAGE for _, t in bench)}
    assert kept["simhash"] - kept["decontaminate"] == {2000 + k for k, _ in bench}
    assert kept["packing"] == kept["decontaminate"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.select("doc_id").collect()} == kept["packing"]


def groups_by_brute_force(rows, similarity=0.8):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for j, _ in rows[:x]:
            small, large = sorted((sets[i], sets[j]), key=len)
            both = len(small & large) if len(small) >= similarity * len(large) else 0
            if both >= similarity * (len(small) + len(large) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_copies_with_blocks_added_cut_and_inserted(spark):
    """Texts of 80 to 1500 words and copies with a run of another text appended, inserted, or with their end cut."""
    rng = random.Random(11)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(20_000)]
    rows, pairs = [], []
    for k in range(90):
        base, other = rng.choices(stock, k=rng.randint(80, 1500)), rng.choices(stock, k=1500)
        n = int(len(base) * rng.uniform(0.05, 0.26))
        at = rng.randrange(len(base))
        copy = [base + other[:n], base[: len(base) - n], base[:at] + other[:n] + base[at:]][k % 3]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    want = groups_by_brute_force(rows)
    assert 30 < sum(want[2 * k] == want[2 * k + 1] for k in range(90)) < 90
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("crowd,tile", [(8, 2048), (1, 16)])
def test_near_copies_in_crowds_of_alike_texts(spark, crowd, tile):
    """A chain in which a text resembles its neighbours alone, and near copies within a group that shares a template."""
    rng = random.Random(13)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(20_000)]
    run = rng.choices(stock, k=30 * 100 + 300)
    rows = [(i, " ".join(run[30 * i : 30 * i + 300])) for i in range(100)]
    template = rng.choices(stock, k=300)
    for i in range(120):
        words = template + rng.choices(stock, k=48)
        rows.append((200 + i, " ".join(words)))
        if i % 4 == 0:
            rows.append((500 + i, " ".join(edited(rng, words, 5))))
    rng.shuffle(rows)
    want = groups_by_brute_force(rows)
    assert {want[i] for i in range(100)} == {0} and sum(want[500 + i] == 200 + i for i in range(0, 120, 4)) > 25
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), crowd=crowd, tile=tile).collect()}
    assert got == want


def test_long_texts_are_decided_by_all_shingles(spark):
    """Copies of 1000 to 2000 words on both sides of 0.8; no sample of their shingles tells them apart."""
    rng = random.Random(17)
    stock = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(20_000)]
    rows = []
    for k in range(40):
        base = rng.choices(stock, k=rng.randint(1000, 2000))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(rng, base, int(len(base) * rng.uniform(0.021, 0.026)))))]
    want = groups_by_brute_force(rows)
    assert 10 < sum(want[2 * k] == want[2 * k + 1] for k in range(40)) < 30
    assert {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()} == want


def test_pipeline_on_empty_tables_and_null_ids(spark, tmp_path):
    def write(folder, rows):
        frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        return sorted(r.doc_id or -1 for r in corpus_pipeline.run(spark, folder).select("doc_id", "piece").where("piece = 0").collect())

    assert write(str(tmp_path / "none"), []) == []
    rows = [(None, "one text of its own here"), (None, None), (3, "some other words stand in this one"), (3, "and others here again for the same id"), (4, "")]
    assert write(str(tmp_path / "null"), rows) == [-1, 3, 3, 4]
