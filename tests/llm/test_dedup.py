"""Exact dedup and SimHash against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from oligoflow.llm import common, exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sample_rows():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "été", "ÉTÉ", "delta", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3)))) for i in range(120)]
    return rows + [(500 + i, None) for i in range(3)] + [(600, ""), (601, "HOT text"), *[(700 + i, "hot TEXT") for i in range(60)], (900, "long " * 50_000)]


def test_group_texts_equals_brute_force(spark):
    rows = sample_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.group_texts(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        same = groups[lower(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_history_and_new_delivery(spark):
    old, new = frame(spark, [(9, "a"), (2, "b")]), frame(spark, [(3, "A"), (4, "c"), (5, "C"), (6, "b")])
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.group_texts(new, old).collect()}
    assert got == {9: (9, 2, True), 3: (9, 2, False), 2: (6, 2, False), 6: (6, 2, True), 4: (5, 2, False), 5: (5, 2, True)}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c")]
    got = exact_dedup.group_texts(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == [(-1, -1, 1), (-1, 1, 3), (1, 1, 1), (1, 1, 3), (1, 1, 3)]
    assert sum(r.kept for r in got) == 3
    kept = exact_dedup.drop_repeats(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "kept"]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "c"), (1, "a"), (1, "b")]
    assert exact_dedup.group_texts(frame(spark, [])).count() == 0
    assert exact_dedup.drop_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_minimal_perfect_hash(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(n, 32)
    levels, bits, slot = exact_dedup.build_hash(keys)
    assert sorted(slot) == list(range(n))
    slots = np.empty_like(keys)
    slots[slot] = keys
    assert (exact_dedup.lookup(keys, levels, bits, slots) == slot).all()
    other = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)), np.uint8).reshape(500, 32)
    assert (exact_dedup.lookup(other, levels, bits, slots) == -1).all()


def brute_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows():
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one two"), (5, "Été été \x0b x y")]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(400)] = "zz"
        rows.append((10 + i, " ".join(words)))
    return rows + [(200 + i, " ".join(rng.choices("pqrstuv", k=30))) for i in range(60)]


@pytest.mark.parametrize("hot", [256, 1])
def test_near_duplicates_equal_brute_force(spark, hot):
    rows = near_rows()
    prints = {i: brute_print(t) for i, t in rows}
    want = brute_components(prints)
    got = simhash.near_duplicates(frame(spark, rows), hot=hot).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 50


def test_near_duplicates_edge_tables(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    got = simhash.near_duplicates(frame(spark, [(4, "a b c"), (4, "a b c"), (None, "a b c"), (None, "solo words here")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


@pytest.mark.parametrize("bits", [0, 1])
def test_links_below_two_bits(spark, bits):
    rng = random.Random(bits)
    prints = {i: (1 << 63 | 5) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 2))) for i in range(40)}
    distinct = {p: i for i, p in reversed(prints.items())}
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for p, i in distinct.items()], "node long, fp long")
    for hot in (256, 1):
        pairs = {tuple(sorted(r)) for r in simhash.links(df, bits, hot).collect()}
        assert pairs == {(min(i, j), max(i, j)) for p, i in distinct.items() for q, j in distinct.items() if i != j and bin(p ^ q).count("1") <= bits}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 60)] + [(70, 70), (71, 72), (72, 71)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 60)} | {71: 71, 72: 71}


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(2000)] + [(5000, 5000 + i) for i in range(1, 300)] + [(9001, 9000), (9000, 9001), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long"), max_rounds=20).collect()}
    want = dict.fromkeys(range(2001), 0) | dict.fromkeys(range(5000, 5300), 5000) | {9000: 9000, 9001: 9000}
    assert got == want
