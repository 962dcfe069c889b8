"""Token links against whole-text encoding and links written out one by one."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest

from oligoflow.llm import token_links
from oligoflow.llm.queries import op13_token_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, n_a long, block string"
ODD = ["", None, " ", " a", "a ", "a  b", "x", "It's don't", "a\n b", "a\nb c.\nD", "\na", "a▁b", "<|endoftext|> x <s> </s> <unk> <0x41>", "日本 語。", "🙂 🙂🙂.", "é́ x ﬁ ½", "c,, d.,\n\nB", "tab\there", "nul\x00 x", "a b 　", "8%%% 12,5.", "<s>"]


@pytest.fixture(scope="module")
def pair():
    return token_links.Pair(A, B)


def by_hand(pair, rows):
    """RESULT by definition; whole texts are encoded in one call."""
    found, held = [], defaultdict(set)
    for n, (doc, text) in enumerate(rows):
        ids_a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = pair.b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[i] for i in ids_a) != want or b"".join(pair.bytes_b[i] for i in ids_b) != want:
            ids_a, ids_b = [], []
        ends_a = list(accumulate(len(pair.bytes_a[i]) for i in ids_a))
        ends_b = list(accumulate(len(pair.bytes_b[i]) for i in ids_b))
        groups = [([], []) for _ in set(ends_a) & set(ends_b)]
        cuts = sorted(set(ends_a) & set(ends_b))
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            for i, e in zip(ids, ends):
                groups[next(k for k, c in enumerate(cuts) if e <= c)][side].append(i)
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        for link in links:
            held[link].add(n)
        text_of = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        found.append((doc, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if ids_a else ""))
    count = {k: len(v) for k, v in held.items()}
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return Counter((d, a, b, g, len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), sha) for d, a, b, g, links, sha in found)


def sample():
    rng = random.Random(3)
    rows = list(enumerate(ODD))
    rows += [(50 + i, "".join(rng.choice(["the", " of", " a", "\n", "ing", " é", ".", " Straße", "'s", " 12", "ê", " "]) for _ in range(rng.choice([2, 9, 60])))) for i in range(40)]
    rows += [(200 + i, " ".join("".join(rng.choices("abcéèÉT.,'1", k=rng.randint(1, 9))) for _ in range(rng.choice([1, 5, 40, 150])))) for i in range(40)]
    return rows + [(900, "same words here"), (901, "same words here"), (901, "same words here"), (None, "same words there"), (902, "b" * 3000), (903, "ab" * 700 + " x")]


@pytest.mark.parametrize(("most_sent", "block_bytes"), [(1 << 20, 8 << 20), (5, 300), (0, 2000)])
def test_links_by_definition(spark, pair, most_sent, block_bytes):
    rows = sample()
    docs = spark.createDataFrame([(d, t, "en", 7, "x") for d, t in rows], DOCS)
    got = Counter(tuple(r) for r in token_links.token_links(docs, A, B, most_sent, block_bytes).collect())
    assert got == by_hand(pair, rows)


def test_wide_groups_are_counted_by_distinct_ids(pair, monkeypatch):
    texts = [t for _, t in sample()]
    plain = token_links._block(token_links.Aligned(pair), texts)
    monkeypatch.setattr(token_links, "WIDE", 1)
    wide = token_links._block(token_links.Aligned(pair), texts)
    assert np.array_equal(plain[0], wide[0]) and np.array_equal(plain[1], wide[1])
    value = plain[1] * 2 + (np.arange(len(plain[1])) % 3 == 0)
    for x, y in zip(token_links._finish(plain[2], value), token_links._finish(wide[2], value)):
        assert np.array_equal(x, y)


def test_terminals_of_long_chains():
    # Ends that alternate and meet at the last byte alone make one component, found in a few doublings.
    a, b = np.append(np.arange(1, 20001, 2), 20001), np.append(np.arange(2, 20001, 2), 20001)
    to_a, to_b = token_links.terminals(a, b)
    assert set(to_a) == set(to_b) == {len(a) - 1}
    same = np.arange(1, 50)
    to_a, to_b = token_links.terminals(same, same)
    assert np.array_equal(to_a, np.arange(49)) and np.array_equal(to_a, to_b)


def test_no_rows_and_registered_query(spark, pair):
    assert token_links.token_links(spark.createDataFrame([], DOCS), A, B).collect() == []
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in op13_token_links(spark, sf).collect()) == by_hand(pair, rows)
