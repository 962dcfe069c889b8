"""Collocations against counts of all phrases, one by one."""

import random
import re
from collections import Counter, defaultdict

import pytest

from oligoflow.llm import phrases

DOCS = "doc_id long, text string, lang string, n long, gram string, score double"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    found, words = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang or "und"] += len(ws)
            for i in range(len(ws)):
                for k in range(1, min(5, len(ws) - i) + 1):
                    found[lang or "und", tuple(ws[i : i + k])] += 1
    return found, words


def by_hand(rows, least, best):
    found, words = counted(rows)
    often = {k: n for k, n in found.items() if n >= least and len(k[1]) > 1}
    inside = set()
    for (lang, p), n in often.items():
        for k in range(2, len(p)):
            inside |= {(lang, p[i : i + k]) for i in range(len(p) - k + 1) if n >= often[lang, p[i : i + k]]}
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if (lang, p) in inside:
            continue
        cuts = [(1000 * a * words[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((score, a, " ".join(p), found[lang, p[:k]], found[lang, p[k:]], words[lang]))
    rows = []
    for lang, some in out.items():
        some.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        rows += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right, n) in enumerate(some[:best])]
    return sorted(rows)


def sample():
    rng = random.Random(5)
    words = ["The", "the", "of", "a", "é", "ÉT", "x1", "we-ll", "a b", "　", "\x1c", "y"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.choice([1, 6, 40]))), rng.choice(["en", "de", None])) for i in range(150)]
    passage = "once upon a midnight dreary while I pondered weak and weary over many a quaint and curious volume"
    rows += [(300 + i, f"{passage} number{i % 4}" if i % 3 else passage + " " + passage, "en") for i in range(30)]
    rows += [(400, None, "en"), (401, "", None), (402, " .,; ", "fr"), (403, "a a a a a a a a a a a a " * 40, "en"), (None, "the of the of", "en"), (404, "same", "xx"), (404, "same", "xx")]
    return rows


@pytest.mark.parametrize(("least", "best", "at_once", "bits"), [(3, 2000, 2_000_000, 32), (8, 7, 50, 32), (2, 50, 500, 1)])
def test_phrases_by_definition(spark, monkeypatch, least, best, at_once, bits):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", at_once)
    monkeypatch.setattr(phrases, "RANKED", 5)
    monkeypatch.setattr(phrases, "BITS_EACH", bits)
    rows = sample()
    docs = spark.createDataFrame([(d, t, g, 1, "g", 0.5) for d, t, g in rows], DOCS).repartition(3)
    assert sorted(tuple(r) for r in phrases.collocations(docs, least, best).collect()) == by_hand(rows, least, best)


def test_shorter_counts_follow_from_edges(spark):
    rows = sample()
    docs = spark.createDataFrame([(d, t, g, 1, "g", 0.5) for d, t, g in rows], DOCS)
    counts, words = phrases.phrase_counts(docs, 1)  # nothing is cut
    want, total = counted(rows)
    for size, found in enumerate(counts, 1):
        assert {(r.lang, tuple(r.gram.split(" "))): r.n for r in found.collect()} == {k: n for k, n in want.items() if len(k[1]) == size}
    assert {r.lang: r.n for r in words.collect()} == {k: n for k, n in total.items() if n}


def test_unary_paths_become_one_row(spark):
    passage = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(passage), "en", 1, "g", 0.5) for i in range(6)] + [(9, " ".join(passage[20:30]) + " z", "en", 1, "g", 0.5)]
    docs = spark.createDataFrame(rows, DOCS)
    found = phrases.edges(docs, phrases.run_filters(docs, 1))
    got = {tuple(r.words): r.n for r in phrases.paths(found).collect()}
    assert got == {tuple(passage[:24]): 6, tuple(passage[20:30]): 7, tuple(passage[26:30] + ["z"]): 1, tuple(passage[26:]): 6}


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
