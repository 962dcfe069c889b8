"""Licence scan, decontamination and chat formatting against brute force."""

import hashlib
import random
import re

import pytest

from oligoflow.llm import chat, decontaminate, license_scan

DOCS = "doc_id long, text string, lang string, score double, spans string, Labels string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1.0, None, "x") for i, t in rows], DOCS)


def test_license_scan_equals_brute_force(spark):
    texts = [
        None, "", "--- !!", "under the MIT License", "Released under the MIT Licence.", "Apache License, Version 2.0; apache license version 2",
        "CC BY-NC 4.0 and cc-by-nc", "under the mit license under the mit license", "ÜNDER the mit license", "all rihgts reserved", "All rights, rights reserved",
        "Licensed under the Apche Licnse, Version 2.0", "x " * 40_000 + "cc by nc", "nothing to see here at all",
    ]
    docs = frame(spark, enumerate(texts))
    got = {r.doc_id: r for r in docs.select("doc_id", license_scan.scan_column(docs).alias("s")).select("doc_id", "s.*").collect()}
    for i, text in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert got[4].labels == "mit" and got[4].base_labels == ""
    assert got[9].labels == "proprietary" and 0.8 < got[9].score < 1
    assert got[11].labels == "apache-2" and got[8].labels in ("", "mit")
    assert license_scan.scan("This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl-3"
    assert license_scan.scan("Licensed under CC BY 4.0.")["labels"] == "cc-by"
    assert got[13].labels == "" and got[13].score == 0
    empty = frame(spark, [])
    assert empty.select(license_scan.scan_column(empty).alias("s")).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_spans_find_every_planted_notice():
    rng = random.Random(2)
    for notice in license_scan.NOTICES:
        rivals = [n for n in license_scan.NOTICES if n != notice and edit_distance(n, notice) <= 2 * license_scan.MOST_EDITS]
        for _ in range(20):
            damaged = list(notice)
            firm = [w in license_scan.decisive([w]) for w in notice.split() for _ in f"{w} "]  # clauses and versions stay
            for _ in range(rng.randint(0, license_scan.edits(notice))):
                at = rng.randrange(1, len(damaged) - 1)
                if damaged[at] != " " and not firm[at]:
                    damaged[at] = rng.choice("abcdefghij")
            text = f" foo {''.join(damaged)} bar "
            found = [s for s in license_scan.fuzzy_spans(text) if s[0] == notice]
            assert found or any(s[0] in rivals for s in license_scan.fuzzy_spans(text))
            for _, a, b, wrong in found:
                assert edit_distance(text[a:b], notice) <= wrong <= license_scan.edits(notice)


def brute_tiles(item, text, least):
    used_i, used_t, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] >= 0 and i + n not in used_i and j + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        used_i |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        covered += n


@pytest.mark.parametrize("letters", [3, 40])
def test_tiles_cover_what_brute_force_covers(letters):
    rng = random.Random(letters)
    for _ in range(40):
        item = [rng.randrange(letters) for _ in range(rng.randint(5, 40))]
        parts = [item[i : i + 8] for i in range(0, len(item), 8)]
        rng.shuffle(parts)
        text = [w for p in parts for w in [*p, -1]]
        found = decontaminate.tiles(item, text)
        places_i = [k for s, _, n in found for k in range(s, s + n)]
        places_t = [k for _, s, n in found for k in range(s, s + n)]
        assert len(set(places_i)) == len(places_i) and len(set(places_t)) == len(places_t)
        assert all(item[s : s + n] == text[t : t + n] and n >= 5 for s, t, n in found)
        if letters == 40:
            assert sum(n for *_, n in found) == brute_tiles(item, text, 5)


def test_leaks_find_whole_partial_and_reordered_passages(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(20, 50)))) for k in range(12)] + [(50, None), (51, "too short"), (0, None)]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(100 + k, noise(200)) for k in range(30)] + [(1, None), (2, "")]
    for k in range(12):
        parts = items[k][1].split()
        half = len(parts) // 2
        rows += [(200 + k, f"{noise(30)} {items[k][1].upper()} {noise(30)}"), (300 + k, f"{noise(9)} {' '.join(parts[half:])} {noise(5)} {' '.join(parts[:half])}")]
        rows += [(400 + k, f"{noise(20)} {' '.join(parts[: len(parts) // 4])} {noise(20)}")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = {(200 + k, k) for k in range(12)} | {(300 + k, k) for k in range(12)}
    got = decontaminate.leaks(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.9 <= r.coverage <= 1 for r in got)
    kept = decontaminate.without_leaks(frame(spark, rows), bench)
    assert kept.columns == ["doc_id", "text", "lang", "score", "spans", "Labels"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(frame(spark, rows), bench.limit(0)).count() == len(rows)


def test_leaks_by_every_pair(spark, monkeypatch):
    """Items that all begin alike, damaged copies about half covered, and a filter too small to keep anything out."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    lead = "which of the following is the right answer".split()
    items = [(k, " ".join(lead + rng.choices(words, k=rng.randint(4, 40)))) for k in range(25)]
    rows = []
    for d in range(60):
        text = rng.choices(words, k=30)
        for k in rng.sample(range(25), 3):
            parts = items[k][1].split()
            cut = sorted(rng.sample(range(len(parts) + 1), 2))
            text += parts[cut[0] : cut[1]] + rng.choices(words, k=3) + parts[: rng.randint(0, len(parts))]
        rows.append((d, " ".join(text)))
    rows.append((100, " ".join(lead * 3)))
    want = {}
    for d, text in rows:
        for k, item in items:
            found = decontaminate.compare(text, item)
            if found[0] >= decontaminate.COVERAGE:
                want[d, k] = found
    assert 40 < len(want) < 1000
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bits in (1 << 27, 64):
        monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
        got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles, r.n_words) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
        assert got == want
    words_of = lambda t: decontaminate.words(t)
    for (d, k), (coverage, _, n) in list(want.items())[:15]:
        item = words_of(items[k][1])
        number = {w: i for i, w in enumerate(dict.fromkeys(item))}
        least = brute_tiles([number[w] for w in item], [number.get(w, -1) for w in words_of(dict(rows)[d])], 5)
        assert abs(least - n) <= 5 and abs(coverage - n / len(item)) < 1e-12


def test_repeated_notices_and_words_take_linear_time():
    import time

    began = time.time()
    found = license_scan.scan("released under the mit license " * 16_000)
    assert found["n_base"] == len(found["spans"]) == 16_000 and time.time() - began < 20
    spans = license_scan.fuzzy_spans(" all rihts reserved all rights reserved x ")
    assert [(s[1], s[3]) for s in spans] == [(1, 1), (20, 0)]


def test_near_misses_take_linear_time():
    import time

    for notice, times in (("all rights reserve ", 16_000), ("released under the mit licens ", 8_000), ("all rights ", 50_000)):
        began = time.time()
        found = license_scan.scan(notice * times)
        assert len(found["spans"]) == (times if "rights " != notice[-7:] else 0) and time.time() - began < 20


def test_clauses_and_versions_stand_exactly():
    none = ["Licensed under CC BY-ND 4.0", "licensed under CC BY NC ND 4.0 terms", "Licensed under the Apache License, Version 1.1", "licensed under the GNU General Public License version 1", "Mozilla Public License, version 1.1", "licensed under cc by 3.0"]
    for text in none:
        assert set(license_scan.scan(text)["labels"].split(",")) <= ({"", "cc-by-nc"} if "BY NC" in text else {""}), text
    some = {"licenced under CC-BY-SA 4.0": "cc-by-sa", "Lisensed under the Apache Licence, Version 2.0": "apache-2", "licensed under the gnu genral public license version 3": "gpl-3", "under the Mozila Public License, Version 2.0": "mpl-2", "licensd under cc by 4.0": "cc-by", "permission is hereby granted, free of charge to any persons obtaining copy": "mit"}
    for text, label in some.items():
        assert license_scan.scan(text)["labels"] == label, text


def test_broken_runs_are_tiled_quickly():
    """An item of one word against many runs of that word, and against one long run; and the same tiles as by brute force."""
    import time

    began = time.time()
    assert decontaminate.compare(" x ".join([" ".join(["la"] * 60)] * 200), " ".join(["la"] * 400)) == (1.0, 7, 400)
    assert decontaminate.compare(" ".join(f"{'a b ' * 30}z{i}" for i in range(200)), "a b " * 200) == (1.0, 7, 400)
    assert time.time() - began < 10


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "a\\b\\h####</turn</turn>", ":\n:\n", "", None, "## ", "\\", "</turn>" * 3, "naïve 🙂 text", "x" * 200_000]
    rows = []
    for k, text in enumerate(hard):
        rows += [(k, 0, "user", text, 1), (k, 1, "assistant", hard[-1 - k], 1)]
    rows += [(50, 1, "assistant", "b", 0), (50, 0, "user", "a", 0), (50, 1, "assistant", "b", 0), (51, 0, None, "x", 0), (51, None, "we:\nird", "y", 0), (None, 0, "user", "q", 0)]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments int")
    done = chat.read_back(chat.format_conversations(frame_))
    got = {r.conv_id: r for r in done.collect()}
    digest = {r.conv_id: r for r in chat.digests(done).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        turns = [(role, text) for _, role, text in mine]
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].loss_text == loss
        d = digest[conv]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[0].valid, got[0].first_bad) == (True, None)
    assert (got[50].valid, got[50].first_bad) == (False, 2)
    assert (got[51].valid, got[51].first_bad) == (False, 0)
    assert (got[None].valid, got[None].first_bad) == (False, None)
    plan = chat.digests(done)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert chat.format_conversations(frame_.limit(0)).count() == 0
