"""Classifiers: held-out accuracy on planted data, and the defined edge cases."""

import random

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import functions as F

from oligoflow.llm import langid, learn, quality, toxicity

DOCS = "doc_id long, text string, lang string, score double, toxic_score string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "s") for r in rows], DOCS)


def prose(rng, n, bad=False):
    words = ["river", "stone", "light", "winter", "carries", "under", "the", "and", "of", "green"]
    return " ".join(rng.choice(words) + ("%%%" if bad else "") for _ in range(n))


def test_toxicity_learns_pairs_and_stems(spark):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        kind = i % 4
        words = prose(rng, 40).split()
        if kind == 0:
            words.insert(rng.randrange(40), "vermin" + rng.choice(["", "ous", "like"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(kind == 0)))
    rows += [(900, None, None), (901, "", None), (902, "calm " * 50_000, None), (903, "VERMIN!", None)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, marks, F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(docs, model).alias("s")).collect()}
    assert all((got[i] >= toxicity.REJECT) == (i % 4 == 0) for i in range(600))
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert got[903] >= toxicity.REJECT > got[902]
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4} | {900, 901, 902}


def hashed(sample):
    return sample.assign(terms=[toxicity.hashed(t) for t in sample.text])


def test_factorization_machine_finds_an_interaction():
    """Two words that tell nothing alone: only together, or only apart, do they mark a text."""
    rng = random.Random(1)
    for rule, marked, clean in ((lambda a, b: a == b, ("alpha beta", ""), ("alpha", "beta")), (lambda a, b: a and b, ("alpha beta",), ("alpha", "beta", ""))):
        pairs = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(1600)]
        sample = pd.DataFrame([(prose(rng, 6) + " alpha" * a + " beta" * b, int(rule(a, b))) for a, b in pairs], columns=["text", "y"])
        scorer = toxicity.Scorer(toxicity.train(hashed(sample), sample.y.mean(), epochs=60))
        assert scorer.scores(list(marked)).min() > 0.5 > scorer.scores(list(clean)).max()


def test_scores_by_the_definition():
    """A score from first principles: intercept, a weight for each term, and a product for each pair of terms."""
    rng = random.Random(4)
    rows = [(prose(rng, 30) + (" vermin horde" if i % 3 == 0 else " vermin" if i % 3 == 1 else ""), int(i % 3 == 0)) for i in range(400)]
    model = toxicity.train(hashed(pd.DataFrame(rows, columns=["text", "y"])), 0.3)
    place = {int(t): i for i, t in enumerate(model["terms"])}
    texts = [t for t, _ in rows[:20]] + ["", None, "Vermin, VERMIN! horde", "unseen words"]
    for text, got in zip(texts, toxicity.Scorer(model).scores(texts)):
        ids = [place[h] for h in sorted(toxicity.terms(text)) if h in place]
        z = model["w0"] + sum(model["w"][i] for i in ids)
        for x, i in enumerate(ids):
            z += sum(float(model["v"][i] @ model["v"][j]) for j in ids[:x])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
    plain = toxicity.raw({**model, "v": model["v"] * 0}, np.array(ids, np.int64), np.array([0, len(ids)]))
    assert np.isfinite(plain).all()


def test_quality_scores_by_the_definition():
    """Sizes under both dictionaries, block by block, their difference a byte, and the curve."""
    rng = random.Random(6)
    sample = pd.DataFrame([(prose(rng, 120, bad=i % 2 == 0), i % 2) for i in range(300)], columns=["text", "y"])
    sample["y"] = [0 if "%" in t else 1 for t in sample.text]
    sample = sample.sample(frac=1, random_state=1).reset_index(drop=True)
    model = quality.train(sample, 0.5)
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False, "level": quality.LEVEL}
    texts = [sample.text[0], sample.text[1], "x" * 5000, "", None]
    slope, base = model["curve"]
    for text, got in zip(texts, quality.score_texts(model, quality.Compressors(model["good"], model["bad"]), texts)):
        data, sizes = (text or "").encode(), []
        for words in (model["good"], model["bad"]):
            compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), **options).compress
            sizes.append(sum(len(compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)))
        x = (sizes[1] - sizes[0]) / len(data) if data else 0.0
        assert abs(got - 1 / (1 + np.exp(-(slope * x + base)))) < 1e-9


def test_language_votes_by_the_definition():
    """Family by the largest margin, language by the votes of its machines; features counted one trigram at a time."""
    rng = random.Random(7)
    stock = {"en": "the of and with that".split(), "de": "der und nicht über".split(), "nl": "het een niet van".split(), "fr": "le et avec cette".split(), "es": "el y con niño".split()}
    sample = pd.DataFrame([(" ".join(rng.choices(w, k=20)), lang) for lang, w in stock.items() for _ in range(30)], columns=["text", "y"])
    model = langid.train(sample)
    for text in [*sample.text[::17], "niño Über", "a"]:
        data = f" {' '.join(text.lower().split())} ".encode()
        counts = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(data, data[1:], data[2:]):
            h = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b * 0x85EBCA77 & 0xFFFFFFFF) ^ (c * 0xC2B2AE3D & 0xFFFFFFFF)
            counts[(h ^ h >> 15) % langid.DIMENSIONS] += 1
        x = np.append(np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), 1)
        family = max(model["families"], key=lambda f: model["rest"][f] @ x)
        votes = dict.fromkeys(model["members"][family], 0)
        for (a, b), w in model["pairs"].items():
            if a in votes:
                votes[a if w @ x >= 0 else b] += 1
        top = [v for v, n in votes.items() if n == max(votes.values())]
        assert langid.predict(model, text)[0] in top


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than rows of each would fit: fewer rows of each are taken, no language is left out."""
    monkeypatch.setattr(langid, "SAMPLE", 240)
    rng = random.Random(9)
    rows = []
    for k in range(80):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(100 * k + i, " ".join("".join(rng.choices(letters, k=3)) for _ in range(12)), f"l{k:02}") for i in range(4)]
    docs = frame(spark, [*rows, (9000, None, "l00"), (9001, None, "nope")])
    model = langid.fit(docs, F.lit(True))
    assert len(model["families"]) == 80 and "nope" not in model["members"]
    got = {r.doc_id: r.f.lang for r in docs.select("doc_id", langid.identify(docs, model).alias("f")).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.95


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b", None), (2, None, None)])
    model = toxicity.fit(docs, spark.createDataFrame([], LABELS), F.lit(True))
    assert all(r.s < 0.3 for r in docs.select(toxicity.score(docs, model).alias("s")).collect())
    assert toxicity.without_toxic(frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_quality_separates_held_out_rows(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 150, bad=i % 3 == 0), "en") for i in range(400)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(400)] + [(9999, 1, 0), (None, None, 1)]
    rows += [(900, None, None), (901, "", None), (902, "stone river " * 20_000, None)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.score(docs, model).alias("s")).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in range(0, 400, 5)]) > 0.98
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    few = quality.fit(docs, marks.limit(3), F.lit(True))
    assert "good" not in few
    assert {r.s for r in docs.select(quality.score(docs, few).alias("s")).collect()} == {few["share"]}


def test_language_hierarchy(spark):
    rng = random.Random(3)
    stock = {
        "en": "the of and with that this which house water other thought".split(),
        "de": "der und nicht schön über wird haus wasser andere gedanke".split(),
        "fr": "le et avec cette maison pensée où être autre l'eau".split(),
        "es": "el y con esta casa pensamiento otro agua ñandú niño".split(),
        "xx": "zqk kqz qqz zkk kzq qkz".split(),
    }
    rows = []
    for i in range(500):
        lang = list(stock)[i % 5]
        rows.append((i, " ".join(rng.choices(stock[lang], k=30)), lang))
    rows += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (903, "der und " * 30_000, None)]
    docs = frame(spark, rows)
    model = langid.fit(docs, F.col("doc_id") % 3 != 1)
    assert model["members"]["germanic"] == ["de", "en"] and ("es", "fr") in model["pairs"] and model["members"]["xx"] == ["xx"]
    got = {r.doc_id: r.f for r in docs.select("doc_id", langid.identify(docs, model).alias("f")).collect()}
    assert np.mean([got[i].lang == list(stock)[i % 5] for i in range(1, 500, 3)]) > 0.98
    assert [got[i].lang for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(0 <= f.score <= 1 for f in got.values())
    none = langid.fit(docs, F.lit(False))
    assert {r.f.lang for r in docs.select(langid.identify(docs, none).alias("f")).collect()} == {"und"}
    one = langid.fit(docs, F.col("lang") == "fr")
    assert got[903].lang == "de" and docs.where("doc_id = 903").select(langid.identify(docs, one).alias("f")).first().f.lang == "fr"
