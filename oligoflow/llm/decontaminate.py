"""Benchmark decontamination by greedy string tiling.

Texts are read as lower-cased words. A document and a benchmark item that share a seed of MIN_TILE words are compared
by tiling: the longest common run of words that no tile holds yet becomes a tile, and so on until no run of MIN_TILE
words is left. Runs are found by running Karp-Rabin hashes, from long search lengths down to MIN_TILE. An item whose
share of tiled words is COVERAGE or more has leaked into the document, in whatever order its parts stand there.

Pairs to compare come from a join on seeds. Documents are read once: a filter of bounded size, made of all seeds of the
benchmark, lets only documents through that may hold one, and these are written with the seeds that they hold. An item
is filed under some of its seeds only. Tiles of at least MIN_TILE words that cover COVERAGE of its n words hold at
least r = ceil(COVERAGE * n / MIN_TILE) of its seeds, so all but r - 1 seeds are enough to meet every document that it
leaked into; those that most items share are left out, so that a common phrase doesn't bring all items together.

Cases: null and empty texts hold no seed; items of fewer than MIN_TILE words can't be told from chance and never match;
repeated rows of one document give one result, documents of one id with other texts each their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_TILE, COVERAGE = 5, 0.5
#: Bits of the seed filter for each seed, the most bits (16 MB) whatever the benchmark's size, and where in a seed the
#: bits of its slots begin.
BITS_EACH, MOST_BITS, SHIFTS = 1024, 1 << 27, (0, 18, 36)
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Seeds:
    """The hashes of all runs of MIN_TILE words of texts; word hashes are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self.known) < REMEMBERED:
            self.known[word] = found
        return found

    def of(self, found: list[str]) -> np.ndarray:
        """One hash for each run, in order."""
        n = len(found) - MIN_TILE + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        get, make = self.known.get, self._word
        ids = np.array([get(w) or make(w) for w in found], np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(MIN_TILE):
                out = (out ^ (out >> np.uint64(29))) * BASE + ids[j : j + n]
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


def tiles(item: list[int], text: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the greedy tiles; a negative word equals none."""
    used_i, used_t = [False] * len(item), [False] * len(text)
    mod, base = (1 << 61) - 1, 1_000_003

    def runs(used: list[bool], seq: list[int], size: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of every window of size free words, rolled on from the one before."""
        top, value, held = pow(base, size - 1, mod), 0, 0
        for at, w in enumerate(seq):
            if used[at] or w < 0:
                value = held = 0
                continue
            if held == size:
                value = (value - (seq[at - size] + 1) * top) % mod
                held -= 1
            value, held = (value * base + w + 1) % mod, held + 1
            if held == size:
                yield at - size + 1, value

    def before(used: list[bool], seq: list[int], at: int) -> int:
        """The free word before a place, -1 if there is none."""
        return seq[at - 1] if at and not used[at - 1] else -1

    def matches(size: int) -> list[tuple[int, int, int]]:
        """For each place of the text the longest run that begins there and nowhere before, the first of equals.

        A pair of places with the same free word before them lies inside a longer run, so it isn't looked at; of the
        others only those are compared word by word that hold a word more than the best so far.
        """
        table: dict[int, dict[int, list[int]]] = defaultdict(dict)
        for at, value in runs(used_i, item, size):
            table[value].setdefault(before(used_i, item, at), []).append(at)
        found = []
        for at, value in runs(used_t, text, size):
            groups = table.get(value)
            if not groups:
                continue
            best, where, word = 0, 0, before(used_t, text, at)
            for lead, starts in groups.items():
                if lead == word >= 0:
                    continue
                for start in starts:
                    more = start + best < len(item) and at + best < len(text) and item[start + best] == text[at + best] >= 0
                    if best and not more and start > where:
                        continue
                    n = 0
                    while start + n < len(item) and at + n < len(text) and item[start + n] == text[at + n] >= 0 and not used_i[start + n] and not used_t[at + n]:
                        n += 1
                    if n > best or (n == best and start < where):
                        best, where = n, start
            if best >= size:
                found.append((where, at, best))
        return found

    out = []
    size = max(least, min(len(item), len(text)))
    while True:
        found = matches(size)
        longest = max((n for *_, n in found), default=0)
        placed = False
        for start, at, n in sorted(found, key=lambda m: (-m[2], m[0], m[1])):
            if n == longest and not any(used_i[start : start + n]) and not any(used_t[at : at + n]):
                used_i[start : start + n] = used_t[at : at + n] = [True] * n
                out.append((start, at, n))
                placed = True
        if placed and longest > least:
            size = max(size, least)
            if matches_left := [m for m in found if m[2] < longest and m[2] >= size]:
                size = max(n for *_, n in matches_left)
                continue
        if placed:
            continue
        if size <= least:
            return out
        size = max(least, size // 2)


def compare(text: str | None, item: str | None) -> tuple[float, int, int]:
    """(share of the item's words that tiles cover, tiles, words tiled) of one document and one item."""
    vocabulary: dict[str, int] = {}
    ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(item)]
    if len(ids) < MIN_TILE:
        return 0.0, 0, 0
    seeds = {tuple(ids[i : i + MIN_TILE]) for i in range(len(ids) - MIN_TILE + 1)}
    read = [vocabulary.get(w, -1) for w in words(text)]
    keep = np.zeros(len(read) + 1, bool)
    at, free = 0, 0  # free: words up to here are known to the item
    for at, w in enumerate(read):
        free = free + 1 if w >= 0 else 0
        if free >= MIN_TILE and tuple(read[at - MIN_TILE + 1 : at + 1]) in seeds:
            keep[at - MIN_TILE + 1 : at + 1] = True
    region: list[int] = []  # only the words that a seed covers; other words end a run
    before = -2
    for i in np.flatnonzero(keep).tolist():
        if i != before + 1:
            region.append(-1)
        region.append(read[i])
        before = i
    found = tiles(ids, region)
    covered = sum(t[2] for t in found)
    return covered / len(ids), len(found), covered


def item_seeds(items: DataFrame, coverage: float) -> DataFrame:
    """(seed, item) under which the items(item, text) are filed: all seeds but the commonest that can be spared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds()
        for batch in batches:
            parts = [(i, seeds.of(w), len(w)) for i, w in ((i, words(t)) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()))]
            counts = [len(h) for _, h, _ in parts]
            hashes = np.concatenate([h for _, h, _ in parts]) if parts else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), *(pa.array(np.repeat(np.array([p[k] for p in parts], np.int64), counts)) for k in (0, 2))], names=["seed", "item", "n"])

    every = common.written(items.mapInArrow(run, "seed long, item long, n long"), "tiling-seeds")
    held = every.distinct().groupBy("seed").agg(F.count("*").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "seed"))  # an item's own seeds
    spare = F.ceil(F.col("n") * coverage / MIN_TILE) - 1
    ranked = every.join(held, "seed").withColumn("rank", rank)
    return common.written(ranked.where(F.col("rank") <= F.col("n") - MIN_TILE + 1 - spare).select("seed", "item").distinct(), "tiling-index")


def seed_filter(index: DataFrame) -> np.ndarray:
    """Bits, as 64-bit words: one is set for each slot of each seed. What comes to the driver has a bound, MOST_BITS."""
    n = index.select("seed").distinct().count()
    bits = min(MOST_BITS, 1 << max(6, (BITS_EACH * max(n, 1) - 1).bit_length()))
    slots = index.select(F.explode(F.array(*[F.shiftrightunsigned("seed", k).bitwiseAND(F.lit(bits - 1)) for k in SHIFTS])).alias("slot"))
    rows = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    found = rows.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def with_seeds(docs: DataFrame, filter_: np.ndarray) -> DataFrame:
    """(doc_id, text, seeds) of docs(doc_id, text) that may hold a seed; seeds are the distinct ones let through."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, bits = Seeds(), sent.value
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            rows, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                hashes = seeds.of(words(text))
                for k in SHIFTS:
                    slot = (hashes >> np.uint64(k)) & mask
                    hashes = hashes[(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0]
                if len(hashes):
                    rows.append(at)
                    found.append(np.unique(hashes).view(np.int64))
            some = batch.take(pa.array(rows, pa.int64()))
            yield some.append_column("seeds", pa.array(found, pa.list_(pa.int64())))
        del seeds
        common.release()

    return docs.mapInArrow(run, "doc_id long, text string, seeds array<long>")


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """(doc_id, text_hash, item_id, coverage, n_tiles, n_words) of every document's text and item that leaked into it."""
    common.small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = common.written(items.withColumn("item", F.monotonically_increasing_id()), "tiling-items")
    index = item_seeds(items.select("item", "text"), coverage)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    held = with_seeds(texts, seed_filter(index)).withColumn("uid", F.monotonically_increasing_id())
    held = common.written(held, "tiling-documents")
    met = held.select("uid", F.explode("seeds").alias("seed")).join(index, "seed").select("uid", "item").distinct()
    pairs = met.join(held.select("uid", "doc_id", "text"), "uid").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")

    @F.pandas_udf("coverage double, n_tiles int, n_words int")
    def tiled(text: pd.Series, item: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(t, i) for t, i in zip(text, item)], columns=["coverage", "n_tiles", "n_words"])

    rows = pairs.select("doc_id", F.xxhash64("text").alias("text_hash"), "item_id", tiled("text", "item_text").alias("t"))
    rows = rows.select("doc_id", "text_hash", "item_id", "t.*").where(F.col("coverage") >= coverage)
    return common.written(rows.distinct(), "tiling-found")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words) of every document and item that leaked into it."""
    return _found(docs, benchmark, coverage).drop("text_hash")


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """docs into which no item leaked, all columns kept."""
    one, two = common.free_name(docs, "leaked_id"), common.free_name(docs, "leaked_hash")
    leaked = _found(docs, benchmark, coverage).select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)).distinct()
    leaked = F.broadcast(leaked) if leaked.count() <= common.BROADCAST_IDS else leaked
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(docs["text"].cast("string")) == F.col(two))
    return docs.join(leaked, same, "left_anti")
