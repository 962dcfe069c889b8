"""Exact dedup by a minimal perfect hash over the distinct digests of an earlier delivery.

The index splits the digest space evenly into buckets. Each bucket row holds a levelled minimal perfect hash
(bit arrays whose set bits, ranked, number the slots) and, per slot, the full digest, the winner's locator
(doc_id, row id) and the group's size. A lookup computes the slot and compares all 32 bytes of the digest there:
equal means a repeat of historical text, unequal means the text is new, and new texts are grouped among themselves.

Cases: null text counts as empty, so null and empty texts are equal; a null doc_id is smaller than any other;
of rows that share doc_id and text one stays; an empty history or delivery gives the other side's groups; the
length of a text doesn't matter, as only digests are moved; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct digests in one index bucket, about.
BUCKET_KEYS = 8_000
#: Bits per key in one level of the hash.
GAMMA = 2.0
INDEX = "bucket int, n long, levels array<int>, bits binary, slots binary, win_doc array<long>, win_row array<long>, sizes array<long>"


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view("<u8").reshape(len(digests), 4)


def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in a level: the digest's own words, remixed for every level."""
    with np.errstate(over="ignore"):
        x = words[:, 1] + np.uint64(level) * (words[:, 2] | np.uint64(1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, all levels' bits, slot of each key) for distinct 32-byte keys given as an (n, 32) uint8 array."""
    words, left, levels, parts = _words(np.ascontiguousarray(digests)), np.arange(len(digests)), [], []
    spots: list[tuple[np.ndarray, np.ndarray]] = []
    base = 0
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        spot = _spot(words[left], len(levels), size)
        alone = np.bincount(spot, minlength=size) == 1
        mine = alone[spot]
        spots.append((left[mine], base + spot[mine]))
        levels.append(size)
        parts.append(alone)
        left, base = left[~mine], base + size
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    bits = np.concatenate(parts) if parts else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    slot = np.empty(len(digests), np.int64)
    for keys, at in spots:
        slot[keys] = rank[at]
    return levels, bits, slot


def lookup(digests: np.ndarray, levels: list[int], bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Slot whose stored digest equals the key byte for byte, else -1."""
    out = np.full(len(digests), -1, np.int64)
    if not len(digests) or not len(slots):
        return out
    words, left, base, rank = _words(np.ascontiguousarray(digests)), np.arange(len(digests)), 0, np.cumsum(bits) - 1
    for level, size in enumerate(levels):
        at = base + _spot(words[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    seen = np.flatnonzero(out >= 0)
    same = (slots[out[seen]] == digests[seen]).all(axis=1)
    out[seen[~same]] = -1
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(group.digest)
    levels, bits, slot = build_hash(digests)
    order = np.argsort(slot)
    take = lambda c: group[c].to_numpy()[order].tolist()
    row = [int(group.bucket.iloc[0]), len(group), levels, np.packbits(bits).tobytes(), digests[order].tobytes(), take("win_doc"), take("win_row"), take("size")]
    return pd.DataFrame([row], columns=["bucket", "n", "levels", "bits", "slots", "win_doc", "win_row", "sizes"])


def _find(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    slot = np.full(len(new), -1, np.int64)
    win = np.zeros((3, len(new)), np.int64)
    if len(index) and len(new):
        row = index.iloc[0]
        total = int(sum(row.levels))
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), count=total).astype(bool)
        slot = lookup(_matrix(new.digest), list(row.levels), bits, np.frombuffer(row.slots, np.uint8).reshape(-1, 32))
        win = np.array([np.asarray(row[c], np.int64)[slot] for c in ("win_doc", "win_row", "sizes")]) * (slot >= 0)
    return pd.DataFrame({"digest": new.digest, "doc": new.win_doc, "row": new.win_row, "size": new["size"], "member": slot >= 0, "old_doc": win[0], "old_row": win[1], "old_size": win[2]})


#: doc_id that stands for null in comparisons; a real row with this id counts as null.
NULL_ID = -(2**63)


def digests(docs: DataFrame, delivery: str) -> DataFrame:
    text = common.ascii_lower(F.coalesce(docs["text"], F.lit("")))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.lit(delivery).alias("delivery") if delivery else F.when(F.xxhash64(docs["doc_id"]) % 2 == 0, "old").otherwise("new").alias("delivery"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    top = F.max(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("d"), F.col("row_id").alias("r"))).alias("top")
    return rows.groupBy("digest").agg(top, F.count("*").alias("size")).select("digest", F.col("top.d").alias("win_doc"), F.col("top.r").alias("win_row"), "size")


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index over grouped digests(digest, win_doc, win_row, size)."""
    at = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return history.withColumn("bucket", at).groupBy("bucket").applyInPandas(_build, INDEX)


def exact_dedup(rows: DataFrame) -> DataFrame:
    """(row_id, doc_id, digest, keep_id, keep_row, group_size) of every row of a written table of digests()."""
    spark = rows.sparkSession
    history = common.written(_groups(rows.where("delivery = 'old'")), "dedup-history")
    fresh = _groups(rows.where("delivery = 'new'"))
    buckets = max(1, -(-history.count() // BUCKET_KEYS))
    index = common.written(build_index(history, buckets), "dedup-index")
    at = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    schema = "digest binary, doc long, row long, size long, member boolean, old_doc long, old_row long, old_size long"
    found = fresh.withColumn("bucket", at).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(lambda a, b: _find(a, b), schema)
    found = common.written(found, "dedup-found")
    later = F.col("doc") > F.col("old_doc")
    later = later | ((F.col("doc") == F.col("old_doc")) & (F.col("row") > F.col("old_row")))
    fresh_groups = found.select(
        "digest",
        F.when(F.col("member") & ~later, F.col("old_doc")).otherwise(F.col("doc")).alias("win_doc"),
        F.when(F.col("member") & ~later, F.col("old_row")).otherwise(F.col("row")).alias("win_row"),
        (F.col("size") + F.col("old_size")).alias("size"),
        "member",
    )
    members = fresh_groups.where("member").select("digest", F.col("win_doc").alias("m_doc"), F.col("win_row").alias("m_row"), F.col("size").alias("m_size"))
    old_groups = history.join(members, "digest", "left").select(
        "digest", F.coalesce("m_doc", "win_doc").alias("win_doc"), F.coalesce("m_row", "win_row").alias("win_row"), F.coalesce("m_size", "size").alias("size")
    )
    groups = old_groups.unionByName(fresh_groups.where("not member").drop("member"))
    return rows.join(groups, "digest").select(
        "row_id", "doc_id", "digest", F.when(F.col("win_doc") != NULL_ID, F.col("win_doc")).alias("keep_id"), F.col("win_row").alias("keep_row"), F.col("size").alias("group_size")
    )


def group_texts(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With history, its rows are the earlier delivery and docs the new one, and both are returned. Without, documents
    whose id hashes even count as the earlier delivery.
    """
    if history is None:
        rows = common.written(digests(docs, ""), "dedup-digests")
    else:
        one = common.written(digests(history, "old"), "dedup-digests")
        two = common.written(digests(docs, "new").withColumn("row_id", -1 - F.col("row_id")), "dedup-digests")
        rows = one.unionByName(two)
    done = exact_dedup(rows)
    return done.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    verdict = common.written(group_texts(docs), "dedup-verdict")
    lost = common.without_ids(docs, verdict.groupBy("doc_id").agg(F.max("kept").alias("some")).where("not some"))
    # An id can stand on several rows, of equal or of different texts; rare, so settled apart.
    twice = verdict.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return lost
    name = common.free_name(docs, "text_digest")
    key = F.sha2(common.ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    kept = verdict.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    tagged = lost.withColumn(name, key)
    chosen = tagged.join(kept, tagged["doc_id"].eqNullSafe(F.col("kept_id")) & (tagged[name] == F.col("kept_sha")), "left_semi")
    return chosen.dropDuplicates(["doc_id", name]).drop(name)
