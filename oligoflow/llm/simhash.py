"""Near-dedup by 64-bit SimHash fingerprints and pigeonhole blocks.

A fingerprint is cut into four blocks of 16 bits. If two fingerprints differ in at most two bits, at least two of
the four blocks agree, so every linked pair meets under one of the six pairs of blocks (32 bits each). Distinct
fingerprints that share such a key are joined and verified by their Hamming distance. Keys with more than HOT
fingerprints aren't paired up: each of their fingerprints is filed under itself and its 64 one-bit neighbours
instead, where any two that share a file differ in at most two bits and all link to the smallest. Both ways are
exact, so no link is lost and no group's pairs are listed in full.

Cases: null and empty texts have no words and get fingerprint zero, which links like any other; fewer words than a
shingle make one shingle; repeated rows share a fingerprint and so a component; null ids stay in the result but
can't name a component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fingerprints under one block key beyond which its pairs are found by one-bit neighbours.
HOT = 256
BLOCK_BITS = 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of each bit over the XXH64 (seed 42) of all shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(joined[i:j], 42) for i, j in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, np.uint64)
    for part in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(values)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), prints(docs["text"].cast("string")).alias("fp"))


def _blocks(distinct: DataFrame) -> DataFrame:
    """(pair, key, node, fp): six rows for each distinct fingerprint."""
    block = lambda i: F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.struct(F.lit(n).cast("byte").alias("pair"), (F.shiftleft(block(i), 16) + block(j)).alias("key")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return distinct.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("k.pair", "k.key", "node", "fp")


def links(distinct: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between nodes of distinct(node, fp), enough to connect all pairs within max_bits (2 at most)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("four blocks find pairs of at most two differing bits")
    blocks = common.written(_blocks(distinct), "simhash-blocks")
    counts = common.written(blocks.groupBy("pair", "key").count().where("count > 1"), "simhash-counts")
    shared = blocks.join(counts.where(F.col("count") <= hot).drop("count"), ["pair", "key"])
    left = shared.select("pair", "key", F.col("node").alias("a"), F.col("fp").alias("fa"))
    right = shared.select("pair", "key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits
    pairs = left.join(right, ["pair", "key"]).where(F.col("a") < F.col("b")).where(near).select("a", "b")
    crowded = counts.where(F.col("count") > hot).drop("count")
    if crowded.isEmpty():
        return pairs
    some = common.written(blocks.join(crowded, ["pair", "key"], "left_semi").select("node", "fp").distinct(), "simhash-crowded")
    if max_bits < 2:  # files of exact neighbours: a fingerprint meets the other's own file
        masks = [F.lit(0).cast("long")] + [F.lit((1 << i) if i < 63 else -(2**63)).cast("long") for i in range(64 if max_bits else 0)]
        own = some.select(F.col("node").alias("a"), F.col("fp").alias("file"))
        other = some.select(F.col("node").alias("b"), F.explode(F.array(*[F.col("fp").bitwiseXOR(m) for m in masks])).alias("file"))
        return pairs.union(own.join(other, "file").where("a <> b").select("a", "b"))
    masks = [F.lit(0).cast("long")] + [F.lit((1 << i) if i < 63 else -(2**63)).cast("long") for i in range(64)]
    files = some.select("node", "fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(m) for m in masks])).alias("file"))
    least = files.groupBy("file").agg(F.min(F.struct("node", "fp")).alias("low"))
    star = files.join(least, "file").where(F.col("low.node") < F.col("node"))
    star = star.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("low.fp"))) <= max_bits)
    return pairs.union(star.select(F.col("low.node").alias("a"), F.col("node").alias("b")))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable by links."""
    prints = common.written(fingerprints(docs, shingle), "simhash-prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    named = distinct.where("node is not null")
    joined = common.components(links(named, max_bits, hot), "simhash")
    roots = named.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(roots, "fp", "left").select("doc_id", "fp", "component_id")


#: Rows under one shingle beyond which each text is first compared with the hub alone.
CROWD = 8
#: Share of texts (one in SAMPLE) whose shingles are counted to put common ones last, count there from which one is
#: common, and most common ones told to the workers. They decide the order of work only, never what is found.
SAMPLE, COMMON, MOST_COMMON = 4, 3, 1_000_000
#: Pairs compared at once within one shingle's rows, and rows of a shingle beyond which they are dealt over tiles.
PAIRS_AT_ONCE, TILE = 1 << 15, 2048
#: Slots of a sketch, a byte each, and standard errors by which a pair's equal slots may fall short.
SLOTS, ERRORS = 128, 6
FOUND = ["gram", "a", "b", "n", "pos"]


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of shingle words; a shorter text is one run."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w, 42) for w in set(words)}
    hashes = np.array([known[w] for w in words], np.uint64)
    size = min(shingle, len(words))
    with np.errstate(over="ignore"):
        x = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(words) - size + 1 + k]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique(x)


def signature(text: str | None, shingle: int = 5) -> tuple[int, bytes]:
    """(fingerprint of the shingles, the hashes of all distinct shingles)."""
    return fingerprint(text, shingle), shingle_hashes(text, shingle).tobytes()


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two whole shingle sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def sketch(hashes: np.ndarray) -> bytes:
    """SLOTS bytes: for each of as many equal ranges of hashes a byte of the least hash in it, 0 for none."""
    first = np.searchsorted(hashes, np.arange(SLOTS, dtype=np.uint64) * np.uint64(2**64 // SLOTS))
    held = first < np.append(first[1:], len(hashes))
    out = np.zeros(SLOTS, np.uint8)
    out[held] = hashes[first[held]] % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def may_resemble(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sketches in the rows of a and b allow their texts to be similar enough.

    Of the slots that either text fills, a share as large as the similarity is equal on average. A pair is put aside
    only if ERRORS standard errors more are missing, which a pair that is similar enough does once in 10**8 or less.
    """
    filled = ((a | b) > 0).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    return equal >= similarity * filled - ERRORS * np.sqrt(similarity * (1 - similarity) * filled) - 1


def _least(n, share):
    """The smallest whole number that is at least n * share."""
    return np.ceil(n * share - 1e-9).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[dict]:
    """Columns of rows sorted by gram, cut so that no gram's rows are in two pieces."""
    kept: list[dict] = []
    count, enough = 0, rows

    def joined() -> dict:
        return {c: np.concatenate([part[c] for part in kept]) for c in kept[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        count += batch.num_rows
        if count < enough:
            continue
        whole = joined()
        cut = int(np.searchsorted(whole["gram"], whole["gram"][-1]))
        if cut:
            yield {c: v[:cut] for c, v in whole.items()}
        kept, count = [{c: v[cut:] for c, v in whole.items()}], count - cut
        enough = max(rows, 2 * count)
    if kept:
        yield joined()


def _fits(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts i and j, of whose shingles this one is the first in common, can still be similar enough."""
    return np.minimum(n[i] - pos[i], n[j] - pos[j]) >= _least(n[i].astype(np.int64) + n[j], similarity / (1 + similarity))


def near_copies(docs: DataFrame, similarity: float = 0.8, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id): texts joined where their sets of five-word shingles resemble each other enough.

    Candidates are found by the prefix rule, which is exact: with all shingles in one order, the first shingle common
    to texts of n and m <= n shingles and similarity t is among the first n - ceil(t n) + 1 of the one and the first
    m - ceil(2 t / (1 + t) m) + 1 of the other. Shingles of many texts come last in that order, so a shared template
    makes no candidates unless little else is in the texts. Candidates whose sketches rule them out are put aside, the
    others are decided by all their shingles, and only their texts are moved. Under a shingle with more than crowd
    texts each is first compared with the hub, the text that has the fewest rarer shingles; then all that aren't in one
    component yet are compared by sketch, in tiles of bounded size, and only pairs that may be similar leave the task.
    Pairs of fingerprints (of five-word shingles) that differ in two bits at most are candidates as well, decided alike.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t, 5) for t in batch["text"]], np.uint64).view(np.int64)
            grams = [shingle_hashes(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": prints, "sketch": [sketch(g) for g in grams], "digest": [xxhash.xxh3_128_digest(g.tobytes()) for g in grams]})
        common.release()

    texts = docs.where("doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = common.written(texts.mapInPandas(sign, "doc_id long, fp long, sketch binary, digest binary"), "simhash-signed")
    # Texts of the same shingles are alike whatever else; the least of those with one fingerprint stands for it.
    same = signed.groupBy("digest").agg(F.min("doc_id").alias("a")).join(signed.select("digest", F.col("doc_id").alias("b")), "digest").where("a <> b").select("a", "b")
    distinct = common.written(signed.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    sketches = signed.groupBy("doc_id").agg(F.min("sketch").alias("sketch"))

    filed = _prefixes(texts, similarity, _common_shingles(texts))
    met = common.written(_sorted(filed, "gram").mapInArrow(_first_pairs(similarity, crowd), "gram long, a long, b long, n int, pos int"), "simhash-met")
    near = met.select("a", "b").unionByName(links(distinct))
    edges = _verified(_sketched(near, sketches, similarity), texts, similarity, "simhash-first").unionByName(same)
    joined = common.components(edges, "simhash-copies")

    many = met.where("gram is not null").select("gram", F.col("a").alias("doc_id"), "n", "pos")
    placed = many.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / tile).alias("tiles"))
    split = common.written(sizes.where("x <> y").select("gram", "tiles"), "simhash-split")
    rows = placed.join(split, "gram").join(sketches, "doc_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    tiled = rows.select(F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other")).alias("gram"), side.alias("side"), "doc_id", "n", "pos", "component", "sketch")
    rest = _sorted(tiled, "gram").mapInArrow(_other_pairs(similarity), "a long, b long")
    more = _verified(rest.distinct(), texts, similarity, "simhash-more")
    if not more.isEmpty():
        joined = common.components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "simhash-all")
    return signed.select("doc_id").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def _sketched(met: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs of met(a, b) that their sketches don't rule out."""

    @F.pandas_udf("boolean")
    def allowed(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, SLOTS) for v in (x, y))
        return pd.Series(may_resemble(one, two, similarity), dtype=bool)

    pairs = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    of_a = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x"))
    of_b = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(of_a, "a").join(of_b, "b").where(allowed("x", "y")).select("a", "b")


def _common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that many sampled texts have."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"gram": np.concatenate([shingle_hashes(t) for t in batch["text"]]).view(np.int64)})

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInPandas(spread, "gram long").groupBy("gram").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "gram").limit(MOST_COMMON).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], found["count"].to_numpy(np.int64)[order]


def _prefixes(texts: DataFrame, similarity: float, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, doc_id, n, pos): the first shingles of each text, their number and places in the common order."""
    sent = texts.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, counts = sent.value
        for batch in batches:
            parts = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                grams = shingle_hashes(text)
                n = len(grams)
                if not n:
                    continue
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
                    grams = grams[np.argsort(np.where(hashes[at] == grams, counts[at], 0), kind="stable")]
                size = n - int(_least(n, similarity)) + 1
                parts.append((grams[:size].view(np.int64), np.full(size, doc, np.int64), np.full(size, n, np.int32), np.arange(size, dtype=np.int32)))
            if parts:
                yield pd.DataFrame(dict(zip(("gram", "doc_id", "n", "pos"), map(np.concatenate, zip(*parts)))))
        common.release()

    return texts.mapInPandas(prefixes, "gram long, doc_id long, n int, pos int")


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def _starts(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, rows) of each gram."""
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return starts, np.diff(np.r_[starts, len(gram)])


def _first_pairs(similarity: float, crowd: int):
    """Of rows sorted by gram: all pairs of small groups (gram null), and each row of the others beside its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            gram, doc, n, pos = (rows[c] for c in ("gram", "doc_id", "n", "pos"))
            starts, sizes = _starts(gram)
            size, index = np.repeat(sizes, sizes), np.arange(len(gram))
            ends = []
            for step in range(1, crowd):  # rows that are step places apart within a small group
                i = index[: max(0, len(gram) - step)]
                i = i[(gram[i] == gram[i + step]) & (size[i] <= crowd)]
                i = i[_fits(n, pos, i, i + step, similarity)]
                ends.append(np.column_stack([np.minimum(doc[i], doc[i + step]), np.maximum(doc[i], doc[i + step])]))
            pairs = np.unique(np.concatenate(ends), axis=0) if ends else np.zeros((0, 2), np.int64)
            blank = pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), blank, blank], FOUND)
            # A pair's first common shingle is among the shorter prefix of one: others' groups need no comparison.
            leads = np.logical_or.reduceat(n - pos >= _least(n, 2 * similarity / (1 + similarity)), starts)
            hub = np.lexsort((doc, pos / n, np.repeat(starts, sizes)))[starts]
            use = np.repeat((sizes > crowd) & leads, sizes)
            beside = np.repeat(doc[hub], sizes)
            yield pa.RecordBatch.from_arrays([pa.array(v[use]) for v in (gram, doc, beside, n, pos)], FOUND)

    return run


def _other_pairs(similarity: float):
    """Of tiles' rows sorted by gram: the pairs of texts in different components that may be similar enough.

    Texts of side 0 are compared with each other, those of side 1 with those of side 2. At least one of a pair isn't in
    the component that has most texts there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _groups(batches):
            for low, size in zip(*_starts(every["gram"])):
                side, doc, n, pos, own, made = (every[c][low : low + size] for c in ("side", "doc_id", "n", "pos", "component", "sketch"))
                made = np.frombuffer(b"".join(made), np.uint8).reshape(-1, SLOTS)
                names, members = np.unique(own, return_counts=True)
                outside = np.flatnonzero(own != names[np.argmax(members)])
                at_once = max(1, PAIRS_AT_ONCE // len(doc))
                for part in range(0, len(outside), at_once):
                    some = outside[part : part + at_once]
                    i, j = np.repeat(some, len(doc)), np.tile(np.arange(len(doc)), len(some))
                    use = np.flatnonzero((own[i] != own[j]) & ((side[i] + side[j] == 0) | (side[i] + side[j] == 3)))
                    use = use[_fits(n, pos, i[use], j[use], similarity)]
                    use = use[may_resemble(made[i[use]], made[j[use]], similarity)]
                    pairs = np.unique(np.column_stack([np.minimum(doc[i[use]], doc[j[use]]), np.maximum(doc[i[use]], doc[j[use]])]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, label: str) -> DataFrame:
    """Those of distinct pairs(a, b) whose texts' shingle sets are similar enough; only texts in pairs are moved."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resemblance(signature_of(x), signature_of(y)) for x, y in zip(a, b)], dtype=float)

    def signature_of(text):
        return shingle_hashes(text).tobytes()

    some = common.written(pairs, f"{label}-pairs")
    ids = some.select(F.col("a").alias("doc_id")).union(some.select("b")).distinct()
    ids = F.broadcast(ids) if ids.count() <= common.BROADCAST_IDS else ids
    used = texts.join(ids, "doc_id", "left_semi")
    of_a = used.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    of_b = used.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return common.written(some.join(of_a, "a").join(of_b, "b").where(alike("x", "y") >= similarity - 1e-12).select("a", "b"), label)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, the one with the smallest doc_id; all columns kept.

    Rows without doc_id stay; rows that share a doc_id stay or go together.
    """
    found = common.written(near_copies(docs), "simhash-found")
    return common.without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
