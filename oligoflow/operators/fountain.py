"""Fountain coding: degrees, droplets, Reed-Solomon parity, screening, and decoding by peeling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..functions import dna
from .consensus import hamming
from .order import running, written

WORDS = 8  # payloads of 32 bytes as eight 32-bit numbers
#: Feedback of the 32-bit Galois register that yields droplet seeds, and its start; fixed values.
LFSR_POLYNOMIAL, LFSR_START = 0b100000000000000000000000011000101, 0b001010101


def lfsr(n: int, start: int = LFSR_START) -> Iterator[int]:
    """The register's next n states."""
    state = start
    for _ in range(n):
        state <<= 1
        if state >> 32:
            state ^= LFSR_POLYNOMIAL
        yield state


def _step(state: int) -> int:
    return next(lfsr(1, state))


def lfsr_state(n: int, start: int = LFSR_START) -> int:
    """The register's n-th state (0: the start), by squaring the matrix of its step over GF(2)."""
    columns, state = [_step(1 << i) for i in range(32)], start

    def apply(matrix: list[int], x: int) -> int:
        out = 0
        while x:
            low = x & -x
            out ^= matrix[low.bit_length() - 1]
            x ^= low
        return out

    while n:
        if n & 1:
            state = apply(columns, state)
        columns, n = [apply(columns, c) for c in columns], n >> 1
    return state


def lfsr_states(spark: SparkSession, n: int) -> DataFrame:
    """(i, seed) of the register's states 1 to n; every batch jumps to its first state and runs on from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("i").to_pylist()
            if ids:
                found = [s for s in lfsr(len(ids), lfsr_state(ids[0] - 1))]
                yield pa.record_batch([rows.column("i"), pa.array(found, pa.int64())], names=["i", "seed"])

    return spark.range(1, n + 1).select(F.col("id").alias("i")).mapInArrow(run, "i long, seed long")


def _soliton_shape(k: int, delta: float, c: float) -> tuple[float, int]:
    """(size, place) of the spike."""
    size = c * math.log(k / delta) * math.sqrt(k)
    return size, min(k, max(1, int(k / size)))


def robust_soliton(k: int, delta: float = 0.5, c: float = 0.1) -> np.ndarray:
    """Probability of each degree 1..k (Luby 2002): the ideal distribution plus a spike, normalised."""
    size, spike = _soliton_shape(k, delta, c)
    d = np.arange(1, k + 1, dtype=float)
    ideal = np.r_[1 / k, 1 / (d[1:] * (d[1:] - 1))]
    extra = np.where(d < spike, size / (k * d), 0.0)
    extra[spike - 1] = max(0.0, size * math.log(size / delta) / k)
    return (ideal + extra) / (ideal + extra).sum()


def soliton_table(spark: SparkSession, k: int, delta: float = 0.5, c: float = 0.1) -> DataFrame:
    """(degree, p) of robust_soliton as a table made in Spark."""
    size, spike = _soliton_shape(k, delta, c)
    d = F.col("degree").cast("double")
    extra = F.when(d < spike, F.lit(size) / (k * d)).when(d == spike, F.lit(max(0.0, size * math.log(size / delta) / k))).otherwise(0.0)
    rows = spark.range(1, k + 1).select(F.col("id").alias("degree")).withColumn("m", F.when(d == 1, F.lit(1 / k)).otherwise(1 / (d * (d - 1))) + extra)
    return rows.join(F.broadcast(rows.agg(F.sum("m").alias("_whole"))), F.lit(True)).select("degree", (F.col("m") / F.col("_whole")).alias("p"))  # one row


def degree_bounds(k: int, delta: float = 0.5, c: float = 0.1) -> list[int]:
    """Bounds on [0, 2**31) for looking up a droplet's degree; degrees beyond the table's end have no mass left."""
    bounds = np.floor(np.cumsum(robust_soliton(k, delta, c)) * (dna.M31 + 1)).astype(np.int64)
    end = int(np.searchsorted(bounds, dna.M31 - 1)) + 1
    bounds = bounds[: min(end, k)]
    bounds[-1] = dna.M31 + 1
    return bounds.tolist()


def segment_words(segments: DataFrame) -> DataFrame:
    """segments(seg_idx, payload hex) as seg_idx, w0..w7."""
    return segments.select("seg_idx", *[F.conv(F.substring("payload", 8 * i + 1, 8), 16, 10).cast("long").alias(f"w{i}") for i in range(WORDS)])


def droplet_plan(spark: SparkSession, n: int, k: int, seed: int, delta: float = 0.5, c: float = 0.1, first: int = 0) -> DataFrame:
    """(droplet, degree, seg_ids): degree by table, segments as the first distinct draws."""
    degree = _degree_lookup(dna.mix(F.col("droplet"), 10, seed), degree_bounds(k, delta, c))
    rows = spark.range(first, first + n).select(F.col("id").alias("droplet")).withColumn("degree", degree)
    draws = F.transform(F.sequence(F.lit(0), F.col("degree") * 4 + 15), lambda j: F.pmod(dna.mix_at(F.col("droplet"), j, 11, seed), F.lit(k)).cast("int"))
    rows = rows.withColumn("seg_ids", F.slice(F.array_distinct(draws), F.lit(1), F.col("degree")))
    return rows.withColumn("degree", F.size("seg_ids"))


def _degree_lookup(draw: Column, bounds: list[int]) -> Column:
    """Degree of the first bound above the draw, by binary search."""
    table = np.array(bounds, np.int64)

    @F.pandas_udf(LongType())
    def search(draws: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, draws.to_numpy(np.int64), side="right") + 1)

    return search(draw).cast("int")


def droplets(plan: DataFrame, segments: DataFrame) -> DataFrame:
    """(droplet, degree, seg_ids, payload hex): the XOR of the droplet's segments."""
    parts = plan.select("droplet", "degree", "seg_ids", F.explode("seg_ids").alias("seg_idx")).join(segment_words(segments), "seg_idx")
    summed = parts.groupBy("droplet", "degree", "seg_ids").agg(*[F.bit_xor(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return summed.select("droplet", "degree", "seg_ids", payload().alias("payload"))


def payload(prefix: str = "w") -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f"{prefix}{i}")), 8, "0") for i in range(WORDS)])


def peel(received: DataFrame) -> DataFrame:
    """(seg_idx, payload) solved from received(droplet, seg_ids, payload), until no droplet has a single segment left.

    Each round solves the segments that stand alone in a droplet and takes them out of the other droplets, by XOR and
    from their lists. What is left and what was solved are written, so every round starts from a short lineage.
    """
    spark, words = received.sparkSession, [f"w{i}" for i in range(WORDS)]
    parts = [F.conv(F.substring("payload", 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(words)]
    left = written(received.select("droplet", F.col("seg_ids").cast("array<long>").alias("segs"), *parts), "peel-left")
    solved = spark.createDataFrame([], "seg_idx long, " + ", ".join(f"{w} long" for w in words))
    while True:
        single = left.where(F.size("segs") == 1).withColumn("seg_idx", F.element_at("segs", 1))
        fresh = written(single.groupBy("seg_idx").agg(*[F.min_by(w, "droplet").alias(w) for w in words]), "peel-fresh")
        if fresh.isEmpty():
            return solved.select("seg_idx", payload().alias("payload"))
        solved = solved.unionByName(fresh)
        more = left.where(F.size("segs") > 1)
        hit = more.select("droplet", F.explode("segs").alias("seg_idx")).join(fresh, "seg_idx")
        out = hit.groupBy("droplet").agg(F.collect_list("seg_idx").alias("gone"), *[F.bit_xor(w).alias(f"x{w}") for w in words])
        rest = more.join(out, "droplet", "left")
        segs = F.when(F.col("gone").isNull(), F.col("segs")).otherwise(F.array_except("segs", "gone"))
        left = written(rest.select("droplet", segs.alias("segs"), *[F.col(w).bitwiseXOR(F.coalesce(f"x{w}", F.lit(0).cast("long"))).alias(w) for w in words]).where(F.size("segs") > 0), "peel-left")


def completion(solved: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: segments of truth(seg_idx, payload), those solved, missing and wrong, and whether all are right."""
    rows = truth.select("seg_idx", "payload").join(solved.select("seg_idx", F.col("payload").alias("_got")), "seg_idx", "left")
    found = rows.agg(F.count("*").alias("segments"), F.count("_got").alias("solved"), F.count_if(F.col("_got").isNull()).alias("missing"), F.count_if(F.col("_got") != F.col("payload")).alias("wrong"))
    return found.withColumn("complete", (F.col("missing") == 0) & (F.col("wrong") == 0))


def files(solved: DataFrame, layout: DataFrame) -> DataFrame:
    """(item_id, content, md5) of items whose segments are all solved; layout has seg_idx, item_id, seg and n_bytes.

    An item's bytes stand in one row; items are files of bounded size, and the corpus is never joined to one file.
    """
    rows = layout.join(solved.select("seg_idx", "payload"), "seg_idx", "left")
    joined = rows.groupBy("item_id", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("seg", "payload"))).alias("parts"), F.count_if(F.col("payload").isNull()).alias("_missing"))
    content = F.substring(F.unhex(F.array_join("parts.payload", "")), F.lit(1), F.col("n_bytes").cast("int"))
    return joined.where("_missing = 0").select("item_id", content.alias("content"), F.md5(content).alias("md5"))


def aggressive_decode(received: DataFrame, tries: int, keep: float, seed: int) -> DataFrame:
    """(seg_idx, payload, votes): the commonest result of several peelings, each of a share of the droplets.

    Wrong droplets spoil only the tries that hold them. Each try draws its droplets by number; of equally common
    results the one that sorts first counts.
    """
    found = None
    for k in range(tries):
        some = received.where(dna.mix(F.col("droplet"), 300 + k, seed) < int(keep * (dna.M31 + 1)))
        got = peel(some)
        found = got if found is None else found.unionByName(got)
    votes = found.groupBy("seg_idx", "payload").agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy("seg_idx").orderBy(F.desc("votes"), "payload"))  # one row a try at most
    return votes.withColumn("_rank", first).where("_rank = 1").drop("_rank")


# Reed-Solomon over GF(256), polynomial 0x11d, generator 2.
_EXP, _LOG = [0] * 512, [0] * 256
_x = 1
for _i in range(255):
    _EXP[_i] = _EXP[_i + 255] = _x
    _LOG[_x] = _i
    _x = (_x << 1) ^ (0x11D if _x & 0x80 else 0)


def _mul(a: int, b: int) -> int:
    return _EXP[_LOG[a] + _LOG[b]] if a and b else 0


def _generator(parity: int) -> list[int]:
    poly = [1]
    for i in range(parity):
        poly = [a ^ b for a, b in zip([*poly, 0], [0, *(_mul(p, _EXP[i]) for p in poly)])]
    return poly


def rs_encode(data: bytes, parity: int = 10) -> bytes:
    """data followed by parity bytes."""
    generator, rest = _generator(parity), [*data, *[0] * parity]
    for i in range(len(data)):
        lead = rest[i]
        if lead:
            for j, g in enumerate(generator):
                rest[i + j] ^= _mul(g, lead)
    return data + bytes(rest[len(data) :])


def _value(poly: list[int], x: int) -> int:
    """Horner, highest power first."""
    out = 0
    for p in poly:
        out = _mul(out, x) ^ p
    return out


def rs_decode(block: bytes, parity: int = 10) -> bytes | None:
    """The data of a block with parity // 2 wrong bytes at most, else None (Berlekamp-Massey, Chien, Forney)."""
    syndromes = [_value(list(block), _EXP[i]) for i in range(parity)]
    if not any(syndromes):
        return block[:-parity]
    locator, old, size, gap, last = [1], [1], 0, 1, 1  # lowest power first
    for n, s in enumerate(syndromes):
        delta = s
        for i in range(1, size + 1):
            delta ^= _mul(locator[i] if i < len(locator) else 0, syndromes[n - i])
        if not delta:
            gap += 1
            continue
        factor = _EXP[(_LOG[delta] - _LOG[last]) % 255]
        moved = [0] * gap + [_mul(factor, o) for o in old]
        wide = max(len(locator), len(moved))
        new = [a ^ b for a, b in zip(locator + [0] * (wide - len(locator)), moved + [0] * (wide - len(moved)))]
        if 2 * size <= n:
            old, size, last, gap = locator, n + 1 - size, delta, 1
        else:
            gap += 1
        locator = new
    while locator and not locator[-1]:
        locator.pop()
    if size != len(locator) - 1 or size > parity // 2:
        return None
    places = [i for i in range(len(block)) if _value(locator[::-1], _EXP[(255 - (len(block) - 1 - i)) % 255]) == 0]
    if len(places) != size:
        return None
    product = [0] * parity
    for i, s in enumerate(syndromes):
        for j, o in enumerate(locator):
            if i + j < parity:
                product[i + j] ^= _mul(s, o)
    fixed = bytearray(block)
    for at in places:
        x = len(block) - 1 - at
        inverse = _EXP[(255 - x) % 255]
        slope = 0
        for i in range(1, len(locator), 2):
            slope ^= _mul(locator[i], _EXP[((i - 1) * ((255 - x) % 255)) % 255])
        if not slope:
            return None
        top = _mul(_value(product[::-1], inverse), _EXP[x % 255])
        fixed[at] ^= _EXP[(_LOG[top] - _LOG[slope]) % 255] if top else 0
    if any(_value(list(fixed), _EXP[i]) for i in range(parity)):
        return None
    return bytes(fixed[:-parity])


_EXPS, _LOGS = np.array(_EXP, np.int64), np.array(_LOG, np.int64)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """Products in the field of an array with one number."""
    return np.where(a > 0, _EXPS[_LOGS[a] + _LOG[b]], 0) if b else np.zeros_like(a)


def _tables(blocks: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of bytes) of the blocks of each length."""
    sizes = np.array([-1 if b is None else len(b) for b in blocks])
    for size in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join(bytes(blocks.iloc[i]) for i in at), np.uint8).reshape(len(at), size).astype(np.int64)


@F.pandas_udf(BinaryType())
def rs_append(data: pd.Series) -> pd.Series:
    """data followed by ten parity bytes; the division runs over all blocks of a batch at once."""
    parity, out = 10, [None] * len(data)
    generator = _generator(parity)[1:]
    for at, rows in _tables(data):
        rest = np.zeros((len(rows), parity), np.int64)
        for i in range(rows.shape[1]):
            lead = rest[:, 0] ^ rows[:, i]
            rest = np.concatenate([rest[:, 1:], np.zeros((len(rows), 1), np.int64)], axis=1)
            for j, g in enumerate(generator):
                rest[:, j] ^= _times(lead, g)
        for i, block in zip(at, np.concatenate([rows, rest], axis=1).astype(np.uint8)):
            out[i] = block.tobytes()
    return pd.Series(out, dtype=object)


@F.pandas_udf(BinaryType())
def rs_correct(block: pd.Series) -> pd.Series:
    """The data of blocks with ten parity bytes; only blocks with a syndrome are searched for errors."""
    parity, out = 10, [None] * len(block)
    for at, rows in _tables(block):
        if rows.shape[1] <= parity:
            continue
        wrong = np.zeros(len(rows), bool)
        for i in range(parity):
            value = np.zeros(len(rows), np.int64)
            for k in range(rows.shape[1]):
                value = _times(value, _EXP[i]) ^ rows[:, k]
            wrong |= value != 0
        for i, bad, row in zip(at, wrong, rows.astype(np.uint8)):
            out[i] = rs_decode(row.tobytes(), parity) if bad else row[:-parity].tobytes()
    return pd.Series(out, dtype=object)


#: An odd factor modulo 2**32 and a mask that spread droplet numbers over all seeds, so that small numbers make no runs.
SPREAD, MASK = 0x9E3779B1, 0x5BD1E995


def _spread(number: Column, factor: int) -> Column:
    """number * factor modulo 2**32, in parts that don't overflow."""
    low, high = number.bitwiseAND(F.lit(0xFFFF)) * factor, (F.shiftright(number, 16) * factor).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (low + high).bitwiseAND(F.lit(0xFFFFFFFF))


def droplet_seed(droplet: Column) -> Column:
    """The 32-bit seed that an oligo carries for a droplet number."""
    return _spread(droplet.cast("long"), SPREAD).bitwiseXOR(F.lit(MASK))


def seed_droplet(seed: Column) -> Column:
    """The droplet number of a seed."""
    return _spread(seed.cast("long").bitwiseXOR(F.lit(MASK)), pow(SPREAD, -1, 1 << 32))


def oligos(drops: DataFrame) -> DataFrame:
    """drops plus dna: four bytes of seed, the payload and the parity as bases."""
    head = F.lpad(F.lower(F.hex(droplet_seed(F.col("droplet")))), 8, "0")
    return drops.withColumn("dna", dna.dna_encode(rs_append(F.unhex(F.concat(head, "payload")))))


def parse_oligos(reads: DataFrame, most_distance: int | None = None, screen: tuple[int, float] | None = None) -> DataFrame:
    """(droplet, payload, distance) of reads(line, dna): corrected, and the first line of each droplet alone.

    distance counts the bases in which a read differs from its corrected strand encoded again. Reads with more than
    most_distance, or whose strand fails the screen (longest run, slack of the GC share), are left out.
    """
    data = rs_correct(dna.dna_decode(F.col("dna")))
    rows = reads.select("line", "dna", data.alias("_data")).where("_data is not null")
    rows = rows.withColumn("_again", dna.dna_encode(rs_append("_data"))).withColumn("distance", hamming("dna", "_again"))
    if most_distance is not None:
        rows = rows.where(F.col("distance") <= most_distance)
    if screen:
        rows = rows.where(dna.screen(F.col("_again"), *screen))
    rows = rows.withColumn("_h", F.lower(F.hex("_data")))
    rows = rows.select("line", seed_droplet(F.conv(F.substring("_h", 1, 8), 16, 10)).alias("droplet"), F.substring("_h", 9, 1 << 20).alias("payload"), "distance")
    return rows.groupBy("droplet").agg(F.min_by("payload", "line").alias("payload"), F.min_by("distance", "line").cast("int").alias("distance"))


def encode_file(segments: DataFrame, k: int, seed: int, alpha: float = 0.3, homopolymer: int = 4, gc_slack: float = 0.1, **soliton) -> DataFrame:
    """The first int(k * (1 + alpha)) + 1 oligos, by droplet number, that pass the screen; raises if too few pass."""
    want = wanted(k, alpha)
    spark, made, kept, first = segments.sparkSession, 2 * want, None, 0
    while True:
        plan = droplet_plan(spark, made, k, seed, first=first, **soliton)
        passed = written(oligos(droplets(plan, segments)).where(dna.screen(F.col("dna"), homopolymer, gc_slack)), "oligos")
        kept = passed if kept is None else kept.unionByName(passed)
        found = kept.count()
        if found >= want:
            return running(kept, ["droplet"], ordinal="_place").where(F.col("_place") < want).drop("_place")
        first, made = first + made, 2 * made
        if first > 1000 * want:
            raise RuntimeError(f"only {found} of {first} droplets pass the screen, {want} are wanted")


def wanted(k: int, alpha: float) -> int:
    """Oligos to be made of k segments."""
    return int(k * (1 + alpha)) + 1


def oligo_bases(payload_bytes: int = 32, seed_bytes: int = 4, parity_bytes: int = 10) -> int:
    """Bases of an oligo, four for each byte."""
    return 4 * (payload_bytes + seed_bytes + parity_bytes)


def oligo_names(coded: DataFrame) -> DataFrame:
    """coded(droplet, degree, seg_ids, ...) with the name that its FASTA record has."""
    segs = F.array_join(F.transform("seg_ids", lambda s: s.cast("string")), ",")
    return coded.withColumn("name", F.concat(F.lit("packet "), F.col("droplet").cast("string"), F.lit("_"), F.col("degree").cast("string"), F.lit("_"), segs))


def seed_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("droplet").agg(F.count("*").alias("n"))


def seed_histogram(reads: DataFrame) -> DataFrame:
    """(n, droplets): how many droplets came n times."""
    return seed_counts(reads).groupBy("n").agg(F.count("*").alias("droplets"))
