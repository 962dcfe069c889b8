"""Columns on DNA strings: base orders, byte coding, composition, k-mers, and random numbers by counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base orders, fixed values: channel and statistics, consensus voting, byte coding.
CHANNEL, VOTING, CODING = "ATCG", "ATGC", "ACGT"
M31 = (1 << 31) - 1


def _nibbles(order: str) -> list[tuple[str, str]]:
    return [(f"{n:x}", order[n >> 2] + order[n & 3]) for n in range(16)]


def dna_encode(data: Column, order: str = CODING) -> Column:
    """Four bases for each byte."""
    text = F.lower(F.hex(data))
    for digit, pair in _nibbles(order):
        text = F.replace(text, F.lit(digit), F.lit(pair))
    return text


def dna_decode(seq: Column, order: str = CODING) -> Column:
    """Bytes of a strand; base pairs become digits through their two-digit codes."""
    digits = F.translate(seq, order, "0123")
    pairs = F.regexp_replace(digits, "(..)", "$1 ")
    for n in range(16):
        pairs = F.replace(pairs, F.lit(f"{n >> 2}{n & 3} "), F.lit("ghijklmnopqrstuv"[n]))
    return F.unhex(F.translate(pairs, "ghijklmnopqrstuv", "0123456789abcdef"))


#: Letters of the six-letter alphabet, and how many stand for how many bytes.
SIX, SIX_LETTERS, SIX_BYTES = "ACGTPZ", 16, 5


def six_encode(data: Column, letters: str = SIX) -> Column:
    """SIX_LETTERS letters for a block of SIX_BYTES bytes, given as hexadecimal digits: its number to the base of six."""
    return F.translate(F.lpad(F.conv(data, 16, 6), SIX_LETTERS, "0"), "012345", letters)


def six_decode(seq: Column, letters: str = SIX) -> Column:
    """The hexadecimal digits of a block's bytes."""
    return F.lower(F.lpad(F.conv(F.translate(seq, letters, "012345"), 6, 16), 2 * SIX_BYTES, "0"))


def six_screen(seq: Column, homopolymer: int = 3, letters: str = SIX) -> Column:
    """True for strands of six letters without a run over homopolymer; their GC share isn't looked at."""
    return ~F.rlike(seq, F.lit("|".join(f"{b}{{{homopolymer + 1}}}" for b in letters)))


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GC]", "")).cast("long")


def longest_run(seq: Column) -> Column:
    runs = F.regexp_extract_all(seq, F.lit("A+|C+|G+|T+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("long")


def screen(seq: Column, homopolymer: int = 4, gc_slack: float = 0.1) -> Column:
    """True for strands without a run over homopolymer and with a GC share within 0.5 ± gc_slack."""
    runs = "|".join(f"{b}{{{homopolymer + 1}}}" for b in "ACGT")
    share = gc_count(seq) / F.length(seq)
    return ~F.rlike(seq, F.lit(runs)) & (share >= F.lit(0.5 - gc_slack)) & (share <= F.lit(0.5 + gc_slack))


#: Codons that end a reading frame, and those that don't, as patterns; fixed values.
STOP, NO_STOP = "T(?:AA|AG|GA)", "(?:[ACG][ACGT][ACGT]|T[CT][ACGT]|TA[CT]|TG[CGT])"


def longest_frame(seq: Column) -> Column:
    """Bases of the longest open reading frame, ATG to a stop codon, of those found one after another from the left."""
    found = F.regexp_extract_all(seq, F.lit(f"ATG{NO_STOP}*{STOP}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0)).cast("long")


def base_index(base: Column, order: str = CHANNEL) -> Column:
    """0-based place of a base in an order, -1 for none."""
    return F.when(base == order[0], 0).when(base == order[1], 1).when(base == order[2], 2).when(base == order[3], 3).otherwise(-1).cast("int")


#: XXH64's primes, and odd factors below 2**31 that spread a position's draw; fixed values.
P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
STEP, SPREAD_A, SPREAD_B = 0x9E3779B9, 0x7FEB352D, 0x2C1B3C6D
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def stream_key(seed: int, stream: int) -> int:
    """One number for a seed (of 47 bits) and a stream (of 16)."""
    return ((seed << 16) | stream) & ((1 << 63) - 1)


def hash_long(value: int, seed: int) -> int:
    """XXH64 of a 64-bit number."""
    turn = lambda x, k: ((x << k) | (x >> (64 - k))) & M64
    h = turn(((seed + P5 + 8) & M64) ^ (turn(value * P2 & M64, 31) * P1 & M64), 27)
    h = (h * P1 + P4) & M64
    h = (h ^ (h >> 33)) * P2 & M64
    h = (h ^ (h >> 29)) * P3 & M64
    return h ^ (h >> 32)


def state(a: Column, stream: int, seed: int) -> Column:
    """64 bits that depend on all bits of a number, on the stream and on the seed; no two numbers share them."""
    return F.xxhash64(F.lit(stream_key(seed, stream)).cast("long"), a.cast("long"))


def mix(a: Column, stream: int, seed: int) -> Column:
    """A draw in [0, 2**31) for a number."""
    return F.shiftrightunsigned(state(a, stream, seed), 33)


def mix_at(a: Column, p: Column, stream: int, seed: int) -> Column:
    """A draw in [0, 2**31) for a number and a position below 2**30: the number's state, stirred by the position."""
    s, low = state(a, stream, seed), F.lit(M32).cast("long")
    h = (s.bitwiseAND(low) + p.cast("long") * F.lit(STEP).cast("long")).bitwiseAND(low)
    h = (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(SPREAD_A).cast("long")).bitwiseAND(low).bitwiseXOR(F.shiftrightunsigned(s, 32))
    h = (h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(SPREAD_B).cast("long")).bitwiseAND(low)
    return F.shiftright(h.bitwiseXOR(F.shiftright(h, 16)), 1)


def _let(value: str, bodies: list[str]) -> str:
    """DuckDB SQL of a value passed on from one expression of h to the next."""
    for body in bodies:
        value = f"list_transform([{value}], lambda h: {body})[1]"
    return value


def state_sql(a: str, stream: int, seed: int) -> str:
    """state as DuckDB SQL, an unsigned number."""
    big = lambda n: f"{n}::UHUGEINT"
    turn = lambda k: f"((h << {k}) | (h >> {64 - k}))"
    first = (hash_long(stream_key(seed, stream), 42) + P5 + 8) & M64
    return _let(
        f"(CAST({a} AS BIGINT)::UHUGEINT * {big(P2)}) & {big(M64)}",
        [f"(({turn(31)} & {big(M64)}) * {big(P1)}) & {big(M64)}", f"xor(h, {big(first)})", f"(({turn(27)} & {big(M64)}) * {big(P1)} + {big(P4)}) & {big(M64)}",
         f"(xor(h, h >> 33) * {big(P2)}) & {big(M64)}", f"(xor(h, h >> 29) * {big(P3)}) & {big(M64)}", "xor(h, h >> 32)"],
    )


def mix_sql(a: str, stream: int, seed: int) -> str:
    """mix as DuckDB SQL."""
    return f"CAST(({state_sql(a, stream, seed)}) >> 33 AS BIGINT)"


def mix_at_ctes(name: str, rows: str, a: str, places: str, stream: int, seed: int, keep: str = "true") -> str:
    """CTEs of DuckDB SQL that end in name: rows for each pos of a list of places, with u, their draw, where keep holds."""
    return ", ".join([
        f"{name}0 AS (SELECT *, {state_sql(a, stream, seed)} AS s FROM ({rows}))",
        f"{name}1 AS (SELECT * EXCLUDE (s), CAST(s & {M32}::UHUGEINT AS BIGINT) AS x, CAST(s >> 32 AS BIGINT) AS y FROM {name}0)",
        f"{name}2 AS (SELECT * EXCLUDE (x), (x + pos * {STEP}) & {M32} AS h FROM (SELECT *, unnest({places}) AS pos FROM {name}1))",
        f"{name}3 AS (SELECT * REPLACE (xor((xor(h, h >> 16) * {SPREAD_A}) & {M32}, y) AS h) FROM {name}2)",
        f"{name}4 AS (SELECT * REPLACE ((xor(h, h >> 15) * {SPREAD_B}) & {M32} AS h) FROM {name}3)",
        f"{name} AS (SELECT * EXCLUDE (h, y), xor(h, h >> 16) >> 1 AS u FROM {name}4 WHERE {keep.replace('u ', '(xor(h, h >> 16) >> 1) ')})",
    ])


def lookup(draw: Column, bounds: list[int], values: list | None = None) -> Column:
    """Index (or value) of the first bound above the draw, as a balanced tree of comparisons."""
    values = list(range(len(bounds))) if values is None else values

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(values[low])
        mid = (low + high) // 2
        return F.when(draw < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds) - 1)
