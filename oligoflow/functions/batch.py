"""Work on one Arrow batch of reads at a time: draws, error placement, bases, mutation, truth strings and their parsing.

Everything here is a whole-batch array expression; which rows meet in a batch is Spark's business alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import dna
from .dna import CHANNEL, CODING, M31

#: Draws for the choice of a base run from 0 to this number.
BASE_DRAWS = 1_000_000
#: Rows whose positions are drawn at once.
ROWS_AT_ONCE = 1024
S, I, D = (ord(c) for c in "SID")  # noqa: E741
LETTERS = np.frombuffer(CHANNEL.encode(), np.uint8)
CODE = np.full(256, -1, np.int64)
CODE[LETTERS] = np.arange(4)
#: For each base, the other three in channel order.
OTHERS = np.array([[LETTERS[j] for j in range(4) if j != i] for i in range(4)], np.uint8)


#: The four bases of each byte, by CODING.
BYTE_BASES = np.array([[ord(CODING[b >> k & 3]) for k in (6, 4, 2, 0)] for b in range(256)], np.uint8)

#: The four letters of each byte of packed strings.
CHANNEL_BASES = np.array([[LETTERS[b >> k & 3] for k in (6, 4, 2, 0)] for b in range(256)], np.uint8)


def encoded(data: np.ndarray) -> np.ndarray:
    """Four bases for each byte."""
    return BYTE_BASES[data].ravel()


@dataclass(frozen=True)
class Noise:
    """Rates of substitution, insertion and deletion for each position, and bounds of BASE_DRAWS for the bases.

    subs[b] are the bounds of the first two substitutes of base b, ins those of the first three inserted bases;
    kmer[kind, 4 * k3 + b4], where given, those of the first three bases in that context (kind 0: S, 1: I).
    """

    rates: np.ndarray
    subs: np.ndarray
    ins: np.ndarray
    kmer: np.ndarray | None = None

    @property
    def length(self) -> int:
        return len(self.rates)

    def bounds(self) -> np.ndarray:
        """(length, 3) bounds on [0, 2**31) of sub, sub + ins and sub + ins + del."""
        return (np.cumsum(self.rates, axis=1) * (M31 + 1)).astype(np.int64)


@dataclass(frozen=True)
class Cuts:
    """For each position the last draw, and the last read with that draw, that is still an error."""

    draw: np.ndarray
    read: np.ndarray


def states(numbers: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """dna.state on arrays."""
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    p1, p2, p3, p4 = (np.uint64(p) for p in (dna.P1, dna.P2, dna.P3, dna.P4))
    first = np.uint64((dna.hash_long(dna.stream_key(seed, stream), 42) + dna.P5 + 8) & dna.M64)
    h = turn(first ^ (turn(numbers.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def draws(numbers: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """dna.mix on arrays."""
    return (states(numbers, stream, seed) >> np.uint64(33)).astype(np.uint32)


def draws_at(numbers: np.ndarray, places: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """dna.mix_at on arrays, which are brought to one shape."""
    s = states(numbers, stream, seed)
    h = s.astype(np.uint32) + places.astype(np.uint32) * np.uint32(dna.STEP)
    h ^= h >> np.uint32(16)
    h *= np.uint32(dna.SPREAD_A)
    h ^= (s >> np.uint64(32)).astype(np.uint32)
    h ^= h >> np.uint32(15)
    h *= np.uint32(dna.SPREAD_B)
    h ^= h >> np.uint32(16)
    return h >> np.uint32(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())


def packed(column: pa.Array) -> pa.Array:
    """Strings of the four bases as binary, four letters to a byte behind one that tells how many the last byte lacks;
    a string with any other letter stands as it is behind a byte of 255."""
    if not len(column):
        return pa.array([], pa.binary())
    letters, offsets = text_bytes(column)
    sizes, rows = np.diff(offsets), len(column)
    row = np.repeat(np.arange(rows), sizes)
    codes = CODE[letters]
    plain = np.bincount(row[codes < 0], minlength=rows) > 0
    quads = -(-sizes // 4)
    lead = np.cumsum(quads) - quads
    wide = np.zeros(quads.sum() * 4, np.uint8)
    wide[np.arange(len(letters)) + np.repeat(lead * 4 - offsets[:-1], sizes)] = np.maximum(codes, 0)
    bits = wide.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    ends = np.cumsum(1 + np.where(plain, sizes, quads))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros(ends[-1], np.uint8)
    out[starts] = np.where(plain, 255, quads * 4 - sizes)
    home = np.repeat(np.arange(rows), quads)
    use = ~plain[home]
    out[(np.arange(len(home)) - lead[home] + starts[home] + 1)[use]] = bits[use]
    raw = plain[row]
    out[(np.arange(len(letters)) - offsets[:-1][row] + starts[row] + 1)[raw]] = letters[raw]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.append(starts, len(out)).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array) -> list[str]:
    """The strings of packed."""
    out = column.to_pylist()
    spelt = CHANNEL_BASES[np.frombuffer(b"".join(out), np.uint8)].tobytes().decode()
    end = 0
    for i, some in enumerate(out):
        start, end = end + 4, end + 4 * len(some)
        out[i] = some[1:].decode() if some[0] == 255 else spelt[start : end - some[0]]
    return out


def packed_letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, sizes, odd) of packed strings: a row of letters each, zeros behind them, and which have other letters."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    starts, held = offsets[:-1] + 1, np.diff(offsets) - 1
    odd = data[starts - 1] == 255
    sizes = np.where(odd, held, 4 * held - data[starts - 1])
    width = int(sizes.max(initial=0))
    quads = -(-width // 4)
    at = starts[:, None] + np.arange(quads)
    out = CHANNEL_BASES[data[np.minimum(at, len(data) - 1)]].reshape(len(starts), 4 * quads)[:, :width]
    if (sizes < width).any():
        out = np.where(np.arange(width) < sizes[:, None], out, np.uint8(0))
    for row in np.flatnonzero(odd):
        out[row] = 0
        out[row, : sizes[row]] = data[starts[row] : starts[row] + sizes[row]]
    return out, sizes, odd


def packed_matrix(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) letters of packed strings that all have this length."""
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column)]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    plain = data[starts] == 255
    out = np.empty((len(column), length), np.uint8)
    bits = data[starts[~plain][:, None] + 1 + np.arange(-(-length // 4))]
    out[~plain] = CHANNEL_BASES[bits].reshape(len(bits), 4 * bits.shape[1])[:, :length]
    out[plain] = data[starts[plain][:, None] + 1 + np.arange(length)]
    return out


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) letters of strands that all have this length."""
    data, offsets = text_bytes(column)
    if (np.diff(offsets) != length).any():
        raise ValueError(f"strands must have {length} bases")
    return data.reshape(-1, length)


def place(ids: np.ndarray, noise: Noise, seed: int, cuts: Cuts | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, kind) of the errors, one at most for each position of each read, in order."""
    n, bounds = noise.length, noise.bounds()
    places = np.arange(n, dtype=np.uint32)
    rows, at, kinds = [], [], []
    for first in range(0, len(ids), ROWS_AT_ONCE):
        some = ids[first : first + ROWS_AT_ONCE]
        u = draws_at(some[:, None], places, 2, seed)
        if cuts is None:
            hit = np.flatnonzero(u < bounds[:, 2].astype(np.uint32))
            drawn, shares = u.ravel()[hit], bounds
        else:
            top = cuts.draw.astype(np.int64)
            hit = np.flatnonzero(u < np.maximum(top + 1, 0).astype(np.uint32))
            row, pos = np.divmod(hit, n)
            hit = hit[(u.ravel()[hit] < top[pos]) | (some[row] <= cuts.read[pos])]
            drawn = draws_at(some[hit // n], hit % n, 3, seed)
            shares = (np.cumsum(noise.rates, axis=1) / np.maximum(noise.rates.sum(axis=1), 1e-300)[:, None] * (M31 + 1)).astype(np.int64)
        row, pos = np.divmod(hit, n)
        rows.append(row + first)
        at.append(pos)
        kinds.append(np.where(drawn < shares[pos, 0], S, np.where(drawn < shares[pos, 1], I, D)))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(rows), join(at), join(kinds).astype(np.uint8)


def context(letters: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k3, b4): index of the three bases before a position, and of the base there; -1 outside 3 <= pos < length - 2."""
    inside = (pos >= 3) & (pos < letters.shape[1] - 2)
    p = np.where(inside, pos, 3)
    c = [CODE[letters[row, p - k]] for k in (3, 2, 1, 0)]
    return np.where(inside, 16 * c[0] + 4 * c[1] + c[2], -1), np.where(inside, c[3], -1)


def bases(ids: np.ndarray, letters: np.ndarray, row: np.ndarray, pos: np.ndarray, kind: np.ndarray, noise: Noise, seed: int) -> np.ndarray:
    """The substitute or the inserted base of each error by inverse distribution, 0 for deletions."""
    v = (draws_at(ids[row], pos, 4, seed) % BASE_DRAWS).astype(np.int64)
    ref = CODE[letters[row, pos]]
    sub = OTHERS[ref, (v[:, None] >= noise.subs[ref]).sum(axis=1)]
    out = np.where(kind == S, sub, LETTERS[(v[:, None] >= noise.ins).sum(axis=1)])
    if noise.kmer is not None:
        k3, b4 = context(letters, row, pos)
        known = k3 >= 0
        index = np.where(known, 4 * k3 + b4, 0)
        picked = LETTERS[(v[:, None] >= noise.kmer[(kind == I).astype(int), index]).sum(axis=1)]
        out = np.where(known, picked, out)
    return np.where(kind == D, 0, out).astype(np.uint8)


def mutated(letters: np.ndarray, row: np.ndarray, pos: np.ndarray, kind: np.ndarray, base: np.ndarray) -> pa.Array:
    """The reads that errors make of strands; an inserted base stands before its position's own."""
    rows, n = letters.shape
    flat, at = letters.reshape(-1).copy(), row * n + pos
    flat[at[kind == S]] = base[kind == S]
    flat[at[kind == D]] = 0
    grown = np.insert(flat, at[kind == I], base[kind == I]) if (kind == I).any() else flat
    sizes = n + np.bincount(row[kind == I], minlength=rows) - np.bincount(row[kind == D], minlength=rows)
    return strings(grown[grown != 0], np.concatenate([[0], np.cumsum(sizes)]))


def _joined(tokens: np.ndarray, row: np.ndarray, tail: np.ndarray, number: list[str]) -> pa.Array:
    """For each row its tokens in order, then number[tail]."""
    out = np.array(number, object)[tail]
    if len(row):
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[starts]] = np.add.reduceat(tokens, starts) + out[row[starts]]
    return pa.array(out, pa.string())


def _behind(row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """end of the event before in the same row, 0 for the first."""
    before = np.concatenate([[0], end[:-1]])
    return np.where(np.concatenate([[True], row[1:] != row[:-1]]), 0, before) if len(row) else end


def _tails(row: np.ndarray, end: np.ndarray, rows: int, length: int) -> np.ndarray:
    tail = np.full(rows, length)
    tail[row] = length - end  # of several events in a row the last one counts
    return tail


def cigar(rows: int, length: int, row: np.ndarray, pos: np.ndarray, kind: np.ndarray) -> pa.Array:
    """Run lengths of M, I and D; a substitution is M, and an insertion stands before its position's base."""
    use = kind != S
    row, pos, kind = row[use], pos[use], kind[use]
    end = pos + (kind == D)
    gap = pos - _behind(row, end)
    same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    follows = same & (gap == 0) & (kind == D) & (np.concatenate([[0], kind[:-1]]) == D) if len(row) else same
    heads = np.flatnonzero(~follows)
    run = np.diff(np.concatenate([heads, [len(row)]]))
    number = np.array([f"{i}M" if i else "" for i in range(length + 1)], object)
    tokens = number[gap[heads]] + np.array([f"{i}D" for i in range(length + 1)], object)[run]
    inserted = kind[heads] == I
    tokens[inserted] = number[gap[heads]][inserted] + "1I"
    return _joined(tokens, row[heads], _tails(row, end, rows, length), list(number))


def md(rows: int, length: int, row: np.ndarray, pos: np.ndarray, kind: np.ndarray, ref: np.ndarray) -> pa.Array:
    """Match runs, the reference's base for substitutions, ^bases for deletions; insertions leave no mark."""
    use = kind != I
    row, pos, kind, ref = row[use], pos[use], kind[use], ref[use]
    gap = pos - _behind(row, pos + 1)
    number = [str(i) for i in range(length + 1)]
    if not len(row):
        return _joined(np.zeros(0, object), row, _tails(row, pos + 1, rows, length), number)
    same = np.concatenate([[False], row[1:] == row[:-1]])
    follows = same & (gap == 0) & (kind == D) & (np.concatenate([[0], kind[:-1]]) == D)
    mark = np.where(kind == D, 4, 0) + CODE[ref]
    tokens = np.array(number, object)[gap] + np.array([*CHANNEL, *(f"^{b}" for b in CHANNEL)], object)[mark]
    tokens[follows] = np.array(list(CHANNEL), object)[CODE[ref[follows]]]
    return _joined(tokens, row, _tails(row, pos + 1, rows, length), number)


def _numbers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last digit, value) of each run of digits; runs end with their row."""
    digit = (data >= 48) & (data <= 57)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(digit & (first[:-1] | ~np.concatenate([[False], digit[:-1]])))
    if not len(starts):
        return starts, starts
    ends = np.flatnonzero(digit & (first[1:] | ~np.concatenate([digit[1:], [False]])))
    value = np.zeros(len(starts), np.int64)
    for k in range(int((ends - starts).max()) + 1):
        at = ends - k
        value += np.where(at >= starts, (data[np.maximum(at, 0)].astype(np.int64) - 48) * 10**k, 0)
    return ends, value


def _rows(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def before_in_row(row: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Sum of the steps before each entry within its row; rows are in order."""
    total = np.cumsum(step) - step
    if not len(row):
        return total
    head = np.concatenate([[True], row[1:] != row[:-1]])
    return total - np.repeat(total[head], np.diff(np.concatenate([np.flatnonzero(head), [len(row)]])))


#: What a run of each kind moves on in the reference and in the read, and the runs that match; H and P move nothing.
_ALONG_REF, _ALONG_READ, _MATCHED = (np.isin(np.arange(256), [ord(c) for c in some]) for some in ("M=XDN", "M=XIS", "M=X"))
SKIP = ord("N")


def cigar_runs(column: pa.Array, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, op, n, ref, read): each run with the 0-based places where it starts; S clips read bases alone, N skips
    bases of the reference."""
    data, offsets = text_bytes(column)
    last, n = _numbers(data, offsets)
    last, n = last[last + 1 < len(data)], n[last + 1 < len(data)]
    op, row = data[last + 1], _rows(offsets, last)
    ref = before_in_row(row, np.where(_ALONG_REF[op], n, 0)) + start[row]
    return row, op, n, ref, before_in_row(row, np.where(_ALONG_READ[op], n, 0))


def _past_skips(row: np.ndarray, op: np.ndarray, n: np.ndarray, ref: np.ndarray, m_row: np.ndarray, m_pos: np.ndarray) -> np.ndarray:
    """Places of MD marks, which don't count the bases that N skips, as places of the reference."""
    if not (op == SKIP).any():
        return m_pos
    gone = before_in_row(row, np.where(op == SKIP, n, 0))
    use = _ALONG_REF[op] & (op != SKIP)
    wide = np.int64(1) << 40
    keys = row[use] * wide + ref[use] - gone[use]
    return m_pos + gone[use][np.maximum(np.searchsorted(keys, m_row * wide + m_pos, side="right") - 1, 0)] if use.any() else m_pos


def md_marks(column: pa.Array, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, pos, kind, base): each substituted and each deleted base of the reference."""
    data, offsets = text_bytes(column)
    last, value = _numbers(data, offsets)
    letter = data >= 65
    letter &= data != ord("^")
    step = letter.astype(np.int64)
    step[last] = value
    every = np.arange(len(data))
    row = _rows(offsets, every)
    pos = before_in_row(row, step) + start[row] if len(data) else every
    mark = np.maximum.accumulate(np.where(letter, 0, every)) if len(data) else every
    kind = np.where(data[mark] == ord("^"), D, S) if len(data) else every
    return row[letter], pos[letter], kind[letter].astype(np.uint8), data[letter]


def rebuilt(read: pa.Array, cigar_: pa.Array, md_: pa.Array) -> pa.Array:
    """The reference's bases of each alignment: what its matched runs keep of the read, with the bases that MD marks."""
    rows = len(read)
    row, op, n, _, at = cigar_runs(cigar_, np.zeros(rows, np.int64))
    letters, offsets = text_bytes(read)
    match = _MATCHED[op]
    row, n, at = row[match], n[match], at[match]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    home = np.repeat(row, n)
    place = offsets[home] + np.repeat(at, n) + within
    held = place < offsets[home + 1]
    kept, sizes = letters[place[held]], np.bincount(home[held], minlength=rows)
    m_row, m_pos, m_kind, m_base = md_marks(md_, np.zeros(rows, np.int64))
    data, ends = text_bytes(md_)
    last, value = _numbers(data, ends)
    long = np.bincount(_rows(ends, last), weights=value, minlength=rows).astype(np.int64) + np.bincount(m_row, minlength=rows)
    starts = np.cumsum(long) - long
    lost = np.zeros(long.sum(), bool)
    lost[starts[m_row[m_kind == D]] + m_pos[m_kind == D]] = True
    of = np.repeat(np.arange(rows), long)
    nth = before_in_row(of, (~lost).astype(np.int64))
    known = ~lost & (nth < sizes[of])
    out = np.zeros(len(lost), np.uint8)
    out[known] = kept[(np.cumsum(sizes) - sizes)[of[known]] + nth[known]]
    out[starts[m_row] + m_pos] = m_base
    whole = strings(out[out != 0], np.concatenate([[0], np.cumsum(np.bincount(of[out != 0], minlength=rows))]))
    given = pc.and_(pc.and_(read.is_valid(), cigar_.is_valid()), md_.is_valid())
    return pc.if_else(given, whole, pa.scalar(None, pa.string()))


def alignment_events(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """row, kind, pos, ref, read of every event of a batch with cigar, md, read and, where it has it, ref_start.

    ref is 0 for insertions, read for deletions; an insertion has the position that follows it. The matched runs are
    there too, as run_row, run_ref and run_n.
    """
    names = batch.schema.names
    start = batch.column("ref_start").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) if "ref_start" in names else np.zeros(batch.num_rows, np.int64)
    row, op, n, ref, read = cigar_runs(batch.column("cigar"), start)
    letters, offsets = text_bytes(batch.column("read"))
    m_row, m_pos, m_kind, m_base = md_marks(batch.column("md"), start)
    m_pos = _past_skips(row, op, n, ref, m_row, m_pos)
    match = _MATCHED[op]
    wide = np.int64(1) << 40
    keys = row[match] * wide + ref[match]
    sub = m_kind == S
    got = np.zeros(len(m_row), np.uint8)
    if match.any() and sub.any():
        home = np.maximum(np.searchsorted(keys, m_row[sub] * wide + m_pos[sub], side="right") - 1, 0)
        at = offsets[m_row[sub]] + read[match][home] + m_pos[sub] - ref[match][home]
        got[sub] = letters[np.clip(at, 0, len(letters) - 1)]
    ins = op == I
    i_row, i_pos = np.repeat(row[ins], n[ins]), np.repeat(ref[ins], n[ins])
    within = np.arange(len(i_row)) - np.repeat(np.cumsum(n[ins]) - n[ins], n[ins])
    i_read = letters[offsets[i_row] + np.repeat(read[ins], n[ins]) + within] if len(i_row) else np.zeros(0, np.uint8)
    return {
        "row": np.concatenate([m_row, i_row]),
        "kind": np.concatenate([m_kind, np.full(len(i_row), I, np.uint8)]),
        "pos": np.concatenate([m_pos, i_pos]),
        "ref": np.concatenate([m_base, np.zeros(len(i_row), np.uint8)]),
        "read": np.concatenate([got, i_read]),
        "run_row": row[match], "run_ref": ref[match], "run_n": n[match],
    }


def single_letters(codes: np.ndarray) -> pa.Array:
    """One-letter strings; 0 is null."""
    held = codes != 0
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    valid = None if held.all() else pa.py_buffer(np.packbits(held, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(codes), offsets, pa.py_buffer(codes[held].astype(np.uint8).tobytes()), valid)
