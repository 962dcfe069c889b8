"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Documents are tokenised once; pieces as long as a sequence stand alone. The other pieces are dealt by hash into groups
of about GROUP, so no group grows with the data, and every group is evolved on ISLANDS islands. An individual is a
list of bins. An island starts from one best-fit packing in order of size and from weaker ones in orders of chance,
so that there is something to inherit. Crossover injects whole well-filled bins of one parent into a copy of the
other, removes the bins that hold a piece twice, and best-fits the displaced pieces. Every island lives through at
least LEAST generations; after them it stops where its best packing meets the bound ceil(sum of lengths / size), or
where PATIENCE generations brought nothing better. After each round every island sends its elite to the next one. The
best island's packing counts; the pieces of its poorly filled bins are dealt and evolved once more together with those
of other groups. The crossovers that a group went through are reported beside its pieces.

Cases: null and empty texts give the end id alone, a piece of one token; repeated rows are packed one by one; ties go to
the smaller row number; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

GROUP, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 4096, 2, 2, 30, 4
LEAST, PATIENCE = 1, 6
#: Bins filled less than this are dissolved and packed again across groups.
WELL_FILLED = 0.97
STATE = "grp long, island int, uids array<long>, lens array<int>, elite array<int>, crossed long"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, keep_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]) of every piece; only the first may be shorter than size.

    With a number of pieces to be remembered, a worker forgets them after each task.
    """
    common.small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(tokenizer, remembered=remembered), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").fill_null(""))):
                ids += end
                n = len(ids) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.record_batch({n: pa.array(c, t) for n, c, t in list(zip(names, columns, kinds))[: 5 + keep_ids]})
        if remembered is not None:
            encoder.forget()
        common.release()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit(bins: list[list[int]], room: list[int], order: list[int], lens: list[int], size: int) -> None:
    """Put the pieces of order, one by one, into the fullest bin that takes them; bins and room change in place."""
    at: dict[int, list[int]] = {}
    mask = 0
    for b, free in enumerate(room):
        if free:
            at.setdefault(free, []).append(b)
            mask |= 1 << free
    for item in order:
        need = lens[item]
        fits = mask >> need
        if fits:
            free = (fits & -fits).bit_length() - 1 + need
            stack = at[free]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << free)
            bins[b].append(item)
        else:
            free, b = size, len(bins)
            bins.append([item])
            room.append(size)
        room[b] = free = free - need
        if free:
            at.setdefault(free, []).append(b)
            mask |= 1 << free


def _value(room: list[int], size: int) -> tuple[int, float]:
    return len(room), -sum((size - r) ** 2 for r in room)


def crossover(one: tuple, two: tuple, lens: list[int], size: int, rng: random.Random) -> tuple:
    """A copy of one with well-filled bins of two."""
    bins, room = one
    other, other_room = two
    ranked = sorted(range(len(other)), key=other_room.__getitem__)
    ranked = ranked[: max(1, len(ranked) // 2)]
    gift = rng.sample(ranked, max(1, len(ranked) // 2))
    taken = {i for b in gift for i in other[b]}
    new, new_room, loose = [list(other[b]) for b in gift], [other_room[b] for b in gift], []
    for items, free in zip(bins, room):
        if taken.isdisjoint(items):
            new.append(list(items))
            new_room.append(free)
        else:
            loose += [i for i in items if i not in taken]
    worst = sorted(range(len(new)), key=new_room.__getitem__)[-3:]
    for b in sorted(worst, reverse=True):  # mutation: the least filled bins are packed anew
        if new_room[b]:
            loose += new.pop(b)
            new_room.pop(b)
    loose.sort(key=lambda i: (-lens[i], i))
    best_fit(new, new_room, loose, lens, size)
    return new, new_room


def evolve(lens: list[int], elites: list[list[int]], size: int, seed: int) -> tuple[list[int], int]:
    """(bin of each piece, crossovers) of a population that starts from the elites and from best-fit individuals."""
    rng, bound, people, crossed = random.Random(seed), -(-sum(lens) // size), [], 0
    for elite in elites:
        bins = [[] for _ in range(max(elite, default=-1) + 1)]
        for i, b in enumerate(elite):
            bins[b].append(i)
        people.append((bins, [size - sum(lens[i] for i in items) for items in bins]))
    falling = sorted(range(len(lens)), key=lambda i: (-lens[i], i))
    while len(people) < POPULATION:
        order = falling if not people else rng.sample(range(len(lens)), len(lens))
        bins, room = [], []
        best_fit(bins, room, order, lens, size)
        people.append((bins, room))
    people.sort(key=lambda p: _value(p[1], size))
    idle = 0
    for generation in range(GENERATIONS if len(lens) > 1 else 0):
        if generation >= LEAST and (len(people[0][1]) <= bound or idle >= PATIENCE):
            break
        best = _value(people[0][1], size)
        children = []
        for k in range(POPULATION // 2):
            one, two = (people[0], rng.choice(people[1:])) if k % 2 else rng.sample(people, 2)
            children.append(crossover(one, two, lens, size, rng))
            crossed += 1
        people = sorted([*people, *children], key=lambda p: _value(p[1], size))[:POPULATION]
        idle = 0 if _value(people[0][1], size) < best else idle + 1
    out = [0] * len(lens)
    for b, items in enumerate(people[0][0]):
        for i in items:
            out[i] = b
    return out, crossed


def _pack(rest: DataFrame, size: int, level: int) -> DataFrame:
    """(uid, length, sequence_id, offset, fill, crossovers) of rest(uid, length)."""
    groups = max(1, -(-rest.count() // GROUP))

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        one = [int(rows["grp"].iloc[0]), 0, rows["uid"].tolist(), rows["length"].tolist(), [], 0]
        return pd.DataFrame([[*one[:1], k, *one[2:]] for k in range(ISLANDS)], columns=STATE_COLUMNS)

    def step(number: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            first = rows.iloc[0]
            grp, island, lens = int(first["grp"]), int(first["island"]), [int(x) for x in first["lens"]]
            elites = sorted([int(x) for x in e] for e in rows["elite"] if len(e))
            best, crossed = evolve(lens, elites, size, hash((level, grp, island, number)))
            uids = list(first["uids"])
            targets = [island, (island + 1) % ISLANDS] if number + 1 < ROUNDS and ISLANDS > 1 else [island]
            # The count stays on its island; what migrates is the elite alone.
            before = int(rows["crossed"].sum()) + crossed
            return pd.DataFrame([[grp, to, uids, lens, best, before if to == island else 0] for to in targets], columns=STATE_COLUMNS)

        return run

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        def value(elite, lens):
            fill = np.bincount(elite, weights=lens)
            return len(fill), -float((fill**2).sum())

        best = min(rows.sort_values("island").itertuples(), key=lambda r: value(np.asarray(r.elite), np.asarray(r.lens)))
        uid, lens, bin_ = np.asarray(best.uids), np.asarray(best.lens), np.asarray(best.elite)
        order = np.lexsort((uid, bin_))
        uid, lens, bin_ = uid[order], lens[order].astype(np.int64), bin_[order].astype(np.int64)
        before = np.cumsum(lens) - lens
        head = np.flatnonzero(np.r_[True, bin_[1:] != bin_[:-1]])
        offset = before - np.repeat(before[head], np.diff(np.r_[head, len(bin_)]))
        fill = np.bincount(bin_, weights=lens)[bin_] / size
        return pd.DataFrame({"uid": uid, "length": lens, "sequence_id": (level << 56) + (int(best.grp) << 20) + bin_, "offset": offset, "fill": fill, "crossovers": int(rows["crossed"].sum())})

    state = rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups))).groupBy("grp").applyInPandas(found, STATE)
    for number in range(ROUNDS):
        state = state.groupBy("grp", "island").applyInPandas(step(number), STATE)
    return common.written(state.groupBy("grp").applyInPandas(settle, "uid long, length int, sequence_id long, offset long, fill double, crossovers long"), "packing-placed")


def place(cut: DataFrame, size: int = 2048) -> DataFrame:
    """cut, a written table with uid and length, plus sequence_id, offset and crossovers."""
    rest = cut.where(F.col("length") < size).select("uid", "length")
    placed = _pack(rest, size, 1)
    poor = placed.where(F.col("fill") < WELL_FILLED).select("uid", "length")
    again = _pack(poor, size, 2)
    better = again.select("sequence_id").distinct().count() < placed.where(F.col("fill") < WELL_FILLED).select("sequence_id").distinct().count()
    if better:
        placed = placed.where(F.col("fill") >= WELL_FILLED).unionByName(again)
    alone = cut.where(F.col("length") >= size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("crossovers"))
    return cut.join(placed.select("uid", "sequence_id", "offset", "crossovers").unionByName(alone), "uid")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, keep_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, crossovers [, ids].

    crossovers counts those of the group in which the piece was packed last; a piece that fills a sequence has none.
    """
    cut = common.written(pieces(docs, tokenizer, end_id, size, keep_ids, remembered).withColumn("uid", F.monotonically_increasing_id()), "packing-pieces")
    return place(cut, size).drop("uid").withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, doc_ids array) of pack_documents(keep_ids=True); a sequence is no longer than its size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
