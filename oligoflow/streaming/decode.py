"""Decoding as reads arrive: each line is corrected, droplets are counted and kept once, files are peeled as they fill up.

Many files share one pool of oligos. Each file is decoded by a state of its own, whose size the file bounds: the number
of reads of each droplet, the payloads that are still open and the segments that are solved. A file that is complete
gives its segments, and its state shrinks to its counts; what comes later changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import dna
from ..operators.fountain import degree_bounds, rs_correct, seed_droplet
from ..sources.strands import decoder_lines


def decode_stream(spark: SparkSession, folder: str, out: str, state: str) -> StreamingQuery:
    """Read text files of reads from folder and append (droplet, payload) to out, once for each droplet.

    The state holds every droplet seen, as there is no time after which one can't come again; a file has about as many
    droplets as segments, so the state's bound is the size of the file that is decoded.
    """
    reads = decoder_lines(spark.readStream.text(folder))
    data = reads.select(F.lower(F.hex(rs_correct(dna.dna_decode(F.col("dna"))))).alias("_h")).where("_h is not null")
    found = data.select(seed_droplet(F.conv(F.substring("_h", 1, 8), 16, 10)).alias("droplet"), F.substring("_h", 9, 1 << 20).alias("payload"))
    once = found.dropDuplicates(["droplet"])
    return once.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)


def file_plan(files: DataFrame, seed: int, factor: float = 2.0, extra: int = 20) -> DataFrame:
    """(file_id, droplet, seg_ids) of the first factor * k + extra droplets of each of files(file_id, k), k segments each."""
    rows = files.where("k > 0").withColumn("droplet", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("k") * factor).cast("long") + extra - 1)))
    return rows.select("file_id", "droplet", segments_of(F.col("file_id"), F.col("droplet"), F.col("k"), seed).alias("seg_ids"))


def segments_of(file_id: Column, droplet: Column, k: Column, seed: int) -> Column:
    """The segments of a droplet of a file with k segments: the degree by the soliton, then the first distinct draws."""

    @F.pandas_udf("int")
    def degree(draw: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros(len(draw), np.int32)
        for n in np.unique(size):
            at = (size == n).to_numpy()
            out[at] = np.searchsorted(np.array(degree_bounds(int(n))), draw[at].to_numpy(), side="right") + 1
        return pd.Series(out)

    key = F.xxhash64(file_id, droplet).bitwiseAND(F.lit((1 << 62) - 1))
    drawn = F.transform(F.sequence(F.lit(0), degree(dna.mix(key, 40, seed), k) * 4 + 15), lambda j: F.pmod(dna.mix_at(key, j, 41, seed), k).cast("int"))
    return F.slice(F.array_distinct(drawn), F.lit(1), F.greatest(degree(dna.mix(key, 40, seed), k), F.lit(1)))


class Peeling:
    """One file's state: counts of its droplets, open droplets and solved segments."""

    def __init__(self, k: int):
        self.k, self.counts, self.open, self.solved = k, {}, {}, {}

    @property
    def complete(self) -> bool:
        return len(self.solved) == self.k

    def add(self, droplet: int, segments: list[int], payload: int, coverage: int) -> None:
        """Count a droplet and, if it is new and the file not complete, take in what it tells."""
        known = droplet in self.counts
        self.counts[droplet] = self.counts.get(droplet, 0) + coverage
        if known or self.complete:
            return
        waiting = [(droplet, set(segments), payload)]
        while waiting:
            name, rest, value = waiting.pop()
            for s in [s for s in rest if s in self.solved]:
                rest.remove(s)
                value ^= self.solved[s]
            if len(rest) > 1:
                self.open[name] = (rest, value)
            elif rest:
                s = rest.pop()
                self.solved[s] = value
                waiting += [(n, *self.open.pop(n)) for n in [n for n, (r, _) in self.open.items() if s in r]]
        if self.complete:
            self.open = {}


SOLVED = "file_id long, seg int, payload string, droplets long, reads long"


def _peel(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held: Peeling | None = pickle.loads(state.get[0]) if state.exists else None
    done = held is not None and held.complete
    for rows in batches:
        rows = rows.sort_values("droplet")
        held = held or Peeling(int(rows["k"].iloc[0]))
        for droplet, segments, payload, coverage in zip(rows["droplet"], rows["seg_ids"], rows["payload"], rows["coverage"]):
            held.add(int(droplet), [int(s) for s in segments], int(payload, 16), int(coverage))
    state.update((pickle.dumps(held),))
    if held.complete and not done:
        yield pd.DataFrame([(key[0], s, f"{held.solved[s]:064x}", len(held.counts), sum(held.counts.values())) for s in sorted(held.solved)], columns=[c.split()[0] for c in SOLVED.split(", ")])


def decode_pool(lines: DataFrame, files: DataFrame, seed: int) -> DataFrame:
    """SOLVED of lines(file_id, value) that arrive as a stream, with files(file_id, k).

    value is a line of reads, with its coverage or without. The segments of a file come once, when all are solved, with
    the droplets and reads that it took; a droplet counts each time, but is used once. Reads that can't be corrected,
    and those of unknown files, are left out.
    """
    f = F.split(F.trim("value"), "\\t")
    kept = lines.where(~F.col("value").startswith(">") & ~F.col("value").contains("N") & (F.trim("value") != ""))
    reads = kept.select("file_id", F.when(F.size(f) > 1, f[0].try_cast("long")).otherwise(1).alias("coverage"), F.element_at(f, -1).alias("dna"))
    data = reads.select("file_id", "coverage", F.lower(F.hex(rs_correct(dna.dna_decode(F.col("dna"))))).alias("_h")).where("_h is not null and coverage > 0")
    found = data.select("file_id", "coverage", seed_droplet(F.conv(F.substring("_h", 1, 8), 16, 10)).alias("droplet"), F.substring("_h", 9, 1 << 20).alias("payload")).join(files, "file_id")
    found = found.withColumn("seg_ids", segments_of(F.col("file_id"), F.col("droplet"), F.col("k"), seed))
    return found.groupBy("file_id").applyInPandasWithState(_peel, SOLVED, "data binary", "append", GroupStateTimeout.NoTimeout)


def run_pool(lines: DataFrame, files: DataFrame, seed: int, out: str, state: str) -> StreamingQuery:
    """decode_pool of all lines that are there, appended to the Parquet folder out; state is the stream's own folder."""
    return decode_pool(lines, files, seed).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
