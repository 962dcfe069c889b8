"""Whole runs: normal mode (sampled depth and errors), simple mode (given copies and errors), profile extraction."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch as kernel
from ..functions import dna
from ..functions.batch import Noise
from ..operators import channel, order, profile
from ..sources import sam
from ..sources import strands as source

#: Reads in a chunk where none is asked for, at most.
CHUNK = 100_000


@dataclass(frozen=True)
class Options:
    family: str = "lognormal"
    depth: float = 10.0
    cv: float | None = 0.3
    dropout: float | None = None
    #: Rates per 1000 bases that replace the profile's: one total or three; none keeps them as they are.
    rates: tuple[float, ...] = ()
    seed: int = 42
    exact: bool = True
    shuffle: bool = False
    merge: bool = False
    chunk: int | None = None
    profile: str | None = None
    use_kmer: bool = False
    #: Ends of the beta family.
    low: float | None = None
    high: float | None = None


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_idx, name, seq) of a FASTA file; raises unless all strands are of one length and of A, T, C and G."""
    order.shared_dir(spark)
    records = source.read_fasta(spark, path)
    report = source.validate(records).first()
    if not report["valid"]:
        raise ValueError(f"not a set of strands: {report.asDict()}")
    return order.running(records.withColumn("seq", F.upper("seq")), ["place"], ordinal="ref_idx").select("ref_idx", "name", "seq")


def noise_of(rates: DataFrame, bases: DataFrame, length: int, kmers: dict[str, DataFrame] | None = None, asked: tuple[float, ...] = ()) -> Noise:
    """The noise of a profile: rates(pos, sub, ins, del), bases(kind, ref_base, read_base, n), kmers S and I (k3, b4, out, n).

    Rates are brought to the strands' length by a spline and to the rates asked for. What comes to the driver is one
    row for each position, 16 for the bases and 2048 for the contexts.
    """
    kinds = ("sub", "ins", "del")
    n = rates.count()
    if n != length:
        rates = profile.resize(rates, kinds, n, length)
    if asked:
        rates = channel.override_rates(rates, list(asked))
    table = np.array([[r[k] for k in kinds] for r in rates.orderBy("pos").collect()], float).reshape(-1, 3)
    lut = profile.base_lut(bases.where("kind = 'S'").groupBy("ref_base", F.col("read_base").alias("base")).agg(F.sum("n").alias("n")))
    of = {b: [r["cum"] for r in sorted(found, key=lambda r: kernel.CHANNEL.index(r["base"]))] for b, found in _by(lut.collect(), "ref_base").items()}
    ins = {r["base"]: r["cum"] for r in profile.inserted_shares(bases.where("kind = 'I'").groupBy(F.col("read_base").alias("base")).agg(F.sum("n").alias("n"))).collect()}
    full = None
    if kmers:
        full = np.zeros((2, 256, 4))
        for k, kind in enumerate("SI"):
            for r in profile.kmer_full(kmers[kind]).collect():
                full[k, 4 * r["k3"] + r["b4"], r["out"]] = r["p"]
    bound = lambda x: np.rint(np.asarray(x) * kernel.BASE_DRAWS).astype(np.int64)
    return Noise(table, bound([of[b][:2] for b in kernel.CHANNEL]), bound([ins[b] for b in kernel.CHANNEL[:3]]), None if full is None else bound(np.cumsum(full, axis=2)[:, :, :3]))


def _by(rows: list, key: str) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def load_profile(spark: SparkSession, path: str, o: Options, length: int) -> tuple[Noise, Options]:
    """The noise of a profile that extract wrote, and o with the profile's share of dropout where none is asked for."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    rates = read("positions").select("pos", *[F.col(f"{k}_rate").alias(k) for k in ("sub", "ins", "del")])
    kmers = {"S": read("kmer_sub"), "I": read("kmer_ins")} if o.use_kmer else None
    found = noise_of(rates, read("bases"), length, kmers, o.rates)
    return found, o if o.dropout is not None else replace(o, dropout=read("depth").first()["dropout"])


def noise_for(spark: SparkSession, o: Options, length: int) -> tuple[Noise, Options]:
    if o.profile:
        return load_profile(spark, o.profile, o, length)
    noise = channel.standard_noise(length)
    if o.rates:
        whole = noise.rates.mean(axis=0)
        scale = np.array(o.rates) / 1000 / whole if len(o.rates) == 3 else o.rates[0] / 1000 / whole.sum()
        noise = replace(noise, rates=noise.rates * scale)
    return noise, o


def chunk_size(n_refs: int, depth: float, asked: int | None = None) -> int:
    """Reads in a chunk: as asked, else all that are expected, CHUNK at most."""
    return asked or max(1, min(int(n_refs * depth), CHUNK))


def normal(refs: DataFrame, o: Options) -> dict[str, DataFrame]:
    """depth, aligned (reads with truth), chunks and a one-row summary of a simulated run."""
    spark = refs.sparkSession
    size = refs.agg(F.max(F.length("seq")).alias("length"), F.count("*").alias("n")).first()
    noise, o = noise_for(spark, o, size["length"] or 0)
    depth = channel.sample_depth(refs, o.family, o.depth, o.cv, o.seed, o.low, o.high)
    if o.dropout is not None:
        depth = channel.calibrate_dropout(depth.select("ref_idx", "n_reads"), o.dropout, o.seed).join(refs, "ref_idx")
    counted = order.written(channel.number_reads(depth), "depth")
    reads = channel.expand(counted.select("ref_idx", "seq", "n_reads", "first_read"))
    cuts = channel.error_cuts(channel.expand(counted.select("ref_idx", "n_reads", "first_read")).select("read_id"), noise, o.seed) if o.exact else None
    aligned = order.written(channel.simulate(reads, noise, o.seed, cuts), "aligned")
    o = replace(o, chunk=chunk_size(size["n"], o.depth, o.chunk))
    return {"refs": refs, "depth": counted, "aligned": aligned, "chunks": channel.chunk_meta(channel.pack_chunks(counted, o.chunk)), "summary": summary(counted, aligned), "options": o}


def simple(refs: DataFrame, copies: DataFrame, errors: DataFrame) -> DataFrame:
    """(read_id, ref_idx, read): every reference as often as copies say, with the errors given and no others."""
    reads = channel.expand(channel.number_reads(refs.join(copies.withColumnRenamed("n", "n_reads"), "ref_idx"))).select("read_id", "ref_idx", "seq")
    plan = source.parse_error_plan(errors, reads.count())
    return channel.explicit_reads(reads, plan)


def simple_chunks(reads: DataFrame, size: int) -> DataFrame:
    """(chunk_idx, first_read, last_read, n_reads) of reads in chunks of size, the last one shorter."""
    chunk = F.floor(F.col("read_id") / size).alias("chunk_idx")
    return reads.groupBy(chunk).agg(F.min("read_id").alias("first_read"), F.max("read_id").alias("last_read"), F.count("*").alias("n_reads"))


def summary(depth: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row: strands, strands without reads, reads, bases, and errors of each kind, counted."""
    a = depth.agg(F.count("*").alias("n_refs"), F.count_if(F.col("n_reads") == 0).alias("n_dropped"), F.sum("n_reads").alias("n_reads"))
    b = aligned.agg(F.sum(F.length("read")).alias("n_bases"), *[F.sum(n).alias(n) for n in ("n_sub", "n_ins", "n_del")])
    return a.join(b, F.lit(True))  # one row each


def merged_name(base: str, shuffled: bool, stamp: Column | None = None) -> Column:
    """Name of the merged file of a run: base, whether shuffled, and a time if given."""
    return F.concat_ws("_", F.lit(base), *([F.lit("shuffled")] if shuffled else []), F.lit("merged"), *([F.date_format(stamp, "yyyyMMdd_HHmmss")] if stamp is not None else []))


def write_run(run: dict, out: str, o: Options) -> None:
    """reads as FASTA (by chunk, or merged), truth, counts of every reference, chunk table and summary, below out."""
    o = replace(o, chunk=run["options"].chunk)
    aligned = run["aligned"].withColumn("place", F.col("read_id"))
    if o.shuffle:
        aligned = channel.shuffle_reads(run["aligned"], o.seed).withColumnRenamed("new_id", "place")
    name = "read_" if o.shuffle else "seq_"
    label = F.concat(F.lit(name), (F.col("place") + 1).cast("string"))
    rows = aligned.withColumn("label", label).repartitionByRange("place").sortWithinPartitions("place")
    lines = rows.select(F.floor(F.col("place") / o.chunk).alias("chunk"), F.concat(F.lit(">"), "label", F.lit("\n"), "read").alias("value"))
    if o.merge:  # one file is what is asked for, so one task writes it
        lines.select("value").coalesce(1).write.mode("overwrite").text(f"{out}/{'shuffled_' if o.shuffle else ''}merged")
    else:
        lines.write.mode("overwrite").partitionBy("chunk").text(f"{out}/reads")
    truth = rows.select("label", F.concat(F.lit("ref_"), (F.col("ref_idx") + 1).cast("string")).alias("ref"), "cigar", "md")
    truth.write.mode("overwrite").csv(f"{out}/read_to_ref_{'shuffled' if o.shuffle else 'ordered'}", sep="\t")
    channel.ref_counts(run["refs"], run["depth"]).write.mode("overwrite").csv(f"{out}/ref_count", sep="\t")
    run["chunks"].write.mode("overwrite").parquet(f"{out}/chunks")
    run["summary"].write.mode("overwrite").json(f"{out}/summary")


def write_command(spark: SparkSession, out: str, argv: list[str]) -> None:
    """The command line of a run, one row, beside its results."""
    spark.range(1).select(F.lit(" ".join(argv)).alias("value")).write.mode("overwrite").text(f"{out}/command_line")


def extract_sam(spark: SparkSession, path: str, refs: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """Noise profile of the records of SAM files with strands refs(ref_idx, name, seq); the mapping rate is of all records."""
    order.shared_dir(spark)
    records = order.written(sam.scan(spark, path), "records")
    return extract(sam.aligned(records), refs, out, records.count())


def extract(aligned: DataFrame, refs: DataFrame, out: str | None = None, n_reads: int | None = None) -> dict[str, DataFrame]:
    """Noise profile of alignments(read_id, ref_idx or ref_name, cigar, md, read [, ref_start]) with strands refs.

    With ref_name, refs(ref_idx, name, seq) give the index, and reads of no known reference count as unmapped.
    """
    order.shared_dir(aligned.sparkSession)
    n_reads = aligned.count() if n_reads is None else n_reads
    rows = profile.mapped(aligned.drop("seq", "ref_idx"), refs) if "ref_name" in aligned.columns else aligned.drop("seq").join(refs.select("ref_idx", "seq"), "ref_idx")
    rows = order.written(rows, "mapped")
    length = refs.agg(F.max(F.length("seq"))).first()[0] or 0
    events = order.written(profile.alignment_events(rows), "events")
    counts = order.written(profile.position_counts(rows), "counts")
    depth = refs.select("ref_idx").join(rows.groupBy("ref_idx").agg(F.count("*").alias("n_reads")), "ref_idx", "left").na.fill(0, ["n_reads"])
    kmers = {n: profile.kmer_counts(events, k) for k, n in (("S", "sub"), ("I", "ins"), ("D", "del"))}
    bases = profile.base_counts(events)
    found = {
        "positions": profile.position_rates(counts, length),
        "bases": bases,
        "depth": profile.depth_stats(depth),
        "fit": profile.fit_depth(depth),
        "summary": profile.overall(counts, bases, F.lit(n_reads), F.lit(rows.count())),
        **{f"kmer_{n}": profile.kmer_probabilities(c, "b4" if n == "del" else "out") for n, c in kmers.items()},
    }
    for name, df in found.items() if out else ():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def summary_line(profile_: dict[str, DataFrame]) -> DataFrame:
    """One row of 14 columns: a profile's depth, fit, rates and counts, to be appended to a table of profiles."""
    depth = profile_["depth"].select("n_refs", "n_covered", "mean_depth", "cv", "dropout")
    best = profile_["fit"].where("rank = 1").select(F.col("family").alias("distribution"), "aic")
    total = profile_["summary"].select("n_reads", "n_mapped", "mapping_rate", "covered", "sub_rate", "ins_rate", "del_rate")
    return depth.join(best, F.lit(True)).join(total, F.lit(True))  # one row each


def extractor_params(family: str, mean: float, cv: float) -> dict[str, float]:
    """Parameters as the extractor states them, which differ from the simulator's for three families.

    nbinom raises a spread that is too small to one it has, beta is symmetric with shapes of 2 on [0, mean], and
    exponential is given by its rate.
    """
    from ..functions.depth import depth_params

    if family == "exponential":
        return {"rate": 1 / mean}
    if family == "beta":
        return {"alpha": 2.0, "beta": 2.0, "low": 0.0, "scale": mean}
    if family == "nbinom":
        cv = max(cv, math.sqrt(1 / mean) * 1.01)
    return depth_params(family, mean, cv)


def rate_text(rate: Column) -> Column:
    """A rate with as many places as it needs: percent from 0.01 on, else per mille, else in powers of ten."""
    return F.when(rate == 0, "0").when(rate >= 0.01, F.format_string("%.2f%%", rate * 100)).when(rate >= 0.00001, F.format_string("%.4f%%", rate * 100)).otherwise(F.format_string("%.2e", rate))


def preview(reads: DataFrame, seed: int, first: int = 2) -> DataFrame:
    """(place, name, seq): the first rows of reads(place, name, seq) and one more, chosen by draw."""
    head = reads.orderBy("place").limit(first)
    more = reads.join(F.broadcast(head.select("place")), "place", "left_anti")
    one = more.orderBy(dna.mix(F.col("place"), 6, seed), "place").limit(1)
    return head.unionByName(one).select("place", "name", "seq")


def mapping_faults(allocated: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_idx, dealt, n_reads) of chunks that don't deal out exactly their reads; none if the mapping is whole."""
    dealt = allocated.groupBy("chunk_idx").agg(F.sum("n").alias("dealt"))
    rows = chunks.select("chunk_idx", "n_reads").join(dealt, "chunk_idx", "full_outer").na.fill(0, ["dealt", "n_reads"])
    return rows.where("dealt <> n_reads").select("chunk_idx", "dealt", "n_reads")
