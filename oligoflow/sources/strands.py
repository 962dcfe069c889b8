"""Strands from tables of text, and the text formats that strands, plans, clusters and alignments come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch as kernel
from ..operators.order import running


def segments(rows: DataFrame, key: str, data: Column, size: int = 32, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, seg, payload hex) of each row's bytes, cut into pieces of size bytes, the last padded with zero bytes.

    The cut is made in the bytes, where a place is found at once, and each piece is spelt out by itself.
    """
    n = F.ceil(F.length("_data") / size).cast("int")
    cut = rows.select(key, *keep, data.alias("_data")).where(F.length("_data") > 0).withColumn("seg", F.explode(F.sequence(F.lit(0), n - 1)))
    piece = F.rpad(F.lower(F.hex(F.substring("_data", F.col("seg") * size + 1, F.lit(size)))), 2 * size, "0")
    return cut.select(key, *keep, "seg", piece.alias("payload"))


#: Strands in one batch that leaves a task, and strands that a task cuts, so that none grows with the tables.
STRANDS_AT_ONCE, STRANDS_IN_TASK = 10_000, 1 << 18


def tasks_for(spark: SparkSession, n: int, most: int) -> int:
    """Tasks of at most about `most` of n pieces of work, as many for each core."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-n // (most * cores)))


def places_of(rows: DataFrame, key: str, text: str, size: int = 32) -> DataFrame:
    """(key, n, base) of each text: its strands and the number of the first; a written table of numbers alone."""
    sizes = rows.select(key, F.ceil(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / size).cast("long").alias("n"))
    return running(sizes, [key], F.col("n"), before="base").select(key, "n", "base")


def strand_ids(places: DataFrame, *columns: str) -> DataFrame:
    """(*columns, ref_idx): the number of every strand, without its bases."""
    return places.where("n > 0").select(*columns, F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)).alias("ref_idx"))


def strands_of(rows: DataFrame, key: str, text: str, size: int = 32, places: DataFrame | None = None, draw: tuple[list[int], int] | None = None, then: tuple[Callable, str] | None = None, ordered: bool = False) -> DataFrame:
    """(ref_idx, key, seg, seq): strands of 4 * size bases; ref_idx numbers them by key (unique), then segment.

    Rows meet their first number before they are cut, so whole rows are joined and strands never are. The join deals
    the rows by key, so that the work after it is shared out even where a file can't be read in parts, over as many
    tasks as the strands need. With draw, the bounds and the seed of a depth, there are n_reads and first_read as well,
    counted on from the column first of places, the reads before each text. With then, a function of a task's batches
    and the schema of what it gives, strands are handed on to it as they are cut and never leave their task.

    If ordered, tasks have the strands in the order of their numbers, one task's behind the other's: texts are sorted
    together with their places, moved once, and no strand is.
    """
    places = places_of(rows, key, text, size) if places is None else places
    carried = ["base"] if draw is None else ["base", "first"]
    texts = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    tasks = tasks_for(rows.sparkSession, places.agg(F.sum("n")).first()[0] or 0, STRANDS_IN_TASK)
    numbers = places.select(key, *[F.col(c).alias(f"_{c}") for c in carried])
    if ordered:
        joined = _beside(texts, numbers, key, tasks)
    else:
        joined = texts.repartition(tasks, key).join(numbers.repartition(tasks, key).hint("merge"), key)
    names = ["ref_idx", key, "seg", "seq"] + (["n_reads", "first_read"] if draw else [])
    bounds = np.array(draw[0], np.int64) if draw else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.text_bytes(batch.column("_text"))
            counts = -(-np.diff(offsets) // size)
            ends = np.cumsum(counts)
            low = 0
            while low < batch.num_rows:  # rows of STRANDS_AT_ONCE strands in all, or one of more
                high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + STRANDS_AT_ONCE, side="right")))
                yield from some(batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], counts[low:high])
                low = high

    def some(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        firsts = np.cumsum(counts) - counts
        padded = np.zeros(counts.sum() * size, np.uint8)
        for first, start, end in zip((firsts * size).tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            padded[first : first + end - start] = data[start:end]
        row = np.repeat(np.arange(batch.num_rows), counts)
        seg = np.arange(len(row)) - np.repeat(firsts, counts)
        ref = batch.column("_base").to_numpy()[row] + seg
        if draw:
            n = np.searchsorted(bounds, kernel.draws(ref, 0, draw[1]).astype(np.int64), side="right")
            before = kernel.before_in_row(row, n) + batch.column("_first").to_numpy()[row]
        for at in range(0, len(row), STRANDS_AT_ONCE):
            part = slice(at, at + STRANDS_AT_ONCE)
            letters = kernel.encoded(padded[at * size : (at + STRANDS_AT_ONCE) * size])
            seqs = kernel.strings(letters, np.arange(len(row[part]) + 1) * 4 * size)
            depth = [pa.array(n[part]), pa.array(before[part])] if draw else []
            yield pa.record_batch([pa.array(ref[part]), batch.column(key).take(pa.array(row[part])), pa.array(seg[part], pa.int32()), seqs, *depth], names=names)

    kinds = f"ref_idx long, `{key}` {dict(rows.dtypes)[key]}, seg int, seq string" + (", n_reads long, first_read long" if draw else "")
    if then:
        work, kinds = then
        return joined.mapInArrow(lambda batches: work(cut(batches)), kinds)
    return joined.mapInArrow(cut, kinds)


def _beside(texts: DataFrame, numbers: DataFrame, key: str, tasks: int) -> DataFrame:
    """texts(key, _text) with the columns of numbers(key, ...), sorted by key over tasks; what stands on one side alone is left out."""
    names = [c for c in numbers.columns if c != key]
    rows = numbers.select(key, F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_text"), *names)
    rows = rows.unionByName(texts.select(key, F.lit(1).alias("_side"), "_text"), allowMissingColumns=True).where(F.col(key).isNotNull())
    rows = rows.repartitionByRange(tasks, key).sortWithinPartitions(key, "_side")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the numbers that came last, whose text may come in the next batch
        for batch in batches:
            ours = batch.column("_side").to_numpy() == 0
            some = batch.select([key, *names]).filter(pa.array(ours))
            stock = pa.Table.from_batches([some] if last is None else [last, some])
            at = np.cumsum(ours)[~ours] - (last is None)
            own = batch.select([key, "_text"]).filter(pa.array(~ours))
            own, at = own.filter(pa.array(at >= 0)), at[at >= 0]
            found = stock.take(pa.array(at)).combine_chunks()
            same = pa.array(np.array(found[key].to_pylist(), object) == np.array(own.column(key).to_pylist(), object), pa.bool_())
            columns = [found[c].chunk(0) if len(at) else pa.nulls(0, found.schema.field(c).type) for c in names]
            if len(at):
                yield pa.record_batch([*own.columns, *columns], names=[key, "_text", *names]).filter(same)
            if len(stock):
                last = stock.slice(len(stock) - 1).combine_chunks().to_batches()[0]

    kinds = dict(numbers.dtypes)
    return rows.mapInArrow(pair, ", ".join([f"`{key}` {kinds[key]}", "_text string", *(f"{c} {kinds[c]}" for c in names)]))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files, to be cut by segments."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, name, seq) of two-line records; place is the record's number in its file's order of reading."""
    blocks = spark.read.option("lineSep", ">").text(path).withColumn("place", F.monotonically_increasing_id()).where("value <> ''")
    lines = F.split(F.rtrim(F.regexp_replace("value", "[\\r\\n]+$", "")), "\\r?\\n", 2)
    return blocks.select("place", lines[0].alias("name"), F.regexp_replace(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")), "\\s+$", "").alias("seq"))


def write_fasta(rows: DataFrame, path: str, name: Column, seq: Column, order: list[str] | None = None, compression: str | None = None) -> None:
    """Two-line records in an order, or as the rows come."""
    lines = rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])])
    if order:
        lines = lines.repartitionByRange(*[f"_o{i}" for i in range(len(order))]).sortWithinPartitions(*[f"_o{i}" for i in range(len(order))])
    lines.select("value").write.text(path, compression=compression)


def validate(strands: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: n, min_len, max_len, bad_bases (rows with another letter than ATCG or none), valid."""
    found = strands.agg(
        F.count("*").alias("n"),
        F.min(F.length(seq)).cast("long").alias("min_len"),
        F.max(F.length(seq)).cast("long").alias("max_len"),
        F.count_if(~F.rlike(seq, F.lit("^[ATCG]+$"))).alias("bad_bases"),
    )
    return found.withColumn("valid", (F.col("n") > 0) & (F.col("bad_bases") == 0) & (F.col("min_len") == F.col("max_len")))


def parse_copy_plan(lines: DataFrame, n_refs: int) -> DataFrame:
    """(ref_idx, n) of lines `index count` (1-based); raises on bad numbers, repeats or an index over n_refs."""
    fields = F.split(F.trim("value"), "\\s+")
    rows = lines.where(F.trim("value") != "").select(F.try_element_at(fields, F.lit(1)).try_cast("long").alias("i"), F.try_element_at(fields, F.lit(2)).try_cast("long").alias("n"))
    repeated = F.count("*") > 1
    plan = rows.groupBy("i").agg(F.max("n").alias("n"), repeated.alias("_twice"), F.count_if(F.col("n").isNull()).alias("_bad"))
    wrong = F.col("i").isNull() | (F.col("_bad") > 0) | F.col("_twice") | (F.col("i") < 1) | (F.col("i") > n_refs)
    stop = F.raise_error(F.concat(F.lit("bad copy plan at index "), F.coalesce(F.col("i").cast("string"), F.lit("?")))).cast("boolean")
    return plan.where(F.when(wrong, stop).otherwise(F.col("n") > 0)).select((F.col("i") - 1).alias("ref_idx"), "n")


def parse_error_plan(lines: DataFrame, n_reads: int) -> DataFrame:
    """(read_idx, pos, etype, base, line_no) of lines `read pos type base` (1-based); rows with line_no and value.

    Raises on a type outside S, I, D, on a base outside ATGC (255 for D) and on bad numbers; reads that don't exist
    are left out.
    """
    at = lambda k: F.try_element_at("_f", F.lit(k))
    # A generated column: a line is split once, not again for every place that its fields are looked at.
    split = lines.where(F.trim("value") != "").select("line_no", F.explode(F.array(F.split(F.trim("value"), "\\s+"))).alias("_f"))
    rows = split.select(at(1).try_cast("long").alias("r"), at(2).try_cast("int").alias("p"), F.upper(at(3)).alias("t"), F.upper(at(4)).alias("b"), "line_no")
    good = F.col("r").isNotNull() & (F.col("p") >= 1) & (((F.col("t") == "D") & (F.col("b") == "255")) | (F.col("t").isin("S", "I") & F.col("b").isin(*"ATGC")))
    stop = F.raise_error(F.concat(F.lit("bad error plan at line "), F.col("line_no").cast("string"))).cast("boolean")
    kept = rows.where(F.when(F.coalesce(good, F.lit(False)), F.col("r").between(1, n_reads)).otherwise(stop))
    return kept.select((F.col("r") - 1).alias("read_idx"), (F.col("p") - 1).alias("pos"), F.col("t").alias("etype"), F.when(F.col("t") != "D", F.col("b")).alias("base"), "line_no")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, ord, read_id) of a cluster report: `>Cluster n` and member lines holding `>read_id...`."""
    blocks = spark.read.option("lineSep", ">Cluster").text(path).where(F.trim("value") != "")
    members = F.regexp_extract_all("value", F.lit(r">(\S+?)\.\.\."), F.lit(1))
    return blocks.select(F.regexp_extract("value", r"^\s*(\d+)", 1).alias("cluster_id"), F.posexplode(members).alias("ord", "read_id"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    """clusters(cluster_id, ord, read_id) as a cluster report, one record for each cluster."""
    member = F.concat(F.col("ord").cast("string"), F.lit("\t0nt, >"), F.col("read_id"), F.lit("... *"))
    grouped = clusters.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("ord", member.alias("line")))).alias("m"))
    grouped.select(F.concat(F.lit(">Cluster "), F.col("cluster_id").cast("string"), F.lit("\n"), F.array_join("m.line", "\n")).alias("value")).write.text(path)


def decoder_lines(lines: DataFrame) -> DataFrame:
    """(coverage, dna) of `coverage<tab>dna` or `dna` lines; headers and lines with N are left out."""
    kept = lines.where(~F.col("value").startswith(">") & ~F.col("value").contains("N") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), "\\t")
    return kept.select(F.when(F.size(f) > 1, f[0].try_cast("int")).otherwise(1).alias("coverage"), F.element_at(f, -1).alias("dna"))
