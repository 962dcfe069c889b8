"""Alignments as SAM text: eleven columns, tags as a map, flags as columns; written and read by Spark's text files.

Places in the text count from 1, here from 0. The sequence of a record stands in the reference's direction; reads of the
other strand are turned back in the column `sequenced`. Header lines may stand in any file of a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bits of a record's flag, and its columns; fixed values of the format.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048}
COLUMNS = ("read_id", "flag", "ref_name", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "template", "read", "quality")


def turned(seq: Column) -> Column:
    """The other strand, read from its own beginning."""
    return F.reverse(F.translate(seq, "ACGTacgtUuRYKMrykmBVDHbvdh", "TGCAtgcaAaYRMKyrmkVBHDvbhd"))


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def _given(column: Column) -> Column:
    return F.when(column != "*", column)


def parse(lines: DataFrame) -> DataFrame:
    """COLUMNS of lines(value) with pos as ref_start from 0, tags (name to value as text), md, one column for each of
    FLAGS, and sequenced, the read as it was sequenced.

    Header and empty lines are left out; * is null, and so is a place of 0. Lines of fewer than eleven columns, or whose
    flag or place is no number, raise an error.
    """
    f = F.split(F.col("value"), "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.col("value"), f.alias("_f"))
    at = lambda n: F.try_element_at("_f", F.lit(n))
    flag, pos = at(2).try_cast("int"), at(4).try_cast("int")
    stop = F.raise_error(F.concat(F.lit("bad alignment line: "), F.substring("value", 1, 200))).cast("boolean")
    good = (F.size("_f") >= 11) & flag.isNotNull() & pos.isNotNull()
    tag = lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 6, 1 << 30).alias("value"))
    tags = F.map_from_entries(F.transform(F.filter(F.slice("_f", F.lit(12), F.greatest(F.size("_f") - 11, F.lit(0))), lambda t: F.rlike(t, F.lit("^[A-Za-z][A-Za-z0-9]:[AifZHB]:"))), tag))
    rows = rows.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(stop)).select(
        at(1).alias("read_id"), flag.alias("flag"), _given(at(3)).alias("ref_name"), F.when(pos > 0, pos - 1).alias("ref_start"), at(5).try_cast("int").alias("mapq"), _given(at(6)).alias("cigar"),
        _given(at(7)).alias("mate_ref"), F.nullif(at(8).try_cast("int"), F.lit(0)).alias("mate_pos"), at(9).try_cast("int").alias("template"), _given(at(10)).alias("read"), _given(at(11)).alias("quality"), tags.alias("tags"),
    )
    rows = rows.select("*", F.try_element_at("tags", F.lit("MD")).alias("md"), *[has(F.col("flag"), n).alias(n) for n in FLAGS])
    return rows.withColumn("sequenced", F.when(F.col("reverse"), turned(F.col("read"))).otherwise(F.col("read")))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_name, length) of the header lines that name references."""
    lines = spark.read.text(path).where(F.col("value").startswith("@SQ\t"))
    field = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    return lines.select(field("SN").alias("ref_name"), field("LN").try_cast("long").alias("length")).distinct()


def aligned(records: DataFrame, primary: bool = False) -> DataFrame:
    """(read_id, ref_name, ref_start, cigar, md, read) of the records that are aligned, of all or of the primary ones.

    A record needs a reference, a place, a CIGAR and a sequence. One without MD covers its places and has no mark.
    """
    use = ~F.col("unmapped") & F.col("ref_name").isNotNull() & F.col("ref_start").isNotNull() & F.col("cigar").isNotNull() & F.col("read").isNotNull()
    if primary:
        use &= ~F.col("secondary") & ~F.col("supplementary")
    return records.where(use).select("read_id", "ref_name", "ref_start", "cigar", F.coalesce("md", F.lit("")).alias("md"), "read")


def mapping(records: DataFrame) -> DataFrame:
    """One row: records, those mapped by their flag, their share, records of the other strand, bases of all and of the mapped."""
    size = F.coalesce(F.length("read"), F.lit(0)).cast("long")
    found = records.agg(
        F.count("*").alias("n_reads"), F.count_if(~F.col("unmapped")).alias("n_mapped"), F.count_if(~F.col("unmapped") & F.col("reverse")).alias("n_reverse"),
        F.coalesce(F.sum(size), F.lit(0)).alias("n_bases"), F.coalesce(F.sum(F.when(~F.col("unmapped"), size)), F.lit(0)).alias("mapped_bases"),
    )
    return found.withColumn("mapping_rate", F.round(F.col("n_mapped") / F.greatest("n_reads", F.lit(1)), 8))


def write(rows: DataFrame, path: str, refs: DataFrame | None = None, compression: str | None = None) -> None:
    """rows(read_id, ref_name, ref_start, cigar, md, read [, unmapped, reverse]) as records, refs(ref_name, length) as header.

    Reads of the other strand stand in the reference's direction already. Unmapped ones lose place, CIGAR and MD, and
    stand as they were sequenced. With compression, a codec of Spark's text files, scan reads them all the same.
    """
    held = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    lost, other = held("unmapped"), held("reverse")
    text = lambda c, none="*": F.when(lost, none).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(none)))
    flag = F.when(lost, F.lit(FLAGS["unmapped"])).otherwise(F.when(other, F.lit(FLAGS["reverse"])).otherwise(F.lit(0)))
    seq = F.when(lost & other, turned(F.col("read"))).otherwise(F.col("read"))
    place = F.when(lost, "0").otherwise((F.coalesce("ref_start", F.lit(-1)) + 1).cast("string"))
    line = F.concat_ws(
        "\t", F.col("read_id").cast("string"), flag.cast("string"), text("ref_name"), place, F.when(lost, "0").otherwise("255"), text("cigar"), F.lit("*"), F.lit("0"), F.lit("0"),
        F.when(F.coalesce(seq, F.lit("")) == "", "*").otherwise(seq), F.lit("*"), F.when(~lost & F.col("md").isNotNull(), F.concat(F.lit("MD:Z:"), "md")),
    )
    rows.select(line.alias("value")).write.text(path, compression=compression)
    if refs is not None:
        refs.select(F.concat(F.lit("@SQ\tSN:"), "ref_name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value")).write.mode("append").text(path, compression=compression)
