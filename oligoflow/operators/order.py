"""Numbering and ranking at scale: no window here gathers more than a bounded part of the rows in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Spark's setting by which a job's shuffle files are removed at its end.
ENDS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new one only on a local master without that setting, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: read again by column, and nothing before it is ever worked out twice."""
    path = f"{shared_dir(df.sparkSession)}/oligoflow/{label}-{uuid.uuid4().hex}"
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path, compression="zstd")  # bases take a third of what they'd take otherwise
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """What a job shuffles goes with the job, not when the driver happens to collect its garbage."""
    before = spark.conf.get(ENDS, None)
    spark.conf.set(ENDS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ENDS)
        else:
            spark.conf.set(ENDS, before)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that written gave; nothing may read them any more, what is yet to be worked out of them included."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent()
            folder.getFileSystem(conf).delete(folder, True)


def running(df: DataFrame, order: list[str], total: Column | None = None, ordinal: str = "ordinal", before: str = "before") -> DataFrame:
    """df with its 0-based ordinal in an order and, for total, the sum over all rows that come before.

    Rows are range-partitioned and sorted once; each partition numbers and sums up its own rows as they pass, and the
    partitions' counts and sums, one row for each partition, are carried on in front of it.
    """
    value = F.coalesce(total.cast("long"), F.lit(0).cast("long")) if total is not None else F.lit(0).cast("long")
    part = df.withColumn("_value", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mark", F.monotonically_increasing_id())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for rows in batches:
            values = rows.column("_value").to_numpy()
            upto = np.cumsum(values) + so_far
            yield rows.append_column("_inner", pa.array(upto - values))
            so_far = int(upto[-1]) if len(upto) else so_far

    if total is not None:
        part = part.mapInArrow(add_up, StructType([*part.schema.fields, StructField("_inner", LongType())]))
    part = written(part, "running").withColumn("_part", F.shiftright("_mark", 33))
    sums = part.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("_value").alias("_sum"))
    heads = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    sums = sums.select("_part", F.coalesce(F.sum("_rows").over(heads), F.lit(0)).alias("_rows0"), F.coalesce(F.sum("_sum").over(heads), F.lit(0)).alias("_sum0"))
    out = part.join(F.broadcast(sums), "_part")
    if total is not None:
        out = out.withColumn(before, F.col("_sum0") + F.col("_inner"))
    out = out.withColumn(ordinal, F.col("_rows0") + F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_value", "_inner", "_mark", "_part", "_rows0", "_sum0")


def largest_remainder(shares: DataFrame, group: list[str], share: str, total: str, key: str) -> DataFrame:
    """shares with whole numbers n that add up to total in each group: floors, then one each by (fraction, key) falling."""
    whole = F.floor(share)
    left = F.col(total) - F.sum(whole).over(Window.partitionBy(*group))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy((F.col(share) - whole).desc(), F.col(key).desc()))
    return shares.withColumn("n", (whole + F.when(rank <= left, 1).otherwise(0)).cast("long"))


def allocate(chunks: DataFrame, window: int) -> DataFrame:
    """(chunk_idx, target, n): each chunk's reads dealt to the chunks within a circular window, in proportion to size.

    chunks has chunk_idx from 0 without gaps, and n_reads. Shares become whole numbers by largest remainder, so every
    chunk deals out exactly its reads; each row meets 2 * window + 1 targets, however many chunks there are.
    """
    n = chunks.count()
    reach = min(window, (n - 1) // 2)
    near = chunks.withColumn("target", F.explode(F.sequence(F.col("chunk_idx") - reach, F.col("chunk_idx") + reach))).withColumn("target", F.pmod("target", F.lit(max(n, 1))))
    sizes = chunks.select(F.col("chunk_idx").alias("target"), F.col("n_reads").alias("room"))
    band = Window.partitionBy("chunk_idx")
    shares = near.join(sizes, "target").withColumn("share", F.col("n_reads") * F.col("room") / F.sum("room").over(band))
    return largest_remainder(shares, ["chunk_idx"], "share", "n_reads", "target").select("chunk_idx", "target", "n")


def as_of(left: DataFrame, at: str, right: DataFrame, start: str) -> DataFrame:
    """left with the columns of the right row that has the largest start not beyond at; null where there is none.

    Both sides are range-partitioned and sorted together, and the last right row is carried along as the rows pass; what
    a partition begins with comes from the partitions before it, one row each. Left rows that share a place are dealt out
    as well. No product of the sides is made, and neither side is broadcast. Of right rows with one start any may count.
    Rows without at match nothing, rows without start are left out.
    """
    clash = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    mine, theirs = left.schema.fields, right.schema.fields
    nulls = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    rows = right.where(F.col(start).isNotNull()).select(F.col(start).alias("_at"), F.lit(0).alias("_side"), *nulls(mine), *right.columns)
    rows = rows.unionByName(left.select(F.col(at).alias("_at"), F.lit(1).alias("_side"), *left.columns, *nulls(theirs)))
    keys = ["_at", "_side", "_tie"]
    ordered = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ordered = ordered.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    names = right.columns

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The left rows of one partition with what was carried, then, as _last, the last right row."""
        carried, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            side, part = batch.column("_side").to_numpy(), batch.column("_part").slice(0, 1)
            some = batch.select(names)
            # Row 0 is what was carried; a row behind the n-th right row of the batch takes row n.
            stock = pa.Table.from_batches([carried if carried is not None else pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in some.schema], schema=some.schema), some.filter(pa.array(side == 0))])
            which = np.cumsum(side == 0)
            last = stock.slice(len(stock) - 1, 1).combine_chunks().to_batches()
            keep = side == 1
            taken = stock.take(pa.array(which[keep])).combine_chunks()
            own = batch.filter(pa.array(keep))
            opened = pa.array((which[keep] == 0) & (carried is None))
            carried = last[0] if carried is not None or (side == 0).any() else None
            columns = [own.column(c) for c in own_names] + [taken[c].combine_chunks() if taken.num_rows else pa.nulls(0, some.schema.field(c).type) for c in names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.record_batch([*columns, own.column("_part"), opened, pa.array(np.zeros(own.num_rows, bool))], names=out_names)
        if part is not None:
            kinds = [f.type for f in batch.select(own_names).schema], [f.type for f in batch.select(names).schema]
            end = [carried.column(c) for c in names] if carried is not None else [pa.nulls(1, t) for t in kinds[1]]
            yield pa.record_batch([*(pa.nulls(1, t) for t in kinds[0]), *end, part, pa.array([carried is None]), pa.array([True])], names=out_names)

    own_names = left.columns
    out_names = [*own_names, *names, "_part", "_open", "_last"]
    free = lambda fields: [StructField(f.name, f.dataType) for f in fields]
    schema = StructType([*free(mine), *free(theirs), StructField("_part", LongType()), StructField("_open", BooleanType()), StructField("_last", BooleanType())])
    # Filled as the sorted rows pass: a table read again comes in any order of its files, and in parts of them.
    filled = written(ordered.mapInArrow(fill, schema), "as-of")
    lasts = filled.where("_last").select("_part", F.when(~F.col("_open"), F.struct(*names)).alias("_row"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    heads = lasts.select("_part", F.last("_row", ignorenulls=True).over(before).alias("_head"))
    found = filled.where("not _last").join(F.broadcast(heads), "_part")
    null_at = F.col(at).isNull()
    return found.select(*left.columns, *[F.when(~null_at, F.when(F.col("_open"), F.col(f"_head.{c}")).otherwise(F.col(c))).alias(c) for c in names])


def overlaps(rows: DataFrame, columns: DataFrame, row: str, column: str, row_start: str, row_size: str, column_start: str, column_size: str) -> DataFrame:
    """(row, column, n): how much the interval of each row has in common with that of each column; n is never 0.

    Rows and columns each lie one behind the other from 0, so every place where one of either begins is in one row and in
    one column, and the n of all places fill both margins. There are no more of them than rows and columns together.
    """
    r = rows.where(F.col(row_size) > 0).select(F.col(row), F.col(row_start).alias("_r0"), (F.col(row_start) + F.col(row_size)).alias("_r1"))
    c = columns.where(F.col(column_size) > 0).select(F.col(column), F.col(column_start).alias("_c0"), (F.col(column_start) + F.col(column_size)).alias("_c1"))
    places = r.select(F.col("_r0").alias("_p")).unionByName(c.select(F.col("_c0").alias("_p"))).distinct()
    met = as_of(as_of(places, "_p", r, "_r0"), "_p", c, "_c0")
    n = F.least("_r1", "_c1") - F.col("_p")
    return met.select(row, column, n.alias("n")).where("n > 0")
