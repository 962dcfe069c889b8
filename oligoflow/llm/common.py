"""Shared helpers: table access, the folder that all executors share, labelled samples, links to components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of ids that is broadcast to drop rows; above it the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows and bytes in one Arrow batch; documents may be long, so batches hold few of them.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Give freed memory back to the system: a worker that is used again would keep what its largest task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new one only on a local master without that setting, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/oligoflow/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_bucket(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = f"_{name}"
    return name


def sample_ids(candidates: DataFrame, key: str, per_class: int, classes: list) -> DataFrame:
    """At most per_class ids of each class, those with the smallest hash; the result is bounded, so it may be broadcast."""
    parts = [
        candidates.where(F.col(key) == F.lit(c)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in classes
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_ids(docs: DataFrame, dropped: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs but those whose id is in dropped (one column); broadcast only while the ids are few."""
    name = free_name(docs, "dropped_id")
    ids = dropped.select(F.col(column).alias(name)).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(ids, docs[column].eqNullSafe(F.col(name)), "left_anti")


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round hooks every node to the neighbour of least hash if that is less than its own, follows that pointer
    three hops more and contracts the edges. Hashes are new in every round, so pointers make short paths only, even
    along a chain in order of ids, and the rounds grow with the logarithm of a component's size. Edge rows for a hub
    are combined before the shuffle, joins are plain equi-joins that AQE can split, and each round's tables are
    written to the shared folder, which cuts the lineage.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-edges")
    found = None
    for number in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", F.lit(number)).alias("h"), "b")).alias("m"))
        up = F.when(F.col("m.h") < F.xxhash64("node", F.lit(number)), F.col("m.b")).otherwise(F.col("node"))
        hook = written(near.select("node", up.alias("up")), f"{label}-hook")
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(over, "up").select("node", F.col("top").alias("up"))
        hook = written(hook, f"{label}-up")
        if found is None:
            found = hook
        else:
            step = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            found = written(found.join(step, "up", "left").select("node", F.coalesce("top", "up").alias("up")), f"{label}-found")
        of_a = hook.select(F.col("node").alias("a"), F.col("up").alias("x"))
        of_b = hook.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(of_a, "a").join(of_b, "b").where("x <> y")
        edges = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
    else:
        raise RuntimeError(f"components of {label} did not settle in {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("up").agg(F.min("node").alias("component"))
    return written(found.join(least, "up").select("node", "component"), f"{label}-named")
