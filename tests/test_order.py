"""As-of joins and two-sided allocation against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from oligoflow.operators import order
from oligoflow.plans import queries
from oligoflow.plans.queries import prepare


@pytest.mark.parametrize(("n", "m", "parts", "hot"), [(500, 60, 5, False), (300, 1, 4, True), (40, 200, 3, False), (20, 0, 2, False), (0, 5, 2, False)])
def test_as_of(spark, n, m, parts, hot):
    prepare(spark)
    rng = random.Random(n)
    starts = sorted(rng.sample(range(1000), m))
    lefts = [(i, 500 if hot and i % 2 else rng.randint(-5, 1100)) for i in range(n)] + [(n, None)]
    left = spark.createDataFrame(lefts, "id long, at long").repartition(parts)
    right = spark.createDataFrame([(s, f"v{s}") for s in starts] + [(None, "lost")], "start long, name string").repartition(parts)
    got = {r.id: (r.at, r.start, r.name) for r in order.as_of(left, "at", right, "start").collect()}
    assert len(got) == n + 1
    for i, at in lefts:
        k = bisect.bisect_right(starts, at) - 1 if at is not None else -1
        assert got[i] == (at, starts[k] if k >= 0 else None, f"v{starts[k]}" if k >= 0 else None)


def test_as_of_when_files_are_read_in_another_order(spark):
    """All written files in one task, the largest first, and in one case cut into many parts."""
    prepare(spark)
    held = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1", "spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in held}
    left = spark.range(20_000).select(F.col("id").alias("at"))
    right = spark.range(0, 3000, 7).select((F.col("id") * F.col("id") % 20_011).alias("start")).distinct()
    starts = sorted(r.start for r in right.collect())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.at: r.start for r in order.as_of(left, "at", right, "start").collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    places = [bisect.bisect_right(starts, at) - 1 for at in range(20_000)]
    assert got == {at: starts[k] if k >= 0 else None for at, k in enumerate(places)}


def test_as_of_makes_no_product(spark):
    prepare(spark)
    left, right = spark.range(1000).select(F.col("id").alias("at")), spark.range(0, 1000, 10).select(F.col("id").alias("start"))
    plan = order.as_of(left, "at", right, "start")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="columns of both sides"):
        order.as_of(left, "at", left, "at")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_margins_are_met(spark, seed):
    prepare(spark)
    rng = random.Random(seed)

    def pieces(total, n):
        edges = [0, *sorted(rng.choices(range(total + 1), k=n - 1)), total]
        return [(i, a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    rows, columns = pieces(5000, 40), pieces(5000, 23)
    found = order.overlaps(spark.createDataFrame(rows, "r long, r0 long, rn long"), spark.createDataFrame(columns, "c long, c0 long, cn long"), "r", "c", "r0", "rn", "c0", "cn").collect()
    got = {(x.r, x.c): x.n for x in found}
    assert len(got) == len(found) <= len(rows) + len(columns)
    want = {(r, c): min(r0 + rn, c0 + cn) - max(r0, c0) for r, r0, rn in rows for c, c0, cn in columns if min(r0 + rn, c0 + cn) > max(r0, c0)}
    assert got == want
    for r, _, rn in rows:
        assert sum(n for (x, _), n in got.items() if x == r) == rn
    for c, _, cn in columns:
        assert sum(n for (_, x), n in got.items() if x == c) == cn


def test_documents_without_reads_take_nothing(spark, tmp_path):
    """As overlaps says, no part is 0: neither the query's nor its SQL's."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(i, "x") for i in range(2000)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.QUERIES["alloc_capacity"](spark, str(tmp_path)).collect()}
    documents = duckdb.connect()
    documents.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = documents.execute(queries.SQL["alloc_capacity"]).fetchall()
    assert got == set(want) and len({d for _, d, _ in got}) < 2000 and min(n for _, _, n in want) > 0
