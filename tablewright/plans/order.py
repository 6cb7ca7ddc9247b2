"""Row order as data: ordinals, and groups of adjacent rows with equal keys, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.sources.scratch import scratch


def bucketed(df: DataFrame, rid: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``_bucket``: ranges of the numeric order column ``rid`` of about equal row counts."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(F.col(rid).cast("long"), [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return df.withColumn("_bucket", F.lit(0))
    edges = F.array(*[F.lit(b) for b in bounds])
    return df.withColumn("_bucket", F.size(F.filter(edges, lambda b: b <= F.col(rid).cast("long"))))


def _running(df: DataFrame, per_row: Column, rid: str) -> DataFrame:
    """Adds ``_sum``, the running sum of ``per_row`` in order of ``rid`` over all buckets.

    Every bucket's rows are summed in a window of their own; the buckets' totals, a row each, are added up and
    joined back. Their number is that of shuffle partitions, so that join is a broadcast of bounded size.
    """
    local = df.withColumn("_own", per_row)
    within = Window.partitionBy("_bucket").orderBy(rid).rowsBetween(Window.unboundedPreceding, 0)
    totals = local.groupBy("_bucket").agg(F.sum("_own").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return local.withColumn("_run", F.sum("_own").over(within)).join(F.broadcast(offsets), "_bucket").withColumn("_sum", F.col("_run") + F.col("_before")).drop("_own", "_run", "_before")


def islands(df: DataFrame, keys: list[Column], rid: str, name: str = "_gid", buckets: int | None = None) -> DataFrame:
    """``df`` with the run of adjacent equal keys that each row is in, in order of ``rid`` (unique, numeric).

    A run is named by the rid of its first row, so names ascend with the order. Rows move once, to their bucket, where
    runs are found; then buckets' ends, a row each, tell which of them go on into the next bucket. Their number is that
    of shuffle partitions, so that join is a broadcast of bounded size.
    """
    own = bucketed(df, rid, buckets).withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    in_order = Window.partitionBy("_bucket").orderBy(rid)
    # A bucket's first row begins a run of its own for now.
    own = own.withColumn("_before", F.lag("_key").over(in_order))
    begins = F.when(F.col("_before").isNull() | ~F.col("_key").eqNullSafe(F.col("_before")), F.col(rid))
    own = own.withColumn("_run", F.max(begins).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = own.groupBy("_bucket").agg(F.min_by("_key", rid).alias("_first"), F.max_by("_key", rid).alias("_last"), F.min("_run").alias("_head"), F.max("_run").alias("_tail"))
    order = Window.orderBy("_bucket")
    ends = ends.withColumn("_goes_on", F.col("_first").eqNullSafe(F.lag("_last").over(order)))
    # Where a bucket's last run begins, unless all of the bucket goes on from the one before.
    known = F.when(~F.col("_goes_on") | (F.col("_tail") != F.col("_head")), F.col("_tail"))
    before = F.max(known).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_bucket", "_head", F.when(F.col("_goes_on"), before).otherwise(F.col("_head")).alias("_true"))
    joined = own.join(F.broadcast(ends), "_bucket").withColumn(name, F.when(F.col("_run") == F.col("_head"), F.col("_true")).otherwise(F.col("_run")))
    return joined.drop("_bucket", "_key", "_before", "_run", "_head", "_true")


def ordinals(df: DataFrame, rid: str, name: str = "_line", buckets: int | None = None) -> DataFrame:
    """``df`` with each row's number from 1 in order of ``rid``."""
    return _running(bucketed(df, rid, buckets), F.lit(1), rid).withColumnRenamed("_sum", name).drop("_bucket")


def running(df: DataFrame, group: list[str], rid: str, sums: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """``df`` with running sums within its group in order of ``rid``, the own row included; a group is split over ranges of ``rid``."""
    own = bucketed(df, rid, buckets).withColumns({f"_own_{name}": value for name, value in sums.items()})
    totals = own.groupBy("_bucket", *group).agg(*[F.sum(f"_own_{name}").alias(f"_own_{name}") for name in sums])
    above = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_own_{name}").over(above), F.lit(0)).alias(f"_before_{name}") for name in sums]
    offsets = totals.select(F.col("_bucket").alias("_b"), *[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], *before)
    within = Window.partitionBy("_bucket", *group).orderBy(rid).rowsBetween(Window.unboundedPreceding, 0)
    local = own.withColumns({f"_own_{name}": F.sum(f"_own_{name}").over(within) for name in sums})
    same = [F.col("_bucket") == F.col("_b"), *[F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)]]
    return local.join(offsets, same).select(*df.columns, *[(F.col(f"_own_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums])


def places(df: DataFrame, group: list[str], rid: str, name: str = "_place", buckets: int | None = None) -> DataFrame:
    """``df`` with each row's number from 1 within its group in order of ``rid``."""
    return running(df, group, rid, {name: F.lit(1).cast("long")}, buckets)


def before_in_order(totals: DataFrame, key: str, total: str, name: str) -> DataFrame:
    """(key, name): the sum of ``total`` over all rows of smaller ``key``, which is unique but may be of any type that sorts.

    Rows are dealt by ranges of the key and written with their range, so that ranges stay as they are; their sums, a row
    each, are added up and joined back.
    """
    spark = totals.sparkSession
    path = scratch(spark, "ranges")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals.select(key, total).repartitionByRange(n, key).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    up_to = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy("_range").agg(F.sum(total).alias("_sum")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(up_to.orderBy("_range")), F.lit(0)).alias("_ahead"))
    local = F.coalesce(F.sum(total).over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_local", local).join(F.broadcast(ranges), F.col("_range") == F.col("_r")).select(key, (F.col("_local") + F.col("_ahead")).alias(name))
