"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: A lookup side is broadcast up to this many bytes (measured on the data, not estimated by the planner).
BROADCAST_BYTES = 16 << 20


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df``: strings by their length, everything else as 16 bytes."""
    parts = [F.coalesce(F.octet_length(c) if t == "string" else F.lit(16), F.lit(0)) + F.lit(16) for c, t in df.dtypes]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.agg(F.sum(total.cast("long")).alias("b")).first()["b"] or 0


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int = 256) -> list[tuple]:
    """Keys that hold more than 1/``parts`` of the rows: at most ``parts`` of them by arithmetic.

    Counted over all rows with a map-side combine. Keys with a null never join and are left out.
    """
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return [tuple(r[k] for k in keys) for r in counts.where(F.col("__n") > max(1, total // parts)).collect()]


def join_lookup(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join every row of ``big`` with ``lookup`` (unique by ``keys``), whatever the distribution of keys.

    ``lookup`` should be materialised. Measured at or under ``limit`` it is broadcast. Beyond that, the rows of
    hot keys (at most 256, each over 1/256 of the rows) are joined with a broadcast of just those lookup rows,
    and all others through a shuffle in which no key can hold more than 1/256 of the rows.
    ``how`` is ``inner``, ``left`` or ``left_anti``.
    """
    keys = list(keys)
    if measured_bytes(lookup) <= limit:
        return big.join(F.broadcast(lookup), keys, how)
    hot = hot_keys(big, keys)
    if not hot:
        return big.join(lookup, keys, how)
    spark = big.sparkSession
    hot_df = F.broadcast(spark.createDataFrame(hot, schema=lookup.select(*keys).schema))
    hot_rows, rest = big.join(hot_df, keys, "left_semi"), big.join(hot_df, keys, "left_anti")
    hot_lookup = lookup.join(hot_df, keys, "left_semi")
    return hot_rows.join(F.broadcast(hot_lookup), keys, how).unionByName(rest.join(lookup, keys, how))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Adds ``position`` (from 1) of each row among the rows of its keys by ``order``, which should be total.

    A window over the keys would sort a hot key in one task. Instead rows are range-partitioned by keys and order and
    numbered within partitions, and the counts of the partitions before (one row per partition and key) are added.
    Rows with a null key are left out.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut(df.dropna(subset=keys).repartitionByRange(*keys, *order).withColumn("__pid", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__pid", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    at = F.row_number().over(Window.partitionBy("__pid", *keys).orderBy(*order))
    return placed.withColumn("__at", at).join(counts, [*keys, "__pid"]).select(*df.columns, (F.col("__at") + F.col("__ahead")).alias("position"))
