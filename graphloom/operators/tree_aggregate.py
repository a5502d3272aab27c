"""Per-key results when a few keys hold most of the records.

Rows are first collapsed to exact, mergeable states; the states of one key are spread over chunks and merged
through rounds of a fixed fan-in, so no reducer ever receives more than ``fan_in`` states per key and map task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Rows that one chunk of the lowest level stands for.
CHUNK_ROWS = 100_000


def chunks_for(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    return max(1, math.ceil(rows / chunk_rows))


def merge_rounds(chunks: int, fan_in: int) -> list[int]:
    """Number of chunks after each round: 40 chunks with fan-in 8 give [5, 1]."""
    out = []
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        out.append(chunks)
    return out


def tree_merge(states: DataFrame, keys: list[str], merges: dict[str, Column], spread_by: list[str], chunks: int, fan_in: int = 8) -> DataFrame:
    """Merge ``states`` (one row per key and ``spread_by``) to one row per key.

    ``merges`` maps each state column to the aggregate that merges it. A value of ``spread_by`` always lands in
    the same chunk, so counts of distinct values of it add up across chunks exactly.
    """
    level = states.withColumn("__chunk", F.pmod(F.xxhash64(*spread_by), F.lit(chunks)).cast("int"))
    aggs = [expr.alias(name) for name, expr in merges.items()]
    level = level.groupBy(*keys, "__chunk").agg(*aggs)
    for left in merge_rounds(chunks, fan_in):
        level = level.withColumn("__chunk", F.pmod(F.col("__chunk"), F.lit(left)).cast("int")).groupBy(*keys, "__chunk").agg(*aggs)
    return level.drop("__chunk")


def target_summary(connections: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = 8) -> DataFrame:
    """Edges, distinct callers, confidence and last detection of every target ``to_id``.

    Columns: to_id, row_count (all rows), edges (distinct pairs of caller and connection_id: re-deliveries count
    once), callers (distinct non-empty from_id), confidence_rows, avg_confidence, min_confidence, max_confidence
    (over all rows that have one), last_detected.

    Null and empty ``to_id`` are targets of their own (the rows are kept, not dropped). A null connection_id counts
    as one edge per caller; a null or empty from_id is an edge but no caller. An empty table gives no rows.
    """
    conf = F.col("confidence").cast("decimal(18,9)")
    base = connections.select("to_id", "from_id", "connection_id", conf.alias("c"), "detected_at")
    state = {
        "row_count": F.sum("row_count"),
        "confidence_rows": F.sum("confidence_rows"),
        "confidence_sum": F.sum("confidence_sum"),
        "min_c": F.min("min_c"),
        "max_c": F.max("max_c"),
        "last_detected": F.max("last_detected"),
    }
    edges = base.groupBy("to_id", "from_id", "connection_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("c").alias("confidence_rows"),
        F.sum("c").cast("decimal(38,9)").alias("confidence_sum"),
        F.min("c").alias("min_c"),
        F.max("c").alias("max_c"),
        F.max("detected_at").alias("last_detected"),
    )
    merged = {k: v.cast("decimal(38,9)") if k == "confidence_sum" else v for k, v in state.items()}
    pairs = edges.groupBy("to_id", "from_id").agg(F.count(F.lit(1)).alias("edges"), *[v.alias(k) for k, v in merged.items()])
    pairs = pairs.withColumn("callers", F.when(F.coalesce(F.col("from_id"), F.lit("")) != "", 1).otherwise(0).cast("long"))
    merged |= {"edges": F.sum("edges"), "callers": F.sum("callers")}
    out = tree_merge(pairs, ["to_id"], merged, ["from_id"], chunks_for(connections.count(), chunk_rows), fan_in)
    return out.select(
        "to_id",
        "row_count",
        "edges",
        "callers",
        "confidence_rows",
        F.round(F.try_divide(F.col("confidence_sum").cast("double"), F.col("confidence_rows")), 6).alias("avg_confidence"),
        F.col("min_c").cast("double").alias("min_confidence"),
        F.col("max_c").cast("double").alias("max_confidence"),
        "last_detected",
    )


def counted_against_recorded(components: DataFrame, summary: DataFrame) -> DataFrame:
    """Each component's recorded ``connections`` beside the counted edges: component_id, recorded, counted, difference.

    Of several rows of a component the one that arrived last holds (ties: the largest seq). A null recorded number
    stays null, as does its difference. Components without edges count 0. Both sides are unique per key when they
    meet, so the join cannot be skewed.
    """
    last = components.where("component_id is not null").groupBy("component_id").agg(F.max_by("connections", F.struct("arrived_at", "seq")).alias("recorded"))
    counts = summary.select(F.col("to_id").alias("component_id"), F.col("edges").alias("counted"))
    joined = last.join(counts, "component_id", "left")
    counted = F.coalesce("counted", F.lit(0).cast("long"))
    return joined.select("component_id", "recorded", counted.alias("counted"), (counted - F.col("recorded")).alias("difference"))
