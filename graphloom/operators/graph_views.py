"""The property graph over the delivered tables: one row per component, one per connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import table



def latest(df: DataFrame, key: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``key``: the one that arrived last (ties: largest seq). Rows without key are not entities.

    ``columns`` names what else is wanted (all if empty), so that the scan reads no more.
    """
    rest = [c for c in df.columns if c != key and (not columns or c in columns)]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("arrived_at", "seq")).alias("r"))
    return kept.select(key, "r.*")


def nodes(spark, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "components"), "component_id", columns)


def edges(spark, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "connections"), "connection_id", columns)


def clean_path(path: Column) -> Column:
    """A path in one spelling: forward slashes, no leading ./ or /, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+|^/", "")


def trimmed(text: Column) -> Column:
    """Without white space of any script at its ends (line ends and tabs included)."""
    return F.regexp_replace(text, r"^[\t\n\f\r\p{Z}]+|[\t\n\f\r\p{Z}]+$", "")


def ends(edges: DataFrame, nodes: DataFrame, prefix_from: str = "from_", prefix_to: str = "to_", columns: tuple[str, ...] = ("name", "component_type", "layer")) -> DataFrame:
    """Edges with the attributes of both ends (left joins; an unknown end has nulls). Hubs are split by AQE."""
    a = nodes.select(F.col("component_id").alias("__a"), *[F.col(c).alias(prefix_from + c) for c in columns])
    b = nodes.select(F.col("component_id").alias("__b"), *[F.col(c).alias(prefix_to + c) for c in columns])
    return edges.join(a, F.col("from_id") == F.col("__a"), "left").join(b, F.col("to_id") == F.col("__b"), "left")


#: The same two views in SQL, to be put behind WITH.
SQL_NODES = "nodes AS (SELECT * FROM components WHERE component_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY arrived_at DESC NULLS LAST, seq DESC) = 1)"
SQL_EDGES = "edges AS (SELECT * FROM connections WHERE connection_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY connection_id ORDER BY arrived_at DESC NULLS LAST, seq DESC) = 1)"
SQL_GRAPH = f"WITH {SQL_NODES},\n{SQL_EDGES}"


def sql_clean_path(path: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({path}, '\', '/'), '/+', '/', 'g'), '^(\./)+|^/', '')"


def sql_trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^[\t\n\f\r\p{{Z}}]+|[\t\n\f\r\p{{Z}}]+$', '', 'g')"
