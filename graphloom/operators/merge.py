"""Deduplication, merge and incremental upkeep of the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .graph_views import clean_path


def best_per_key(df: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """One row per key: the highest confidence, the first by ``order`` on ties; null keys are keys.

    An aggregate instead of a ranking, so that a hot key is combined in every task.
    """
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col(order)).alias("o"))).alias("__r"))
    return g.select(*keys, "__r.*").select(*df.columns)


def merge_latest(existing: DataFrame, incoming: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Union by key in which an incoming row wins over an existing one, and the last of either over earlier ones.

    Rows with a null or empty key are dropped, as they have no identity.
    """
    both = existing.withColumn("__s", F.lit(0)).unionByName(incoming.withColumn("__s", F.lit(1))).where(F.col(key) != "")
    rest = [c for c in existing.columns if c != key]
    g = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("__s", order)).alias("__r"))
    return g.select(key, "__r.*").select(*existing.columns)


def walk_set(changed: DataFrame, reverse_deps: DataFrame) -> DataFrame:
    """Changed paths and the files that import them, one hop: path."""
    importers = reverse_deps.join(changed.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select(F.col("importer").alias("path"))
    return changed.select("path").unionByName(importers).distinct()


def keep_unchanged(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prior state that a rescan of ``changed`` (path) leaves: components of other files, and edges that are
    neither in a changed file nor from a removed component."""
    paths = changed.select(F.col("path").alias("__p")).distinct()
    kept = nodes.join(paths, clean_path(F.col("file")) == F.col("__p"), "left_anti")
    gone = nodes.join(paths, clean_path(F.col("file")) == F.col("__p"), "left_semi").select(F.col("component_id").alias("from_id"))
    rest = edges.join(paths, clean_path(F.col("file")) == F.col("__p"), "left_anti").join(gone, "from_id", "left_anti")
    return kept, rest.select(*edges.columns)


def integrity_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose end is no component and no FILE: id: connection_id, end, id."""
    ends = F.array(F.struct(F.lit("from").alias("end"), F.col("from_id").alias("id")), F.struct(F.lit("to").alias("end"), F.col("to_id").alias("id")))
    refs = edges.select("connection_id", F.explode(ends).alias("e")).select("connection_id", "e.end", "e.id").where("id <> '' and not startswith(id, 'FILE:')")
    return refs.join(nodes.select(F.col("component_id").alias("id")), "id", "left_anti").select("connection_id", "end", "id")


def resolve_file_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with FILE: ends replaced by the component of the repo that owns the path (the last by seq): connection_id, from_id, to_id."""
    owner = nodes.where("file <> ''").groupBy("repo", clean_path(F.col("file")).alias("path")).agg(F.max_by("component_id", "seq").alias("owner"))
    path = lambda c: F.when(F.startswith(F.col(c), F.lit("FILE:")), clean_path(F.substring(F.col(c), 6, 1 << 30)))
    a = owner.select(F.col("repo").alias("ar"), F.col("path").alias("ap"), F.col("owner").alias("ao"))
    b = owner.select(F.col("repo").alias("br"), F.col("path").alias("bp"), F.col("owner").alias("bo"))
    j = edges.withColumn("fp", path("from_id")).withColumn("tp", path("to_id"))
    j = j.join(a, (F.col("repo") == F.col("ar")) & (F.col("fp") == F.col("ap")), "left").join(b, (F.col("repo") == F.col("br")) & (F.col("tp") == F.col("bp")), "left")
    return j.select("connection_id", F.coalesce("ao", "from_id").alias("from_id"), F.coalesce("bo", "to_id").alias("to_id"))
