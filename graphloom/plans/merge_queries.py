"""Deduplication, merge and integrity over the whole delivered tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, merge as m
from ..operators.graph_views import SQL_EDGES, SQL_GRAPH, clean_path, edges, nodes, sql_clean_path
from ..session import table

CUT = "2025-08-01 00:00:00"
_EDGE_KEY = ["from_id", "to_id", "connection_type", "file", "line"]


def component_dedup(spark, d):
    return m.best_per_key(table(spark, d, "components").select("component_type", "name", "file", "confidence", "seq", "component_id"), ["component_type", "name", "file"])


def connection_dedup(spark, d):
    return m.best_per_key(table(spark, d, "connections").select(*_EDGE_KEY, "confidence", "seq", "connection_id"), _EDGE_KEY)


def merged_components(spark, d):
    c = table(spark, d, "components").select("component_id", "name", "version", "status", "seq", "arrived_at")
    when = F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz")
    return m.merge_latest(c.where(when), c.where(~when), "component_id").select("component_id", "name", "version", "status", "seq")


def integrity_issues(spark, d):
    return m.integrity_issues(nodes(spark, d), edges(spark, d))


def file_node_owners(spark, d):
    return m.resolve_file_nodes(nodes(spark, d), edges(spark, d))


def _changed(spark, d):
    s = table(spark, d, "source_files").where(F.col("scanned_at") > F.lit(CUT).cast("timestamp_ntz"))
    return s.where("file is not null").select(clean_path(F.col("file")).alias("path")).distinct()


def rescan_walk_set(spark, d):
    return m.walk_set(_changed(spark, d), catalog.reverse_dependencies(nodes(spark, d), edges(spark, d)))


def rescan_kept_edges(spark, d):
    _, rest = m.keep_unchanged(nodes(spark, d), edges(spark, d), _changed(spark, d))
    return rest.select("connection_id")


QUERIES = {f.__name__: f for f in (component_dedup, connection_dedup, merged_components, integrity_issues, file_node_owners, rescan_walk_set, rescan_kept_edges)}

_P = sql_clean_path("file")
_CHANGED = f"changed AS (SELECT DISTINCT {_P} AS path FROM source_files WHERE file IS NOT NULL AND scanned_at > TIMESTAMP '{CUT}')"

SQL = {
    "component_dedup": "SELECT component_type, name, file, confidence, seq, component_id FROM components QUALIFY row_number() OVER (PARTITION BY component_type, name, file ORDER BY coalesce(confidence, -1) DESC, seq) = 1",
    "connection_dedup": "SELECT from_id, to_id, connection_type, file, line, confidence, seq, connection_id FROM connections QUALIFY row_number() OVER (PARTITION BY from_id, to_id, connection_type, file, line ORDER BY coalesce(confidence, -1) DESC, seq) = 1",
    "merged_components": f"SELECT component_id, name, version, status, seq FROM components WHERE component_id <> '' AND arrived_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY arrived_at >= TIMESTAMP '{CUT}' DESC, seq DESC) = 1",
    "integrity_issues": f"""{SQL_GRAPH}, r AS (SELECT connection_id, 'from' AS "end", from_id AS id FROM edges UNION ALL SELECT connection_id, 'to', to_id FROM edges)
      SELECT * FROM r WHERE id <> '' AND NOT starts_with(id, 'FILE:') AND id NOT IN (SELECT component_id FROM nodes)""",
    "file_node_owners": f"""{SQL_GRAPH}, o AS (SELECT repo, {_P} AS path, arg_max(component_id, seq) AS owner FROM nodes WHERE file <> '' GROUP BY 1, 2)
      SELECT e.connection_id, coalesce(a.owner, e.from_id) AS from_id, coalesce(b.owner, e.to_id) AS to_id FROM edges e
      LEFT JOIN o a ON starts_with(e.from_id, 'FILE:') AND a.repo = e.repo AND a.path = {sql_clean_path('substr(e.from_id, 6)')} LEFT JOIN o b ON starts_with(e.to_id, 'FILE:') AND b.repo = e.repo AND b.path = {sql_clean_path('substr(e.to_id, 6)')}""",
    "rescan_walk_set": f"""{SQL_GRAPH}, {_CHANGED}, i AS (SELECT to_id, {_P} AS importer FROM edges WHERE connection_type = 'imports' AND file IS NOT NULL),
      t AS (SELECT {sql_clean_path('substr(to_id, 6)')} AS target, importer FROM i WHERE to_id LIKE 'FILE:%' UNION ALL SELECT {sql_clean_path('n.file')}, importer FROM i JOIN nodes n ON n.component_id = i.to_id WHERE n.file IS NOT NULL)
      SELECT path FROM changed UNION SELECT importer FROM t JOIN changed ON path = target WHERE target <> importer""",
    "rescan_kept_edges": f"""{SQL_GRAPH}, {_CHANGED}, g AS (SELECT component_id FROM nodes WHERE {_P} IN (SELECT path FROM changed))
      SELECT connection_id FROM edges WHERE ({_P} IS NULL OR {_P} NOT IN (SELECT path FROM changed)) AND (from_id IS NULL OR from_id NOT IN (SELECT component_id FROM g))""",
}
