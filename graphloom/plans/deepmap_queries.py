"""Packets, summary and diagram of the whole graph, each beside its SQL."""

from __future__ import annotations

from ..operators import deepmap as m
from ..operators.graph_views import SQL_GRAPH, edges, nodes
from .graph_queries import _RULES, _known, _rule_rows


def packet_groups(spark, d):
    return m.packet_groups(nodes(spark, d, "repo", "layer"), edges(spark, d, "from_id", "to_id"))


def executive_summary(spark, d):
    n = _known(spark, d)
    return m.executive_summary(n, _rule_rows(spark, d, n))


def top_diagram(spark, d):
    return m.diagram_lines(nodes(spark, d, "name"), edges(spark, d, "from_id", "to_id", "connection_type"))


QUERIES = {f.__name__: f for f in (packet_groups, executive_summary, top_diagram)}

_DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) WHERE id IS NOT NULL GROUP BY 1)"

SQL = {
    "packet_groups": f"""{SQL_GRAPH}, {_DEGREE}, s AS (SELECT n.repo, n.component_id, coalesce(n.layer, 'external') AS layer, coalesce(d.degree, 0) AS degree, count(*) OVER (PARTITION BY n.repo, coalesce(n.layer, 'external')) AS n FROM nodes n LEFT JOIN deg d ON d.id = n.component_id),
      l AS (SELECT *, CASE WHEN n < {m.MIN_GROUP} THEN 'residual' ELSE 'layer-' || layer END AS label FROM s WHERE repo IS NOT NULL)
      SELECT repo, label, CAST((row_number() OVER (PARTITION BY repo, label ORDER BY degree DESC, component_id) - 1) // {m.NODES_PER_PACKET} + 1 AS INTEGER) AS part, component_id FROM l""",
    "executive_summary": _RULES
    + """SELECT severity, type, count(*) AS items FROM (SELECT 'critical' AS severity, 'architecture_rule' AS type FROM rule_rows WHERE severity = 'error' AND rule_id <> 'vulnerable-dependency'
      UNION ALL SELECT CASE status WHEN 'vulnerable' THEN 'critical' WHEN 'deprecated' THEN 'high' WHEN 'outdated' THEN 'medium' WHEN 'unused' THEN 'low' END, status FROM nodes WHERE status IN ('vulnerable', 'deprecated', 'outdated', 'unused')) GROUP BY 1, 2""",
    "top_diagram": f"""{SQL_GRAPH}, {_DEGREE}, b AS (SELECT n.component_id AS id, n.name FROM nodes n JOIN deg d ON d.id = n.component_id ORDER BY d.degree DESC, n.component_id LIMIT 20)
      SELECT 'node' AS kind, regexp_replace(id, '[^A-Za-z0-9]', '_', 'g') || '["' || replace(name, '"', '''') || '"]' AS line FROM b
      UNION ALL SELECT DISTINCT 'edge', regexp_replace(from_id, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || connection_type || '| ' || regexp_replace(to_id, '[^A-Za-z0-9]', '_', 'g') FROM edges WHERE from_id IN (SELECT id FROM b) AND to_id IN (SELECT id FROM b)""",
}
