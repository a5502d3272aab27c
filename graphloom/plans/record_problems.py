"""Queries of the record problems 3, 4 and 6 over their whole tables."""

from __future__ import annotations

from ..operators.orphans import REFERENCE_FIELDS, orphan_references, orphan_report
from ..operators.snapshot_cells import change_report, snapshot_changes
from ..operators.tree_aggregate import counted_against_recorded, target_summary
from ..session import table


def p3_targets(spark, d):
    return target_summary(table(spark, d, "connections"))


def p3_recorded(spark, d):
    return counted_against_recorded(table(spark, d, "components"), target_summary(table(spark, d, "connections")))


def p4_found(spark, d):
    return snapshot_changes(table(spark, d, "component_snapshots")).select("snapshot_id", "component_id", "change_kind")


def p4_fields(spark, d):
    return snapshot_changes(table(spark, d, "component_snapshots"))


def p4_report(spark, d):
    return change_report(snapshot_changes(table(spark, d, "component_snapshots")))


def _orphans(spark, d):
    return orphan_references(table(spark, d, "connections"), table(spark, d, "components"), table(spark, d, "source_files"))


def p6_found(spark, d):
    return _orphans(spark, d).select("seq", "field_name", "kind")


def p6_report(spark, d):
    return orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p3_targets, p3_recorded, p4_found, p4_fields, p4_report, p6_found, p6_report)}

_TARGETS = """
SELECT to_id, count(*) AS row_count,
       count(DISTINCT (from_id, connection_id)) AS edges,
       count(DISTINCT nullif(from_id, '')) AS callers,
       count(confidence) AS confidence_rows,
       round(CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) / nullif(count(confidence), 0), 6) AS avg_confidence,
       min(confidence) AS min_confidence, max(confidence) AS max_confidence, max(detected_at) AS last_detected
FROM connections GROUP BY to_id
"""

_CHANGES = """
WITH latest AS (
  SELECT snapshot_id, component_id, version, status FROM component_snapshots WHERE snapshot_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, component_id ORDER BY delivered_at DESC NULLS LAST, seq DESC) = 1),
heads AS (SELECT snapshot_id, min(repo) AS repo, min(taken_at) AS taken_at FROM component_snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1),
pairs AS (SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS previous_id FROM heads),
after AS (SELECT p.snapshot_id, l.component_id, l.version, l.status FROM pairs p JOIN latest l USING (snapshot_id) WHERE p.previous_id IS NOT NULL),
before AS (SELECT p.snapshot_id, l.component_id, l.version, l.status FROM pairs p JOIN latest l ON l.snapshot_id = p.previous_id),
changes AS (
  SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.component_id, b.component_id) AS component_id,
    CASE WHEN b.snapshot_id IS NULL THEN 'added' WHEN a.snapshot_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    CASE WHEN b.snapshot_id IS NULL OR a.snapshot_id IS NULL THEN ''
         ELSE concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN a.version IS DISTINCT FROM b.version THEN 'version' END) END AS changed_fields
  FROM after a FULL JOIN before b ON a.snapshot_id = b.snapshot_id AND a.component_id IS NOT DISTINCT FROM b.component_id
  WHERE a.snapshot_id IS NULL OR b.snapshot_id IS NULL OR a.version IS DISTINCT FROM b.version OR a.status IS DISTINCT FROM b.status)
"""

_REFS = " UNION ALL ".join(f"SELECT seq, '{f}' AS field_name, {f} AS value, repo, detected_at, arrived_at FROM connections WHERE {f} IS NOT NULL AND {f} <> ''" for f in REFERENCE_FIELDS)

_ORPHANS = f"""
WITH refs AS ({_REFS}),
known AS (SELECT component_id, CASE WHEN count(removed_at) = count(*) THEN max(removed_at) END AS removed_at, min(arrived_at) AS first_arrived
          FROM components WHERE component_id IS NOT NULL GROUP BY 1),
paths AS (SELECT DISTINCT repo, file FROM source_files),
orphans AS (
  SELECT r.seq, r.field_name, r.detected_at,
    CASE WHEN r.value LIKE 'FILE:%' THEN 'source_files' ELSE 'components' END AS referenced_table,
    CASE WHEN r.value LIKE 'FILE:%' THEN CASE WHEN p.file IS NULL THEN 'missing' END
         WHEN k.component_id IS NULL THEN 'missing'
         WHEN k.removed_at <= r.detected_at THEN 'deleted'
         WHEN k.first_arrived > r.arrived_at THEN 'late' END AS kind
  FROM refs r
  LEFT JOIN paths p ON r.value LIKE 'FILE:%' AND p.repo = r.repo AND p.file = substr(r.value, 6)
  LEFT JOIN known k ON r.value NOT LIKE 'FILE:%' AND k.component_id = r.value)
"""

SQL = {
    "p3_targets": _TARGETS,
    "p3_recorded": f"""
WITH t AS ({_TARGETS}),
last AS (SELECT component_id, connections AS recorded FROM components WHERE component_id IS NOT NULL
         QUALIFY row_number() OVER (PARTITION BY component_id ORDER BY arrived_at DESC NULLS LAST, seq DESC) = 1)
SELECT l.component_id, l.recorded, coalesce(t.edges, 0) AS counted, coalesce(t.edges, 0) - l.recorded AS difference
FROM last l LEFT JOIN t ON t.to_id = l.component_id
""",
    "p4_found": _CHANGES + "SELECT snapshot_id, component_id, change_kind FROM changes",
    "p4_fields": _CHANGES + "SELECT * FROM changes",
    "p4_report": _CHANGES
    + """SELECT snapshot_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
       count(*) FILTER (change_kind = 'changed') AS changed FROM changes GROUP BY 1""",
    "p6_found": _ORPHANS + "SELECT seq, field_name, kind FROM orphans WHERE kind IS NOT NULL",
    "p6_report": _ORPHANS
    + "SELECT referenced_table, strftime(detected_at, '%Y-%m') AS month, field_name, kind, count(*) AS orphans FROM orphans WHERE kind IS NOT NULL GROUP BY ALL",
}
