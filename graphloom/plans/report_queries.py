"""Reports over whole tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, extract, history, merge, reports as r, traverse
from ..operators.catalog import PACKAGE_FOLDERS, VENDOR_SEGMENTS
from ..operators.graph_views import SQL_EDGES, SQL_GRAPH, SQL_NODES, edges, nodes, sql_clean_path
from ..session import cut, table
from .estate_queries import AS_OF, SCAN_AT, SQL as _ESTATE, _latest_versions
from .extract_queries import SQL as _EXTRACT, _ENVCAT, _IN, _q
from .graph_queries import ROUNDS, SQL as _GRAPH, _links

GLOBS = ("src/**/ticket/*", "**/*.py", "web/components/?*/**")


def manifest(spark, d):
    return r.manifest(nodes(spark, d, "component_type"), edges(spark, d, "connection_type"))


def snapshot_records(spark, d):
    return r.snapshot_records(nodes(spark, d, "name"), edges(spark, d, "from_id", "to_id", "connection_type", "file"))


def layer_rollup(spark, d):
    """Layers as communities, ranked by the first rounds of PageRank as its SQL unrolls them."""
    n = nodes(spark, d, "layer")
    return r.community_rollup(n.select("component_id", F.coalesce("layer", F.lit("none")).alias("community")), traverse.pagerank(n, _links(spark, d), ROUNDS, tolerance=0.0))


def premerge_diff(spark, d):
    """Each repo's last snapshot against its first one; repos with a single snapshot have no baseline."""
    snaps = table(spark, d, "component_snapshots")
    heads = snaps.where("snapshot_id is not null").groupBy("repo").agg(F.min_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("first"), F.max_by("snapshot_id", F.struct("taken_at", "snapshot_id")).alias("last"))
    heads = cut(heads)
    return r.premerge_diff(snaps, heads.where("first <> last").select("repo", F.col("first").alias("snapshot_id")), heads.select("repo", F.col("last").alias("snapshot_id")))


def diff_guard(spark, d):
    return r.diff_guard(table(spark, d, "component_snapshots"))


def refresh_report(spark, d):
    n = nodes(spark, d, "name", "component_type", "version", "first_seen_at")
    return r.refresh_report(history.freshness(n, _latest_versions(n), AS_OF, 180), n)


def model_access(spark, d):
    return r.model_access(extract.orm_calls(table(spark, d, "connections"), "seq", "code"))


def env_usage(spark, d):
    rows = table(spark, d, "connections").where("code is not null").select("code")
    return r.env_usage(rows, "code", extract.env_references(rows, "code"))


def resource_topology(spark, d):
    return r.resource_topology(edges(spark, d, "to_id", "code"))


def remapped_edges(spark, d):
    """Edges with the ends of components that another repo has under the same stable id led to one of them."""
    n = nodes(spark, d, "stable_id")
    return r.remap_ids(edges(spark, d, "from_id", "to_id"), n, n)


def hosting(spark, d):
    return r.hosting(nodes(spark, d, "repo", "name", "component_type", "layer"))


def mappable_components(spark, d):
    return r.mappable(nodes(spark, d, "name", "component_type", "file"), GLOBS)


def plan_choice(spark, d):
    """The plan of each repo's edges: its snapshots count as audits before, a repo with few sure edges had a breach."""
    lots = edges(spark, d, "repo", "confidence").groupBy("repo").agg(F.count(F.lit(1)).alias("lot"), (F.avg("confidence") < 0.7).alias("breach"))
    prior = table(spark, d, "component_snapshots").groupBy("repo").agg(F.countDistinct("snapshot_id").alias("prior"))
    return r.plan_choice(lots.join(prior, "repo", "left").select("repo", "lot", F.lit(None).cast("string").alias("plan"), "breach", F.coalesce("prior", F.lit(0)).alias("prior")))


def stale_files(spark, d):
    return r.stale_files(table(spark, d, "source_files"), SCAN_AT)


def audit_report(spark, d):
    """All classes of defects over the whole graph; the verdict is that of its lot."""
    n, e, files = cut(nodes(spark, d, "repo", "file")), cut(edges(spark, d, "repo", "from_id", "to_id", "connection_type", "file", "line", "symbol")), table(spark, d, "source_files")
    known = files.where("file is not null").select("repo", "file").distinct()
    checks = {
        "missing-file": (n.where("file <> ''"), audit.missing_files(n, files)),
        "unknown-end": (e, merge.integrity_issues(n, e).select("connection_id").distinct()),
        "wrong-endpoint": (e.where("symbol <> '' and file is not null").join(known, ["repo", "file"], "left_semi"), audit.wrong_endpoints(e, files)),
        "stale-reference": (known, r.stale_files(files, SCAN_AT)),
        "collision": (e, audit.collisions(e.withColumn("seq", F.lit(0)), ["from_id", "to_id", "connection_type", "file", "line"], "seq")),
    }
    return r.audit_report(checks, n.count() + e.count())


def audit_missed_edges(spark, d):
    """What is recorded of every file, for a reviewer to find what is missing."""
    files = table(spark, d, "source_files").where("file is not null").select("repo", "file")
    return r.recorded_edges(files, edges(spark, d, "repo", "file", "to_id", "symbol"), nodes(spark, d, "name"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest, snapshot_records, layer_rollup, premerge_diff, diff_guard, refresh_report, model_access, env_usage, resource_topology, remapped_edges, hosting, mappable_components, plan_choice, stale_files, audit_report,
        audit_missed_edges,
    )
}

_PATH = sql_clean_path("coalesce(file, '')")
_PARTS = f"string_split({_PATH}, '/')"
_SNAPS = "one AS (SELECT * FROM component_snapshots WHERE snapshot_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_id, component_id ORDER BY delivered_at DESC NULLS LAST, seq DESC) = 1)"
_ACCEPT = "CASE " + " ".join(f"WHEN {'lot <= ' + str(top) if top is not None else 'true'} THEN {c}" for top, _, _, c in audit.AQL_PLANS) + " END"
_FULL = "CASE " + " ".join(f"WHEN {'lot <= ' + str(top) if top is not None else 'true'} THEN {n}" for top, _, n, _ in audit.AQL_PLANS) + " END"
_STALE = f"""stale AS (SELECT repo, {sql_clean_path('file')} AS path, arg_max(coalesce(sha256(content), ''), {{'s': scanned_at, 'f': file_id}}) FILTER (scanned_at <= TIMESTAMP '{SCAN_AT}') AS a, arg_max(coalesce(sha256(content), ''), {{'s': scanned_at, 'f': file_id}}) AS b
  FROM source_files WHERE file IS NOT NULL GROUP BY 1, 2), stale_rows AS (SELECT repo, path, CASE WHEN b = '' THEN 'missing' ELSE 'hash mismatch' END AS reason FROM stale WHERE a <> '' AND a <> b)"""
_SUB = lambda sql: "(" + sql + ")"

SQL = {
    "manifest": f"""{SQL_GRAPH} SELECT 'components' AS section, 'total' AS key, count(*) AS items FROM nodes UNION ALL SELECT 'components', coalesce(component_type, 'unknown'), count(*) FROM nodes GROUP BY 2
      UNION ALL SELECT 'connections', 'total', count(*) FROM edges UNION ALL SELECT 'connections', coalesce(connection_type, 'unknown'), count(*) FROM edges GROUP BY 2""",
    "snapshot_records": f"""{SQL_GRAPH} SELECT e.connection_id, e.from_id, e.to_id, e.connection_type, coalesce(a.name, '?') AS from_name, coalesce(b.name, '?') AS to_name, e.file FROM edges e LEFT JOIN nodes a ON a.component_id = e.from_id LEFT JOIN nodes b ON b.component_id = e.to_id""",
    "layer_rollup": f"""WITH {SQL_NODES}, ranks AS ({_GRAPH["pagerank"]}), m AS (SELECT coalesce(layer, 'none') AS community, component_id, coalesce(rank, 0) AS rank FROM nodes LEFT JOIN ranks USING (component_id))
      SELECT community, count(*) AS members, round(sum(rank), 6) AS rank, (SELECT string_agg(component_id, ',' ORDER BY rank DESC, component_id) FROM (SELECT * FROM m x WHERE x.community = m.community ORDER BY rank DESC, component_id LIMIT 5)) AS best FROM m GROUP BY community""",
    "premerge_diff": f"""WITH {_SNAPS}, h AS (SELECT repo, arg_min(snapshot_id, {{'t': taken_at, 's': snapshot_id}}) AS a, arg_max(snapshot_id, {{'t': taken_at, 's': snapshot_id}}) AS b FROM component_snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1),
      x AS (SELECT h.repo, component_id, version, status FROM h JOIN one ON one.snapshot_id = h.a WHERE a <> b), y AS (SELECT h.repo, component_id, version, status FROM h JOIN one ON one.snapshot_id = h.b),
      j AS (SELECT coalesce(x.repo, y.repo) AS repo, x.component_id AS p, y.component_id AS q, x.version IS DISTINCT FROM y.version OR x.status IS DISTINCT FROM y.status AS differs FROM x FULL JOIN y ON x.repo = y.repo AND x.component_id = y.component_id),
      c AS (SELECT repo, count(*) FILTER (p IS NULL) AS added, count(*) FILTER (q IS NULL) AS removed, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL AND differs) AS changed FROM j GROUP BY 1)
      SELECT h.repo, a <> b AS available, CASE WHEN a <> b THEN coalesce(added, 0) END AS added, CASE WHEN a <> b THEN coalesce(removed, 0) END AS removed, CASE WHEN a <> b THEN coalesce(changed, 0) END AS changed FROM h LEFT JOIN c USING (repo) WHERE h.repo IS NOT NULL""",
    "diff_guard": f"""WITH {_SNAPS}, s AS (SELECT repo, snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS previous FROM (SELECT DISTINCT repo, snapshot_id, taken_at FROM component_snapshots WHERE snapshot_id IS NOT NULL)),
      b AS (SELECT s.snapshot_id AS id, component_id FROM s JOIN one ON one.snapshot_id = s.previous), a AS (SELECT s.snapshot_id AS id, component_id FROM s JOIN one ON one.snapshot_id = s.snapshot_id WHERE previous IS NOT NULL),
      j AS (SELECT coalesce(a.id, b.id) AS snapshot_id, a.component_id AS x, b.component_id AS y FROM a FULL JOIN b ON a.id = b.id AND a.component_id = b.component_id)
      SELECT snapshot_id, count(y) AS before, count(x) AS after, count(*) FILTER (y IS NULL) AS added, count(*) FILTER (x IS NULL) AS removed, count(y) + count(*) FILTER (y IS NULL) - count(*) FILTER (x IS NULL) = count(x) AS consistent FROM j GROUP BY 1""",
    "refresh_report": f"""WITH {SQL_NODES}, f AS ({_ESTATE["package_freshness"]}) SELECT component_type, freshness, bump, count(*) AS packages FROM f JOIN nodes USING (component_id) GROUP BY ALL""",
    "model_access": f"""WITH o AS ({_EXTRACT["orm_calls"]}) SELECT model, count(*) AS files, count(*) FILTER (label = 'reads') AS readers, count(*) FILTER (label = 'writes') AS writers, count(*) FILTER (label = 'reads+writes') AS both FROM o GROUP BY 1""",
    "env_usage": f"""WITH refs AS ({_EXTRACT["env_references"]}), defs AS (SELECT name, count(*) AS defined FROM (SELECT unnest(list_distinct(regexp_extract_all(code, {_q(r.ENV_DEFINITION)}, 1))) AS name FROM connections WHERE code IS NOT NULL) GROUP BY 1),
      j AS (SELECT coalesce(d.name, f.name) AS name, d.defined, f.rows AS referenced FROM defs d FULL JOIN refs f ON f.name = d.name)
      SELECT name, {_ENVCAT} AS category, coalesce(defined, 0) AS defined, coalesce(referenced, 0) AS referenced, CASE WHEN referenced IS NULL THEN 'unused' WHEN defined IS NULL THEN 'undefined' ELSE 'used' END AS state FROM j""",
    "resource_topology": f"""WITH {SQL_EDGES}, a AS ({_EXTRACT["connection_addresses"].replace("FROM connections", "FROM edges")}) SELECT resource, count(DISTINCT (host, coalesce(port, 0))) AS endpoints, count(*) AS mentions, count(DISTINCT e.to_id) AS targets FROM a JOIN edges e USING (seq) GROUP BY 1""",
    "remapped_edges": f"""{SQL_GRAPH}, now AS (SELECT stable_id, min(component_id) AS now FROM nodes WHERE stable_id IS NOT NULL GROUP BY 1), lead AS (SELECT component_id, now FROM nodes JOIN now USING (stable_id) WHERE component_id <> now)
      SELECT e.connection_id, coalesce(a.now, e.from_id) AS from_id, coalesce(b.now, e.to_id) AS to_id, CAST((a.now IS NOT NULL)::INT + (b.now IS NOT NULL)::INT AS INTEGER) AS remapped FROM edges e LEFT JOIN lead a ON a.component_id = e.from_id LEFT JOIN lead b ON b.component_id = e.to_id""",
    "hosting": f"WITH {SQL_NODES} SELECT h.component_id AS host_id, n.component_id FROM nodes h JOIN nodes n ON n.repo = h.repo WHERE h.layer = 'infra' AND n.component_id <> h.component_id AND n.layer IN ({_IN(r.HOSTED_LAYERS)}) AND ("
    + " OR ".join(f"(lower(h.name) = '{host}' AND n.component_type IN ({_IN(types)}) AND (" + " OR ".join(f"contains(lower(n.name), '{x}')" for x in names) + "))" for host, (names, types) in r.HOSTS.items())
    + ")",
    "mappable_components": f"""WITH {SQL_NODES}, copied AS (SELECT DISTINCT component_id FROM (SELECT component_id, {_PARTS} AS q, unnest(range(2, len({_PARTS}) + 1)) AS i FROM nodes WHERE file IS NOT NULL)
        WHERE q[i - 1] IN ({_IN(PACKAGE_FOLDERS)}) AND q[i] IN (SELECT name FROM nodes WHERE component_type IN ({_IN(traverse.PACKAGE_TYPES)})))
      SELECT component_id, CASE WHEN {' OR '.join(f"regexp_matches({_PATH}, {_q(r.glob_pattern(g))})" for g in GLOBS)} THEN 'excluded' WHEN list_has_any({_PARTS}, [{_IN(VENDOR_SEGMENTS)}]) THEN 'vendored'
        WHEN component_id IN (SELECT component_id FROM copied) THEN 'suspect' ELSE 'kept' END AS verdict FROM nodes WHERE component_type = 'component'""",
    "plan_choice": f"""WITH {SQL_EDGES}, l AS (SELECT repo, count(*) AS lot, avg(confidence) < 0.7 AS breach FROM edges GROUP BY 1), p AS (SELECT repo, count(DISTINCT snapshot_id) AS prior FROM component_snapshots GROUP BY 1),
      k AS (SELECT l.repo, lot, CASE WHEN coalesce(breach, false) THEN 'Cochran' WHEN coalesce(prior, 0) >= 3 THEN 'SPRT' ELSE 'AQL' END AS plan FROM l LEFT JOIN p ON p.repo = l.repo)
      SELECT repo, plan, CAST(CASE WHEN plan = 'Cochran' THEN ceil({1.96 * 1.96 * 0.05 * 0.95 / 0.0025!r}::DOUBLE / (1 + ({1.96 * 1.96 * 0.05 * 0.95 / 0.0025!r}::DOUBLE - 1) / lot)) ELSE {_FULL} END AS BIGINT) AS n, CASE WHEN plan = 'Cochran' THEN 0 ELSE {_ACCEPT} END AS c FROM k""",
    "stale_files": f"WITH {_STALE} SELECT * FROM stale_rows",
    "audit_report": f"""{SQL_GRAPH}, {_STALE}, lots AS (SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) AS lot), known AS (SELECT DISTINCT repo, file FROM source_files WHERE file IS NOT NULL),
      c AS (SELECT 'missing-file' AS class, (SELECT count(*) FROM nodes WHERE file <> '') AS checked, (SELECT count(*) FROM ({_ESTATE["audit_missing_files"]})) AS defects
        UNION ALL SELECT 'unknown-end', (SELECT count(*) FROM edges), (SELECT count(DISTINCT connection_id) FROM edges WHERE (from_id <> '' AND NOT starts_with(from_id, 'FILE:') AND from_id NOT IN (SELECT component_id FROM nodes)) OR (to_id <> '' AND NOT starts_with(to_id, 'FILE:') AND to_id NOT IN (SELECT component_id FROM nodes)))
        UNION ALL SELECT 'wrong-endpoint', (SELECT count(*) FROM edges WHERE symbol <> '' AND (repo, file) IN (SELECT (repo, file) FROM known)), (SELECT count(*) FROM ({_ESTATE["audit_wrong_endpoints"]}))
        UNION ALL SELECT 'stale-reference', (SELECT count(*) FROM known), (SELECT count(*) FROM stale_rows)
        UNION ALL SELECT 'collision', (SELECT count(*) FROM edges), (SELECT count(*) FROM (SELECT 1 FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND connection_type IS NOT NULL AND file IS NOT NULL AND line IS NOT NULL GROUP BY from_id, to_id, connection_type, file, line HAVING count(*) > 1))),
      t AS (SELECT * FROM c UNION ALL SELECT 'all', sum(checked), sum(defects) FROM c)
      SELECT class, CAST(checked AS BIGINT) AS checked, CAST(defects AS BIGINT) AS defects, round(defects::DOUBLE / nullif(checked, 0), 6) AS rate, CASE WHEN class = 'all' THEN CASE WHEN defects <= {_ACCEPT} THEN 'accept' ELSE 'reject' END END AS verdict FROM t, lots""",
    "audit_missed_edges": f"""{SQL_GRAPH}, s AS (SELECT DISTINCT repo, file FROM source_files WHERE file IS NOT NULL) SELECT e.repo, e.file, e.connection_id, e.to_id, n.name AS target_name, e.symbol FROM edges e JOIN s ON s.repo = e.repo AND s.file = e.file LEFT JOIN nodes n ON n.component_id = e.to_id""",
}
