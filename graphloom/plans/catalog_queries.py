"""Catalog queries over the whole delivered tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators.graph_views import SQL_EDGES, SQL_GRAPH, SQL_NODES, clean_path, edges, ends, nodes, sql_clean_path, sql_trimmed, trimmed
from ..session import table

AS_OF = "2026-01-01 00:00:00"
FIND, SUGGEST = "ember quota", "harborquotaz"
QUERIES_TO_RESOLVE = ("fivateke", "HeronWorkflow", "platform", "orbit", "tutasi", "src/api", "npm", "quota")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def list_packages(spark, d):
    return nodes(spark, d).where("component_type = 'npm' and layer = 'external'").select("component_id", "name", "version")


def counts_by_dimension(spark, d):
    return c.counts_by(nodes(spark, d))


def graph_nodes(spark, d):
    return nodes(spark, d).select("component_id", "name", "component_type", F.coalesce("layer", F.lit("external")).alias("layer"))


def graph_edges(spark, d):
    return edges(spark, d, "from_id", "to_id", "connection_type", "symbol").select("connection_id", F.col("from_id").alias("source"), F.col("to_id").alias("target"), "connection_type", F.coalesce("symbol", "connection_type").alias("label"))


def name_index(spark, d):
    return nodes(spark, d).groupBy("name").agg(F.max_by("component_id", "seq").alias("component_id"), F.count(F.lit(1)).alias("components"))


def node_degrees(spark, d):
    return c.degrees(nodes(spark, d), edges(spark, d, "from_id", "to_id", "connection_type")).select("component_id", "incoming", "outgoing")


def most_connected(spark, d):
    got = c.degrees(nodes(spark, d), edges(spark, d, "from_id", "to_id", "connection_type")).select("component_id", "name", (F.col("incoming") + F.col("outgoing")).alias("degree"))
    return got.orderBy(F.desc("degree"), "component_id").limit(10)


def top_of_layer(spark, d):
    return c.top_per_layer(nodes(spark, d), edges(spark, d, "from_id", "to_id", "connection_type"))


def file_owner_map(spark, d):
    return c.file_map(nodes(spark, d), edges(spark, d, "from_id", "file", "seq"))


def reverse_deps(spark, d):
    return c.reverse_dependencies(nodes(spark, d), edges(spark, d, "to_id", "file", "connection_type"))


def file_level_connections(spark, d):
    return c.file_connections(edges(spark, d, "from_id", "to_id", "file", "connection_type"))


def storage_stats(spark, d):
    n = nodes(spark, d).agg(F.count(F.lit(1)).alias("components"), F.countDistinct("repo").alias("repos"), F.countDistinct("component_type").alias("types"), F.sum(F.when(F.col("version").isNull(), 1).otherwise(0)).cast("long").alias("unversioned"))
    e = edges(spark, d).agg(F.count(F.lit(1)).alias("connections"), F.countDistinct("connection_type").alias("connection_types"))
    return n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")


def file_hashes(spark, d):
    rows = table(spark, d, "source_files").where("content is not null")
    return rows.select("file_id", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def file_discovery(spark, d):
    return c.discover_files(table(spark, d, "source_files"))


def file_vendor_segments(spark, d):
    return c.vendor_paths(table(spark, d, "source_files"))


def find_component(spark, d):
    return c.find_components(nodes(spark, d), FIND)


def suggest_component(spark, d):
    return c.candidates(nodes(spark, d), SUGGEST)


def resolve_components(spark, d):
    q = spark.createDataFrame([(x,) for x in QUERIES_TO_RESOLVE], "query string")
    return c.resolve(nodes(spark, d), edges(spark, d), q)


def alias_groups(spark, d):
    return c.merge_aliases(nodes(spark, d), edges(spark, d, "from_id", "to_id", "connection_type"))


def bounded_listing(spark, d):
    return c.bounded(edges(spark, d, "confidence").where("confidence < 0.5"), 50)


def compact_connections(spark, d):
    named = ends(edges(spark, d, "from_id", "to_id", "connection_type", "confidence"), nodes(spark, d))
    return named.select("connection_id", F.coalesce("from_name", F.lit("?")).alias("f"), F.coalesce("to_name", F.lit("?")).alias("t"), F.col("connection_type").alias("ct"), F.col("confidence").alias("c"))


def resolved_edges(spark, d):
    named = ends(edges(spark, d, "from_id", "to_id", "connection_type"), nodes(spark, d)).where("from_name is not null and to_name is not null")
    return named.groupBy("from_component_type", "to_component_type", "connection_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("from_id").alias("sources"))


def layer_flow(spark, d):
    named = ends(edges(spark, d, "from_id", "to_id", "connection_type"), nodes(spark, d)).where("from_layer is not null and to_layer is not null and from_layer <> to_layer")
    return named.groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("edges"))


def production_edges(spark, d):
    kept = F.coalesce("classification", F.lit("production")).isin("production", "unknown", "admin", "analytics")
    return edges(spark, d, "repo", "classification").where(kept).groupBy("repo").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("classification").eqNullSafe("production")).alias("strict"))


def confidence_bands(spark, d):
    return c.coverage_bands(edges(spark, d, "confidence", "classification"))


def coverage_gaps(spark, d):
    return c.coverage_gaps(nodes(spark, d), edges(spark, d, "from_id", "to_id", "confidence"))


def coverage_summary(spark, d):
    return c.coverage_summary(nodes(spark, d), edges(spark, d, "repo", "file", "confidence"), table(spark, d, "source_files"))


def dead_components(spark, d):
    return c.dead_components(nodes(spark, d), edges(spark, d, "from_id", "to_id", "connection_type"))


def lesson_search(spark, d):
    return c.search_lessons(table(spark, d, "lessons"), "(webhook|quota).*session", severity="critical")


def lesson_categories(spark, d):
    rows = table(spark, d, "lessons").where("category is not null")
    return rows.groupBy(F.lower(trimmed(F.col("category"))).alias("category")).agg(F.count(F.lit(1)).alias("lessons"), F.count_if("promoted").alias("promoted"), F.sum("occurrences").alias("occurrences"))


def lesson_promotions(spark, d):
    return c.recurring_lessons(table(spark, d, "lessons"))


def repo_listing(spark, d):
    return c.repo_listing(nodes(spark, d), edges(spark, d, "repo", "detected_at"), AS_OF)


def unmapped_files(spark, d):
    files = c.discover_files(table(spark, d, "source_files"))
    owned = nodes(spark, d).where("file is not null").select("repo", clean_path(F.col("file")).alias("path")).distinct()
    return files.join(owned, ["repo", "path"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("unmapped"), F.min("path").alias("first_path"))


QUERIES = {
    f.__name__: f
    for f in (
        list_packages, counts_by_dimension, graph_nodes, graph_edges, name_index, node_degrees, most_connected, top_of_layer, file_owner_map, reverse_deps, file_level_connections,
        storage_stats, file_hashes, file_discovery, file_vendor_segments, find_component, suggest_component, resolve_components, alias_groups, bounded_listing, compact_connections, resolved_edges,
        layer_flow, production_edges, confidence_bands, coverage_gaps, coverage_summary, dead_components, lesson_search, lesson_categories, lesson_promotions, repo_listing, unmapped_files,
    )
}

_BASE = sql_trimmed(r"regexp_replace(regexp_replace(regexp_replace(lower(<>), '\s*config([^A-Za-z0-9_].*)?$', '', 'g'), '\s*\(.*\)$', '', 'g'), '[@/].*', '', 'g')")
_DEGREES = f"""{SQL_GRAPH},
deg AS (
  SELECT n.*, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing FROM nodes n
  LEFT JOIN (SELECT to_id, count(*) c FROM edges GROUP BY 1) i ON i.to_id = n.component_id
  LEFT JOIN (SELECT from_id, count(*) c FROM edges GROUP BY 1) o ON o.from_id = n.component_id)
"""
_NAMED = f"""{SQL_GRAPH},
named AS (SELECT e.*, a.name AS from_name, a.component_type AS from_component_type, a.layer AS from_layer, b.name AS to_name, b.component_type AS to_component_type, b.layer AS to_layer
  FROM edges e LEFT JOIN nodes a ON a.component_id = e.from_id LEFT JOIN nodes b ON b.component_id = e.to_id)
"""
_PATH = sql_clean_path("file")
_DISCOVER = f"""SELECT DISTINCT repo, {_PATH} AS path, lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM source_files
WHERE file IS NOT NULL AND lower(regexp_extract({_PATH}, '\\.([A-Za-z0-9]+)$', 1)) IN ({_list(c.SOURCE_EXTENSIONS)})
AND NOT list_has_any(string_split({_PATH}, '/'), [{_list(c.IGNORED_FOLDERS)}])"""
_Q = FIND
_SCORE = (
    f"CASE WHEN lower(name) = '{_Q}' THEN 100 WHEN contains(lower(name), '{_Q}') THEN {60 + min(20, len(_Q))} ELSE 0 END"
    + "".join(f" + CASE WHEN list_contains(regexp_split_to_array(lower(name), '[\\s/_.\\-]+'), '{t}') THEN 30 ELSE 0 END + CASE WHEN list_contains(list_transform(coalesce(tags, []), lambda x: lower(x)), '{t}') THEN 10 ELSE 0 END" for t in _Q.split())
    + f" + CASE WHEN contains(lower(coalesce(purpose, '')), '{_Q}') THEN 20 ELSE 0 END + CASE WHEN contains(lower(coalesce(file, '')), '{_Q}') THEN 8 ELSE 0 END"
)
_S = SUGGEST

SQL = {
    "list_packages": f"WITH {SQL_NODES} SELECT component_id, name, version FROM nodes WHERE component_type = 'npm' AND layer = 'external'",
    "counts_by_dimension": f"""WITH {SQL_NODES} SELECT CASE WHEN grouping(component_type) = 0 THEN 'component_type' WHEN grouping(layer) = 0 THEN 'layer' ELSE 'status' END AS dimension,
      CASE WHEN grouping(component_type) = 0 THEN component_type WHEN grouping(layer) = 0 THEN layer ELSE status END AS value, count(*) AS components
      FROM nodes GROUP BY GROUPING SETS ((component_type), (layer), (status))""",
    "graph_nodes": f"WITH {SQL_NODES} SELECT component_id, name, component_type, coalesce(layer, 'external') AS layer FROM nodes",
    "graph_edges": f"WITH {SQL_EDGES} SELECT connection_id, from_id AS source, to_id AS target, connection_type, coalesce(symbol, connection_type) AS label FROM edges",
    "name_index": f"WITH {SQL_NODES} SELECT name, arg_max(component_id, seq) AS component_id, count(*) AS components FROM nodes GROUP BY name",
    "node_degrees": _DEGREES + "SELECT component_id, incoming, outgoing FROM deg",
    "most_connected": _DEGREES + "SELECT component_id, name, incoming + outgoing AS degree FROM deg ORDER BY degree DESC, component_id LIMIT 10",
    "top_of_layer": _DEGREES + "SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(critical, false) DESC, incoming + outgoing DESC, component_id) AS rank, component_id, incoming + outgoing AS degree FROM deg QUALIFY rank <= 5",
    "file_owner_map": f"""{SQL_GRAPH}, claims AS (
      SELECT {_PATH} AS path, component_id, 0 AS rank, seq FROM nodes WHERE file IS NOT NULL
      UNION ALL SELECT {sql_clean_path('e.file')}, n.component_id, 1, e.seq FROM edges e JOIN nodes n ON n.component_id = e.from_id WHERE e.file IS NOT NULL)
      SELECT path, arg_max(component_id, {{'r': rank, 's': seq}}) AS component_id, count(*) AS claims FROM claims GROUP BY path""",
    "reverse_deps": f"""{SQL_GRAPH}, i AS (SELECT to_id, {_PATH} AS importer FROM edges WHERE connection_type = 'imports' AND file IS NOT NULL)
      SELECT DISTINCT target, importer FROM (
        SELECT {sql_clean_path('substr(to_id, 6)')} AS target, importer FROM i WHERE to_id LIKE 'FILE:%'
        UNION ALL SELECT {sql_clean_path('n.file')}, importer FROM i JOIN nodes n ON n.component_id = i.to_id WHERE n.file IS NOT NULL) WHERE target <> importer""",
    "file_level_connections": f"""WITH {SQL_EDGES}, r AS (
      SELECT connection_id, connection_type = 'imports' AS i, file AS path, true AS source FROM edges
      UNION SELECT connection_id, connection_type = 'imports', substr(from_id, 6), true FROM edges WHERE from_id LIKE 'FILE:%'
      UNION SELECT connection_id, connection_type = 'imports', substr(to_id, 6), false FROM edges WHERE to_id LIKE 'FILE:%')
      SELECT path, count(*) FILTER (i AND source) AS imports, count(*) FILTER (i AND NOT source) AS imported_by, count(*) FILTER (NOT i AND source) AS other_from, count(*) FILTER (NOT i AND NOT source) AS other_to
      FROM r WHERE path IS NOT NULL GROUP BY path""",
    "storage_stats": f"""{SQL_GRAPH} SELECT * FROM (SELECT count(*) AS components, count(DISTINCT repo) AS repos, count(DISTINCT component_type) AS types, count(*) FILTER (version IS NULL) AS unversioned FROM nodes),
      (SELECT count(*) AS connections, count(DISTINCT connection_type) AS connection_types FROM edges)""",
    "file_hashes": "SELECT file_id, sha256(content) AS hash, strlen(content) AS size FROM source_files WHERE content IS NOT NULL",
    "file_discovery": _DISCOVER,
    "file_vendor_segments": f"""SELECT DISTINCT repo, path, s AS segment FROM (
      SELECT repo, {_PATH} AS path, list_filter(string_split({_PATH}, '/'), lambda x: x IN ({_list(c.VENDOR_SEGMENTS)}))[1] AS s FROM source_files WHERE file IS NOT NULL) WHERE s IS NOT NULL""",
    "find_component": f"""WITH {SQL_NODES}, s AS (SELECT component_id, name, {_SCORE} AS base FROM nodes)
      SELECT component_id, name, CASE WHEN base = 0 AND regexp_matches(lower(name), '{".*".join(chr(92) + x if not x.isalnum() else x for x in _Q)}') THEN 4 ELSE base END AS score FROM s WHERE score > 0 ORDER BY score DESC, component_id LIMIT 10""",
    "suggest_component": f"""WITH {SQL_NODES} SELECT component_id, name, CASE WHEN contains(lower(name), '{_S}') OR contains('{_S}', lower(name)) THEN 3 ELSE 0 END
      + CASE {' '.join(f"WHEN starts_with(lower(name), '{_S[:i]}') THEN {i}" for i in range(len(_S), 0, -1))} ELSE 0 END - abs(length(name) - {len(_S)}) * 0.5::DOUBLE AS score
      FROM nodes WHERE score > 0 ORDER BY score DESC, component_id LIMIT 5""",
    "resolve_components": _DEGREES
    + f""", q AS (SELECT unnest([{_list(QUERIES_TO_RESOLVE)}]) AS query),
      m AS (SELECT q.query, d.component_id, d.seq, d.incoming + d.outgoing AS n, length(d.name) AS l,
        CASE WHEN q.query = d.component_id THEN 1 WHEN lower(q.query) = lower(d.name) THEN 2 WHEN lower(q.query) = lower({sql_clean_path('d.file')}) THEN 3
          WHEN contains(lower(d.name), lower(q.query)) THEN 4 WHEN {_BASE.replace('<>', 'd.name')} = {_BASE.replace('<>', 'q.query')} THEN 5 WHEN contains(lower({sql_clean_path('d.file')}), lower(q.query)) THEN 6 END AS step
        FROM q, deg d)
      SELECT query, component_id, step FROM m WHERE step IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY query ORDER BY step, CASE WHEN step IN (1, 4, 5) THEN -n ELSE 0 END, CASE WHEN step = 4 THEN l ELSE 0 END, seq) = 1""",
    "alias_groups": _DEGREES + f"SELECT base, component_type, arg_max(component_id, {{'n': incoming + outgoing, 's': -seq}}) AS component_id, count(*) AS members FROM (SELECT *, {_BASE.replace('<>', 'name')} AS base FROM deg) GROUP BY base, component_type",
    "bounded_listing": f"WITH {SQL_EDGES} SELECT count(*) AS total, least(count(*), 50) AS returned, count(*) > 50 AS truncated, 50 AS \"limit\" FROM edges WHERE confidence < 0.5",
    "compact_connections": _NAMED + "SELECT connection_id, coalesce(from_name, '?') AS f, coalesce(to_name, '?') AS t, connection_type AS ct, confidence AS c FROM named",
    "resolved_edges": _NAMED + "SELECT from_component_type, to_component_type, connection_type, count(*) AS edges, count(DISTINCT from_id) AS sources FROM named WHERE from_name IS NOT NULL AND to_name IS NOT NULL GROUP BY ALL",
    "layer_flow": _NAMED + "SELECT from_layer, to_layer, count(*) AS edges FROM named WHERE from_layer IS NOT NULL AND to_layer IS NOT NULL AND from_layer <> to_layer GROUP BY ALL",
    "production_edges": f"WITH {SQL_EDGES} SELECT repo, count(*) AS edges, count(*) FILTER (classification = 'production') AS strict FROM edges WHERE coalesce(classification, 'production') IN ('production', 'unknown', 'admin', 'analytics') GROUP BY repo",
    "confidence_bands": f"WITH {SQL_EDGES} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, coalesce(classification, 'unclassified') AS classification, count(*) AS connections FROM edges GROUP BY ALL",
    "coverage_gaps": _DEGREES
    + """SELECT 'zero-consumers' AS gap, component_id AS target FROM deg WHERE incoming = 0 AND coalesce(layer, '') <> 'external'
      UNION ALL SELECT 'no-outgoing', component_id FROM deg WHERE outgoing = 0 AND coalesce(layer, '') NOT IN ('database', 'external')
      UNION ALL SELECT 'low-confidence-connection', connection_id FROM edges WHERE confidence < 0.5""",
    "coverage_summary": f"""{SQL_GRAPH}, f AS (SELECT DISTINCT repo, {_PATH} AS path FROM source_files WHERE file IS NOT NULL),
      m AS (SELECT repo, {_PATH} AS path FROM nodes WHERE file IS NOT NULL UNION SELECT repo, {_PATH} FROM edges WHERE file IS NOT NULL),
      t AS (SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f JOIN m USING (repo, path)) AS mapped, (SELECT count(*) FROM edges) AS connections, (SELECT round(avg(coalesce(confidence, 0)), 6) FROM edges) AS mean_confidence),
      p AS (SELECT *, CASE WHEN total > 0 THEN CAST(round(mapped * 100.0::DOUBLE / total) AS BIGINT) ELSE 0 END AS percent FROM t)
      SELECT total, mapped, percent, connections, mean_confidence, CASE WHEN connections > 0 THEN round(mean_confidence * 0.6::DOUBLE + percent / 100.0::DOUBLE * 0.4::DOUBLE, 2) ELSE 0.0 END AS overall_confidence FROM p""",
    "dead_components": f"""{SQL_GRAPH} SELECT component_id, name, component_type FROM nodes WHERE component_type IN ({_list(c.DEAD_TYPES)}) AND status = 'active'
      AND component_id NOT IN (SELECT from_id FROM edges WHERE from_id IS NOT NULL UNION SELECT to_id FROM edges WHERE to_id IS NOT NULL)""",
    "lesson_search": """SELECT seq, lesson_id, project, category, severity, promoted FROM lessons WHERE lower(severity) = 'critical' AND (
      coalesce(regexp_matches(pattern, '(?i)(webhook|quota).*session'), false) OR coalesce(regexp_matches(resolution, '(?i)(webhook|quota).*session'), false)
      OR coalesce(len(list_filter(signature, lambda x: regexp_matches(x, '(?i)(webhook|quota).*session'))) > 0, false))""",
    "lesson_categories": f"SELECT lower({sql_trimmed('category')}) AS category, count(*) AS lessons, count(*) FILTER (promoted) AS promoted, sum(occurrences) AS occurrences FROM lessons WHERE category IS NOT NULL GROUP BY 1",
    "lesson_promotions": f"SELECT lower({sql_trimmed('pattern')}) AS pattern, category, count(DISTINCT project) AS projects, count(*) AS lessons FROM lessons WHERE pattern IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT project) >= 3",
    "repo_listing": f"""{SQL_GRAPH} SELECT n.repo, n.c AS components, coalesce(e.c, 0) AS connections, e.l AS last_detected, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(e.l)) / 3600000000) AS BIGINT) AS age_hours,
      coalesce(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(e.l)) / 3600000000) >= 24, false) AS stale
      FROM (SELECT repo, count(*) c FROM nodes GROUP BY 1) n LEFT JOIN (SELECT repo, count(*) c, max(detected_at) l FROM edges GROUP BY 1) e ON n.repo = e.repo""",
    "unmapped_files": f"""WITH {SQL_NODES}, f AS ({_DISCOVER}), o AS (SELECT DISTINCT repo, {_PATH} AS path FROM nodes WHERE file IS NOT NULL)
      SELECT f.repo, count(*) AS unmapped, min(f.path) AS first_path FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo = f.repo AND o.path = f.path) GROUP BY 1""",
}
