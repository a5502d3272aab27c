"""Rules, traversals and metrics over the whole graph, each beside its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, rules, traverse as t
from ..operators.catalog import PACKAGE_FOLDERS, VENDOR_SEGMENTS
from ..operators.graph_views import SQL_EDGES, SQL_GRAPH, SQL_NODES, clean_path, edges, nodes, sql_clean_path
from ..session import cut

CUSTOM_RULES = [
    ("no-frontend-to-infra", "frontend", None, None, "infra", None, None),
    ("no-worker-to-llm", None, "worker", None, None, "llm", None),
    ("no-quota-users", None, None, None, None, None, "quota"),
]
RULE_SCHEMA = "id string, from_layer string, from_type string, from_name string, to_layer string, to_type string, to_name string"
ROUNDS = 5
#: Depth of the trace from a small start, and of that from the hub, whose paths grow tenfold with each hop.
HOPS, HUB_HOPS = 5, 3


def _links(spark, d):
    """The edges' ends and types, read and deduplicated once for all steps of a traversal."""
    return cut(edges(spark, d, "from_id", "to_id", "connection_type"))


def _start(n, e) -> str:
    """The smallest id among known components with 6 to 20 distinct dependents: small enough to read, the same everywhere."""
    fan = t.simple_edges(e).groupBy("dst").count().where("count between 6 and 20").join(n.select(F.col("component_id").alias("dst")), "dst", "left_semi")
    return fan.agg(F.min("dst")).first()[0]


def _hub(n, e) -> str:
    """The known component with most distinct neighbours, the smallest id on ties."""
    p = t.simple_edges(e).where("src <> dst")
    near = p.unionByName(p.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().groupBy("src").count()
    top = near.join(n.select(F.col("component_id").alias("src")), "src", "left_semi").orderBy(F.desc("count"), "src").first()
    return top and top["src"]


def _known(spark, d):
    """The nodes' attributes that rules and traversals ask for, read and deduplicated once."""
    return cut(nodes(spark, d, "seq", "repo", "name", "component_type", "layer", "status", "critical", "file", "tags"))


def _rule_rows(spark, d, n=None, e=None):
    e = cut(edges(spark, d, "from_id", "to_id", "connection_type", "code")) if e is None else e
    return rules.builtin_rules(_known(spark, d) if n is None else n, e)


def rules_builtin(spark, d):
    return _rule_rows(spark, d)


def rules_counts(spark, d):
    return rules.rule_counts(_rule_rows(spark, d))


def rules_degenerate(spark, d):
    n = _known(spark, d)
    return rules.degenerate_rules(_rule_rows(spark, d, n), n)


def rules_custom(spark, d):
    return rules.forbidden_edges(nodes(spark, d, "name", "component_type", "layer"), edges(spark, d, "from_id", "to_id"), spark.createDataFrame(CUSTOM_RULES, RULE_SCHEMA))


def module_depth(spark, d):
    return rules.module_depth(_known(spark, d), _links(spark, d)).select("component_id", "fan_in", "fan_out", "shallowness")


def layer_violations(spark, d):
    return rules.layer_violations(nodes(spark, d, "component_type", "file"), _links(spark, d)).select("connection_id", "from_tier", "to_tier")


def edge_classes(spark, d):
    return rules.classify_edges(nodes(spark, d, "name", "file"), edges(spark, d, "from_id", "to_id", "file"))


def impact(spark, d):
    """What a change of the hub reaches: the component with most neighbours."""
    n, e = nodes(spark, d, "seq"), _links(spark, d)
    return t.impact(n, e, _hub(n, e))


def impact_severity(spark, d):
    return t.impact_severity(nodes(spark, d, "layer", "critical"), _links(spark, d))


def focus_subgraph(spark, d):
    n, e = nodes(spark, d, "seq"), _links(spark, d)
    return t.neighbourhood(e, spark.createDataFrame([(_hub(n, e),)], "id string"), 2)


def entry_points(spark, d):
    return t.entry_points(nodes(spark, d, "name", "component_type", "layer", "file", "tags"))


def reachable(spark, d):
    return t.reachable(_links(spark, d), entry_points(spark, d).select("id"))


def transitively_dead(spark, d):
    return t.transitively_dead(_known(spark, d), _links(spark, d))


def reachability_report(spark, d):
    return t.reachability_report(_known(spark, d), _links(spark, d))


def trace_paths(spark, d):
    n, e = nodes(spark, d, "component_type", "layer"), _links(spark, d)
    return t.trace(n, e, _start(n, e), HOPS)


def trace_hub(spark, d):
    """All that flows into the hub over up to HUB_HOPS edges."""
    n, e = nodes(spark, d, "component_type", "layer"), _links(spark, d)
    return t.trace(n, e, _hub(n, e), HUB_HOPS, "backward")


def import_cycles(spark, d):
    return t.short_cycles(edges(spark, d, "from_id", "to_id", "connection_type").where("connection_type = 'imports'"))


def cycle_core(spark, d):
    return t.in_cycle(edges(spark, d, "from_id", "to_id", "connection_type").where("connection_type = 'imports'"))


def import_cycle_sets(spark, d):
    """Strongly connected sets of imports, by their smallest id."""
    return t.cyclic_sets(edges(spark, d, "from_id", "to_id", "connection_type").where("connection_type = 'imports'"))


def pagerank(spark, d):
    """The first ROUNDS rounds, as its SQL unrolls them; ``pagerank_converged`` has the ranks."""
    return t.pagerank(nodes(spark, d, "seq"), _links(spark, d), ROUNDS, tolerance=0.0)


def pagerank_converged(spark, d):
    return t.pagerank(nodes(spark, d, "seq"), _links(spark, d))


def communities(spark, d):
    return t.communities(nodes(spark, d, "seq"), _links(spark, d))


def layer_modularity(spark, d):
    labels = nodes(spark, d, "layer").select("component_id", F.coalesce("layer", F.lit("")).alias("community"))
    return t.modularity(_links(spark, d), labels)


def bridges(spark, d):
    return t.bridge_ratio(nodes(spark, d, "layer"), _links(spark, d))


def group_prefixes(spark, d):
    return t.common_prefix(nodes(spark, d, "repo", "file").where("file is not null").select("repo", clean_path(F.col("file")).alias("path")), "repo", "path")


def duplicate_creation(spark, d):
    return rules.duplicate_creation(nodes(spark, d, "name", "component_type"), edges(spark, d, "to_id", "code"))


def escalation(spark, d):
    """Components by weighted signals: centrality percentile .35, bridge .25, violations .30, calls to models .10."""
    n, e = _known(spark, d), cut(edges(spark, d, "from_id", "to_id", "connection_type", "code"))
    mine = n.where("layer <> 'external' or layer is null").select("component_id")
    counts = catalog.degrees(n, e).join(mine, "component_id", "left_semi").select("component_id", (F.col("incoming") + F.col("outgoing")).alias("degree"))
    # percent_rank over all components by range partitions would need no single task; distinct degrees are few, so rank those
    by = counts.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    pct = by.select("degree", F.when(total > 1, below / (total - 1)).otherwise(1.0).alias("centrality"))
    broken = rules.builtin_rules(n, e).where("rule_id in ('frontend-direct-db', 'layer-violation', 'database-no-backend', 'duplicate-resource-creation')").groupBy("component_id").agg(F.count(F.lit(1)).alias("v"))
    models = n.where("component_type = 'llm'").select(F.col("component_id").alias("to_id"))
    calls = e.where("connection_type = 'service-call'").join(models, "to_id", "left_semi").groupBy(F.col("from_id").alias("component_id")).agg(F.count(F.lit(1)).alias("c"))
    rows = counts.join(pct, "degree").join(t.bridge_ratio(n, e).select("component_id", "bridge"), "component_id", "left").join(broken, "component_id", "left").join(calls, "component_id", "left")
    one = lambda c: F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / 3.0)
    score = F.col("centrality") * 0.35 + F.coalesce("bridge", F.lit(0.0)) * 0.25 + one("v") * 0.30 + one("c") * 0.10
    return rows.select("component_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "component_id").limit(50)


QUERIES = {
    f.__name__: f
    for f in (
        rules_builtin, rules_counts, rules_degenerate, rules_custom, module_depth, layer_violations, edge_classes, impact, impact_severity, focus_subgraph, entry_points, reachable, transitively_dead, reachability_report,
        trace_paths, trace_hub, import_cycles, import_cycle_sets, cycle_core, pagerank, pagerank_converged, communities, layer_modularity, bridges, group_prefixes, duplicate_creation, escalation,
    )
}


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_P = "pairs AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL)"
_START = "start AS (SELECT min(dst) AS id FROM (SELECT dst FROM pairs JOIN nodes ON component_id = dst GROUP BY dst HAVING count(*) BETWEEN 6 AND 20))"
_HUB = "start AS (SELECT src AS id FROM (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs) JOIN nodes ON component_id = src WHERE src <> dst GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_INTERNAL = "mine AS (SELECT * FROM nodes WHERE component_type = 'component' AND file <> '' AND NOT ends_with(file, 'package.json'))"
_SEGS = r"list_filter(string_split(regexp_replace(replace(file, '\', '/'), '\.[^.]+$', ''), '/'), lambda x: x <> '')"
_KEY = f"lower(CASE WHEN {_SEGS}[1] IN ('src', 'app', 'lib') THEN coalesce({_SEGS}[2], {_SEGS}[1]) ELSE {_SEGS}[1] END)"
_TIER = "CASE " + " ".join(f"WHEN {_KEY} IN ({_list(v)}) THEN {k}" for k, v in rules.TIERS.items()) + " END"
_NAMED = """named AS (SELECT e.*, a.name AS from_name, a.component_type AS from_component_type, a.layer AS from_layer, a.file AS from_file, b.name AS to_name, b.component_type AS to_component_type, b.layer AS to_layer
  FROM edges e LEFT JOIN nodes a ON a.component_id = e.from_id LEFT JOIN nodes b ON b.component_id = e.to_id)"""


def _custom_sql() -> str:
    parts = []
    for rid, fl, ft, fn, tl, tt, tn in CUSTOM_RULES:
        conds = ["from_name IS NOT NULL", "to_name IS NOT NULL"]
        conds += [f"from_layer = '{fl}'"] * bool(fl) + [f"from_component_type = '{ft}'"] * bool(ft) + [f"contains(lower(from_name), '{fn}')"] * bool(fn)
        conds += [f"to_layer = '{tl}'"] * bool(tl) + [f"to_component_type = '{tt}'"] * bool(tt) + [f"contains(lower(to_name), '{tn}')"] * bool(tn)
        parts.append(f"SELECT '{rid}' AS rule_id, connection_id FROM named WHERE {' AND '.join(conds)}")
    return f"{SQL_GRAPH}, {_NAMED} " + " UNION ALL ".join(parts)


def _class_sql() -> str:
    own, source = "lower(coalesce(file, ''))", "lower(coalesce(from_file, ''))"
    chain = "".join(f" WHEN regexp_matches({p}, '{pattern}') THEN '{name}:0.9'" for p in (own, source) for name, pattern in rules.CLASS_PATHS)
    chain += "".join(f" WHEN contains(lower({s}), '{w}') THEN '{name}:0.7'" for name, words in rules.CLASS_NAMES for s in ("from_name", "to_name") for w in words)
    loose = "".join(f" WHEN regexp_matches({own}, '{dict(rules.CLASS_PATHS)[n]}') THEN '{n}:0.8'" for n in ("test", "dev-only", "migration"))
    verdict = f"CASE WHEN from_name IS NOT NULL AND to_name IS NOT NULL THEN CASE{chain} ELSE 'production:0.4' END ELSE CASE{loose} ELSE 'production:0.4' END END"
    return f"{SQL_GRAPH}, {_NAMED}, v AS (SELECT connection_id, {verdict} AS v FROM named) SELECT connection_id, split_part(v, ':', 1) AS \"class\", CAST(split_part(v, ':', 2) AS DOUBLE) AS class_confidence FROM v"


def _pagerank_sql() -> str:
    sql = f"""{SQL_GRAPH}, {_P}, n AS (SELECT count(*) AS n FROM nodes),
    links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM pairs WHERE src IN (SELECT component_id FROM nodes) AND dst IN (SELECT component_id FROM nodes)),
    r0 AS (SELECT component_id AS id, 1.0::DOUBLE / n.n AS rank FROM nodes, n)"""
    for i in range(ROUNDS):
        sql += f""", g{i} AS (SELECT l.dst AS id, sum(r.rank / l.degree) AS got FROM links l JOIN r{i} r ON r.id = l.src GROUP BY 1),
        m{i} AS (SELECT coalesce(sum(rank), 0) AS m FROM r{i} WHERE id NOT IN (SELECT src FROM links)),
        r{i + 1} AS (SELECT r.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * m.m / n.n + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM r{i} r LEFT JOIN g{i} g USING (id), m{i} m, n)"""
    return sql + f" SELECT id AS component_id, round(rank, 9) AS rank FROM r{ROUNDS}, n WHERE n.n >= {t.MIN_METRIC_NODES}"


def _converged_sql() -> str:
    return f"""WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, {_P}, n AS (SELECT count(*) AS n FROM nodes),
    links AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM pairs WHERE src IN (SELECT component_id FROM nodes) AND dst IN (SELECT component_id FROM nodes)),
    steps AS (SELECT 0 AS i, component_id AS id, 1.0::DOUBLE / n.n AS rank, 1.0::DOUBLE AS change FROM nodes, n
      UNION ALL SELECT i + 1, id, new, sum(abs(new - rank)) OVER () FROM (
        SELECT s.i, s.id, s.rank, 0.15::DOUBLE / n.n + 0.85::DOUBLE * m.m / n.n + 0.85::DOUBLE * coalesce(g.got, 0) AS new FROM steps s
        LEFT JOIN (SELECT l.dst AS id, sum(r.rank / l.degree) AS got FROM links l JOIN steps r ON r.id = l.src GROUP BY 1) g USING (id),
        (SELECT coalesce(sum(rank), 0) AS m FROM steps WHERE id NOT IN (SELECT src FROM links)) m, n WHERE s.i < 100 AND s.change >= 1e-6))
    SELECT id AS component_id, round(rank, 9) AS rank FROM steps, n WHERE i = (SELECT max(i) FROM steps) AND n.n >= {t.MIN_METRIC_NODES}"""


_ENTRY_PATH = sql_clean_path("coalesce(file, '')")
_ENTRIES = (
    f"entries AS (SELECT component_id AS id, CASE WHEN component_type IN ({_list(t.ENTRY_TYPES)}) THEN 'component-type' WHEN regexp_matches(name, '{t.ENTRY_NAMES}') THEN 'name-pattern' WHEN list_has_any(tags, [{_list(t.ENTRY_TAGS)}]) THEN 'tag' "
    + " ".join(f"WHEN regexp_matches({_ENTRY_PATH}, '{pattern}') THEN '{source}'" for source, pattern in t.ENTRY_PATHS)
    + f" WHEN layer IN ({_list(t.ENTRY_LAYERS)}) THEN 'infra-layer' END AS reason FROM nodes)"
)
_PARTS = f"string_split({_ENTRY_PATH}, '/')"
_UNREACHED = f"""r AS (SELECT id FROM entries WHERE reason IS NOT NULL UNION SELECT p.dst FROM pairs p JOIN r ON p.src = r.id),
linked AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges),
copied AS (SELECT DISTINCT component_id FROM (SELECT component_id, {_PARTS} AS q, unnest(range(2, len({_PARTS}) + 1)) AS i FROM nodes WHERE file IS NOT NULL)
  WHERE q[i - 1] IN ({_list(PACKAGE_FOLDERS)}) AND q[i] IN (SELECT name FROM nodes WHERE component_type IN ({_list(t.PACKAGE_TYPES)}))),
unreached AS (SELECT component_id, component_type, CASE WHEN {_PARTS}[-1] IN ({_list(t.MANIFESTS)}) THEN 'dependency-manifest' WHEN list_has_any({_PARTS}, [{_list(VENDOR_SEGMENTS)}]) OR component_id IN (SELECT component_id FROM copied) THEN 'vendored' END AS suppressed
  FROM nodes WHERE EXISTS (SELECT 1 FROM entries WHERE reason IS NOT NULL) AND component_type NOT IN ({_list(t.NEVER_DEAD)}) AND component_id IN (SELECT id FROM linked) AND component_id NOT IN (SELECT id FROM r))"""
_CYCLES = """{0}_reach AS (SELECT src AS a, dst AS b FROM {0} UNION SELECT x.a, p.dst FROM {0}_reach x JOIN {0} p ON p.src = x.b),
{0}_sets AS (SELECT x.a AS id, min(x.b) AS cycle FROM {0}_reach x JOIN {0}_reach y ON y.a = x.b AND y.b = x.a GROUP BY 1)"""
_RULES = f"""{SQL_GRAPH.replace("WITH ", "WITH RECURSIVE ", 1)}, {_P}, {_ENTRIES}, {_UNREACHED}, {_INTERNAL}, {_NAMED},
imports AS (SELECT e.connection_id, e.from_id, e.to_id FROM edges e JOIN nodes a ON a.component_id = e.from_id JOIN nodes b ON b.component_id = e.to_id WHERE e.connection_type = 'imports'),
tiers AS (SELECT component_id, {_TIER} AS tier FROM mine),
violations AS (SELECT e.connection_id, e.from_id, a.tier AS from_tier, b.tier AS to_tier FROM imports e JOIN tiers a ON a.component_id = e.from_id JOIN tiers b ON b.component_id = e.to_id WHERE a.tier > b.tier),
inner_pairs AS (SELECT DISTINCT i.from_id, i.to_id FROM imports i JOIN mine a ON a.component_id = i.from_id JOIN mine b ON b.component_id = i.to_id WHERE i.from_id <> i.to_id),
depth AS (SELECT m.component_id, coalesce(i.c, 0) AS fan_in, coalesce(o.c, 0) AS fan_out, round(coalesce(o.c, 0)::DOUBLE / (coalesce(i.c, 0) + 1), 6) AS shallowness FROM mine m
  LEFT JOIN (SELECT to_id, count(*) c FROM inner_pairs GROUP BY 1) i ON i.to_id = m.component_id LEFT JOIN (SELECT from_id, count(*) c FROM inner_pairs GROUP BY 1) o ON o.from_id = m.component_id),
duplicates AS (SELECT n.component_id, count(*) AS sites FROM edges e JOIN nodes n ON n.component_id = e.to_id WHERE n.component_type IN ('service', 'llm')
  AND (contains(coalesce(e.code, ''), n.name || '(') OR contains(coalesce(e.code, ''), '= ' || n.name)) AND NOT regexp_matches(coalesce(e.code, ''), 'static\\s+(let|var)|lazy\\s+var|\\.shared') GROUP BY 1 HAVING count(*) > 1),
hot AS (SELECT to_id AS component_id, count(*) AS n FROM imports JOIN mine ON mine.component_id = to_id GROUP BY 1 ORDER BY n DESC, component_id LIMIT {rules.RULE_LIMIT}),
wide AS (SELECT from_id AS component_id, count(*) AS n FROM imports JOIN mine ON mine.component_id = from_id GROUP BY 1 ORDER BY n DESC, component_id LIMIT {rules.RULE_LIMIT}),
shallow AS (SELECT * FROM depth WHERE fan_out >= 4 AND shallowness >= 2 ORDER BY shallowness DESC, fan_out DESC, component_id LIMIT {rules.RULE_LIMIT}),
touched AS (SELECT src AS id FROM (SELECT from_id AS src FROM edges UNION SELECT to_id FROM edges) WHERE src IS NOT NULL),
inner_imports AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM imports WHERE from_id <> to_id), {_CYCLES.format('inner_imports')},
rule_rows AS (
  SELECT 'orphan-component' AS rule_id, 'warning' AS severity, component_id, component_type AS detail FROM nodes WHERE component_id NOT IN (SELECT id FROM touched)
  UNION ALL SELECT 'database-no-backend', 'warning', component_id, 'database' FROM nodes n WHERE layer = 'database' AND NOT EXISTS (SELECT 1 FROM named x WHERE x.to_id = n.component_id AND x.from_layer = 'backend')
  UNION ALL SELECT 'frontend-direct-db', 'error', from_id, connection_id FROM named WHERE from_layer = 'frontend' AND to_layer = 'database'
  UNION ALL SELECT 'unused-package', 'info', component_id, 'unused' FROM nodes WHERE status = 'unused'
  UNION ALL SELECT 'vulnerable-dependency', 'error', component_id, 'vulnerable' FROM nodes WHERE status = 'vulnerable'
  UNION ALL SELECT 'deprecated-dependency', 'warning', component_id, 'deprecated' FROM nodes WHERE status = 'deprecated'
  UNION ALL SELECT 'single-point-of-failure', 'warning', n.component_id, CAST(i.c AS VARCHAR) FROM nodes n JOIN (SELECT to_id, count(*) c FROM edges GROUP BY 1) i ON i.to_id = n.component_id WHERE n.layer = 'backend' AND i.c > 5
  UNION ALL SELECT 'hotspot-module', 'warning', component_id, CAST(n AS VARCHAR) FROM hot WHERE n >= 5
  UNION ALL SELECT 'high-fan-out', 'warning', component_id, CAST(n AS VARCHAR) FROM wide WHERE n >= 8
  UNION ALL SELECT 'shallow-module', 'warning', component_id, CAST(fan_out AS VARCHAR) FROM shallow
  UNION ALL SELECT 'layer-violation', 'error', from_id, from_tier || '>' || to_tier FROM violations
  UNION ALL SELECT 'duplicate-resource-creation', 'warning', component_id, CAST(sites AS VARCHAR) FROM duplicates
  UNION ALL SELECT 'circular-dependency', 'error', cycle, CAST(count(*) AS VARCHAR) FROM inner_imports_sets GROUP BY cycle
  UNION ALL SELECT 'transitively-dead', 'warning', component_id, component_type FROM unreached WHERE suppressed IS NULL)
"""
_WEIGHTS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.ROUTE_WEIGHTS.items()) + " ELSE 0 END"
_MODEL_SIGNALS = """deg AS (SELECT n.component_id, coalesce(i.c, 0) + coalesce(o.c, 0) AS degree FROM nodes n LEFT JOIN (SELECT to_id, count(*) c FROM edges GROUP BY 1) i ON i.to_id = n.component_id
  LEFT JOIN (SELECT from_id, count(*) c FROM edges GROUP BY 1) o ON o.from_id = n.component_id WHERE n.layer <> 'external' OR n.layer IS NULL),"""
_BRIDGE = """ge AS (SELECT e.from_id, e.to_id, CASE WHEN coalesce(a.layer, '') <> coalesce(b.layer, '') THEN 1 ELSE 0 END AS x FROM edges e JOIN nodes a ON a.component_id = e.from_id JOIN nodes b ON b.component_id = e.to_id),
bridge AS (SELECT component_id, count(*) AS edges, sum(x) AS crossing, CASE WHEN count(*) >= 2 THEN round(sum(x)::DOUBLE / count(*), 6) ELSE 0.0 END AS bridge FROM (SELECT from_id AS component_id, x FROM ge UNION ALL SELECT to_id, x FROM ge) GROUP BY 1)"""

SQL = {
    "rules_builtin": _RULES + "SELECT * FROM rule_rows",
    "rules_counts": _RULES + "SELECT rule_id, severity, count(DISTINCT component_id) AS components, count(*) AS violations FROM rule_rows GROUP BY 1, 2",
    "rules_degenerate": _RULES
    + """, c AS (SELECT rule_id, count(DISTINCT component_id) AS components FROM rule_rows GROUP BY 1), p AS (SELECT count(*) AS n FROM nodes)
      SELECT rule_id, components, round(components::DOUBLE / n, 6) AS share_of_components, round(components::DOUBLE / (SELECT sum(components) FROM c), 6) AS share_of_violations FROM c, p WHERE components::DOUBLE / n > 0.5 AND n >= 20""",
    "rules_custom": _custom_sql(),
    "module_depth": _RULES + "SELECT * FROM depth",
    "layer_violations": _RULES + "SELECT connection_id, from_tier, to_tier FROM violations",
    "duplicate_creation": _RULES + "SELECT * FROM duplicates",
    "edge_classes": _class_sql(),
    "impact": f"""{SQL_GRAPH}, {_P}, {_HUB},
      direct AS (SELECT e.from_id AS affected_id, NULL AS via_id, e.connection_id, 'direct' AS impact_type FROM edges e JOIN start s ON e.to_id = s.id JOIN nodes n ON n.component_id = e.from_id),
      first AS (SELECT DISTINCT affected_id FROM direct)
      SELECT * FROM direct UNION ALL
      SELECT e.from_id, e.to_id, e.connection_id, 'transitive' FROM edges e JOIN first f ON e.to_id = f.affected_id JOIN nodes n ON n.component_id = e.from_id, start s WHERE e.from_id NOT IN (SELECT affected_id FROM first) AND e.from_id <> s.id""",
    "impact_severity": f"""{SQL_GRAPH}, {_P}, d AS (SELECT dst, count(*) AS c FROM pairs JOIN nodes ON component_id = src GROUP BY 1), x AS (SELECT n.component_id, n.layer, n.critical, coalesce(d.c, 0) AS dependents FROM nodes n LEFT JOIN d ON d.dst = n.component_id)
      SELECT component_id, dependents, CASE WHEN layer IN ('database', 'infra') OR dependents > 5 OR coalesce(critical, false) THEN 'critical' WHEN layer = 'backend' OR dependents BETWEEN 3 AND 5 THEN 'high' WHEN dependents = 2 THEN 'medium' ELSE 'low' END AS severity FROM x""",
    "focus_subgraph": f"""{SQL_GRAPH}, {_P}, {_HUB}, both_ways AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
      one AS (SELECT DISTINCT dst AS id FROM both_ways JOIN start ON src = id WHERE dst <> id),
      two AS (SELECT DISTINCT b.dst AS id FROM both_ways b JOIN one ON b.src = one.id WHERE b.dst NOT IN (SELECT id FROM one) AND b.dst NOT IN (SELECT id FROM start))
      SELECT id, 0 AS distance FROM start UNION ALL SELECT id, 1 FROM one UNION ALL SELECT id, 2 FROM two""",
    "entry_points": f"WITH {SQL_NODES}, {_ENTRIES} SELECT * FROM entries WHERE reason IS NOT NULL",
    "reachable": f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, {_P}, {_ENTRIES}, {_UNREACHED} SELECT id FROM r",
    "transitively_dead": f"WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, {_P}, {_ENTRIES}, {_UNREACHED} SELECT component_id, component_type FROM unreached WHERE suppressed IS NULL",
    "reachability_report": f"""WITH RECURSIVE {SQL_NODES}, {SQL_EDGES}, {_P}, {_ENTRIES}, {_UNREACHED} SELECT 'entry:' || reason AS item, count(*) AS value FROM entries WHERE reason IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'suppressed:' || suppressed, count(*) FROM unreached WHERE suppressed IS NOT NULL GROUP BY 1 UNION ALL SELECT 'considered', count(*) FROM unreached""",
    "import_cycles": f"""WITH {SQL_EDGES}, p AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE connection_type = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id)
      SELECT a.src || '>' || a.dst AS cycle, 2 AS length FROM p a JOIN p b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
      UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM p a JOIN p b ON b.src = a.dst JOIN p c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
    "pagerank": _pagerank_sql(),
    "pagerank_converged": _converged_sql(),
    "layer_modularity": f"""{SQL_GRAPH}, {_P}, e AS (SELECT coalesce(a.layer, '') AS s, coalesce(b.layer, '') AS t FROM pairs JOIN nodes a ON a.component_id = src JOIN nodes b ON b.component_id = dst),
      g AS (SELECT c, sum(o)::DOUBLE AS o, sum(i)::DOUBLE AS i FROM (SELECT s AS c, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, 0, 1 FROM e) GROUP BY 1)
      SELECT round((SELECT count(*) FILTER (s = t)::DOUBLE / nullif(count(*), 0) FROM e) - (SELECT sum(o * i) FROM g) / (SELECT nullif(count(*), 0)::DOUBLE * count(*) FROM e), 6) AS q""",
    "bridges": f"{SQL_GRAPH}, {_BRIDGE} SELECT * FROM bridge",
    "group_prefixes": f"""WITH {SQL_NODES}, p AS (SELECT repo, string_split({sql_clean_path('file')}, '/') AS p FROM nodes WHERE file IS NOT NULL), m AS (SELECT repo, min(p) AS a, max(p) AS b FROM p GROUP BY 1),
      n AS (SELECT repo, a, b, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) AS n FROM m)
      SELECT repo, array_to_string(a[:least(n, len(a) - 1, len(b) - 1)], '/') AS prefix FROM n""",
    "escalation": _RULES
    + f""", {_MODEL_SIGNALS} {_BRIDGE},
      pct AS (SELECT component_id, CASE WHEN count(*) OVER () > 1 THEN (rank() OVER (ORDER BY degree) - 1)::DOUBLE / (count(*) OVER () - 1) ELSE 1.0 END AS centrality FROM deg),
      v AS (SELECT component_id, count(*) AS v FROM rule_rows WHERE rule_id IN ('frontend-direct-db', 'layer-violation', 'database-no-backend', 'duplicate-resource-creation') GROUP BY 1),
      c AS (SELECT e.from_id AS component_id, count(*) AS c FROM edges e JOIN nodes n ON n.component_id = e.to_id WHERE e.connection_type = 'service-call' AND n.component_type = 'llm' GROUP BY 1)
      SELECT pct.component_id, round(centrality * 0.35::DOUBLE + coalesce(bridge, 0) * 0.25::DOUBLE + least(1.0::DOUBLE, coalesce(v, 0) / 3.0::DOUBLE) * 0.30::DOUBLE + least(1.0::DOUBLE, coalesce(c, 0) / 3.0::DOUBLE) * 0.10::DOUBLE, 6) AS score
      FROM pct LEFT JOIN bridge USING (component_id) LEFT JOIN v USING (component_id) LEFT JOIN c USING (component_id) ORDER BY score DESC, component_id LIMIT 50""",
}


def _trace_sql(start: str, hops: int, backward: bool) -> str:
    """All paths from a start; a bridge goes against the edges of one type at a queue that was entered by the other."""
    src, dst, kind, via = ("b", "a", "queue-consumes", "queue-produces") if backward else ("a", "b", "queue-produces", "queue-consumes")
    sql = f"""{SQL_GRAPH}, {_P}, {start},
      linked AS (SELECT DISTINCT from_id AS a, to_id AS b, connection_type AS ct FROM edges WHERE connection_type <> 'env-dependency' AND from_id IS NOT NULL AND to_id IS NOT NULL),
      step AS (SELECT x.*, coalesce(n.layer, '') AS l FROM (SELECT {src} AS src, {dst} AS dst, ct, NULL AS via FROM linked
        UNION ALL SELECT {dst}, {src}, ct, '{via}' FROM linked WHERE ct = '{kind}' AND {dst} IN (SELECT component_id FROM nodes WHERE component_type = 'queue') AND NOT EXISTS (SELECT 1 FROM linked o WHERE o.b = linked.a AND o.a = linked.b)) x JOIN nodes n ON n.component_id = x.dst),
      p0 AS (SELECT [n.component_id] AS ids, []::VARCHAR[] AS ts, [coalesce(n.layer, '')] AS ls FROM nodes n JOIN start s ON s.id = n.component_id)"""
    on = "step.src = p{0}.ids[-1] AND NOT list_contains(p{0}.ids, step.dst) AND (step.via IS NULL OR step.via = p{0}.ts[-1])"
    for i in range(hops):
        sql += f", p{i + 1} AS (SELECT list_append(ids, dst) AS ids, list_append(ts, ct) AS ts, list_append(ls, l) AS ls FROM p{i} JOIN step ON {on.format(i)})"
    done = f"SELECT * FROM p{hops}" + "".join(f" UNION ALL SELECT * FROM p{i} WHERE NOT EXISTS (SELECT 1 FROM step WHERE {on.format(i)})" for i in range(1, hops))
    return sql + f""", done AS ({done}) SELECT array_to_string(ids, '>') AS route, array_to_string(ts, '>') AS types, len(ts) AS hops,
        list_sum(list_transform(ts, lambda x: {_WEIGHTS.format('x')})) + 2 * greatest(len(list_distinct(list_filter(ls, lambda x: x <> ''))) - 1, 0) + least(len(ids), 6) AS score FROM done"""


_IMPORTED = f"WITH RECURSIVE {SQL_EDGES}, imported AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM edges WHERE connection_type = 'imports' AND from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id), {_CYCLES.format('imported')}"
SQL |= {
    "trace_hub": _trace_sql(_HUB, HUB_HOPS, True),
    "trace_paths": _trace_sql(_START, HOPS, False),
    "import_cycle_sets": f"{_IMPORTED} SELECT id, cycle FROM imported_sets",
    # between cycles: what a cycle reaches and what reaches a cycle
    "cycle_core": f"""{_IMPORTED}, downstream AS (SELECT b AS id FROM imported_reach WHERE a IN (SELECT id FROM imported_sets)), upstream AS (SELECT a AS id FROM imported_reach WHERE b IN (SELECT id FROM imported_sets))
      SELECT DISTINCT id FROM downstream WHERE id IN (SELECT id FROM upstream)""",
}
